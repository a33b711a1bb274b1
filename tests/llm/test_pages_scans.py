"""Problems 3, 4, 7 and 10: held-out accuracy and edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import main_body as P3
from quillmill.llm import quality as P7
from quillmill.llm import scanned as P4
from quillmill.llm import spam as P10

PROSE = "The quiet morning follows another patient habit because nobody asks for more. A friend rarely forgives the early silence, and the plan often hides it. "


def test_tree_on_held_out_pages():
    x, y = P3.training_pages(sites=120, seed=99)
    assert (P3.tree().predict(x) == y).mean() > 0.97
    assert (P3.tree().predict(x[:0]) == np.zeros(0, bool)).all()
    # sites whose furniture has wordings that training lacked
    unseen, z = P3.training_pages(sites=200, seed=5, half=1)
    assert (P3.Tree().fit(*P3.training_pages(half=0)).predict(unseen) == z).mean() > 0.9


def test_link_density_and_word_count_of_the_neighbours_matter():
    used = {P3.NAMES[f] for f in P3.tree().feature if f >= 0}
    assert {"words", "p_words", "n_words", "links"} <= used and {"p_links", "n_links", "pp_links", "nn_links"} & used


def _prose(r):
    w = lambda: "".join(r.choice(P3._SYL) for _ in range(3))
    return " ".join(f"The {w()} of {w()} and the {w()} never {w()} another {w()} while {w()} is with my {w()}." for _ in range(3))


def test_furniture_lines(spark):
    r = random.Random(4)
    body = [_prose(r), "What it costs in the end", _prose(r), _prose(r)]
    page = "\n".join(["Home | About | Podcast | Search", "We use cookies to improve your visit. Accept all | Manage settings", "", *body, "Subscribe | Donate | Advertise", "12 comments \u00b7 3 shares"])
    rows = [("a", page, None, None), ("a", page, None, None), ("junk", "| 1 | 2 |\n" * 40, None, None), ("n", None, None, None), ("e", "", None, None), ("b", "   \n\n", None, None), ("one", PROSE, None, None)]
    rows += [("html", f"<p>{_prose(r)}</p>\n<p>{_prose(r)}</p>\n<a href='/x'>Contact</a>\n<div>Subscribe | Donate | Advertise</div>", None, None)]
    # a notice that a source repeats, and the same sentence where it stands once only
    notice = "Typed by the friends of this old page; please forgive mistakes."
    rows += [(f"m{i}", "\n".join([_prose(r), _prose(r), notice]), None, "s") for i in range(8)]
    # a count of comments, on pages of many sources
    rows += [(f"k{i}", "\n".join([_prose(r), _prose(r), _prose(r), f"{i + 3} comments \u00b7 3 shares", "<a href='/x'>Contact</a>"]), None, f"k{i}") for i in range(6)]
    rows += [("once", "\n".join([_prose(r), _prose(r), _prose(r)]), None, "t")]
    df = spark.createDataFrame(rows, "item_id string, text string, title string, source string")
    got = sorted(tuple(x) for x in P3.furniture(df).collect())
    assert [n for i, n in got if i == "a"] == [0, 1, 7, 8]
    assert [n for i, n in got if i == "html"] == [2, 3]
    assert {i for i, _ in got} == {"a", "html", *[f"m{i}" for i in range(8)], *[f"k{i}" for i in range(6)]}
    assert all(n in (3, 4) for i, n in got if i[0] == "k")
    assert all(n == 2 for i, n in got if i[0] == "m")
    assert P3.furniture(df.limit(0)).count() == 0
    clean = {x.item_id: x.body for x in P3.main_bodies(df).collect()}
    assert "cookies" not in clean["a"] and "What it costs" in clean["a"] and clean["n"] is None and clean["one"] == PROSE


def test_copies_do_not_hide_a_standing_line(spark):
    r = random.Random(6)
    notice = "Typed by the friends of this old page; please forgive mistakes."
    rows = [(f"m{i}", "\n".join([_prose(r), _prose(r), notice]), None, "s") for i in range(30)]
    rows += [(f"p{i}", "\n".join([_prose(r), _prose(r), _prose(r)]), None, "s") for i in range(70)]
    copy = "\n".join([_prose(r), _prose(r), _prose(r)])
    rows += [(f"c{i}", copy, None, "s") for i in range(900)]
    df = spark.createDataFrame(rows, "item_id string, text string, title string, source string")
    assert {tuple(x) for x in P3.furniture(df).collect()} == {(f"m{i}", 2) for i in range(30)}
    # a line on fewer than 8 % of the distinct pages isn't one, however often a page with it is copied
    rows = rows[:7] + [(f"d{i}", rows[0][1], None, "s") for i in range(50)] + rows[30:]
    rows += [(f"q{i}", "\n".join([_prose(r), _prose(r), _prose(r)]), None, "s") for i in range(30)]
    assert P3.furniture(spark.createDataFrame(rows, df.schema)).count() == 0


WORDS = sorted(set("habit morning careful friend another burden silence comfort wound deadline mirror reward calm story plan follows rarely gently ordinary feeling kitchen question enough while patient".split()))
CONFUSED = {"e": [("c", 5)], "i": [("|", 3), ("!", 2)], "rn": [("m", 2)], "m": [("rn", 2)], "l": [("1", 3)], "t": [("f", 1)], "o": [("0", 2)], "n": [("ri", 1)]}


def _editor():
    r = random.Random(2)
    examples = [(*P4.noised(w, CONFUSED, r, 0.3, 0.0), []) for w in WORDS * 40]
    free = [(*P4.noised(w, CONFUSED, r), []) for w in WORDS * 40]
    return P4.Editor(WORDS).train(examples + free, examples).judged(WORDS, CONFUSED)


def test_editor_on_held_out_noise():
    ed, r = _editor(), random.Random(8)
    noisy = [(P4.noised(w, CONFUSED, r, 0.3, 0.0)[0], w) for w in WORDS * 20]
    assert sum(ed.repair(n)[0] == w for n, w in noisy) / len(noisy) > 0.97
    assert ed.repair("xyzzy")[:2] == ("xyzzy", ()) and ed.repair("habit")[:2] == ("habit", ()) and ed.repair("")[:2] == ("", ())
    # misreadings that training never showed: replaced, lost and doubled letters
    unseen = {"hablt": "habit", "habjt": "habit", "carefal": "careful", "mornng": "morning", "habbit": "habit", "frjend": "friend"}
    assert {n: ed.repair(n)[0] for n in unseen} == unseen


def test_line_ends_are_joined_by_the_editor():
    clean = "the careful habit follows another patient morning while a well-meant friend keeps the long-term silence and the plan carries enough calm"
    words = clean.split()
    scans = []
    for k in range(12):
        out = []
        for i, w in enumerate(words):
            if "-" in w and (i + k) % 2:
                out.append(w.replace("-", "-\n"))
            elif (i + k) % 5 == 0 and len(w) > 5:
                out.append(w[:3] + "-\n" + w[3:])
            else:
                out.append(w)
        scans.append((" ".join(out), clean))
    examples, _, vocabulary = P4.examples_of(scans)
    assert any("\n" in e[0] for e in examples) and {"well-meant", "habit"} <= set(vocabulary)
    ed = P4.Editor(vocabulary).train(examples)
    cut = lambda a, b: ed.joined(a, b, P4.marks_of("-", a in ed.lexicon, b in ed.lexicon, False))[1:3]
    assert cut("care", "ful") == ("", "careful") and cut("well", "meant") == ("-", "well-meant") and cut("long", "term") == ("-", "long-term")


def test_alignment_finds_what_was_misread():
    clean = "the careful habit follows another patient morning while nobody asks for more of it"
    got = set(P4.aligned("the careful habit follows anothcr pati-\nent morning while nobody asks", clean))
    assert ("w", "anothcr", "another", "") in got and ("j", "pati\nent", "patient", "-") in got
    assert P4.outputs("rn", "m") == ["m", ""] and P4.outputs("habbit", "habit").count("") == 1 and "".join(P4.outputs("mornng", "morning")) == "morning"
    assert "".join(P4.outputs("abit", "habit")) == "habit" and P4.outputs("x", "") == [""]


def test_scanned_pages(spark):
    words = "the careful habit follows another patient morning because nobody asks well-meant friend silence".split()
    clean = spark.createDataFrame([(str(i), 0, " ".join(words)) for i in range(5)], "doc_id string, chunk_index int, text string")
    line = "the careful habit follows another patient morning"
    body = [" ".join(words[k % 12 :] + words[: k % 12])[:52].rsplit(" ", 1)[0].removesuffix("well-meant").strip() for k in range(14)]
    page1 = ["On Habit | 12", *body, "because nobody asks the careful hab-"]
    page2 = ["On Habit | 13", "it follows anothcr patient well-", "meant friend because nobody asks.", *body[:7], "1938", *body[7:], "the c1oser silence", "ñ"]
    rows = [("a", "\n".join(page1 + page2), "On Habit", "Ann"), ("n", None, None, None), ("e", "", "", None), ("f", "\f\n\f", None, None), ("s", "word", None, None)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id string, raw_text string, title string, author string")
    got = sorted(tuple(x) for x in P4.found_defects(df, clean, ["doc_id", "chunk_index"]).collect())
    assert got == [("a", 0, "furniture"), ("a", 15, "hyphen"), ("a", 16, "furniture"), ("a", 17, "misread")]
    text = {x.doc_id: x.text for x in P4.repaired(df, clean, ["doc_id", "chunk_index"]).collect()}
    assert "the careful habit follows another patient well-meant friend because nobody asks." in text["a"] and "On Habit" not in text["a"]
    assert P4.found_defects(df.limit(0), clean.limit(0), ["doc_id", "chunk_index"]).count() == 0


def test_quality(spark):
    cases = {
        "prose": (PROSE * 3, False), "german": ("Die ehrliche Antwort im Alltag stärkt den langen Tag, weil der Kopf nie Pause macht. " * 2, False), "nbsp": ((PROSE * 2).replace(" ", "\xa0"), False),
        "figures": ("In the end the mood rose (p = 0.04, n = 120) because the habit held. " * 4, False), "speech": ("and so the plan follows a friend while nobody asks for more " * 5, False),
        "verse": ("The day is long,\nand no one calls,\nthe night is near,\na shadow falls.\n" * 3, False), "short list": (PROSE * 3 + "\n- one\n- two\n- three", False),
        "list": ("\n".join(f"#{i} the calm plan" for i in range(20)), True), "csv": ("date,a,b\n" + "2020-01-01,1.2,3.4\n" * 20, True), "code": (".a-1 { margin:2px; color:#fff; width:3% }\n" * 9, True),
        "base64": ("cApaRBXehXql24iZXfhEo5d70nmQfhwyR1GYZb" * 9, True), "rule": ("=" * 300, True), "short": ("1,2,3", False), "empty": ("", False), "blank": (" \n" * 80, True),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()] + [("null", None)], "id string, text string")
    out = {x.id: x for x in P7.with_statistics(df, "text").collect()}
    assert {k: out[k].junk for k in cases} == {k: j for k, (_, j) in cases.items()}
    assert out["null"].junk is None or not out["null"].junk
    assert out["list"].reasons and not out["prose"].reasons and out["prose"].words == len(PROSE.split()) * 3
    clash = P7.with_statistics(df.withColumn("words", F.lit("mine")).withColumn("Junk", F.lit(1)).withColumn("extra", F.lit(2)), "text")
    assert {"extra", "words", "junk"} <= set(clash.columns) and clash.filter("id = 'prose'").first().words == len(PROSE.split()) * 3
    assert {x.item_id for x in P7.junk(df, "id", "text").collect()} == {k for k, (_, j) in cases.items() if j}


def test_spam(spark):
    r = random.Random(2)
    nouns, verbs = "morning friend habit silence plan memory letter garden teacher boundary sibling reader".split(), "follows hides repeats carries invites avoids mirrors forgives names delays".split()
    sent = lambda: f"The {r.choice(nouns)} of {r.choice(nouns)} {r.choice(verbs)} another {r.choice(nouns)} while {r.choice(nouns)} {r.choice(verbs)} my {r.choice(nouns)}. "
    prose = "".join(sent() for _ in range(40))
    spam = {1: "deep focus tips deep focus deep focus app " * 40, 2: "\n".join(f"- [best habit](https://a{i}.example/x{i})" for i in range(40)), 3: " ".join(f"#habit{i}best" for i in range(60)), 4: "Our cold plunge is the best cold plunge for anyone who wants a cold plunge. " * 12}
    fine = {10: prose, 11: prose.replace(".", "").lower(), 12: prose + " https://a.example/x https://b.example/y", 13: prose + "#one #two", 14: "", 15: "short", 16: "https://a.example"}
    df = spark.createDataFrame([*spam.items(), *fine.items(), (20, None), (1, spam[1])], "doc_id bigint, text string")
    assert {x.doc_id for x in P10.spam(df).collect()} == set(spam)
    assert P10.spam(df.limit(0)).count() == 0


def test_function_words_do_not_crowd_out_a_keyword_pair():
    # ten pairs of function words as frequent as the keyword, which has short words only
    names = ["garden", "window", "market", "bridge", "doctor", "kettle", "ladder", "mirror"]
    text = " ".join(f"and it is of the to be in for this with gut fix {w}." for w in names)
    assert P10.judge(text)[-1] == "stuffed"
    assert P10.judge(text.replace("gut fix", "so"))[-1] is None
