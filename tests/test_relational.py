"""Admission, addresses, quotas and sources on small crafted tables."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quillmill.operators import admission as A
from quillmill.operators import relational as R
from quillmill.operators import rendering as M
from quillmill.operators import topk as W
from quillmill.operators import urls as H
from quillmill.plans.catalogue import queries
from quillmill.sources.page_blocks import page_text
from quillmill.sources.text_files import archives, text_blocks, whole_files, write_bodies


def test_two_key_admission_is_the_ordered_walk(spark):
    r = random.Random(6)
    for n in (0, 1, 200):
        rows = [(i, r.choice(["a", "b", "c", "d", None]) and f"{r.randrange(30)}", r.choice([None, "", f"s{r.randrange(30)}", f"s{r.randrange(30)}"])) for i in range(n)]
        seen_c, seen_s, exp = set(), set(), []
        for i, c, s in rows:
            if (c is not None and c in seen_c) or (s and s in seen_s):
                continue
            exp.append(i)
            seen_c |= {c} - {None}
            seen_s |= {s} - {None, ""}
        df = spark.createDataFrame(rows, "i int, c string, s string")
        assert sorted(x.i for x in A.two_key_admission(df, "c", "s", "i").collect()) == exp


def test_first_by_content_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "i int, c string")
    assert sorted(x.i for x in A.first_by_content(df, "c", [F.col("i")]).collect()) == [1, 3, 4, 5]


def test_url_keys(spark):
    def key(u):
        u = u.lower().strip().rstrip("/")
        return hashlib.md5(u.split("?")[0].split("#")[0].encode()).hexdigest()[:16]

    urls = ["https://A.example/x/", "https://a.example/x?q=1", "https://a.example/x/?q", "a#b?c", " x "]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(H.url_key(F.col("u"))).collect()
    assert [x[0] for x in got] == [key(u) for u in urls]
    v = spark.createDataFrame([("https://youtu.be/abcdefghijk",), ("https://www.youtube.com/shorts/abcdefghijk?x",), ("https://x.example",)], "u string").select(H.video_id(F.col("u")), H.title_of_url(F.lit("https://x.example/2020/my-first_post.html"))).collect()
    assert [x[0] for x in v] == ["abcdefghijk", "abcdefghijk", None] and v[0][1] == "My First Post"


def test_titles_known_is_a_prefix_test(spark):
    old = [("g", "Deep Work Rules"), ("g", "Zed"), ("h", "Deep")]
    new = [(1, "g", "Deep Work (Part 1/3)"), (2, "g", "Deep Works"), (3, "h", "Deep Work"), (4, "h", "Deep"), (5, "k", "Deep"), (6, "g", "Zed")]
    out = R.title_known(spark.createDataFrame(new, "i int, g string, t string"), "t", "g", spark.createDataFrame(old, "g string, t string"))
    assert {x.i: x.known for x in out.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}


def test_titles_known_query_tests_whole_titles(spark, tmp_path):
    rows = [
        ("1", "A", "USED", "The Quiet Mind and Work (Part 1/2)"), ("2", "A", "USED", "Attention(Part 2/2)"),
        ("3", "A", "AVAILABLE", "The Quiet Mind at Home"), ("4", "A", "AVAILABLE", "The Quiet Mind and Work (Part 2/2)"), ("5", "B", "AVAILABLE", "The Quiet Mind and Work"),
        ("6", "A", "AVAILABLE", "The Quiet Mind and Work"), ("7", "A", "AVAILABLE", "Attention(Part 1/2)"), ("8", "A", "AVAILABLE", "The Quiet Mind and Work, Again"),
    ]
    spark.createDataFrame(rows, "id string, source_author string, status string, raw_title string").write.parquet(str(tmp_path / "content_reservoir.parquet"))
    got = queries()["titles_known"](spark, str(tmp_path)).collect()
    assert {x.id: x.known for x in got} == {"3": False, "4": True, "5": False, "6": True, "7": True, "8": False}


def _ordered_import(files, tracked, authors, titles):
    """D8 row by row."""
    base = lambda t: re.sub(r"\s*\(Part \d+/\d+\)$", "", t)
    keys, known, out = set(), set(titles), {}
    for i, k, a, t in sorted(files):
        if k is None or t is None:
            out[i] = "parse_error"
            continue
        if k in keys or k in tracked:
            out[i] = "duplicate"
        elif a not in authors:
            out[i] = "unknown_author"
        elif any(g == a and o.startswith(base(t)) for g, o in known):
            out[i] = "title_known"
        else:
            out[i] = "inserted"
            known.add((a, t))
        keys.add(k)
    return out


def _routed(spark, files, tracked, authors, titles):
    df = spark.createDataFrame(files, "i int, k string, a string, t string")
    out = A.routed(df, "k", "i", spark.createDataFrame([(k,) for k in tracked], "k string"), spark.createDataFrame([(a,) for a in authors], "a string"), "a", spark.createDataFrame(titles, "a string, t string"), "t").collect()
    assert len(out) == len(files)
    return {x.i: x.outcome for x in out}


def test_import_routing_tests_title_beginnings(spark):
    files = [
        (1, "k1", "A", "X"), (2, "k2", "B", "X"), (3, "k3", "A", "Y (Part 1/2)"), (4, "k4", "A", "Y (Part 2/2)"), (5, "k5", "A", "Y"), (6, "k6", "B", "Y"),
        (7, "k3", "A", "Z"), (8, "k8", "Q", "W"), (9, "k9", "A", "W"), (10, None, "A", "W"), (11, "t", "A", "V"), (12, "k12", "A", "X (Part 1/3) more"),
    ]
    got = _routed(spark, files, ["t"], ["A", "B"], [("A", "X (Part 1/3)")])
    assert got == {1: "title_known", 2: "inserted", 3: "inserted", 4: "title_known", 5: "title_known", 6: "inserted", 7: "duplicate", 8: "unknown_author", 9: "inserted", 10: "parse_error", 11: "duplicate", 12: "inserted"}


def test_import_routing_is_the_ordered_walk(spark):
    r = random.Random(9)
    ends = ["", "", "a", "ab", " (", " (Part 1/2)", " (Part 2/2)", " (Part 1/2) (Part 1/2)", "(Part 2/2)"]
    files = [(i, r.choice([None, *map(str, range(300))]), r.choice("ABCQ"), r.choice([None, *"xyz" * 9]) and r.choice("xyz") + r.choice("xyz") + r.choice(ends)) for i in range(160)]
    titles = [("A", "xya"), ("B", "zz (Part 1/2)"), ("Q", "xx")]
    got = _routed(spark, files, ["7", "8", "9"], ["A", "B", "C"], titles)
    assert got == _ordered_import(files, {"7", "8", "9"}, {"A", "B", "C"}, titles)
    assert len({*got.values()}) == 5


def test_quotas():
    assert W.scaled_quotas({"a": 20, "b": 5, "c": 1}, 6) == {"a": 4, "b": 1, "c": 1}
    assert W.ratio_quotas({"a": 0.5, "b": 0.3, "c": 0.1}, 10) == {"a": 6, "b": 3, "c": 1}
    assert W.ratio_quotas({"a": 0.0}, 10) == {}


def test_ratio_allocation_fills_up(spark):
    rows = [(i, t) for i, t in enumerate("aaaaabbc" + "d" * 10)]
    got = W.ratio_allocation(spark.createDataFrame(rows, "i int, t string"), "t", [F.col("i")], {"a": 0.2, "b": 0.8}, 10).collect()
    assert sorted(x.i for x in got) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert {x.i for x in got if x.backfill} == {2, 3, 4, 7, 8, 9}


def test_evenness_and_underused(spark):
    n = lambda rows: spark.createDataFrame(rows, "g string, rows long")
    assert R.evenness(n([]), "rows", 8).first()[0] == 1.0
    assert R.evenness(n([("a", 5)]), "rows", 8).first()[0] == 0.0
    assert abs(R.evenness(n([(c, 3) for c in "abcdefgh"]), "rows", 8).first()[0] - 1) < 1e-12
    groups = n([("a", 0), ("b", 0)])
    assert {x.g for x in R.underused(groups, "g", n([("a", 10)]), "rows").collect()} == {"b"}
    assert {x.g for x in R.underused(groups, "g", n([]), "rows").collect()} == {"a", "b"}


def test_validation(spark):
    texts = [None, "", "[removed]", "x" * 299, "x" * 300, "x" * 50000, "x" * 50001]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(A.validation_reasons(F.col("t"))).collect()
    assert [x[0] for x in got] == [["content_empty"], ["content_empty"], ["content_deleted"], ["content_too_short"], [], [], ["content_too_long"]]


def test_sources_and_sink(spark, tmp_path):
    block = "URL: a.example/x\n" + "word " * 60
    (tmp_path / "b.txt").write_text(block + "\n-----\nno address\n---\nurl : https://b.example\nshort")
    got = text_blocks(whole_files(spark, str(tmp_path))).collect()
    assert [x.url for x in got] == ["https://a.example/x"] and got[0].content == ("word " * 60).strip()
    a = tmp_path / "arch"
    a.mkdir()
    (a / "1.txt").write_text("URL: u\nTITLE: t\nAUTHOR_ID: x\n---\nbody\n---\nmore")
    (a / "2.txt").write_text("URL: u\n---\nbody")
    rows = sorted(archives(whole_files(spark, str(a))).collect(), key=lambda x: x.path)
    assert [x.valid for x in rows] == [True, False] and rows[0].content == "body\n---\nmore"
    write_bodies(spark.createDataFrame([("a", "# A"), ("b", "# B")], "n string, b string"), str(tmp_path / "out"), "n", "b")
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_page_blocks(spark):
    rows = [("d", 1, 0.0, 50.0, 300.0, 60.0, 600.0, 800.0, 0, "left"), ("d", 1, 0.0, 90.0, 590.0, 99.0, 600.0, 800.0, 0, "wide"), ("d", 1, 310.0, 50.0, 500.0, 60.0, 600.0, 800.0, 0, "right"),
            ("d", 1, 0.0, 780.0, 90.0, 790.0, 600.0, 800.0, 0, "foot"), ("d", 1, 0.0, 1.0, 9.0, 2.0, 600.0, 800.0, 1, "image"), ("d", 2, 0.0, 1.0, 9.0, 2.0, 600.0, 800.0, 0, "next")]
    df = spark.createDataFrame(rows, "doc_id string, page_num int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, block_type int, text string")
    assert page_text(df).first().text == "wide\n\nleft\n\nright\n\nnext"


def test_rendering(spark):
    r = spark.range(1).select(M.file_name(F.lit(3), F.lit("Monday"), F.lit("reel"), F.lit(8)), M.file_name(F.lit(12), F.lit("Friday"), F.lit("quote"), F.lit(None).cast("int")), M.preview(F.lit('# A\n> "quoted"\nx')), M.preview(F.lit("**plain** text")), M.bullets(F.array().cast("array<string>"))).first()
    assert list(r) == ["03_MON_REEL_8AM.md", "12_FRI_QUOTE_TBD.md", "quoted", "plain text", "N/A"]


def test_free_angles_and_briefs(spark):
    angles = spark.createDataFrame([("a", "REEL"), ("b", "REEL"), ("c", "QUOTE")], "angle string, fit string")
    usage = spark.createDataFrame([("1", "a", "2025-01-10"), ("1", "b", "2024-01-10"), ("2", "b", "2025-01-10"), ("1", "c", "2025-01-10")], "atom string, angle string, day string").withColumn("ts", F.col("day").cast("timestamp"))
    free = lambda kind: sorted(x.angle for x in R.free_angles(angles, F.col("fit") == kind, "angle", usage, "atom", "1", "ts", "2025-01-15", 84).collect())
    assert free("REEL") == ["b"] and free("QUOTE") == [] and free("CAROUSEL") == ["b"]
    content = spark.createDataFrame([("g1", "s1"), ("g2", "s2"), ("g3", "s9")], "id string, schedule_id string")
    plan = spark.createDataFrame([("s1", "t1", "P", "REEL", '{"a": 1}'), ("s2", "t2", "P", "QUOTE", None)], "id string, trace_id string, required_pillar string, required_format string, brief string")
    assert sorted((x.generated_content_id, x.trace_id, x.brief) for x in R.with_brief(content, plan).collect()) == [("g1", "t1", '{"a": 1}'), ("g2", "t2", "{}")]


def test_lines_by_format(spark):
    kinds = "kind string, reel struct<hook_line:string,body:array<string>,punch_line:string>, slides array<struct<headline:string,body:string>>, quote struct<quote_text:string,quote_text_alt:string>"
    rows = [
        ("REEL", ("Hook", ["b1", "b2"], "So REMEMBER, rest"), None, None), ("CAROUSEL", None, [("H1", "B1"), ("H2", ""), ("H3", None)], None), ("CAROUSEL", None, [], None),
        ("QUOTE", None, None, ("One. Two", "Alt")), ("QUOTE", None, None, ("The takeaway", "x")), ("QUOTE", None, None, ("Ends.", "x")), ("OTHER", None, None, None),
    ]
    c = [F.col(x) for x in ("kind", "reel", "slides", "quote")]
    got = spark.createDataFrame(rows, kinds).select(M.full_text(*c), M.first_line(*c), M.last_line(*c), M.summary_ending(M.last_line(*c))).collect()
    assert [tuple(x) for x in got] == [
        ("Hook b1 b2 So REMEMBER, rest", "Hook", "So REMEMBER, rest", "remember,"), ("H1 B1 H2 H3", "H1", "H3", None), ("", "", "", None),
        ("One. Two Alt", "One", "Two", None), ("The takeaway x", "The takeaway", "The takeaway", "the takeaway"), ("Ends. x", "Ends", "", None), ("", "", "", None),
    ]
