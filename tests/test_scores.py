"""Rules, scores and selection against Python versions."""

import random
import re

from pyspark.sql import functions as F

from quillmill.functions import lexicons as L
from quillmill.operators import elite as E
from quillmill.operators import rules as U
from quillmill.operators import scores as S


def tension(text):
    t = text.lower()
    s = min(sum(t.count(f" {w} ") for w in L.CONTRAST_TENSION) * 12, 36) + min(sum(t.count(w) for w in L.NEGATIONS) * 8, 24)
    s += 20 * bool(re.search("the more .{5,30}, the (less|more)", t)) + 20 * bool(re.search(r"\?.*you (think|believe|assume)", t))
    hit = False
    for b in L.BLAME:
        for m in re.finditer(rf"\b{b}\b", t):
            c = t[max(0, m.start() - 50) : m.start() + 50]
            hit |= any(n in c for n in L.NEGATIONS) or any(f" {w} " in f" {c} " for w in L.CONTRAST_TENSION)
    return min(s + 15 * hit, 100)


def test_tension(spark):
    r = random.Random(4)
    vocab = ["you", "they", "not", "but", "calm", "nothing", "the more you wait", ", the less it helps", "system", "yet", "café", "?", "believe", "youth", "word " * 9]
    texts = ["", "you", "not you", "you " + "x" * 60 + " not", "the more you think about it, the less"] + [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.tension(F.col("t")).alias("s")).collect()
    assert [(x.t, x.s) for x in rows] == [(t, tension(t)) for t in texts]


def test_rules(spark):
    long_ = "word " * 260
    texts = {"WORD_COUNT_LOW": "few words", "WORD_COUNT_HIGH": "word " * 901, "META_STRUCTURAL": long_ + "as discussed earlier, as we will see", "INDEX_REFERENCE": long_ + "1-2 [3] ibid. et al. pp. 4",
             "PURE_BIOGRAPHY": long_ + "was born in Rome, died in Pisa, had 3 children", "QUOTATION_DUMP": "“" + long_ + "”", "LIST_WITHOUT_MEANING": "\n".join("- " + "word " * 30 for _ in range(10)), "NO_SIGNAL": long_, "PASS": long_ + "research shows"}
    df = spark.createDataFrame(list(texts.items()), "want string, t string")
    got = df.select("want", U.rule_decision(F.col("t"), F.size(F.split(F.trim("t"), r"\s+"))).alias("d"), U.signals(F.col("t")).alias("s")).collect()
    assert all(x.want == x.d for x in got), got
    assert [x.s for x in got if x.want == "PASS"] == [["academic"]]


def greedy(rows):
    chosen, labels = [], {i: [] for i in range(len(rows))}
    for axis, quota, least in E.AXES:
        n = 0
        for i in sorted(range(len(rows)), key=lambda i: -rows[i][axis]):
            if n >= quota:
                break
            if rows[i][axis] >= least:
                if i not in chosen:
                    chosen.append(i)
                    n += 1
                labels[i].append(axis)
    if len(chosen) < 15:
        for i in sorted((i for i in range(len(rows)) if i not in chosen), key=lambda i: -rows[i]["total"]):
            if len(chosen) >= 15:
                break
            if rows[i]["total"] >= 80 and rows[i]["identity"] + rows[i]["tension"] >= 50:
                chosen.append(i)
                labels[i] = ["fill"]
    return {i: labels[i] for i in chosen}


def test_elite_is_the_greedy_walk(spark):
    r = random.Random(2)
    data, docs = [], {}
    for d in range(40):
        rows = []
        for i in range(r.randrange(1, 60)):
            s = {a: r.choice([0, 10, 20, 25, 30, 35, 60]) for a, _, _ in E.AXES}
            s["total"] = sum(s.values())
            rows.append(s)
            data.append((d, i, *[s[a] for a, _, _ in E.AXES], s["total"]))
        docs[d] = rows
    cols = "doc int, i int, " + ", ".join(f"{a} int" for a, _, _ in E.AXES) + ", total int"
    got = {}
    for x in E.elite(spark.createDataFrame(data, cols), "doc", "i").collect():
        got.setdefault(x.doc, {})[x.i] = list(x.axes)
    assert got == {d: greedy(rows) for d, rows in docs.items()}
