"""Problems 6, 8 and 9 against brute force."""

import os
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmill.llm import history as P6
from quillmill.llm import leakage as P9
from quillmill.llm import packing as P8

WORDS = [f"w{i}" for i in range(300)]


def shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def edited(r, words, k):
    out = list(words)
    for _ in range(k):
        out[r.randrange(len(out))] = r.choice(WORDS)
    return out


def test_near_duplicates_of_half_a_million_shingles(spark):
    # a slice holds a 16th of them: 33,125 and 32,375, to both sides of what 16 bits count
    words = [f"w{i}" for i in range(530_000)]
    rows = [("h", 0, datetime(2024, 1, 1), " ".join(words)), ("n", 1, datetime(2024, 1, 2), " ".join(words[:518_000]))]
    df = spark.createDataFrame(rows, "id string, kind int, ts timestamp, text string")
    table = P6.pivot_table(df.withColumn("src", F.lit("s"))).collect()
    assert all(min(x.slices) > 0 and sum(x.slices) == x.size for x in table) and len(table) == 2
    assert {x.id for x in P6.by_content(df.withColumn("src", F.lit("s"))).collect()} == {"n"}


@pytest.mark.parametrize("leaders", [32, 1])
def test_near_duplicates_of_history(spark, monkeypatch, leaders):
    monkeypatch.setattr(P6, "LEADERS", leaders)
    r = random.Random(5)
    t0, rows = datetime(2025, 1, 1), []
    bases = [[r.choice(WORDS) for _ in range(r.choice([18, 20, 25, 80, 200]))] for _ in range(40)]
    for i in range(160):
        b = r.choice(bases)
        kind = int(r.random() < 0.5)
        text = " ".join(edited(r, b, r.choice([0, 0, 1, 2, 4, 8]))) + r.choice(["", "!", " Extra Words at the end"])
        rows.append(("s", f"i{i}", kind, t0 + timedelta(hours=r.randrange(9)) if kind else None, text))
    rows += [("s", "null", 1, t0, None), ("s", "empty", 1, t0, ""), ("s", "blank", 1, None, " . "), rows[0], rows[1]]
    exp = set()
    for _, i, kind, ts, t in rows:
        a = shingles(t)
        if kind != 1 or not a:
            continue
        for _, j, k2, ts2, u in rows:
            b = shingles(u)
            if b and j != i and 10 * len(a & b) >= 7 * len(a | b) and (k2 == 0 or (ts2, j) < (ts, i)):
                exp.add(i)
    df = spark.createDataFrame(rows, "src string, id string, kind int, ts timestamp, text string")
    got = {x.id for x in P6.by_content(df).collect()}
    assert got == exp and 0 < len(exp) < 80
    # the stored table of the history gives the same
    table = P6.pivot_table(df.filter("kind = 0"))
    assert {x.id for x in P6.by_content(df, table).collect()} == exp
    assert P6.by_content(df.limit(0)).count() == 0


def test_addresses(spark):
    urls = {"https://www.A.example/x/": "a.example /x ", "http://m.a.example/x#f": "a.example /x ", "https://a.example/X": "a.example /X ", "https://a.example/": None, "https://a.example": None, "https://a.example/?utm=1": None,
            "https://a.example/?p=3&utm=1": "a.example  p=3", "https://a.example/w?v=1&id=2&x=3": "a.example /w id=2&v=1", "": None, None: None, "a.example/x": "a.example /x ", "//a.example/x": "a.example /x "}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", P6.page_key(F.col("u")).alias("k")).collect()
    assert {x.u: x.k for x in got} == urls
    t = datetime(2025, 1, 1)
    rows = [("h", 0, None, "https://a.example/x"), ("p1", 1, t, "http://www.a.example/x/"), ("p2", 1, t, "https://b.example/y"), ("p3", 1, t + timedelta(1), "https://m.b.example/y?z=1"), ("p3", 1, t + timedelta(1), "https://m.b.example/y?z=1"), ("p4", 1, t, None)]
    assert {x.id for x in P6.by_address(spark.createDataFrame(rows, "id string, kind int, ts timestamp, url string")).collect()} == {"p1", "p3"}


def test_two_batches_equal_one_run(spark, tmp_path):
    r = random.Random(12)
    say = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    texts: list[list[str]] = []
    for _ in range(120):
        w = list(r.choice(texts)) if texts and r.random() < 0.4 else say(r.randrange(15, 60))
        if w and r.random() < 0.5:
            w[r.randrange(len(w))] = "changed"
        texts.append(w)
    day = lambda i: datetime(2024, 1, 1 + i // 10)
    rows = [("s", f"i{i:03}", int(i >= 40), day(i) if i >= 40 else None, " ".join(w)) for i, w in enumerate(texts)]
    schema = "src string, id string, kind int, ts timestamp, text string"
    df = spark.createDataFrame(rows, schema)
    whole = {x.id for x in P6.by_content(df).collect()}
    path = str(tmp_path / "pivots")
    P6.append(path, df.filter("kind = 0"))
    got = set()
    for low, high in ((40, 80), (80, 120)):
        batch = spark.createDataFrame(rows[low:high], schema)
        got |= {x.id for x in P6.by_content(batch, P6.stored(spark, path)).collect()}
        P6.append(path, batch)
    assert got == whole and whole
    assert P6.stored(spark, path).select("id").distinct().count() == P6.pivot_table(df).select("id").distinct().count()


@pytest.mark.parametrize("hits", [1, 4_000_000])
def test_leaks(spark, monkeypatch, hits):
    monkeypatch.setattr(P9, "MAX_HITS", hits)
    r = random.Random(7)
    vocab = ["a", "I", "über", "habit", "x1", "the", "morning", "of", "ß"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, say(r.choice([5, 12, 13, 14, 60]))) for i in range(30)]
    items += [(30, items[4][1] if len(items[4][1]) >= 13 else say(20)), (31, [])]
    docs = []
    for d in range(150):
        w = say(r.randrange(0, 40))
        it = r.choice(items)[1]
        if len(it) >= 13 and r.random() < 0.7:
            k = r.choice([11, 12, 13, 14])
            s = r.randrange(max(1, len(it) - k + 1))
            w += it[s : s + k] + say(3)
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    docs += [(900, None), (901, ""), (902, "!!!")]

    def runs(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    its = [(i, " ".join(w) + "?") for i, w in items] + [(40, None)]
    exp = {(d, i) for d, t in docs for i, u in its if runs(t) & runs(u)}
    df, qf = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(its, "item_id bigint, text string")
    assert {tuple(x) for x in P9.leaks(df, qf).collect()} == exp and exp
    assert {tuple(x) for x in P9.leaks(df, qf, block_chars=150).collect()} == exp
    assert P9.leaks(df.limit(0), qf).count() == 0 and P9.leaks(df, qf.limit(0)).count() == 0


def test_leaks_with_edits(spark):
    words = [f"word{i}x" for i in range(40)]
    item = " ".join(words)
    one = " ".join([*words[:8], "OTHER", *words[9:20]])
    df = spark.createDataFrame([(1, "before " + one + " after"), (2, " ".join(words[:12])), (3, " ".join(words[5:18]))], "doc_id bigint, text string")
    qf = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {tuple(x) for x in P9.leaks(df, qf).collect()} == {(3, 7)}
    assert {tuple(x) for x in P9.leaks(df, qf, edits=1).collect()} >= {(1, 7), (3, 7)}


def test_leaks_with_edits_against_brute_force(spark):
    r = random.Random(21)
    vocab = [f"word{i}" for i in range(60)]
    items = [(i, [r.choice(vocab) for _ in range(r.choice([12, 13, 20, 40]))]) for i in range(12)]
    docs = []
    for d in range(60):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 25))]
        it = r.choice(items)[1]
        if len(it) >= 13:
            k = r.randrange(len(it) - 12)
            run = it[k : k + 13]
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(run))
                run = r.choice([run[:at] + ["other"] + run[at + 1 :], run[:at] + run[at + 1 :], run[:at] + ["more"] + run[at:]])
            w = w + run + [r.choice(vocab) for _ in range(4)]
        docs.append((d, w))

    def near(q, t, k):
        """Whether some stretch of t is within k word edits of q."""
        row = [0] * (len(t) + 1)
        for i, a in enumerate(q, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row) <= k

    exp = {(d, i) for d, t in docs for i, q in items if any(near(q[s : s + 13], t, 1) for s in range(len(q) - 12))}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    qf = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert {tuple(x) for x in P9.leaks(df, qf, edits=1).collect()} == exp and exp


def test_plan_uses_every_length_once():
    r = random.Random(9)
    for _ in range(60):
        counts = {r.randrange(1, 65): r.randrange(1, 50) for _ in range(r.randrange(0, 30))}
        pats = P8.plan(counts, 64)
        used = {}
        for p, n in pats:
            assert n > 0 and sum(z * k for z, k in p.items()) <= 64
            for z, k in p.items():
                used[z] = used.get(z, 0) + k * n
        assert used == counts


@pytest.mark.skipif(not os.path.exists(P8.TOKENIZER), reason="no tokenizer files here")
def test_packing(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["habit", "morning", "x", "über"]) for _ in range(r.choice([1, 5, 40, 300])))) for i in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string")
    out = P8.packed(df, capacity=64).collect()
    assert {x.doc_id for x in out} == {d for d, _ in docs}
    fill, per = {}, {}
    for x in out:
        per.setdefault(x.doc_id, []).append((x.piece_no, x.token_start, x.tokens))
        if x.container is not None:
            fill[x.container] = fill.get(x.container, 0) + x.tokens
    total = {x.doc_id: x.n for x in P8.token_counts(df).groupBy("doc_id").agg(F.max("tokens").alias("n")).collect()}
    for d, ps in per.items():
        ps.sort()
        assert sum(p[2] for p in ps) == total[d] and len(ps) == max(1, -(-total[d] // 64))
        assert all(p[1] == 64 * p[0] for p in ps)
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.03 * -(-sum(fill.values()) // 64) + 1
