"""Problems 1, 2 and 5 against brute force and edge cases."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmill.llm import repeated_lines as P1
from quillmill.llm import split_items as P2
from quillmill.llm import top_n as P5


def norm(line):
    k = re.sub(r"[\s\xa0]+", " ", line.lower())
    k = re.sub(r"\d+", "0", k)
    return re.sub(r"^[\W_]+|[\W_]+$", "", k)


def brute_lines(rows, least=5):
    docs = defaultdict(set)
    for i, t, a in rows:
        a = re.sub(r"[\s\xa0]+", " ", a or "").strip().lower()
        if i is None or t is None or not a:
            continue
        for line in t.split("\n"):
            if norm(line):
                docs[a, norm(line)].add(i)
    out = set()
    for i, t, a in rows:
        a = re.sub(r"[\s\xa0]+", " ", a or "").strip().lower()
        if i is None or t is None or not a:
            continue
        out |= {(i, n) for n, line in enumerate(t.split("\n")) if len(docs.get((a, norm(line)), ())) >= least}
    return out


SCHEMA = "id string, raw_text string, source_author string"


def test_repeated_lines(spark):
    r = random.Random(1)
    pool = ["Share this 12!", "  share\xa0THIS 7 ", "— By me —", "Über uns…", "***", "", "x", "(c) 2020 Ann", "© 2021 Ann"]
    rows = [(f"d{i}", "\n".join(r.choice(pool + [f"own line {r.random()}"]) for _ in range(r.randrange(1, 8))), r.choice(["Ann Lee", " ann  LEE ", "Bo", None, "  "])) for i in range(60)]
    rows += [rows[0], (None, "Share this 1", "Bo"), ("n", None, "Bo"), ("crlf", "Share this 9\r\nx\r", "Bo")]
    got = P1.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == brute_lines(rows)


def test_dense_containers(spark, monkeypatch):
    monkeypatch.setattr(P1, "ARRAY_MAX", 3)
    rows = [(f"d{i}", f"standing line {i}\nonly {chr(97 + i % 26) * (i // 26 + 1)}", "A") for i in range(40)]
    assert {tuple(x) for x in P1.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_lines(rows) == {(f"d{i}", 0) for i in range(40)}


def test_lines_are_removed_and_columns_kept(spark):
    rows = [(f"d{i}", f"head\nbody {chr(97 + i) * 3}", "A") for i in range(6)] + [("z", None, "A"), ("y", "head", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit(1)).withColumn("doc", F.lit(2))
    out = {x.id: x.clean_text for x in P1.without_repeated(df).collect()}
    assert out["d2"] == "body ccc" and out["z"] is None and out["y"] == "head"
    assert {"k", "doc"} <= set(P1.without_repeated(df).columns)
    assert P1.repeated_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit,overlap", [(6000, 300), (100, 20), (10, 3), (50, 0)])
def test_pieces(spark, limit, overlap):
    r = random.Random(limit)
    texts = ["", "a", "x" * limit, "x" * (limit + 1), "é" * (3 * limit), "𝔘" * (2 * limit + 5), "word " * limit, "A sentence here. " * limit, ("para " * 9 + "\n\n") * (limit // 4), "\n" * (2 * limit), " " * (2 * limit + 1), "a\r\n\r\nb" * limit, "é" * limit]
    texts += ["".join(r.choice("ab .,\n") for _ in range(r.randrange(1, 5 * limit))) for _ in range(20)]
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)] + [("n", 0, None)], "id string, chunk_index int, text string")
    got = defaultdict(list)
    for x in P2.split_items(df, "id", "text", limit=limit, overlap=overlap).orderBy("item_id", "piece_no").collect():
        got[int(x.item_id)].append(x)
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ps = got[i]
        assert all(len(p.text) <= limit for p in ps)
        assert "".join(p.text[p.overlap_chars :] for p in ps) == t
        assert (len(ps) > 1) == (len(t) > limit)
        done = ""
        for p in ps:
            assert p.overlap_chars <= overlap and done.endswith(p.text[: p.overlap_chars])
            done += p.text[p.overlap_chars :]
    over = {int(x.item_id) for x in P2.oversized(df, "id", "text", limit=limit, overlap=overlap).collect()}
    assert over == {i for i, t in enumerate(texts) if len(t) > limit}


def test_cuts_prefer_paragraphs(spark):
    para = "Some words make a sentence. " * 30
    text = "\n\n".join([para] * 12)
    df = spark.createDataFrame([("a", 0, text)], "id string, chunk_index int, text string")
    ps = P2.split_items(df, "id", "text").orderBy("piece_no").collect()
    assert all(p.text.endswith("\n\n") for p in ps[:-1])
    assert all(250 <= p.overlap_chars <= 300 and not p.text[:1].isspace() for p in ps[1:])


def test_words_stay_whole_where_they_can(spark):
    text = "A start. " + "x" * 5696 + " end of it. " + "y" * 9000
    df = spark.createDataFrame([("a", 0, text)], "id string, chunk_index int, text string")
    ps = [p.text[p.overlap_chars :] for p in P2.split_items(df, "id", "text").orderBy("piece_no").collect()]
    assert "".join(ps) == text and ps[0] == "A start. " and ps[1] == "x" * 5696 + " " and ps[2] == "end of it. "


ATOMS = "id string, primary_pillar string, virality_score double, updated_at timestamp, source_metadata struct<credibility:string,batch_id:string>, extra string"


def test_top_n(spark):
    from datetime import datetime, timedelta

    r = random.Random(3)
    t0 = datetime(2025, 1, 1)
    rows = []
    for i in range(400):
        score = r.choice([None, float("nan"), -0.0, 0.0, 1.0, 2.0, 2.0, r.random()])
        batch = r.choice(["b1", "b1", "b1", "b2", None])
        rows.append((f"i{i:03}", r.choice(["A", " a ", "B", None]), score, t0, ("x", batch), "e"))
    rows += [(i, p, 9.0, t0 + timedelta(days=1), m, e) for i, p, s, t, m, e in rows[:20]] + rows[30:40] + [("null-time", "A", 99.0, None, ("x", "b1"), "e")]
    latest = {}
    for x in rows:
        if x[0] not in latest or (x[3] or datetime.min) > (latest[x[0]][3] or datetime.min):
            latest[x[0]] = x
    groups = defaultdict(list)
    for i, p, s, _, m, _ in latest.values():
        if s is None or s != s or m[1] is None:
            continue
        groups[(p.strip().upper() if p else None, m[1])].append((-s if s else 0.0, i))
    exp = {(g, i, k + 1) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:3])}
    df = spark.createDataFrame(rows, ATOMS)
    for parts in (None, 7):
        got = P5.first_positions(P5.latest_rows(df).filter("score is not null and not isnan(score) and batch_id is not null").withColumn("score", F.when(F.col("score") == 0, 0.0).otherwise(F.col("score"))), ["pillar", "batch_id"], [F.desc("score"), F.asc("id")], 3, partitions=parts)
        assert {((x.pillar, x.batch_id), x.id, x.position) for x in got.collect()} == exp
    assert {(x.pillar, x.batch_id, x.id) for x in P5.top_items(df, 3).collect()} == {(*g, i) for g, i, _ in exp}
    assert P5.top_items(df.limit(0), 3).count() == 0


def test_positions_of_a_hot_group(spark):
    from quillmill.operators.positions import all_positions

    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.col("id"))
    rows, counts = all_positions(df, ["g"], [F.asc("id")], partitions=9)
    got = {(x.g, x.id): x.position for x in rows.collect()}
    for g in (0, 1):
        ids = sorted(i for i in range(5000) if (i % 7 == 0) == bool(g))
        assert [got[g, i] for i in ids] == list(range(1, len(ids) + 1))
    assert {x.g: x.n for x in counts.collect()} == {0: 4285, 1: 715}
