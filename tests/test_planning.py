"""Slots, angles, assignment, score gates, lookups, configuration and sinks on small tables."""

import random

from pyspark.sql import functions as F

from quillmill.operators import admission as A
from quillmill.operators import cleaning as T
from quillmill.operators import planning as N
from quillmill.operators import relational as R
from quillmill.operators import rendering as M
from quillmill.operators import topk as W
from quillmill.sources.text_files import json_state, save_json_state, valid_files, write_bodies, yaml_list

ANGLES = [("a", True, ["P"], ["R"], [2, 3], 1.0), ("b", True, ["P", "Q"], ["R", "C"], [], 2.0), ("c", True, ["Q"], ["C"], [4], 3.0), ("off", False, ["P"], ["R"], [1, 5], 9.0)]
SCHEMA = "angle string, active boolean, pillars array<string>, formats array<string>, levels array<int>, multiplier double"


def test_angles_fit_by_pillar_format_and_level(spark):
    angles = spark.createDataFrame(ANGLES, SCHEMA)
    rows = spark.createDataFrame([(1, "P", "R", 2), (2, "P", "R", 5), (3, "P", "R", None), (4, "Q", "C", 1), (5, "P", "C", 1), (6, None, "R", 2)], "i int, pillar string, format string, level int")
    got = sorted((x.i, x.angle) for x in N.compatible_angles(rows, angles, "level").collect())
    # a null level is 3; less than two bounds take any level; inactive angles never fit
    assert got == [(1, "a"), (1, "b"), (2, "b"), (3, "a"), (3, "b"), (4, "b"), (4, "c"), (5, "b")]
    assert [(x.format, x.angle) for x in N.angles_of_format(angles).collect()] == [("C", "c"), ("C", "b"), ("R", "b"), ("R", "a")]
    assert {(x.format, x.angle) for x in N.angles_of_format(angles, 1).collect()} == {("C", "c"), ("R", "b")}


def test_items_without_an_angle_fall_back(spark):
    slots = spark.createDataFrame([(1, "Z", "R"), (2, "P", "R")], "slot int, pillar string, format string")
    items = spark.createDataFrame([("x", "Z", ["R", "R"], 1), ("y", "P", ["R"], 2), ("n", None, None, None)], "item string, pillar string, formats array<string>, level int")
    got = {(x.slot, x.item, x.angle, x.fallback) for x in N.slot_candidates(slots, items, spark.createDataFrame(ANGLES, SCHEMA), "level", 1).collect()}
    assert got == {(1, "x", "b", True), (2, "y", "a", False), (2, "y", "b", False)}


def test_greedy_assignment_is_the_ordered_walk(spark):
    r = random.Random(3)
    for n in (0, 5, 60):
        rows = [(s, f"i{r.randrange(12)}", r.choice(["a", "b"]), float(r.randrange(6))) for s in range(1, 8) for _ in range(n // 5)]
        taken, exp = set(), []
        for s in range(1, 8):
            free = sorted((-v, i, a) for t, i, a, v in rows if t == s and i not in taken)
            if free:
                taken.add(free[0][1])
                exp.append((s, free[0][1], -free[0][0], free[0][2]))
        df = spark.createDataFrame(rows, "slot int, item string, angle string, score double")
        assert sorted(tuple(x) for x in N.greedy_assignment(df, 7).collect()) == exp


def test_score_summary(spark):
    rows = [(1, {"hook": 6, "voice": 7}), (2, {"hook": 5, "voice": 6}), (3, {"hook": 9}), (4, None), (5, {"hook": 11, "voice": 10})]
    out = {x.i: x for x in M.score_summary(spark.createDataFrame(rows, "i int, s map<string,int>"), "s", [("hook", 6), ("voice", 7)], ["voice", "hook"]).collect()}
    assert (out[1].mean, out[1].passed_all, out[1].attention, out[1].error) == (6.5, True, "", None)
    assert (out[2].passed_all, out[2].attention) == (False, "voice: 6/10, hook: 5/10")
    assert [out[i].error for i in (3, 4, 5)] == ["out of range: voice", "out of range: hook,voice", "out of range: hook"] and out[3].mean is None


def test_bodies_by_format(spark):
    reel, slide = "struct<hook_line:string,body:array<string>,punch_line:string>", "array<struct<headline:string,body:string>>"
    rows = [("REEL", ("h", ["x", "y"], "p"), None, None), ("CAROUSEL", None, [("a", "b"), ("c", "")], None), ("QUOTE", None, None, ("q", "")), ("OTHER", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, f"kind string, reel {reel}, slides {slide}, quote struct<quote_text:string,quote_text_alt:string>")
    got = [x[0] for x in df.select(M.piece_body(F.col("kind"), F.col("reel"), F.col("slides"), F.col("quote"))).collect()]
    assert got == ['> "h"\n\n1. "x"\n2. "y"\n\n> "p"', "### 1 (cover)\n\n> **a**\n\n> b\n\n### 2\n\n> **c**", "> q", "", ""]


def test_lookups(spark):
    keys, tab = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, "a"), (3, "c")], "id int, v string")
    assert {(x.k, x.v, x.found) for x in R.looked_up(keys, "k", tab, "id").collect()} == {(1, "a", True), (2, None, False), (None, None, False)}
    assert [x.present for x in R.exists_any(tab).collect() + R.exists_any(tab.limit(0)).collect()] == [True, False]
    at = spark.createDataFrame([(0,), (None,), (1704067200,), (1703000000,)], "e bigint")
    assert [x[0] for x in at.select(R.within_lookback(F.col("e"), "2024-01-05 00:00:00", 7)).collect()] == [False, False, True, False]


def test_hot_groups_are_numbered_exactly(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(300)]
    new = spark.createDataFrame(rows, "i int, g string")
    old = spark.createDataFrame([("hot", 9), ("cold", 4)], "g string, n int")
    out = {x.i: x.next_index for x in A.next_index(new, old, "g", "n", F.col("i")).collect()}
    exp, at = {}, {"hot": 9, None: -1}
    for i, g in rows:
        at[g] += 1
        exp[i] = at[g]
    assert out == exp
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["A b", "a-B", None, "c", "a b"])], "i int, n string")
    assert {x.i: x.unique_slug for x in A.resolved_slugs(names, "n", F.col("i")).collect()} == {0: "a_b", 1: "a_b_1", 2: None, 3: "c", 4: "a_b_2"}


def test_quota_sample_keeps_no_more_than_the_largest_quota(spark):
    df = spark.createDataFrame([("a" if i % 2 else "b", str(i)) for i in range(50)] + [(None, "x"), ("c", "y")], "g string, id string")
    out = W.quota_sample(df, "g", "id", {"a": 3, "b": 1})
    assert sorted((x.g, x["rank"]) for x in out.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    assert W.quota_sample(df, "g", "id", {}).count() == 0


def test_cleaning_warns_of_high_loss(spark):
    rows = [("a", "x" + " " * 98 + "y"), ("b", "plain text"), ("c", ""), ("d", None)]
    out = {x.i: x.cleaning_warnings for x in T.cleaned(spark.createDataFrame(rows, "i string, t string"), "i", "t").collect()}
    assert out["a"] == ["High removal rate: 97.0% of text removed (threshold: 30%)"] and out["b"] == [] and out["c"] == []


def test_configuration_state_and_sink(spark, tmp_path):
    (tmp_path / "c.yml").write_text("books:\n- title: A\n  pages: 3\n- title: B\n")
    assert [tuple(x) for x in yaml_list(spark, str(tmp_path / "c.yml"), "books", "title string, pages int").collect()] == [("A", 3), ("B", None)]
    assert yaml_list(spark, str(tmp_path / "c.yml"), "none", "title string").count() == 0
    path = str(tmp_path / "state")
    assert json_state(spark, path, "id string, n int").count() == 0
    save_json_state(spark.createDataFrame([("a", 1)], "id string, n int"), path)
    assert [tuple(x) for x in json_state(spark, path, "id string, n int").collect()] == [("a", 1)]
    rows = [(f"week_01/{i:02}_MON.md", f"# {i}") for i in range(20)] + [("empty.md", None)]
    assert write_bodies(spark.createDataFrame(rows, "n string, b string").repartition(3), str(tmp_path / "out"), "n", "b") == 21
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.*")} == {n: b or "" for n, b in rows}
    files = spark.createDataFrame([("a.pdf", 4, b"%PDF"), ("b.txt", 4, b"%PDF"), ("c.PDF", 0, b""), ("d.pdf", 4, b"text"), (None, 1, None)], "path string, length int, content binary")
    assert [x.reason for x in valid_files(files).collect()] == [None, "not .pdf", "missing or empty", "not of its kind", "missing or empty"]


def test_diversity_and_counters(spark):
    ev = spark.createDataFrame([("a",)] * 8 + [("b",)] * 1 + [("c",)], "g string")
    counts = ev.filter("g <> 'c'").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    x = N.diversity_report(ev, "g", counts, "n", 4, 0.5).first()
    assert (x.underused, x.saturated) == ("b,c", "a") and 0 < x.evenness < 1
    assert N.utilisation(counts, "g", "n", {"a": 0.5}).first()[0] == 8 * 0.5 / 9
    assert N.utilisation(counts.limit(0), "g", "n", {"a": 0.5}).first()[0] == 0.0
    assert tuple(N.outcome_counts(ev, {"as": F.col("g") == "a"}).first()) == (10, 8)
