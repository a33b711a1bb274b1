"""The composed plan and the registered queries' contract."""

import importlib

import pytest

from quillmill.plans import catalogue
from quillmill.plans.pipeline import passages

PARA = "You never focus on the real work, but the cost of the habit is hidden. Stop the noise and choose the morning. "


def test_passages(spark):
    text = "\n\n".join([PARA * 3] * 30)
    docs = spark.createDataFrame([("a", text, 1), ("b", "", 1), ("c", None, 1), ("d", "too short", 1)], "id string, t string, p int")
    out = passages(docs, "id", "t", "p", rules=False).collect()
    assert out and {x.id for x in out} <= {"a", "d"} and all(x.axes for x in out)
    assert len({(x.id, x.index) for x in out}) == len(out) <= 35
    strict = passages(docs, "id", "t", "p").collect()
    assert {(x.id, x.index) for x in strict} <= {(x.id, x.index) for x in out}


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_has_the_core_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "quillmill.llm", None)
    names = set(importlib.reload(__spark_entry__).queries())
    assert names == set(catalogue.queries()) and set(__spark_entry__.oracle_sql()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("module", ["operators", "sources", "functions", "plans", "streaming"])
def test_core_never_imports_the_subpackage(module):
    from pathlib import Path

    import quillmill

    for p in (Path(quillmill.__file__).parent / module).rglob("*.py"):
        assert "quillmill.llm" not in p.read_text()
