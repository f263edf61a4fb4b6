"""Analyses that queries share: declared, computed once, deleted after the last use."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowlens.operators.fixpoint import shared_folder
from flowlens.plans import catalog, graphs, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TAINT = ["taint_explicit", "vuln_branch", "taint_sink", "taint_implicit", "vuln_inst", "constraints"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_who_asks():
    assert registry.uses(["taint_explicit", "vuln_branch", "closure"]) == {"tainted": {"taint_explicit", "vuln_branch"}, "flow": {"tainted"}, "trade": {"closure"}}
    assert registry.uses(TAINT)["flow"] == {"tainted", "tainted_implicit", "constraints"}
    assert all(need in registry.ANALYSES for needs in registry.NEEDS.values() for need in needs)


def test_together_gives_what_each_gives_alone(spark, monkeypatch):
    """The tables that exist after each query are those that a later one reads."""
    runs = []
    for name, plan in list(registry.ANALYSES.items()):
        monkeypatch.setitem(registry.ANALYSES, name, lambda t, name=name, plan=plan: runs.append(name) or plan(t))
    held, got = [], {}
    real = registry.Tables.drop_used
    monkeypatch.setattr(registry.Tables, "drop_used", lambda t, every=False: real(t, every) or held.append(sorted(t.written)))
    for name, df in registry.together(spark, SF, [*TAINT, "taint_explicit"]):
        got[name] = rows(df)
    assert sorted(runs) == ["flow", "tainted", "tainted_implicit"]
    assert held == [["flow", "tainted"], ["flow"], ["flow", "tainted_implicit"], ["flow", "tainted_implicit"], ["flow"], [], []]
    assert got == {name: rows(registry.QUERIES[name](spark, SF)) for name in TAINT} and all(got.values())


def test_a_stopped_run_leaves_no_table(spark):
    where = Path(shared_folder(spark).removeprefix("file:"))
    before = set(where.glob("round-*"))
    run = registry.together(spark, SF, ["dot_roundtrip", "join_inner"])
    assert next(run)[0] == "dot_roundtrip" and len(set(where.glob("round-*")) - before) == 1
    run.close()
    assert set(where.glob("round-*")) == before
    assert list(registry.together(spark, SF, [])) == []


def test_an_undeclared_analysis_is_refused(spark, monkeypatch):
    def hidden(t):
        return graphs.tainted(t)

    registry.query()(hidden)
    try:
        with pytest.raises(registry.UndeclaredAnalysisError, match="hidden does not declare tainted"):
            registry.QUERIES["hidden"](spark, SF)
    finally:
        for table in (registry.QUERIES, registry.NEEDS, registry._PLANS):
            table.pop("hidden")
    assert graphs.tainted(registry.Tables(spark, SF)).where(F.col("depth") == 0).count() > 0
