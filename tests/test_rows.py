"""Rows of ways and relations that aren't gathered first, and dealt by their number."""

from tidewarden.operators import elements
from tidewarden.plans import registry
from tidewarden.sources import tables
from tidewarden.sources.tables import Context


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_equal_gathered_ones(spark, small, monkeypatch):
    c = Context(spark, small)
    want = sorted(tuple(r) for r in elements.way_nodes(c.ways).collect())
    assert sorted(tuple(r) for r in c.way_nodes.collect()) == want
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    assert sorted(tuple(r) for r in c.way_nodes.collect()) == want
    assert sorted(tuple(r) for r in c.members.collect()) == sorted(tuple(r) for r in elements.relation_members(c.relations).drop("pos").collect())


def test_tracker_edges_gather_nothing_and_are_dealt_by_rows(spark, small, monkeypatch):
    before = sorted(tuple(r) for r in registry.QUERIES["tracker_edges"](spark, small).collect())
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    df = registry.QUERIES["tracker_edges"](spark, small)
    assert "collect_list" not in _plan(df) and "REPARTITION_BY_NUM" in _plan(df)
    assert sorted(tuple(r) for r in df.collect()) == before


def test_relation_coordinates_gather_nothing(spark, small):
    assert "collect_list" not in _plan(registry.QUERIES["relation_coordinates"](spark, small))
