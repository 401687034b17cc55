import pytest
from pyspark.sql import functions as F

from tidewarden.functions import filters
from tidewarden.operators import changes, coastlines, elements, overlay
from tidewarden.streaming import replication


def ends(spark, rows):
    return spark.createDataFrame(rows, "id long, first_node long, last_node long")


@pytest.mark.parametrize("rows,state", [([(1, 9, 1), (2, 9, 2), (3, 3, 9)], 0), ([(1, 9, 1), (2, 3, 9), (3, 9, 2)], 1), ([(1, 1, 9), (2, 2, 9), (3, 9, 3)], 0), ([(1, 9, 1), (2, 9, 9)], 0), ([(1, 9, 9)], 0)])
def test_endpoint_fold(spark, rows, state):
    got = {r.node_id: r.state for r in coastlines.unconnected_nodes(ends(spark, rows)).collect()}
    assert got.get(9, 0) == state


def test_revived_element(spark):
    rows = [(1, 0, 1, "N", 5, 1), (2, 2, 1, "N", 5, 3), (3, 1, 1, "N", 5, 2), (1, 1, 2, "N", 6, 9), (2, 1, 1, "N", 6, 4), (1, 2, 3, "W", 7, 1)]
    df = spark.createDataFrame(rows, "file_seq long, sec int, pos long, etype string, id long, version int")
    got = {(r.etype, r.id): (r.deleted, r.version) for r in changes.merge(df).collect()}
    assert got == {("N", 5): (False, 2), ("N", 6): (False, 9), ("W", 7): (True, 1)}


def test_closure_ends_in_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 99)], "parent long, child long")
    alive = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    got = {(r.node, r.depth) for r in elements.closure(e, spark.createDataFrame([(1,)], "id long"), alive).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_overlay_hides_deleted(spark):
    t = lambda rows: spark.createDataFrame(rows, "id long, v string, deleted boolean")
    base, state, batch = t([(1, "a", False), (2, "a", False), (3, "a", False)]), t([(2, "b", False), (3, None, True)]), t([(2, None, True), (4, "c", False)])
    got = {(r.id, r.v) for r in overlay.overlay(batch, state, base, keys=("id",)).collect()}
    assert got == {(1, "a"), (4, "c")}


def test_filter_corners(spark):
    df = spark.createDataFrame([(1, None), (2, {}), (3, {"x": "y"}), (4, {"k": "v"})], "id long, tags map<string,string>")
    f = filters.ElementFilter("N", (filters.TagFilter("k"),), (1, 2, 3))
    ids = lambda c: {r.id for r in df.where(c).collect()}
    assert ids(f.matches(F.col("tags"), F.col("id"))) == {3, 4}
    assert ids(filters.ElementFilter("N", ids=(1,)).matches(F.col("tags"), F.col("id"))) == {3, 4}
    with pytest.raises(ValueError, match="needs"):
        filters.ElementFilter("N")


def test_plan_of_steps():
    day, hour = 86400, 3600
    steps = replication.plan(day - 120, {60: 3 * day + 180, 3600: 3 * day, 86400: 3 * day})
    assert [s[0] for s in steps] == [60, 60, 86400, 86400, 60, 60, 60]
    assert steps[0][1] == day - 120 and all(a[2] == b[1] for a, b in zip(steps, steps[1:]))
    assert [s[0] for s in replication.plan(22 * hour, {60: day, 3600: 23 * hour, 86400: 0})][:2] == [3600, 60]
    assert replication.path_of(5123456) == "005/123/456"
    seq, end = replication.parse_state("#c\n\nsequenceNumber=7\ntimestamp=2024-01-02T03\\:04\\:05Z\n")
    assert seq == 7 and end.isoformat() == "2024-01-02T03:04:05+00:00"
