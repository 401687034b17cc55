"""A batch of changes over kept state gives what a run over everything gives."""

import random

from pyspark.sql import functions as F

from tidewarden import schemas
from tidewarden.operators import admins, coastlines
from tidewarden.sources.state import Snapshots
from tidewarden.streaming.loop import Engine


def world(rnd):
    """Squares of four corner nodes: some coastlines, some areas whose outer way is a square, a centre each."""
    nodes, ways, relations = [], [], []
    for k in range(8):
        x, y, s = rnd.randrange(6) * 2.0, rnd.randrange(6) * 2.0, rnd.choice([1.0, 2.0, 3.0])
        ids = [k * 10 + i + 1 for i in range(4)]
        for i, (dx, dy) in zip(ids, ((0, 0), (s, 0), (s, s), (0, s))):
            nodes.append((i, y + dy, x + dx, {"place": "town"} if k % 2 else {}))
        ring = [*ids, ids[0]]
        if k % 3 == 0:
            ways.append((k + 1, ring[: rnd.choice([3, 4, 5])], {"natural": "coastline"}))
        else:
            ways.append((k + 1, ring, {}))
            centre = [("N", ids[0], "admin_centre")] if k % 4 else []
            relations.append((k + 1, [("W", k + 1, "outer"), *centre], {"boundary": "administrative", "type": "boundary", "admin_level": "2" if k < 3 else "4", "name": f"area {k}"}))
    return nodes, ways, relations


def batch(rnd, nodes, ways, relations, seq):
    out, pos = [], 0
    for i, lat, lon, tags in rnd.sample(nodes, 4):
        pos += 1
        out.append((seq, 1, pos, "N", i, 2, lat + rnd.choice([0.0, 0.5]), lon + 0.5, None, None, tags))
    for i, ns, tags in rnd.sample(ways, 2):
        pos += 1
        out.append((seq, 1, pos, "W", i, 2, None, None, ns[: rnd.choice([2, len(ns)])], None, tags))
    for i, ms, tags in rnd.sample(relations, 2):
        pos += 1
        gone = rnd.random() < 0.3
        out.append((seq, 2 if gone else 1, pos, "R", i, 2, None, None, None, None if gone else ms, {} if gone else {**tags, "admin_level": rnd.choice(["4", "9", "x"])}))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_incremental_is_full(spark, tmp_path):
    rnd = random.Random(3)
    n, w, r = world(rnd)
    base = {"nodes": spark.createDataFrame(n, schemas.NODES), "ways": spark.createDataFrame(w, schemas.WAYS), "relations": spark.createDataFrame(r, schemas.RELATIONS)}
    expected = spark.createDataFrame([(2, "A", "A", "AAA", 4, 5), (2, "A", "A", "AAA", 4, 77), (99, "B", "B", "BBB", None, None)], schemas.EXPECTED)
    e = Engine(spark, base, Snapshots(spark, str(tmp_path / "s")), expected)
    e.bootstrap()
    for k in (1,):
        df = spark.createDataFrame(batch(rnd, n, w, r, k), schemas.CHANGES)
        assert e.process(df, k, run_ts=F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp"))
        assert not e.process(df, k)
    now = e.elements(e.snapshots.table("state"))
    keep = ["id", "first_node", "last_node", "reason"]
    assert rows(e.snapshots.table("coast").select(*keep)) == rows(coastlines.Coastlines().full(now).select(*keep))
    keep = ["id", "friendly_name", "admin_level", "reason", "sound"]
    full = admins.Admins().full(now)
    assert rows(e.snapshots.table("areas").select(*keep)) == rows(full.select(*keep))
    a = admins.Admins()
    assert rows(a.issues(now, e.snapshots.table("areas"))) == rows(a.issues(now, full))
    seen = spark.read.parquet(f"{tmp_path}/s/issues/1")
    assert seen.where("first_seen is null").count() == 0 and seen.count() > 0
