"""The engine's state: layers, replay after a crash, publishing, catching up."""

import json

import pytest
from pyspark.sql import functions as F

from tidewarden import schemas
from tidewarden.functions import filters
from tidewarden.operators import callbacks, features
from tidewarden.sources import specs
from tidewarden.sources.state import Layer, Snapshots
from tidewarden.streaming import replication
from tidewarden.streaming.analyzers import Features, Names
from tidewarden.streaming.loop import Engine


def test_layers(spark, tmp_path):
    """What a batch changes lies over what was there, until layers are written as one."""
    s = Snapshots(spark, str(tmp_path / "s"), most_layers=3)
    row = lambda *r: spark.createDataFrame(list(r), "id long, x string, deleted boolean")
    want = {}
    for k in range(8):
        delta = [(k, f"new{k}", False), (k - 1, f"changed{k}", False), (k - 3, None, True)]
        for i, x, gone in delta:
            want.pop(i, None) if gone else want.update({i: x})
        assert s.commit(k, {"n": lambda read: read("t").agg(F.count("*").alias("n"))}, {"seq": k}, {"t": Layer(row(*delta), ("id",)), "e": Layer(spark.createDataFrame([(k % 2, k)], "a long, b long"))})
        assert {r.id: r.x for r in s.table("t").collect()} == want and s.table("n").first().n == len(want)
        s.drop_before(k)
    assert sorted(map(tuple, s.table("e").distinct().collect())) == [(k % 2, k) for k in sorted(range(8), key=lambda k: (k % 2, k))]
    assert s.progress() == {"seq": 7} and len(s._pointer()["_layers"]["t"]["from"]) <= 3


@pytest.fixture
def engine(spark, tmp_path):
    base = {
        "nodes": spark.createDataFrame([(k, 1.0 * k, 2.0, {"name": "*"} if k % 3 == 0 else {"place": "town", "name": f"n{k}"}) for k in range(1, 9)], schemas.NODES),
        "ways": spark.createDataFrame([(1, [1, 2], {"name": "*"})], schemas.WAYS),
        "relations": spark.createDataFrame([], schemas.RELATIONS),
    }
    expected = spark.createDataFrame([], schemas.EXPECTED)
    listed = spark.createDataFrame([("N", k, {"place": ["town", "city"]}, {"place": True}) for k in (1, 2, 3)], "osm_type string, osm_id long, tags map<string,array<string>>, is_array map<string,boolean>")
    return Engine(spark, base, Snapshots(spark, str(tmp_path / "s")), expected, [Names(), Features(listed)], str(tmp_path / "published"), now=lambda: 10_000.0)


def changes(spark, *rows):
    """(kind, id, section, tags)"""
    return spark.createDataFrame([(1, sec, k, kind, i, 2, 0.0, 0.0, None, None, tags) for k, (kind, i, sec, tags) in enumerate(rows)], schemas.CHANGES)


def found(engine):
    return {(r.issue_type, r.osm_type, r.osm_id, r.details) for r in engine.snapshots.table("issues").collect()}


def test_replay_after_a_crash(spark, engine, monkeypatch):
    engine.bootstrap()
    missing = "Missing tag 'place', expected it to be ''town' or 'city''"
    first = {("Names", "N", 3, None), ("Names", "N", 6, None), ("Names", "W", 1, None), ("ImportantFeatures", "N", 3, missing)}
    assert found(engine) == first
    whole = Engine._publish
    monkeypatch.setattr(Engine, "_publish", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    batch = changes(spark, ("N", 1, 1, {"name": "*"}), ("N", 3, 1, {"place": "town"}), ("N", 2, 2, {}), ("W", 1, 2, {}))
    with pytest.raises(RuntimeError):
        engine.process(batch, 1)
    monkeypatch.setattr(Engine, "_publish", whole)
    assert not engine.snapshots.exists("issues/1")
    assert not engine.process(batch, 1) and engine.snapshots.exists("issues/1/_SUCCESS")
    second = {("Names", "N", 1, None), ("Names", "N", 6, None), ("ImportantFeatures", "N", 1, missing), ("ImportantFeatures", "N", 2, "Deleted")}
    assert found(engine) == second
    seen = {r.osm_id: r.first_seen for r in spark.read.parquet(f"{engine.snapshots.root}/issues/1").where("issue_type = 'Names'").collect()}
    assert seen[6] < seen[1]
    assert engine.process(changes(spark, ("N", 6, 1, {"name": "x"})), 2) and found(engine) == {x for x in second if x[2] != 6}
    issues, header = specs.read_issues(spark, engine.publish_to)
    assert header.first().seq == 2 and issues.count() == 3


def test_publishing_guard(spark, engine):
    """Old data isn't published over a newer snapshot; a snapshot that isn't there is none."""
    assert specs.read_issues(spark, engine.publish_to) is None
    engine.bootstrap(seq=5, end_s=0)
    assert specs.read_issues(spark, engine.publish_to)[1].first().seq == 5
    assert engine.process(changes(spark, ("N", 6, 1, {"name": "x"})), 1, seq=4, end_s=9_990)
    assert specs.read_issues(spark, engine.publish_to)[1].first().seq == 5


def test_catching_up(spark, engine):
    """Steps that are done are left out, a failing one is tried again, a missing file ends the run."""
    engine.bootstrap(end_s=3600)
    steps, calls = replication.plan(3540, {60: 3780}), []

    def read(period, start, end):
        calls.append(start)
        if calls == [3600]:
            raise OSError("gone for now")
        return changes(spark, ("N", 7, 1, {"name": "*"})) if start < 3720 else None

    assert engine.catch_up(steps, read, wait_s=0) == 2 and calls == [3600, 3600, 3660, 3720]
    assert engine.snapshots.progress()["end_s"] == 3720 and ("Names", "N", 7, None) in found(engine)
    with pytest.raises(OSError):
        engine.catch_up([(60, 3720, 3780)], lambda *_: (_ for _ in ()).throw(OSError("no")), wait_s=0, tries=2)


def test_features_listed_twice(spark):
    twice = spark.createDataFrame([("N", 1), ("N", 1), ("W", 1)], "osm_type string, osm_id long")
    with pytest.raises(ValueError, match="N 1"):
        features.unique(twice)


def test_callbacks(spark, tmp_path):
    e = spark.createDataFrame([("N", k, {"place": "town"} if k % 2 else {"name": "x"}) for k in range(6)], "etype string, id long, tags map<string,string>")
    places = [filters.ElementFilter("N", (filters.TagFilter("place"),)), filters.ElementFilter("N", ids=(1, 2))]
    got = callbacks.validate(e, places, lambda r: "low" if r["id"] < 3 else None)
    assert sorted((r.id, r.reason) for r in got.collect()) == [(1, "low"), (2, "low")]
    out = tmp_path / "seen"
    out.mkdir()
    callbacks.process(e, places, lambda r: (out / f"{r.id}-{len(list(out.iterdir()))}").write_text(json.dumps(r.tags)))
    assert sorted({int(p.name.split("-")[0]) for p in out.iterdir()}) == [1, 2, 3, 5]
