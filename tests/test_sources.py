import gzip
import json
import struct
import zlib

import pytest

from tidewarden.sources import osc, pbf, specs
from tidewarden.sources.state import Snapshots


def vi(n):
    out = b""
    n &= (1 << 64) - 1
    while n >= 0x80:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def zz(n):
    return vi((n << 1) ^ (n >> 63))


def f(k, v):
    return vi(k << 3 | 2) + vi(len(v)) + v if isinstance(v, bytes) else vi(k << 3) + vi(v)


def delta(xs):
    return b"".join(zz(x - y) for x, y in zip(xs, [0, *xs]))


def blob(kind, data):
    body = f(2, len(data)) + f(3, zlib.compress(data))
    head = f(1, kind.encode()) + f(3, len(body))
    return struct.pack(">I", len(head)) + head + body


@pytest.fixture
def pbf_file(tmp_path):
    strings = [b"", b"natural", b"coastline", b"name", "Älv".encode(), b"outer", b"boundary", b"administrative", b"type"]
    table = f(1, b"".join(f(1, s) for s in strings))
    dense = f(1, delta([10, 12, 15])) + f(8, delta([600000000, 610000000, -50])) + f(9, delta([100, -200, 300])) + f(10, vi(3) + vi(4) + vi(0) + vi(0) + vi(1) + vi(2) + vi(0))
    way = f(1, 7) + f(2, vi(1)) + f(3, vi(2)) + f(8, delta([10, 15, 12, 10]))
    other = f(1, 9) + f(2, vi(3)) + f(3, vi(4)) + f(8, delta([10, 12]))
    rel = f(1, 3) + f(2, vi(6) + vi(8)) + f(3, vi(7) + vi(6)) + f(8, vi(5) + vi(0)) + f(9, delta([7, 10])) + f(10, vi(1) + vi(0))
    half = f(1, 4) + f(2, vi(6)) + f(3, vi(7))
    path = tmp_path / "x.pbf"
    groups = [f(2, f(2, dense)), f(2, f(3, way) + f(3, other)), f(2, f(4, rel) + f(4, half))]
    path.write_bytes(blob("OSMHeader", b"") + b"".join(blob("OSMData", table + g) for g in groups))
    return str(path)


def test_pbf(spark, pbf_file):
    pbf.register(spark)
    read = lambda **o: spark.read.format("mappbf").options(**o).load(pbf_file)
    nodes = {r.id: (round(r.lat, 7), round(r.lon, 7), r.tags) for r in read(kind="N").collect()}
    assert nodes == {10: (60.0, 0.00001, {"name": "Älv"}), 12: (61.0, -0.00002, {}), 15: (-0.000005, 0.00003, {"natural": "coastline"})}
    ways = read(kind="W", tags=json.dumps({"natural": ["coastline"]})).collect()
    assert [(r.id, r.nodes) for r in ways] == [(7, [10, 15, 12, 10])]
    rel = read(kind="R", tags=json.dumps({"boundary": ["administrative"], "type": []})).collect()
    assert [(r.id, [tuple(m) for m in r.members]) for r in rel] == [(3, [("W", 7, "outer"), ("N", 10, "")])]
    assert {r.id for r in read(kind="R").collect()} == {3, 4}
    assert [r.id for r in read(kind="N", ids="12,99").collect()] == [12]
    assert [x[:2] for x in pbf.blob_index(pbf_file)] == [("N", 10), ("W", 7), ("R", 3)]


def test_change_file(spark, tmp_path):
    text = """<osmChange><create><node id="1" version="1" lat="1.5" lon="2.5"><tag k="place" v="town"/></node></create>
    <modify><way id="2" version="3"><nd ref="1"/><nd ref="5"/></way><relation id="3" version="2"><member type="way" ref="2" role="outer"/></relation></modify>
    <delete><node id="9" version="4"/></delete><modify><node id="1" version="2" lat="1" lon="2"/></modify></osmChange>"""
    folder = tmp_path / "000" / "001"
    folder.mkdir(parents=True)
    with gzip.open(folder / "042.osc.gz", "wt") as g:
        g.write(text)
    rows = osc.read_changes(spark, str(folder / "042.osc.gz")).orderBy("sec", "pos").collect()
    assert [(r.sec, r.etype, r.id, r.version) for r in rows] == [(0, "N", 1, 1), (1, "W", 2, 3), (1, "R", 3, 2), (1, "N", 1, 2), (2, "N", 9, 4)]
    assert rows[0].file_seq == 1042 and rows[0].tags == {"place": "town"} and rows[1].nodes == [1, 5]
    assert [tuple(m) for m in rows[2].members] == [("W", 2, "outer")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.state.txt").write_text("# x\n\nsequenceNumber=12\ntimestamp=2024-01-02T03\\:04\\:00Z\n")
    (r,) = osc.read_states(spark, str(tmp_path / "s"), 60).collect()
    assert (r.seq, str(r.end_ts)) == (12, "2024-01-02 03:04:00")


def test_specs(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"RelationId": 5, "EnglishName": "X", "Iso2": "XX", "Iso3": "XXX", /* c */ "Admins": {"4": [9, 7], "10": []}}')
    rows = specs.read_expected(spark, str(p)).collect()
    assert {(r.country_id, r.level, r.admin_id) for r in rows} == {(5, 4, 9), (5, 4, 7), (5, 10, None)}
    p.write_text('[{"osm_type": "node", "osm_id": 3, "tags": {"a": "b", "c": ["d", "e"]}, "wkt": "", "category": "k"}]')
    (r,) = specs.read_features(spark, str(p)).collect()
    assert r.tags == {"a": ["b"], "c": ["d", "e"]} and r.is_array == {"a": False, "c": True} and r.osm_type == "N"
    assert specs.should_publish(0, 100, 9, 5) and specs.should_publish(0, 900, 4, 5) and not specs.should_publish(0, 900, 9, 5)


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "st"))
    assert s.table("t") is None and s.version() is None
    assert s.commit(0, {"t": spark.range(3)}, {"seq": 1})
    assert s.commit(1, {"t": s.table("t").where("id > 0")}, {"seq": 2})
    assert not s.commit(1, {"t": spark.range(9)})
    assert s.table("t").count() == 2 and s.progress() == {"seq": 2}


def test_kept_index(spark, pbf_file, tmp_path):
    """The index is made once; with it, only the blobs of a kind that can hold the ids are read."""
    pbf.register(spark)
    assert pbf.latest_base(spark, str(tmp_path)) is None
    index = pbf.build_index(spark, pbf_file)
    assert [(r.kind, r.first_id) for r in index.orderBy("offset").collect()] == [("N", 10), ("W", 7), ("R", 3)]
    assert pbf.max_blob_bytes(index) > 0 and pbf.max_blob_bytes(index.limit(0)) == 0
    assert sorted(r.id for r in pbf.load(spark, pbf_file, "N", index).collect()) == [10, 12, 15]
    assert [r.id for r in pbf.load(spark, pbf_file, "N", index, ids=[12, 99]).collect()] == [12]
    assert pbf.load(spark, pbf_file, "W", index, ids=[1]).count() == 0
    blobs = pbf.load(spark, pbf_file, "R", index)
    assert {r.id for r in blobs.collect()} == {3, 4}
    # what is kept is taken as it is, unless asked not to
    spark.createDataFrame([("N", 1, 5, 6)], pbf.INDEX).write.mode("overwrite").parquet(f"{pbf_file}.index")
    assert pbf.build_index(spark, pbf_file).count() == 1 and pbf.build_index(spark, pbf_file, ignore_cache=True).count() == 3
    for name in ("planet-240101.osm.pbf", "planet-240201.osm.pbf", "other.pbf"):
        (tmp_path / name).write_bytes(b"")
    assert pbf.latest_base(spark, str(tmp_path)).endswith("planet-240201.osm.pbf")


def test_metadata(spark, tmp_path):
    table = f(1, f(1, b""))
    info = f(1, vi(3) + vi(4)) + f(2, delta([1_700_000_000, 1_700_000_060]))
    dense = f(1, delta([5, 6])) + f(5, info) + f(8, delta([10, 20])) + f(9, delta([30, 40])) + f(10, vi(0) + vi(0))
    path = tmp_path / "m.pbf"
    path.write_bytes(blob("OSMData", table + f(2, f(2, dense))))
    pbf.register(spark)
    rows = spark.read.format("mappbf").options(kind="N", metadata="true").load(str(path)).collect()
    assert [(r.id, r.version, r.ts) for r in rows] == [(5, 3, 1_700_000_000), (6, 4, 1_700_000_060)]
    assert pbf.data_timestamp(str(path), pbf.build_index(spark, str(path))) == 1_700_000_060


def test_cached_changes(spark, tmp_path):
    """A file comes through the cache, past it if what is kept there can't be read; one that isn't there is None."""
    text = "<osmChange><create><node id='1' version='1' lat='1' lon='2'/></create></osmChange>"
    source, cache = tmp_path / "source" / "000" / "000", tmp_path / "cache"
    source.mkdir(parents=True)
    with gzip.open(source / "007.osc.gz", "wt") as g:
        g.write(text)
    read = lambda path, **o: osc.read_cached(spark, str(tmp_path / "source"), str(cache), 60, path, wait_s=0, **o)
    assert [r.id for r in read("000/000/007.osc.gz").collect()] == [1]
    kept = cache / "60" / "000" / "000" / "007.osc.gz"
    assert kept.exists() and read("000/000/008.osc.gz") is None
    kept.write_bytes(b"broken")
    (kept.parent / ".007.osc.gz.crc").unlink(missing_ok=True)
    assert [r.id for r in read("000/000/007.osc.gz").collect()] == [1]
    (source / "007.osc.gz").write_bytes(b"broken too")
    kept.unlink()
    (kept.parent / ".007.osc.gz.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="osc|change|gz|header|Malformed"):
        read("000/000/007.osc.gz", tries=2)


def test_filters_of_a_scan(spark, pbf_file):
    from tidewarden.functions import filters as fl

    pbf.register(spark)
    named, coast = fl.ElementFilter("N", (fl.TagFilter("name"),)), fl.ElementFilter("N", (fl.TagFilter("natural", ("coastline",)), fl.TagFilter("name", ("x",))))
    areas = fl.ElementFilter("R", (fl.TagFilter("boundary", ("administrative",)), fl.TagFilter("type", ("boundary",))))
    ids = lambda kind, *chosen: sorted(r.id for r in pbf.load_filtered(spark, pbf_file, kind, list(chosen)).collect())
    assert fl.merged_tags([named, coast]) == {"N": {"name": ("x",), "natural": ("coastline",)}}
    assert ids("N", named, coast, fl.COASTLINE) == [10, 15] and ids("N", coast) == [15] and ids("N", fl.COASTLINE) == []
    assert ids("W", fl.COASTLINE, named) == [7]
    assert ids("R", areas) == [3] and ids("R", areas, fl.ElementFilter("R", (fl.TagFilter("boundary"),))) == [3, 4]


def test_stale(spark):
    from pyspark.sql import functions as F

    from tidewarden.functions import scalars

    ts = lambda x: F.lit(f"2024-01-01 00:{x}:00").cast("timestamp")
    assert spark.range(1).select(scalars.is_stale(ts("00"), ts("11")), scalars.is_stale(ts("00"), ts("09"))).first()[:] == (True, False)
