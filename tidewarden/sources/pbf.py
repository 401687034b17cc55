"""Map data in the PBF format as a Spark data source.

``spark.read.format("mappbf").option("kind", "N").load(path)`` gives nodes, "W"
ways, "R" relations, in the schemas of ``schemas.py``.  A file is planned as
ranges of blobs; tasks read, inflate and decode only their ranges.  Options:
``tags`` (JSON: key to list of values, empty for any) keeps nodes and ways with
any of these tags and relations with all of them, tested on string numbers
before an element is built; ``ids`` (comma-separated) keeps these elements and,
by the blob index, reads only blobs that can hold them; ``blobs`` (JSON: pairs of
offset and size, as ``load`` takes them from a kept index) reads these alone;
``metadata`` adds version and timestamp columns.  Files are opened by pyarrow, so any of its
file systems can hold them.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import filters
from ..schemas import NODES, RELATIONS, WAYS

_KINDS = ("N", "W", "R")


def open_file(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        if x < 0x80:
            return out, at
        shift += 7


def fields(b: bytes):
    """(number, value) of a message: integers for varints, bytes for what has a length."""
    at, end = 0, len(b)
    while at < end:
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            v, at = varint(b, at)
        elif kind == 2:
            n, at = varint(b, at)
            v, at = b[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, at = b[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, v


def packed(b: bytes) -> np.ndarray:
    """All varints of a packed field."""
    x = np.frombuffer(b, np.uint8)
    if not len(x):
        return np.empty(0, np.uint64)
    end = np.flatnonzero(x < 0x80)
    start = np.concatenate([[0], end[:-1] + 1])
    shift = (np.arange(len(x)) - np.repeat(start, end - start + 1)) * 7
    return np.bitwise_or.reduceat((x & 0x7F).astype(np.uint64) << shift.astype(np.uint64), start)


def zigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def deltas(b: bytes) -> np.ndarray:
    return np.cumsum(zigzag(packed(b)))


def walk(f, start: int = 0):
    """(offset of the blob's data, size, type) of all blobs from a place on."""
    f.seek(start)
    while True:
        head = f.read(4)
        if len(head) < 4:
            return
        (n,) = struct.unpack(">I", head)
        h = dict(fields(f.read(n)))
        size = h[3]
        at = f.tell()
        yield at, size, h[1].decode()
        f.seek(at + size)


def inflate(b: bytes) -> bytes:
    blob = dict(fields(b))
    if 1 in blob:
        return blob[1]
    out = zlib.decompress(blob[3])
    if 2 in blob and len(out) != blob[2]:
        raise ValueError("size of inflated blob")
    return out


class Block:
    """A decoded primitive block."""

    def __init__(self, raw: bytes):
        self.groups, self.strings = [], []
        self.granularity, self.lat0, self.lon0, self.dates = 100, 0, 0, 1000
        for k, v in fields(raw):
            if k == 1:
                self.strings = [s for _, s in fields(v)]
            elif k == 2:
                self.groups.append(v)
            elif k == 17:
                self.granularity = v
            elif k == 18:
                self.dates = v
            elif k in (19, 20):
                v = v - (1 << 64) if v >> 63 else v
                self.lat0, self.lon0 = (v, self.lon0) if k == 19 else (self.lat0, v)

    def first(self) -> tuple[str, int] | None:
        """Kind and id of the first element."""
        for g in self.groups:
            for k, v in fields(g):
                if k == 2:
                    return "N", int(deltas(dict(fields(v))[1])[0])
                if k in (1, 3, 4):
                    i = dict(fields(v))[1]
                    return ("N", i >> 1 ^ -(i & 1)) if k == 1 else (_KINDS[k - 2], i)
        return None

    def _text(self, k: int) -> str:
        return self.strings[k].decode("utf-8", "replace")

    def wanted(self, tags: dict[str, list[str]]) -> dict[int, set[int] | None]:
        """Filters as string numbers; a key that the block doesn't have is left out."""
        number = {}
        for k, s in enumerate(self.strings):
            number.setdefault(s, k)
        out: dict[int, set[int] | None] = {}
        for key, values in tags.items():
            k = number.get(key.encode())
            if k is not None:
                out[k] = {number[v.encode()] for v in values if v.encode() in number} if values else None
        return out

    def elements(self, kind: str, tags: dict[str, list[str]] | None, ids: set[int] | None, metadata: bool):
        want = self.wanted(tags) if tags else None
        if tags and (not want or kind == "R" and len(want) < len(tags)):
            return

        def passes(keys, values) -> bool:
            if want is None:
                return True
            hits = {k for k, v in zip(keys, values) if k in want and (want[k] is None or v in want[k])}
            return len(hits) == len(want) if kind == "R" else bool(hits)

        def tag_map(keys, values):
            return {self._text(k): self._text(v) for k, v in zip(keys, values)}

        def info(m):
            if not metadata:
                return ()
            i = dict(fields(m.get(4, b"")))
            return i.get(1), i[2] * self.dates // 1000 if 2 in i else None

        scale = 1e-9
        for g in self.groups:
            for k, v in fields(g):
                if k == 2 and kind == "N":
                    m = dict(fields(v))
                    own = deltas(m[1])
                    lat, lon = (scale * (o + self.granularity * deltas(m[f])) for f, o in ((8, self.lat0), (9, self.lon0)))
                    kv = packed(m.get(10, b"")).astype(np.int64).tolist()
                    more = [(None, None)] * len(own)
                    if metadata and 5 in m:
                        d = dict(fields(m[5]))
                        stamps = deltas(d[2]) * self.dates // 1000 if 2 in d else [None] * len(own)
                        more = list(zip(packed(d[1]).astype(np.int64).tolist() if 1 in d else [None] * len(own), [int(t) if t is not None else None for t in stamps]))
                    at = 0
                    for n, i in enumerate(own.tolist()):
                        keys, values = [], []
                        while at < len(kv) and kv[at]:
                            keys.append(kv[at])
                            values.append(kv[at + 1])
                            at += 2
                        at += 1
                        if (ids is None or i in ids) and passes(keys, values):
                            yield (i, float(lat[n]), float(lon[n]), tag_map(keys, values), *(more[n] if metadata else ()))
                elif k == 1 and kind == "N" or k == 3 and kind == "W" or k == 4 and kind == "R":
                    m = dict(fields(v))
                    i = m[1]
                    if k == 1:
                        i = i >> 1 ^ -(i & 1)
                    if ids is not None and i not in ids:
                        continue
                    keys, values = (packed(m.get(f, b"")).astype(np.int64).tolist() for f in (2, 3))
                    if not passes(keys, values):
                        continue
                    if k == 1:
                        z = lambda x: x >> 1 ^ -(x & 1)
                        yield (i, scale * (self.lat0 + self.granularity * z(m[8])), scale * (self.lon0 + self.granularity * z(m[9])), tag_map(keys, values), *info(m))
                    elif k == 3:
                        yield (i, deltas(m.get(8, b"")).tolist(), tag_map(keys, values), *info(m))
                    else:
                        roles, refs, kinds = packed(m.get(8, b"")).tolist(), deltas(m.get(9, b"")).tolist(), packed(m.get(10, b"")).tolist()
                        yield (i, [(_KINDS[t], r, self._text(s)) for s, r, t in zip(roles, refs, kinds)], tag_map(keys, values), *info(m))


def blob_index(path: str) -> list[tuple[str, int, int]]:
    """(kind, first id, offset of the blob's data), sorted; by kinds as they are in a file: nodes, ways, relations."""
    with open_file(path) as f:
        out = []
        for at, size, kind in list(walk(f)):
            if kind == "OSMData":
                f.seek(at)
                first = Block(inflate(f.read(size))).first()
                if first:
                    out.append((*first, at))
    return sorted(out, key=lambda x: (_KINDS.index(x[0]), x[1]))


INDEX = "kind string, first_id bigint, offset bigint, size bigint"


def build_index(spark: SparkSession, path: str, keep: str | None = None, ignore_cache: bool = False) -> DataFrame:
    """(kind, first_id, offset, size) of all blobs, sorted, kept as a table at ``keep`` (default: beside the file).

    The driver reads the heads of blobs only; tasks inflate them. One entry stands for some megabytes."""
    keep = keep or f"{path}.index"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{keep}/_SUCCESS")
    if ignore_cache or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        with open_file(path) as f:
            blobs = [(at, size) for at, size, kind in walk(f) if kind == "OSMData"]

        def first(batches):
            with open_file(path) as f:
                for pdf in batches:
                    out = []
                    for at, size in zip(pdf.offset.tolist(), pdf["size"].tolist(), strict=True):
                        f.seek(at)
                        got = Block(inflate(f.read(size))).first()
                        if got:
                            out.append((*got, at, size))
                    yield pd.DataFrame(out, columns=["kind", "first_id", "offset", "size"])

        tasks = max(1, min(len(blobs), 10_000, sum(x[1] for x in blobs) >> 26))
        found = spark.createDataFrame(blobs, "offset bigint, size bigint").repartition(tasks, "offset").mapInPandas(first, INDEX)
        found.coalesce(1).sortWithinPartitions("kind", "first_id").write.mode("overwrite").parquet(keep)
    return spark.read.schema(INDEX).parquet(keep)


def max_blob_bytes(index: DataFrame) -> int:
    """The largest blob's size, 0 without blobs: what a task holds at least."""
    return index.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]


def data_timestamp(path: str, index: DataFrame) -> int | None:
    """Seconds of the last node of the last blob of nodes: how far the data goes."""
    last = index.where("kind = 'N'").orderBy(F.desc("first_id")).limit(1).collect()
    if not last:
        return None
    with open_file(path) as f:
        f.seek(last[0].offset)
        stamps = [x[-1] for x in Block(inflate(f.read(last[0]["size"]))).elements("N", None, None, True)]
    return stamps[-1] if stamps else None


def load(spark: SparkSession, path: str, kind: str, index: DataFrame | None = None, ids: list[int] | None = None, **options: str) -> DataFrame:
    """Elements of a kind; with an index, only blobs of that kind are read, and of ids only those that can hold them."""
    reader = spark.read.format("mappbf").option("kind", kind).options(**options)
    if ids is not None:
        reader = reader.option("ids", ",".join(map(str, sorted(set(ids)))))
    if index is not None:
        own = sorted((r.first_id, r.offset, r["size"]) for r in index.where(F.col("kind") == kind).collect())
        if ids is not None:
            firsts = [x[0] for x in own]
            places = {int(np.searchsorted(firsts, i, "right")) - 1 for i in ids}
            own = [own[k] for k in sorted(places) if k >= 0]
        reader = reader.option("blobs", json.dumps([x[1:] for x in own]))
    return reader.load(path)


def load_filtered(spark: SparkSession, path: str, kind: str, chosen: list[filters.ElementFilter], index: DataFrame | None = None) -> DataFrame:
    """Elements of a kind that any of the filters takes, in one scan: it gets the keys and values of all, united, and
    each filter is applied to what passes."""
    own = [f for f in chosen if f.kind == kind and f.tags]
    if not own:
        return load(spark, path, kind, index).limit(0)
    tags = filters.merged_tags(own)[kind]
    # a key that some filter wants with any value is wanted with any; relations need all keys, so only those of one filter
    bare = {t.key for f in own for t in f.tags if not t.values}
    push = {"tags": json.dumps({k: [] if k in bare else list(v) for k, v in tags.items()})} if kind != "R" or len(own) == 1 else {}
    return load(spark, path, kind, index, **push).where(reduce(or_, [f.scan(F.col("tags")) for f in own]))


def latest_base(spark: SparkSession, folder: str, pattern: str = "planet-*.osm.pbf") -> str | None:
    """The last file of a folder by name, None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return max((f.getPath().toString() for f in found), default=None)


class _Range(InputPartition):
    def __init__(self, blobs: list[tuple[int, int]]):
        self.blobs = blobs


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "N")
        self.tags = json.loads(options["tags"]) if "tags" in options else None
        self.ids = {int(x) for x in options["ids"].split(",") if x} if "ids" in options else None
        self.metadata = options.get("metadata", "false").lower() == "true"
        self.bytes = int(options.get("bytesPerPartition", 64 << 20))
        self.blobs = json.loads(options["blobs"]) if "blobs" in options else None

    def _planned(self) -> list[tuple[int, int]]:
        if self.blobs is not None:
            return sorted((int(at), int(size)) for at, size in self.blobs)
        keep = None
        if self.ids is not None:
            # the blob that may hold an id is the last one that starts at or before it
            own = [(first, at) for kind, first, at in blob_index(self.path) if kind == self.kind]
            firsts = [x[0] for x in own]
            keep = {own[k][1] for i in self.ids if (k := int(np.searchsorted(firsts, i, "right")) - 1) >= 0}
        with open_file(self.path) as f:
            return [(at, size) for at, size, kind in walk(f) if kind == "OSMData" and (keep is None or at in keep)]

    def partitions(self):
        out, now, total = [], [], 0
        for at, size in self._planned():
            now.append((at, size))
            total += size
            if total >= self.bytes:
                out.append(_Range(now))
                now, total = [], 0
        if now or not out:
            out.append(_Range(now))
        return out

    def read(self, partition):
        left = None if self.ids is None else set(self.ids)
        with open_file(self.path) as f:
            for at, size in partition.blobs:
                f.seek(at)
                for row in Block(inflate(f.read(size))).elements(self.kind, self.tags, left, self.metadata):
                    if left is not None:
                        left.discard(row[0])
                    yield row
                if left is not None and not left:  # all are found
                    return


class MapPbf(DataSource):
    """Registered by ``register(spark)`` as mappbf."""

    @classmethod
    def name(cls) -> str:
        return "mappbf"

    def schema(self) -> str:
        more = ", version int, ts bigint" if self.options.get("metadata", "false").lower() == "true" else ""
        return {"N": NODES, "W": WAYS, "R": RELATIONS}[self.options.get("kind", "N")] + more

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(MapPbf)
