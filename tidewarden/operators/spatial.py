"""Spatial joins by grid cells, segment predicates, range joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_cells(boxes: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that a box (minx, miny, maxx, maxy) touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    return boxes.withColumn("cx", F.explode(span("minx", "maxx"))).withColumn("cy", F.explode(span("miny", "maxy")))


def box_join(left: DataFrame, right: DataFrame, cell: float, on: tuple[str, ...] = (), before: str | None = None) -> DataFrame:
    """Pairs whose boxes meet; columns of the left get the prefix l_, of the right r_. ``on`` must be equal too,
    and the left's ``before`` less than the right's.

    A pair is made only in the cell of the corner that both boxes share, so
    nothing has to be made distinct."""
    a, b = with_cells(left, cell), with_cells(right, cell)
    a = a.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], "cx", "cy")
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], "cx", "cy")
    cond = [a.cx == b.cx, a.cy == b.cy, *[a[f"l_{c}"] == b[f"r_{c}"] for c in on]]
    meet = (F.col("l_minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("l_maxx")) & (F.col("l_miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("l_maxy"))
    home = (a.cx == F.floor(F.greatest("l_minx", "r_minx") / cell)) & (a.cy == F.floor(F.greatest("l_miny", "r_miny") / cell))
    if before:
        cond.append(a[f"l_{before}"] < b[f"r_{before}"])
    # the work is in pairs of rows: partitions that are small by their bytes must not be merged
    spark = left.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["cx", "cy"]
    return a.repartition(n, *keys, *[f"l_{c}" for c in on]).join(b.repartition(n, *keys, *[f"r_{c}" for c in on]), cond).where(meet & home).drop("cx", "cy")


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Sign of the turn from a to b to p."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments(lines: DataFrame) -> DataFrame:
    """Segments of (id, coords) with their boxes; repeated points are left out."""
    n = F.size("coords")
    pairs = F.arrays_zip(F.slice("coords", 1, n - 1).alias("a"), F.slice("coords", 2, n - 1).alias("b"))
    s = lines.where(n >= 2).select("id", F.posexplode(pairs).alias("k", "s")).select("id", "k", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    s = s.where("ax <> bx or ay <> by")
    return s.withColumns({"minx": F.least("ax", "bx"), "miny": F.least("ay", "by"), "maxx": F.greatest("ax", "bx"), "maxy": F.greatest("ay", "by")})


def proper_crossings(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of segments of different lines whose interiors cross in one point."""
    p = box_join(a, b, cell).where("l_id <> r_id")
    c = lambda n: F.col(n)
    o1 = side(c("l_ax"), c("l_ay"), c("l_bx"), c("l_by"), c("r_ax"), c("r_ay"))
    o2 = side(c("l_ax"), c("l_ay"), c("l_bx"), c("l_by"), c("r_bx"), c("r_by"))
    o3 = side(c("r_ax"), c("r_ay"), c("r_bx"), c("r_by"), c("l_ax"), c("l_ay"))
    o4 = side(c("r_ax"), c("r_ay"), c("r_bx"), c("r_by"), c("l_bx"), c("l_by"))
    return p.where((o1 * o2 < 0) & (o3 * o4 < 0))


def blob_ranges(index: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """(kind, first_id, offset) with the first id of the next blob; the last has none."""
    w = Window.partitionBy(*by).orderBy("first_id")
    return index.withColumn("next_id", F.lead("first_id").over(w))


def assign_blobs(ids: DataFrame, index: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """Each asked (kind, id) with the blob that may hold it; ids before the first blob have none.

    An index has an entry for some megabytes of a file: it is counted, sent to tasks as sorted arrays
    and searched there. A larger one is met in an order of ids and starts by ranges of ids, each range
    with the last start before it."""
    asked = ids.select("kind", "id").distinct()
    rows = index.select("kind", "first_id", "offset").limit(most_broadcast + 1).collect()
    if len(rows) <= most_broadcast:
        by_kind = {k: sorted((r.first_id, r.offset) for r in rows if r.kind == k) for k in {r.kind for r in rows}}
        starts = {k: (np.array([x[0] for x in v], np.int64), np.array([x[1] for x in v], np.int64)) for k, v in by_kind.items()}

        def search(batches):
            for b in batches:
                kind, ident = b.column("kind").to_pylist(), b.column("id").to_numpy()
                kinds, out = np.array(kind, dtype=object), np.full(len(kind), -1, np.int64)
                for k, (first, offset) in starts.items():
                    at = np.flatnonzero(kinds == k)
                    place = np.searchsorted(first, ident[at], "right") - 1
                    out[at] = np.where(place >= 0, offset[np.maximum(place, 0)], -1)
                found = pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), pa.array(out)], ["kind", "id", "offset"])
                yield found.filter(pa.array(out >= 0))

        return asked.mapInArrow(search, "kind string, id long, offset long")
    span = asked.groupBy("kind").agg(F.min("id").alias("a"), (F.greatest(F.lit(1), F.max("id") - F.min("id"))).alias("w"))
    part = F.greatest(F.lit(0), F.least(F.lit(1023), F.floor((F.col("id") - F.col("a")) * 1023 / F.col("w"))))
    u = index.select("kind", F.col("first_id").alias("id"), "offset", F.lit(0).alias("q")).unionByName(asked.select("kind", "id", F.lit(None).cast("bigint").alias("offset"), F.lit(1).alias("q"))).join(F.broadcast(span), "kind").withColumn("p", part)
    last = u.where("q = 0").groupBy("kind", "p").agg(F.max_by("offset", "id").alias("end"))
    before = last.select("kind", F.col("p").alias("from"), "end", F.explode(F.sequence(F.col("p") + 1, F.lit(1024))).alias("p")).groupBy("kind", "p").agg(F.max_by("end", "from").alias("carried"))
    w = Window.partitionBy("kind", "p").orderBy("id", "q").rowsBetween(Window.unboundedPreceding, 0)
    out = u.withColumn("offset", F.last("offset", ignorenulls=True).over(w)).where("q = 1").join(before, ["kind", "p"], "left")
    return out.withColumn("offset", F.coalesce("offset", "carried")).where("offset is not null").select("kind", "id", "offset")


def node_way_buckets(way_nodes: DataFrame, width: int = 100_000_000) -> DataFrame:
    """(bucket, node_id, way_id), the buckets being ranges of node ids; written with ``partitionBy("bucket")``."""
    return way_nodes.select(F.floor(F.col("node_id") / width).alias("bucket"), "node_id", "way_id").distinct()
