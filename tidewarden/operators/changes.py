"""Merging change files and finding what they affect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ZERO = "named_struct('v', 0, 'tomb', false, 'file_seq', cast(null as bigint), 'sec', cast(null as int), 'pos', cast(null as bigint))"
_FOLD = f"""aggregate(sort_array(collect_list(struct(file_seq, sec, pos, coalesce(version, 0) as version))), {_ZERO},
  (a, x) -> case when x.sec > 0 and a.v > x.version then a
                 when x.sec = 2 then named_struct('v', 0, 'tomb', true, 'file_seq', x.file_seq, 'sec', x.sec, 'pos', x.pos)
                 else named_struct('v', x.version, 'tomb', false, 'file_seq', x.file_seq, 'sec', x.sec, 'pos', x.pos) end)"""


def merge(changes: DataFrame) -> DataFrame:
    """One row of (etype, id): the change that stands after all files in order, and whether it deletes.

    A create always stands; a modification or deletion only if what stands isn't
    newer; a deletion forgets its version, so an older modification can revive
    an element. The fold sees keys only; the payload is joined afterwards."""
    won = changes.groupBy("etype", "id").agg(F.expr(_FOLD).alias("w"))
    won = won.where("w.file_seq is not null").select("etype", "id", F.col("w.tomb").alias("deleted"), F.col("w.v").cast("int").alias("kept_version"), F.col("w.file_seq").alias("file_seq"), F.col("w.sec").alias("sec"), F.col("w.pos").alias("pos"))
    rest = [c for c in changes.columns if c not in ("etype", "id", "file_seq", "sec", "pos")]
    payload = changes.select("etype", "id", "file_seq", "sec", "pos", *rest)
    return won.join(payload, ["etype", "id", "file_seq", "sec", "pos"]).drop("sec")


def _modified(merged: DataFrame, kind: str) -> DataFrame:
    return merged.where((F.col("etype") == kind) & ~F.col("deleted") & (F.col("version") >= 2)).select("id")


def changed_ways(merged: DataFrame, node_way: DataFrame) -> DataFrame:
    """Ways of modified nodes, and modified ways; first versions and deletions don't count."""
    by_node = node_way.join(_modified(merged, "N"), node_way.node_id == F.col("id")).select(F.col("way_id").alias("id"))
    return by_node.unionByName(_modified(merged, "W")).distinct()


def changed_relations(merged: DataFrame, node_way: DataFrame, way_relation: DataFrame, node_relation: DataFrame, tracked: DataFrame) -> DataFrame:
    """Relations of changed ways and modified nodes, and tracked relations that changed or were deleted."""
    ways, nodes = changed_ways(merged, node_way), _modified(merged, "N")
    by_way = way_relation.join(ways, way_relation.way_id == ways.id).select(F.col("rel_id").alias("id"))
    by_node = node_relation.join(nodes, node_relation.node_id == nodes.id).select(F.col("rel_id").alias("id"))
    direct = merged.where("etype = 'R'").select("id").join(tracked.select("id"), "id", "left_semi")
    return by_way.unionByName(by_node).unionByName(direct).distinct()


def changed_coastlines(merged: DataFrame, node_way: DataFrame, coastlines: DataFrame) -> DataFrame:
    """Known coastlines of modified nodes, and every way that changed itself (direct)."""
    direct = merged.where("etype = 'W'").select("id")
    by_node = changed_ways(merged, node_way).join(direct, "id", "left_anti").join(coastlines.select("id"), "id", "left_semi")
    return by_node.withColumn("direct", F.lit(False)).unionByName(direct.withColumn("direct", F.lit(True)))


def tracker_edges(relation_members: DataFrame, way_nodes: DataFrame) -> dict[str, DataFrame]:
    """Inverted indexes of what relations and ways consist of, as distinct edges."""
    by_way = relation_members.where("type = 'W'").select(F.col("ref").alias("way_id"), "rel_id").distinct()
    return {
        "node_way": way_nodes.join(by_way.select("way_id").distinct(), "way_id", "left_semi").select("node_id", "way_id").distinct(),
        "way_relation": by_way,
        "node_relation": relation_members.where("type = 'N'").select(F.col("ref").alias("node_id"), "rel_id").distinct(),
        "tracked": relation_members.select(F.col("rel_id").alias("id")).distinct(),
    }


def locate(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each period and timestamp the sequence whose span [start, end) holds it, else the first that starts after.

    ``states`` has period_s, seq, end_ts; ``wanted`` has period_s, ts."""
    ends = states.select("period_s", F.col("end_ts").alias("ts"), "seq", F.lit(0).alias("q"))
    asked = wanted.select("period_s", "ts").distinct().select("period_s", "ts", F.lit(None).cast("bigint").alias("seq"), F.lit(1).alias("q"))
    # from the latest time back: the least sequence whose end lies behind; states are a row a minute, so a period's are sorted together
    w = Window.partitionBy("period_s").orderBy(F.col("ts").desc(), F.col("q").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ends.unionByName(asked).withColumn("seq", F.min("seq").over(w)).where("q = 1 and seq is not null").select("period_s", "ts", "seq")
