"""Issue snapshots and their views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..schemas import BLOCKING_TYPES, ISSUE_TYPES

KEY = ("issue_type", "osm_type", "osm_id", "details")


def first_seen(current: DataFrame, previous: DataFrame | None, run_ts: Column) -> DataFrame:
    """Issues with the time they were first seen: that of the same issue in the previous snapshot, else now.

    An issue is its type, element and details (null equals null); its name doesn't count. Repeats in the
    previous snapshot are one; which one of them has the time doesn't matter to us, the least is taken."""
    if previous is None:
        return current.withColumn("first_seen", run_ts)
    p = previous.groupBy(*KEY).agg(F.min("first_seen").alias("p_seen")).select(*[F.col(c).alias(f"p_{c}") for c in KEY], "p_seen", F.lit(True).alias("p_known"))
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in KEY]
    j = current.join(p, same, "left")
    return j.select(*[current[c] for c in current.columns], F.when(F.col("p_known"), F.col("p_seen")).otherwise(run_ts).alias("first_seen"))


def header(current: DataFrame, run_ts: Column, seq: Column, previous: DataFrame | None = None) -> DataFrame:
    """One row: run_ts, seq, last_good_ts, last_good_seq. A run without a blocking issue is good; else the previous good one stays."""
    bad = current.agg(F.coalesce(F.bool_or(F.col("issue_type").isin(*BLOCKING_TYPES)), F.lit(False)).alias("bad"))
    old = previous.select("last_good_ts", "last_good_seq") if previous is not None else current.sparkSession.createDataFrame([(datetime(1, 1, 1), -1)], "last_good_ts timestamp, last_good_seq bigint")
    return bad.crossJoin(old.limit(1)).select(run_ts.alias("run_ts"), seq.cast("bigint").alias("seq"), F.when(F.col("bad"), F.col("last_good_ts")).otherwise(run_ts).alias("last_good_ts"), F.when(F.col("bad"), F.col("last_good_seq")).otherwise(seq.cast("bigint")).alias("last_good_seq"))


def overview(issues: DataFrame) -> DataFrame:
    """(pos, issue_type, n, colour) for a fixed list of types, in its order, with zeros."""
    types = issues.sparkSession.createDataFrame(list(enumerate(ISSUE_TYPES)), "pos int, issue_type string")
    n = issues.groupBy("issue_type").agg(F.count("*").alias("n"))
    j = types.join(n, "issue_type", "left").select("pos", "issue_type", F.coalesce("n", F.lit(0)).alias("n"))
    return j.withColumn("colour", scalars.overview_colour(F.col("issue_type"), F.col("n")))


def page(issues: DataFrame, issue_type: str) -> DataFrame:
    """The issues of a type by day, newest first, then by element."""
    return (
        issues.where(F.col("issue_type") == issue_type)
        .select(F.to_date("first_seen").alias("day"), scalars.day_title(F.col("first_seen")).alias("title"), "first_seen", "osm_type", "osm_id", scalars.element_url(F.col("osm_type"), F.col("osm_id")).alias("url"), "friendly_name", "details")
        .orderBy(F.desc("day"), F.desc("first_seen"), "osm_type", "osm_id")
    )


def links(elements: DataFrame) -> DataFrame:
    """(osm_type, osm_id) with the links that a page shows: the element, for relations an analysis, and a local editor."""
    kind, ident = F.col("osm_type"), F.col("osm_id")
    return elements.select("osm_type", "osm_id", scalars.element_url(kind, ident).alias("page"), F.when(kind == "R", scalars.analyzer_url(ident)).alias("analyzer"), scalars.editor_url(kind, ident).alias("editor"))
