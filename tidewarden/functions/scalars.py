"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BLOCKING_TYPES


def kind_name(kind: Column) -> Column:
    """N, W, R to node, way, relation; an error for others."""
    return F.when(kind == "N", "node").when(kind == "W", "way").when(kind == "R", "relation").otherwise(F.raise_error(F.concat(F.lit("no such kind: "), kind)))


def friendly_name(tags: Column) -> Column:
    return F.coalesce(tags["name:en"], tags["name"], F.lit(""))


def feature_name(tags: Column) -> Column:
    """Of an expected feature, whose tags have lists of values."""
    pick = lambda k: F.array_join(tags[k], ", ")
    return F.coalesce(pick("name:en"), pick("name"), F.lit("Unnamed"))


def format_or(values: Column) -> Column:
    """'a' | 'a' or 'b' | 'a', 'b', or 'c'."""
    quoted = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    n = F.size(values)
    return (
        F.when(n == 1, quoted[0])
        .when(n == 2, F.concat_ws(" or ", quoted))
        .otherwise(F.concat(F.array_join(F.slice(quoted, 1, n - 1), ", "), F.lit(", or "), F.element_at(quoted, -1)))
    )


def sequence_path(seq: Column) -> Column:
    """AAA/BBB/CCC of a sequence number."""
    s = F.lpad(seq.cast("string"), 9, "0")
    return F.concat_ws("/", s.substr(1, 3), s.substr(4, 3), s.substr(7, 3))


def issue_type_of_level(level: Column) -> Column:
    return F.when(level > 6, F.concat(F.lit("OpenAdminPolygon"), level.cast("string"))).otherwise(F.lit("OpenAdminPolygon"))


def element_url(kind: Column, ident: Column, base: str = "https://www.openstreetmap.org") -> Column:
    return F.concat(F.lit(base + "/"), kind_name(kind), F.lit("/"), ident.cast("string"))


def analyzer_url(ident: Column) -> Column:
    """Page that analyses a relation. A fixed value."""
    return F.concat(F.lit("http://ra.osmsurround.org/analyzeRelation?relationId="), ident.cast("string"))


def editor_url(kind: Column, ident: Column) -> Column:
    """Asks a local editor to load an element with its members. A fixed value."""
    return F.concat(F.lit("http://localhost:8111/load_object?new_layer=true&objects="), F.lower(kind), ident.cast("string"), F.lit("&relation_members=true"))


def overview_colour(issue_type: Column, n: Column) -> Column:
    return F.when(n == 0, "green").when(issue_type.isin(*BLOCKING_TYPES), "red").otherwise("orange")


def day_title(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd  -  EEEE")


def is_stale(snapshot_ts: Column, now: Column, minutes: int = 10) -> Column:
    return snapshot_ts + F.expr(f"interval {minutes} minutes") < now


def state_file_url(base: str, seq: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), sequence_path(seq), F.lit(".state.txt"))


def diff_file_url(base: str, seq: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), sequence_path(seq), F.lit(".osc.gz"))
