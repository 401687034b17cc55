"""Expected features against actual tags, and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

ISSUE = "ImportantFeatures"


def tag_issues(features: DataFrame, actual: DataFrame) -> DataFrame:
    """Issues of features (osm_type, osm_id, tags map<string,array<string>>, is_array map<string,boolean>) whose
    element in ``actual`` (etype, id, deleted, tags) is deleted or has other tags; elements that aren't in ``actual`` have none."""
    f = features.withColumn("friendly_name", scalars.feature_name(F.col("tags")))
    j = f.join(actual.select(F.col("etype").alias("osm_type"), F.col("id").alias("osm_id"), "deleted", F.col("tags").alias("own")), ["osm_type", "osm_id"])
    head = ["friendly_name", F.lit(ISSUE).alias("issue_type"), "osm_type", "osm_id"]
    gone = j.where("deleted").select(*head, F.lit("Deleted").alias("details"))
    e = j.where(~F.col("deleted")).select("*", F.explode("tags").alias("k", "want")).where("k <> 'population'")
    found = F.col("own")[F.col("k")]
    many = F.coalesce(F.col("is_array")[F.col("k")], F.lit(False))
    q = lambda s: F.concat(F.lit("'"), s, F.lit("'"))
    text = (
        F.when(found.isNull(), F.concat(F.lit("Missing tag "), q(F.col("k")), F.lit(", expected it to be "), q(scalars.format_or(F.col("want")))))
        .when(~F.array_contains("want", found), F.concat(F.lit("Expected tag "), q(F.col("k")), F.lit(" to be "), F.when(many, scalars.format_or(F.col("want"))).otherwise(q(F.col("want")[0])), F.lit(", but found "), q(found)))
    )
    return gone.unionByName(e.withColumn("details", text).where("details is not null").select(*head, "details"))


def unique(features: DataFrame, keys: tuple[str, ...] = ("osm_type", "osm_id")) -> DataFrame:
    """The features, or an error if two have the same element."""
    twice = features.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError("listed twice: " + " ".join(str(twice[0][k]) for k in keys))
    return features


def name_issues(elements: DataFrame) -> DataFrame:
    """Elements (etype, id, tags) whose name is '*'."""
    return elements.where(F.col("tags")["name"] == "*").select(F.lit(None).cast("string").alias("friendly_name"), F.lit("Names").alias("issue_type"), F.col("etype").alias("osm_type"), F.col("id").alias("osm_id"), F.lit(None).cast("string").alias("details"))
