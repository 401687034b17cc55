"""JSON specifications: expected areas of countries, expected features, issue snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRY = "RelationId bigint, EnglishName string, Iso2 string, Iso3 string, Admins map<string,array<bigint>>"
FEATURE = "osm_type string, osm_id bigint, tags map<string,string>, wkt string, category string"


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """One row of (country, level, area), a country without areas has one with nulls. Comments in the files are allowed."""
    raw = spark.read.option("multiLine", True).option("allowComments", True).schema(COUNTRY).json(path)
    x = raw.select(F.col("RelationId").alias("country_id"), F.col("EnglishName").alias("name"), F.col("Iso2").alias("iso2"), F.col("Iso3").alias("iso3"), F.explode_outer("Admins").alias("level", "ids"))
    return x.select("country_id", "name", "iso2", "iso3", F.col("level").cast("int").alias("level"), F.explode_outer("ids").alias("admin_id")).distinct()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features whose tag values are a text or a list of texts: lists, and whether each was one."""
    raw = spark.read.option("multiLine", True).option("allowComments", True).schema(FEATURE).json(path)
    kinds = F.create_map(*[F.lit(x) for k, v in (("node", "N"), ("way", "W"), ("relation", "R"), ("N", "N"), ("W", "W"), ("R", "R")) for x in (k, v)])
    is_list = lambda v: F.startswith(F.ltrim(v), F.lit("["))
    values = F.transform_values("tags", lambda _, v: F.when(is_list(v), F.from_json(v, "array<string>")).otherwise(F.array(v)))
    return raw.select(kinds[F.col("osm_type")].alias("osm_type"), "osm_id", values.alias("tags"), F.transform_values("tags", lambda _, v: is_list(v)).alias("is_array"), "wkt", "category")


def write_issues(issues: DataFrame, header: DataFrame, path: str) -> None:
    """One JSON document: the header with all issues nested, for readers of whole snapshots.

    A snapshot is what a page shows, thousands of rows; tables of issues are kept as Parquet."""
    rows = issues.agg(F.sort_array(F.collect_list(F.struct("issue_type", "osm_type", "osm_id", "friendly_name", "details", "first_seen"))).alias("issues"))
    header.crossJoin(rows).coalesce(1).write.mode("overwrite").json(path)


def read_issues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Issues and header of a snapshot, None where there isn't one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    schema = "run_ts timestamp, seq bigint, last_good_ts timestamp, last_good_seq bigint, issues array<struct<issue_type:string,osm_type:string,osm_id:bigint,friendly_name:string,details:string,first_seen:timestamp>>"
    raw = spark.read.schema(schema).json(path)
    return raw.select(F.explode("issues").alias("i")).select("i.*"), raw.drop("issues")


def should_publish(data_end_s: int, now_s: int, remote_seq: int | None, seq: int, window_s: int = 300) -> bool:
    """Fresh data is published, and old data where the remote snapshot is older still."""
    return now_s - data_end_s < window_s or remote_seq is None or remote_seq < seq
