"""Change files in XML: sections create, modify and delete, each with elements."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = "array<struct<_k:string,_v:string>>"
_HEAD = "_id:bigint,_version:int"
_SECTION = (
    f"array<struct<node:array<struct<{_HEAD},_lat:double,_lon:double,tag:{_TAG}>>,"
    f"way:array<struct<{_HEAD},nd:array<struct<_ref:bigint>>,tag:{_TAG}>>,"
    f"relation:array<struct<{_HEAD},member:array<struct<_type:string,_ref:bigint,_role:string>>,tag:{_TAG}>>>>"
)
SCHEMA = f"create {_SECTION}, modify {_SECTION}, delete {_SECTION}"
SECTIONS = ("create", "modify", "delete")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``schemas.CHANGES`` from change files (gzip too); file_seq comes from the digits of the path.

    Within a file, elements count by section, then kind, then place."""
    raw = spark.read.format("xml").option("rowTag", "osmChange").schema(SCHEMA).load(path).withColumn("path", F.input_file_name())
    digits = F.regexp_extract("path", r"(\d+(?:/\d+)*)\.osc", 1)
    raw = raw.withColumn("file_seq", F.regexp_replace(digits, "/", "").cast("bigint"))
    tags = lambda e: F.map_from_entries(F.transform(F.coalesce(e["tag"], F.array().cast(_TAG)), lambda t: F.struct(t["_k"], F.coalesce(t["_v"], F.lit("")))))
    parts = []
    for sec, name in enumerate(SECTIONS):
        for k, (kind, field) in enumerate((("N", "node"), ("W", "way"), ("R", "relation"))):
            s = raw.select("file_seq", F.posexplode(name).alias("s", "section")).select("file_seq", "s", F.posexplode(f"section.{field}").alias("p", "e"))
            e = F.col("e")
            none = lambda t: F.lit(None).cast(t)
            members = "array<struct<type:string,ref:bigint,role:string>>"
            kinds = F.create_map(*[F.lit(x) for x in ("node", "N", "way", "W", "relation", "R")])
            parts.append(
                s.select(
                    "file_seq",
                    F.lit(sec).alias("sec"),
                    (F.col("s") * 3_000_000_000 + k * 1_000_000_000 + F.col("p")).cast("bigint").alias("pos"),
                    F.lit(kind).alias("etype"),
                    e["_id"].alias("id"),
                    F.coalesce(e["_version"], F.lit(0)).alias("version"),
                    (e["_lat"] if kind == "N" else none("double")).alias("lat"),
                    (e["_lon"] if kind == "N" else none("double")).alias("lon"),
                    (F.transform(F.coalesce(e["nd"], F.array().cast("array<struct<_ref:bigint>>")), lambda n: n["_ref"]) if kind == "W" else none("array<bigint>")).alias("nodes"),
                    (F.transform(F.coalesce(e["member"], F.array().cast("array<struct<_type:string,_ref:bigint,_role:string>>")), lambda m: F.struct(kinds[m["_type"]].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))).cast(members) if kind == "R" else none(members)).alias("members"),
                    tags(e).alias("tags"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def read_states(spark: SparkSession, path: str, period_s: int) -> DataFrame:
    """(period_s, seq, end_ts) from state files: key=value lines, # and blank lines skipped, escapes undone, UTC."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#') and instr(v, '=') > 0")
    kv = lines.select("path", F.split("v", "=", 2).alias("p")).select("path", F.col("p")[0].alias("k"), F.replace(F.col("p")[1], F.lit("\\"), F.lit("")).alias("v"))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    g = kv.groupBy("path").agg(pick("sequenceNumber").alias("seq"), pick("timestamp").alias("ts"))
    return g.select(F.lit(period_s).alias("period_s"), F.col("seq").cast("bigint").alias("seq"), F.to_timestamp("ts").alias("end_ts"))


def cached(spark: SparkSession, source: str, cache: str, period_s: int, path: str, refresh: bool = False) -> str | None:
    """The place of a change file in a cache by period and sequence, copied there from ``source`` first if it is missing
    (or ``refresh``); None where the source has none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    here, there = place(f"{cache}/{period_s}/{path}"), place(f"{source}/{path}")
    own, other = here.getFileSystem(conf), there.getFileSystem(conf)
    if refresh or not own.exists(here):
        if not other.exists(there):
            return None
        tmp = place(f"{cache}/{period_s}/{path}.copy")
        jvm.org.apache.hadoop.fs.FileUtil.copy(other, there, own, tmp, False, True, conf)
        own.delete(here, False)
        own.rename(tmp, here)
    return here.toString()


def read_cached(spark: SparkSession, source: str, cache: str, period_s: int, path: str, tries: int | None = None, wait_s: float = 1.0) -> DataFrame | None:
    """The changes of a file through the cache; a file that can't be read is fetched again, past the cache, and tried
    for ever unless ``tries`` says how often. None where there is none."""
    attempt = 0
    while True:
        place = cached(spark, source, cache, period_s, path, refresh=attempt > 0)
        if place is None:
            return None
        try:
            df = read_changes(spark, place)
            if spark.read.option("rowTag", "osmChange").option("mode", "FAILFAST").schema(SCHEMA).format("xml").load(place).count() == 0:
                raise ValueError(f"no change document in {place}")
            return df
        except Exception:
            attempt += 1
            if tries is not None and attempt >= tries:
                raise
            time.sleep(wait_s)
