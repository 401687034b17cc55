"""The queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]
TOKENIZERS: str | None = None


@cache
def tokenizer(name: str) -> str:
    """A public tokenizer's file; its folder is TOKENIZERS, or that of the installed package."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    pages = table(spark, sf_dir, "pages")
    return html.extract_pages(pages, html.fit(pages))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    path = tokenizer("byte_bpe_50k.json")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_turns(rows.unionByName(more), path), path)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    path = tokenizer("piece_bpe_32k.model")
    # a null id is neither held out nor learned from
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    langs, logp = langid.train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()), path)
    return langid.predict(docs, langs, logp, path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op2_html_extraction, op4_chat_formatting, op9_language_id, op10_packing)}


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES[op5_quality_rules.__name__] = op5_quality_rules


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.dedup(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.dedup(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op1_suffix_array_dedup, op7_substring_dedup)}


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES[op3_minhash_near_dedup.__name__] = op3_minhash_near_dedup


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES[op8_benchmark_decontamination.__name__] = op8_benchmark_decontamination


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    return lines.dedup(table(spark, sf_dir, "documents"), min_words=1)


QUERIES[op6_line_dedup.__name__] = op6_line_dedup


QUERIES[pipeline.__name__] = pipeline
