"""Corpus preparation: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes the session, the documents that its predecessor kept and the
folder of the tables, and returns the documents that it keeps, with the columns
of ``documents``; the last one returns the placed pieces.

Defined for all stages: an empty table gives an empty one; columns beyond
``documents``' own are kept, whatever they are called, by all but the last;
repeated rows are judged each, but for what a stage says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewarden.llm import _state, decontam, lines, minhash, packing, quality
from tidewarden.llm.queries import table, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or are outliers go; null and empty texts fail the base rule, a null language or source is a value of its own."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of lines are cut out, in order of id and line; documents of which nothing is left go, null and empty texts stay."""
    return lines.keep_first(docs, min_words=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id; null and empty texts are no copies of each other."""
    return minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences; null and empty texts are a terminator alone."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Robust estimates, edit distances and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each but the last keeps is written to the shared folder and read again.

    Once a stage's output stands, what it kept on the way and its predecessor's output are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{_state.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        with _state.scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _state.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
