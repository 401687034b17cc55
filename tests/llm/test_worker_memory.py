"""What near-duplicate search leaves in workers, and how many files it writes."""

import re
from pathlib import Path

import numpy as np
import pytest

from tidewarden.llm import _vec, minhash


def held() -> int:
    """MB of this process's own memory."""
    return sum(map(int, re.findall(r"\n(?:Anonymous):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024


@pytest.mark.skipif(not _vec._trim(), reason="needs glibc")
def test_memory_goes_back_when_a_task_ends():
    pins = []

    def run(batches):
        for _ in batches:
            parts = [np.ones(60_000, np.uint8) for _ in range(3000)]
            pins.append(np.ones(60_000, np.uint8))  # stands above the others, so that they don't go by themselves
            yield len(parts)

    before = held()
    assert list(run([0])) == [3000]
    assert held() > before + 100
    assert list(_vec.tidy(run)([0])) == [3000]
    assert held() < before + 50


def test_few_buckets_are_few_files(spark, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    files = {}

    def checkpoint(df, *spent, write=minhash.checkpoint):
        out = write(df, *spent)
        files.setdefault(",".join(out.columns), len(out.inputFiles()))
        return out

    monkeypatch.setattr(minhash, "checkpoint", checkpoint)
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(400)]
    texts += [x + " tail" for x in texts[:5]]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = minhash.near_duplicates(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in rows} == {k: k if k < 400 else k - 400 for k in range(405)}
    assert files["key,node,lead"] == 1
