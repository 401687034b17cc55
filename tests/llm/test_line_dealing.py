"""Line dedup moves keys by parts, compares buckets of some hundred rows at once, and leaves little behind."""

import time

import numpy as np
import pyarrow as pa

from tidewarden.llm import _state
from tidewarden.llm import lines as L
from tidewarden.operators import _state as kept


def test_keys_are_moved_by_parts():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5000, (60_000, 3)).astype(np.uint64)
    dealt = list(L._dealt(iter(np.array_split(x, 7)), 64, most=20_000))
    assert sum(b.num_rows for b in dealt) <= 4 * 64
    rows = pa.Table.from_batches(dealt).sort_by("part").combine_chunks().to_batches()[0]
    got = list(L._gathered([rows.slice(k, 5) for k in range(0, rows.num_rows, 5)], most=8000))
    assert len(got) > 3
    keys = [set(g[:, 0].tolist()) for g in got]
    assert sum(map(len, keys)) == len(set().union(*keys))  # a key is in one piece
    assert sorted(map(tuple, np.concatenate(got).tolist())) == sorted(map(tuple, x.tolist()))
    assert list(L._gathered([])) == [] and list(L._dealt(iter([]), 64)) == []


def test_middling_buckets_take_few_steps():
    calls = []

    def within(a, b):
        calls.append(1)
        return np.bitwise_count(a ^ b) <= 2

    groups, rows = 40, 200
    sim = np.random.default_rng(2).integers(0, 1 << 62, groups * rows).astype(np.uint64)
    sim[7], sim[215] = sim[3], sim[210]
    b = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(groups), rows)), pa.array(np.arange(groups * rows)), pa.array(sim.view(np.int64))], ["key", "node", "sim"])
    out = L._leads(b, within)
    assert list(zip(out.column("node").to_pylist(), out.column("lead").to_pylist(), strict=True)) == [(3, 3), (7, 3), (210, 210), (215, 210)]
    assert len(calls) <= rows


def test_rows_that_lead_nobody_are_live_beside_a_led_one():
    n = 1000
    sim = np.random.default_rng(3).integers(0, 1 << 62, n).astype(np.uint64)
    sim[0], sim[1], sim[2] = 0, 0b11, 0b1111  # the second one is near both others, which are not near each other
    b = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(sim.view(np.int64))], ["key", "node", "sim"])
    out = L._leads(b, lambda a, b: np.bitwise_count(a ^ b) <= 2)
    assert out.column("node").to_pylist() == [0, 1, 2] and out.column("lead").to_pylist() == [0, 0, 2]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_checkpoints_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    held = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = spark.range(20_000).repartition(4, "id")
    out = _state.checkpoint(df)
    for _ in range(30):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert out.count() == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == held
    _state.drop(out)


def test_cutting_lines_keeps_their_numbers_alone(spark):
    docs = spark.createDataFrame([(1, "one two three\nfour five"), (2, "six\none two three"), (3, "four five"), (4, None)], "doc_id long, text string")
    with _state.scope(spark):
        out = L.keep_first(docs, min_words=1)
        assert len(kept._scopes[-1]) == 1
        assert sorted(map(tuple, out.collect())) == [(1, "one two three\nfour five"), (2, "six"), (4, None)]
