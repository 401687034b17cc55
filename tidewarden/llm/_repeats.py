"""Finding windows of one length that also occur earlier, over a whole corpus.

Shared by the byte-level and the word-level operator, which differ in how they
choose anchors and compare windows (their ``Scheme``).

1.  Each document yields anchors: short spans chosen so that two equal windows
    share an equal anchor.  An anchor answers for a run of windows around it,
    its segment.  One row an anchor goes to the partition of its hash.
2.  There, a segment equal to an earlier one is settled: all its windows are
    repeats.  Segments that share only the anchor are asked for in detail.
3.  Documents add what the comparison needs (bytes, or window hashes).
4.  Each anchor's segments are compared window by window.
5.  Documents meet the findings.

Documents are shuffled once; steps 1, 3 and 5 read that same exchange.

Skew: within a block of documents, repeats of a segment are settled on the
spot and never meet at its anchor.  An anchor with many different segments in
one block is hot: its segments are spread, a mark tells the anchor's partition,
and its windows are compared by their own hashes, again settled within blocks
first.  So no partition gets more rows of a key than a few from each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vec as V
from ._state import checkpoint

ROW = "pk long, kind int, seg long, anchor long, doc_id long, r long, a int, n int"
ASK = "doc_id long, r long, a int, n int, kind int, anchor long"
DETAIL = "pk long, kind int, seg long, doc_id long, r long, a int, n int, payload binary"
FOUND = "doc_id long, r long, a int, n int"
#: Kinds of rows: an anchor; settled already; of a hot anchor; the mark of a hot anchor.
ANCHOR, SETTLED, HOT, MARK = 0, 1, 2, 3
#: Kinds of requests: all windows are repeats; compare segments; compare single windows.
REPEAT, COMPARE, WINDOWS = 1, 2, 3
LAST = (1 << 63) - 1  # a null id counts as the largest


@dataclass
class Scheme:
    """How windows are anchored and compared."""

    def read(self, buf: np.ndarray, off: np.ndarray):
        """What the other methods need of a block."""
        raise NotImplementedError

    def anchors(self, block) -> tuple[np.ndarray, ...]:
        """By anchor: row of the block, anchor hash, segment hash, first window, number of windows (window positions count from the row's start)."""
        raise NotImplementedError

    def payload(self, block, row: int, a: int, n: int) -> bytes:
        raise NotImplementedError

    def windows(self, block, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hashes of single windows."""
        raise NotImplementedError

    def later(self, order: np.ndarray, same: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of entries sorted so that equal ones stand together by position, which have an equal one before them:
        ``order`` has their positions, ``same`` whether each equals the one before it, ``doc`` their documents."""
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        return doc > doc[lead]

    def equal_earlier(self, group: np.ndarray, doc: np.ndarray, n: np.ndarray, payloads: list[bytes]) -> np.ndarray:
        """For all windows of all segments, whether an equal one of the same group comes earlier; segments are in order."""
        raise NotImplementedError


def _batch(schema: str, *cols) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)], [f for f, _ in fields])


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [V.col(batch, x).to_numpy(zero_copy_only=False) for x in names]


def whole_groups(batches, keys: tuple[str, ...]):
    """Sorted batches cut so that no group of equal keys is split; only a group that is still open is held back."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            x = V.col(batch, k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
            if carry:
                change[0] |= x[0] != V.col(carry[-1], k)[-1].as_py()
        cut = np.flatnonzero(change)
        if not len(cut):
            carry.append(batch)
            continue
        head = [*carry, batch.slice(0, int(cut[-1]))]
        yield pa.Table.from_batches([b for b in head if b.num_rows]).combine_chunks().to_batches()[0] if any(b.num_rows for b in head) else batch.slice(0, 0)
        carry = [batch.slice(int(cut[-1]))]
    if carry:
        yield pa.Table.from_batches(carry).combine_chunks().to_batches()[0]


def _spread(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros(len(parts[0]), V.U64)
    for p in parts:
        x = V.mix(x * V.U64(31) + p.astype(np.int64).view(V.U64))
    return V.signed(x)


def _anchor_rows(scheme: Scheme, hot: int):
    def run(batches):
        for block in V.blocks(batches, "text"):
            doc, r = numbers(block, "doc_id", "r")
            buf, off = V.buffer(V.col(block, "text"))
            row, anchor, seg, a, n = scheme.anchors(scheme.read(buf, off))
            if not len(row):
                continue
            if ((doc[1:] < doc[:-1]) | ((doc[1:] == doc[:-1]) & (r[1:] < r[:-1]))).any():
                order = np.lexsort((a, r[row], doc[row]))
                row, anchor, seg, a, n = row[order], anchor[order], seg[order], a[order], n[order]
            both = V.mix(anchor * V.U64(0x9E3779B97F4A7C15) ^ seg)
            _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
            order = np.argsort(both, kind="stable")
            settled = np.zeros(len(row), dtype=bool)
            settled[order] = scheme.later(order, np.append(False, both[order][1:] == both[order][:-1]), doc[row][order])
            # different segments of an anchor in this block
            names, which = np.unique(anchor[first], return_inverse=True)
            many = np.bincount(which) > hot
            is_hot = many[which[inverse]]
            d, rr = doc[row], r[row]
            anchor, seg = V.signed(anchor), V.signed(seg)
            pk = np.where(settled, _spread(d, a), np.where(is_hot, _spread(anchor, seg), anchor))
            kind = np.where(settled, SETTLED, np.where(is_hot, HOT, ANCHOR)).astype(np.int32)
            yield _batch(ROW, pk, kind, seg, anchor, d, rr, a.astype(np.int32), n.astype(np.int32))
            if many.any():
                m = V.signed(names[many])
                z = np.zeros(len(m), np.int32)
                yield _batch(ROW, m, z + MARK, z.astype(np.int64), m, z.astype(np.int64), z, z, z)

    return run


def _settle(scheme: Scheme, cap: int):
    def run(batches):
        for b in whole_groups(batches, ("pk",)):
            if not b.num_rows:
                continue
            pk, kind, seg, anchor, doc, r, a, n = numbers(b, "pk", "kind", "seg", "anchor", "doc_id", "r", "a", "n")
            new = np.ones(len(pk), dtype=bool)
            new[1:] = pk[1:] != pk[:-1]
            sub = new.copy()
            sub[1:] |= seg[1:] != seg[:-1]
            real = (kind == ANCHOR) | (kind == HOT)
            group = np.cumsum(new) - 1
            repeat = scheme.later(np.arange(len(pk)), ~sub, doc)
            segs = np.bincount(group, sub & real)
            marked = np.bincount(group, kind == MARK) > 0
            hot = (kind == HOT) | ((segs > cap) | marked)[group]
            ask = np.where(kind == SETTLED, REPEAT, np.where(repeat, REPEAT, np.where(hot, WINDOWS, COMPARE)))
            keep = (kind == SETTLED) | (real & (repeat | hot | (segs >= 2)[group]))
            yield _batch(ASK, doc[keep], r[keep], a[keep], n[keep], ask[keep].astype(np.int32), anchor[keep])

    return run


def asked(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a column of lists of structs; null counts as an empty list."""
    column = column.fill_null([]) if column.null_count else column
    flat = column.flatten()
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.concatenate([[0], np.cumsum(size)]), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _runs(row: np.ndarray, start: np.ndarray):
    """Consecutive window starts of a row as (row, first, number)."""
    if not len(row):
        return row, start, start
    cut = np.ones(len(row), dtype=bool)
    cut[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(cut)
    return row[at], start[at], np.diff(np.append(at, len(row)))


def _details(scheme: Scheme):
    def run(batches):
        for block in V.blocks(batches, "text"):
            doc, r = numbers(block, "doc_id", "r")
            off, (ar, a, n, kind, anchor) = asked(V.col(block, "asks"), "r", "a", "n", "kind", "anchor")
            row = np.repeat(np.arange(len(doc)), np.diff(off))
            mine = (ar == r[row]) & (kind != REPEAT)
            row, a, n, kind, anchor = row[mine], a[mine].astype(np.int64), n[mine].astype(np.int64), kind[mine], anchor[mine]
            if not len(row):
                continue
            buf, off = V.buffer(V.col(block, "text"))
            read = scheme.read(buf, off)
            k = np.flatnonzero(kind == COMPARE)
            if len(k):
                load = [scheme.payload(read, int(row[i]), int(a[i]), int(n[i])) for i in k]
                z = np.zeros(len(k), np.int32)
                yield _batch(DETAIL, anchor[k], z + COMPARE, z.astype(np.int64), doc[row[k]], r[row[k]], a[k].astype(np.int32), n[k].astype(np.int32), load)
            k = np.flatnonzero(kind == WINDOWS)
            if len(k):
                rows, starts = np.repeat(row[k], n[k]), V.ragged(a[k], n[k])
                name = np.repeat(anchor[k], n[k])
                key = V.mix(scheme.windows(read, rows, starts) ^ name.view(V.U64))
                order = np.lexsort((starts, r[rows], doc[rows]))  # rows of a join come in any order
                rows, starts, name, key = rows[order], starts[order], name[order], key[order]
                order = np.argsort(key, kind="stable")
                done = np.zeros(len(rows), dtype=bool)
                done[order] = scheme.later(order, np.append(False, key[order][1:] == key[order][:-1]), doc[rows][order])
                pk = np.where(done, _spread(doc[rows], starts), V.signed(key))
                what = np.where(done, REPEAT, WINDOWS).astype(np.int32)
                yield _batch(DETAIL, pk, what, name, doc[rows], r[rows], starts.astype(np.int32), np.ones(len(rows), np.int32), pa.nulls(len(rows), pa.binary()))

    return run


def _compare(scheme: Scheme):
    def run(batches):
        for b in whole_groups(batches, ("pk",)):
            if not b.num_rows:
                continue
            pk, kind, seg, doc, r, a, n = numbers(b, "pk", "kind", "seg", "doc_id", "r", "a", "n")
            out = [np.flatnonzero(kind == REPEAT)]
            k = np.flatnonzero(kind == WINDOWS)
            if len(k):
                sub = np.ones(len(k), dtype=bool)
                sub[1:] = (pk[k][1:] != pk[k][:-1]) | (seg[k][1:] != seg[k][:-1])
                out.append(k[scheme.later(np.arange(len(k)), ~sub, doc[k])])
            k = np.concatenate(out)
            if len(k):
                yield _batch(FOUND, doc[k], r[k], a[k], n[k])
            k = np.flatnonzero(kind == COMPARE)
            load = V.col(b, "payload")
            for part in _by_group(pk, k, n):
                hit = scheme.equal_earlier(pk[part], doc[part], n[part].astype(np.int64), load.take(pa.array(part)).to_pylist())
                owner = np.repeat(part, n[part])[hit]
                start = V.ragged(a[part], n[part].astype(np.int64))[hit]
                o, s, m = _runs(owner, start)
                if len(o):
                    yield _batch(FOUND, doc[o], r[o], s.astype(np.int32), m.astype(np.int32))

    return run


def _by_group(pk: np.ndarray, k: np.ndarray, n: np.ndarray, limit: int = 400_000):
    """Rows in parts of about ``limit`` windows that hold whole groups."""
    new = np.flatnonzero(np.append(True, pk[k][1:] != pk[k][:-1]))
    done = np.concatenate([[0], np.cumsum(n[k])])
    at = 0
    while at < len(k):
        nxt = new[new > at]
        far = nxt[done[nxt] - done[at] <= limit]
        to = int(far[-1]) if len(far) else int(nxt[0]) if len(nxt) else len(k)
        if not len(nxt) or done[len(k)] - done[at] <= limit:
            to = len(k)
        yield k[at:to]
        at = to


def repeats(docs: DataFrame, scheme: Scheme, finish, out_schema: str, id_col: str = "doc_id", text_col: str = "text", hot: int = 32, cap: int = 4096) -> DataFrame:
    """Finds repeated windows and hands each block of documents with its findings to ``finish``.

    ``finish(block, read, rows, starts, counts)`` yields record batches; its
    findings are runs of window starts, possibly overlapping.
    """
    # no column but these two, so that all steps read one and the same exchange
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if not ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        key, own = "doc_id", ids.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).cast("long"))
    else:
        # rows of one id are told apart by r, in order of their texts; no task gets all rows of an id
        spread = ids.withColumn("m", F.monotonically_increasing_id()).repartitionByRange("doc_id", "text", "m").sortWithinPartitions("doc_id", "text", "m")
        key, own = "r", checkpoint(spread.select("doc_id", "text", F.monotonically_increasing_id().alias("r")))
    anchors = own.select("doc_id", "r", "text").mapInArrow(_anchor_rows(scheme, hot), ROW)
    asks = anchors.repartition("pk").sortWithinPartitions("pk", "seg", "doc_id", "r", "a").mapInArrow(_settle(scheme, cap), ASK)
    asks = asks.groupBy(key).agg(F.collect_list(F.struct("r", "a", "n", "kind", "anchor")).alias("asks"))
    both = own.join(asks, key, "left")
    detail = both.where(F.col("asks").isNotNull()).select("doc_id", "r", "text", "asks").mapInArrow(_details(scheme), DETAIL)
    found = detail.repartition("pk").sortWithinPartitions("pk", "kind", "seg", "doc_id", "r", "a").mapInArrow(_compare(scheme), FOUND)
    found = found.groupBy(key).agg(F.collect_list(F.struct("r", "a", "n")).alias("found"))

    def run(batches):
        for block in V.blocks(batches, "text"):
            (r,) = numbers(block, "r")
            parts = []
            for name, fields in (("asks", ("r", "a", "n", "kind")), ("found", ("r", "a", "n"))):
                off, got = asked(V.col(block, name), *fields)
                row = np.repeat(np.arange(len(r)), np.diff(off))
                mine = got[0] == r[row] if len(row) else np.zeros(0, bool)
                if name == "asks" and len(row):
                    mine &= got[3] == REPEAT
                parts.append((row[mine], got[1][mine].astype(np.int64), got[2][mine].astype(np.int64)))
            rows, starts, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
            buf, off = V.buffer(V.col(block, "text"))
            yield from finish(block, buf, off, rows, starts, counts)

    return both.join(found, key, "left").select(F.nullif("doc_id", F.lit(LAST)).alias("id"), "r", "text", "asks", "found").mapInArrow(run, out_schema)


def cover(total: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mask of what the spans [at, at + size) cover."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge)[:-1] > 0
