"""Packing of tokenised documents into sequences of several lengths.

Documents are routed by what remains after their full windows to context-size
tiers, each to the shortest that holds it.  Each tier is packed by itself into
windows of its own size, the longest tier first; a window's gap is filled from
the shorter tiers, the longest piece that fits first, and where none fits, by a
piece that is cut, so windows are filled exactly.  What is left at the end of a
task is cut at powers of two, which need no padding.  Finished windows are dealt
to step groups, the largest to the group of least load, so that all groups of a
task hold the same number of tokens but for its last few, which share the rest.
Each task packs the rows of its own partition: no shuffle, memory bounded by the
pieces that wait, and a lost task is redone alone.

Defined cases: a null text counts as empty, and an empty document is its
terminator alone; a null id is carried as null; repeated rows are packed once
each; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class ChunkEncoder:
    """Ids of whole texts, encoding each distinct chunk once.

    A chunk is a run of white space with the run of other characters after it.
    The tokenizer's pattern never lets a token go from another character to
    white space, and its only look-ahead is from a white-space run to the next
    character, which is in the same chunk; so chunks can be encoded apart.
    """

    def __init__(self, tokenizer_path: str, keep: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, V.U64)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    @staticmethod
    def cuts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of chunks, and row offsets into them."""
        n = len(buf)
        space = V.SPACE[buf]
        start = np.zeros(n + 1, dtype=bool)
        start[1:n] = space[1:] & ~space[:-1]
        # after a white-space character of two or three bytes, no cut
        odd = (buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3)
        at = np.flatnonzero(odd)
        for width in (2, 3):
            x = at + width
            start[x[x <= n]] = False
        start[off[:-1][np.diff(off) > 0]] = True
        s = np.flatnonzero(start[:n])
        return s, np.searchsorted(s, off).astype(np.int64)

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and row offsets into them."""
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        s, rows = self.cuts(buf, off)
        e = np.append(s[1:], len(buf))
        keys, first, inverse = np.unique(V.spans(V.prefix(buf), s, e), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) > self.keep:
                self.clear()
                new = np.arange(len(keys))
            raw = buf.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)]
            got = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))
            base = len(self.ids)
            self.ids = np.concatenate([self.ids, flat])
            # both are sorted, so the new ones are put in their places
            place = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, place, keys[new])
            self.starts = np.insert(self.starts, place, base + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, place, sizes)
            at = np.searchsorted(self.keys, keys)
        where = at[inverse]
        sizes = self.sizes[where]
        out = self.ids[V.ragged(self.starts[where], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return out, ends[rows]


@cache
def encoder(tokenizer_path: str) -> ChunkEncoder:
    """One for a Python worker, so that later tasks there find what earlier ones encoded."""
    return ChunkEncoder(tokenizer_path)


class Groups:
    """Deals windows to step groups of so many tokens, the largest first, each to the least loaded; rows leave as groups fill."""

    def __init__(self, tokens: int, base: int):
        self.tokens, self.next, self.held, self.load, self.rows = tokens, base, [], 0, []

    def add(self, size: int, rows: list[tuple]) -> None:
        self.held.append((size, rows))
        self.load += size
        if self.load >= 4 * self.tokens:
            self._deal(3)

    def _deal(self, n: int) -> None:
        """Fills n groups, up to their tokens while windows are left over; sizes are powers of two, so groups come out even."""
        left, loads = [], [0] * n
        for size, rows in sorted(self.held, key=lambda x: -x[0]):
            k = min(range(n), key=loads.__getitem__)
            if loads[k] + size > self.tokens:
                left.append((size, rows))
            else:
                loads[k] += size
                self.rows += [(*r, self.next + k) for r in rows]
        self.next += n
        self.held, self.load = left, sum(x[0] for x in left)

    def finish(self) -> None:
        """What is left, in as few groups as hold it, evenly."""
        if self.held:
            n = -(-self.load // self.tokens)
            most, self.tokens = self.tokens, self.load
            self._deal(n)
            self.tokens = most

    def drain(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


class Packer:
    """Packs pieces into windows, a queue of waiting pieces for each tier."""

    def __init__(self, context: int, tiers: tuple[int, ...], base: int, group_tokens: int):
        self.context, self.tiers = context, tuple(sorted(tiers, reverse=True))
        self.queues = {t: deque() for t in self.tiers}
        self.next, self.waiting = base, 0
        self.groups = Groups(group_tokens, base)

    def _row(self, piece, seq: int, offset: int, tier: int) -> tuple:
        doc, start, ids, total = piece
        return (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, offset, tier)

    def _close(self, tier: int, pieces: list) -> None:
        """A full window of pieces."""
        rows, at = [], 0
        for p in pieces:
            rows.append(self._row(p, self.next, at, tier))
            at += len(p[2])
        self.next += 1
        self.groups.add(tier, rows)

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.context:
            self._close(self.context, [(doc, at, ids[at : at + self.context], total)])
            at += self.context
        if at < total:
            self._route((doc, at, ids[at:], total))

    def _route(self, piece) -> None:
        """To the shortest tier that holds the piece."""
        size = len(piece[2])
        tier = min((t for t in self.tiers if t >= size), default=self.tiers[0])
        self.queues[tier].append(piece)
        self.waiting += size

    def _take(self, tier: int):
        piece = self.queues[tier].popleft()
        self.waiting -= len(piece[2])
        return piece

    def pending(self) -> int:
        return sum(len(q) for q in self.queues.values())

    def pack(self, low: int = 0) -> None:
        """Packs the tiers in turn, the longest first, until about ``low`` pieces wait or too few tokens for another window."""
        for tier in self.tiers:
            while self.queues[tier] and self.waiting >= tier and self.pending() > low:
                self._window(tier)

    def _window(self, tier: int) -> None:
        """A window of the tier's size: a piece of its own, then whatever fits, the longest tier first, at last a cut piece."""
        pieces, gap = [self._take(tier)], tier
        gap -= len(pieces[0][2])
        while gap:
            fits = next((t for t in self.tiers if self.queues[t] and len(self.queues[t][0][2]) <= gap), None)
            if fits is not None:
                pieces.append(self._take(fits))
                gap -= len(pieces[-1][2])
                continue
            cut = next(t for t in reversed(self.tiers) if self.queues[t])
            doc, start, ids, total = self._take(cut)
            pieces.append((doc, start, ids[:gap], total))
            self._route((doc, start + gap, ids[gap:], total))
            gap = 0
        self._close(tier, pieces)

    def finish(self) -> None:
        """Windows of all tiers, then powers of two."""
        self.pack()
        while self.waiting:
            self._exactly(1 << self.waiting.bit_length() - 1)
        self.groups.finish()

    def _exactly(self, size: int) -> None:
        """A window of so many of the waiting tokens, in order of tiers."""
        pieces, gap = [], size
        while gap:
            doc, start, ids, total = self._take(next(t for t in self.tiers if self.queues[t]))
            pieces.append((doc, start, ids[:gap], total))
            if len(ids) > gap:
                rest = (doc, start + gap, ids[gap:], total)
                self.queues[min(t for t in self.tiers if t >= len(rest[2]))].appendleft(rest)
                self.waiting += len(rest[2])
            gap -= len(pieces[-1][2])
        self._close(size, pieces)

    def drain(self) -> list[tuple]:
        return self.groups.drain()


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", context: int = 1024, tiers: tuple[int, ...] = (1024, 512, 256, 128), end_id: int = 0, window: int = 512, group_tokens: int = 64 * 1024) -> DataFrame:
    """One row for each placed piece; see the module for the method and the defined cases.

    ``tiers`` are the context sizes, ``window`` the number of pieces that wait
    before windows are filled, ``group_tokens`` the tokens of a step group.
    """
    types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    def run(batches):
        from pyspark import TaskContext

        context_ = TaskContext.get()
        encode = encoder(tokenizer_path)
        packer = Packer(context, tiers, (context_.partitionId() if context_ else 0) << 32, group_tokens)

        def out(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for block in V.blocks(batches, "text"):
            buf, off = V.buffer(V.col(block, "text"))
            ids, at = encode(buf, off)
            for k, doc in enumerate(V.col(block, "doc_id").to_pylist()):
                own = np.empty(at[k + 1] - at[k] + 1, np.uint32)
                own[:-1] = ids[at[k] : at[k + 1]]
                own[-1] = end_id
                packer.add(doc, own)
                if packer.pending() >= 2 * window:
                    packer.pack(window)
            yield out(packer.drain())
        packer.finish()
        yield out(packer.drain())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
