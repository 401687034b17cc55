"""Substring dedup over words by difference-cover anchors.

A window is ``width`` consecutive words.  With a difference cover D modulo v,
any two positions i and j have an offset k < v with i + k and j + k both at
positions of D modulo v.  So hashing only the spans of ``width - v + 1`` words
that start at cover positions, two equal windows share an equal anchor at an
aligned offset; from it, they are extended and compared (see ``_repeats``).

Defined cases: a null or empty text has no words; a window never crosses
documents; repeats within a document stay; a null id counts as the largest;
rows with one id never remove words of each other; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as R
from . import _vec as V

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


@cache
def difference_cover(v: int) -> tuple[int, ...]:
    """A small set whose differences are all residues modulo v, by search for the least size."""
    if v < 3:
        return tuple(range(v))
    size = 2
    while size * (size - 1) + 1 < v:
        size += 1
    while True:
        found = _search(v, size, [0, 1], {0, 1, v - 1})
        if found:
            return found
        size += 1


def _search(v: int, size: int, chosen: list[int], seen: set[int]) -> tuple[int, ...] | None:
    if len(seen) == v:
        return tuple(chosen)
    left = size - len(chosen)
    if not left or (v - len(seen)) > sum(2 * (len(chosen) + i) for i in range(left)):
        return None
    for x in range(chosen[-1] + 1, v):
        new = {(x - c) % v for c in chosen} | {(c - x) % v for c in chosen}
        found = _search(v, size, [*chosen, x], seen | new)
        if found:
            return found
    return None


@dataclass
class Words(R.Scheme):
    width: int = 50
    period: int = 31

    def read(self, buf, off):
        s, e, rows = V.words(buf, off)
        h = V.prefix(V.spans(V.prefix(buf), s, e)) if len(s) else np.zeros(1, V.U64)
        return h, rows

    def anchors(self, block):
        h, rows = block
        v, size = self.period, self.width - self.period + 1
        in_cover = np.zeros(v, dtype=bool)
        in_cover[list(difference_cover(v))] = True
        count = np.diff(rows)
        row = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(row), dtype=np.int64)
        inside = at - rows[row]
        pick = in_cover[inside % v] & (count[row] >= self.width) & (inside + size <= count[row])
        p, row, inside = at[pick], row[pick], inside[pick]
        first = np.maximum(inside - (v - 1), 0)
        last = np.minimum(inside, count[row] - self.width)
        ok = last >= first
        p, row, inside, first, last = p[ok], row[ok], inside[ok], first[ok], last[ok]
        start = rows[row] + first
        seg = V.mix(V.spans(h, start, rows[row] + last + self.width) + (inside - first).astype(V.U64))
        return row, V.spans(h, p, p + size), seg, first, last - first + 1

    def payload(self, block, row, a, n):
        h, rows = block
        at = rows[row] + a + np.arange(n)
        return V.spans(h, at, at + self.width).tobytes()

    def windows(self, block, rows_, starts):
        h, rows = block
        at = rows[rows_] + starts
        return V.spans(h, at, at + self.width)

    def equal_earlier(self, group, doc, n, payloads):
        g = np.repeat(np.cumsum(np.append(True, group[1:] != group[:-1])) - 1, n)
        d = np.repeat(doc, n)
        key = V.mix(np.frombuffer(b"".join(payloads), V.U64) ^ V.mix(g.astype(V.U64)))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        return d > d[first[inverse]]


def dedup(docs: DataFrame, width: int = 50, period: int = 31, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """What is left of each document without windows of ``width`` words that start in one of smaller id; ``with_text`` adds the text."""
    scheme = Words(width=width, period=min(period, width))

    def finish(block, buf, off, rows_, starts, counts):
        s, e, rows = V.words(buf, off)
        gone = R.cover(len(s), rows[rows_] + starts, counts + width - 1) if len(s) else np.zeros(0, bool)
        total = np.concatenate([[0], np.cumsum(gone)])
        # words in order, each with one space before it; the first space of a document is cut
        k = np.flatnonzero(~gone)
        size = e[k] - s[k]
        ends = np.concatenate([[0], np.cumsum(size + 1)])
        flat = np.full(int(ends[-1]), 0x20, np.uint8)
        flat[V.ragged(ends[:-1] + 1, size)] = buf[V.ragged(s[k], size)]
        edge = ends[np.searchsorted(k, rows)]
        joined = flat.tobytes()
        kept = [joined[x + 1 : y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        cols = [V.col(block, "id"), pa.array(np.diff(rows)), pa.array(total[rows[1:]] - total[rows[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols, names = [*cols, pa.array([x.decode() for x in kept], pa.string())], [*names, "text"]
        yield pa.RecordBatch.from_arrays(cols, names)

    return R.repeats(docs, scheme, finish, OUT + (", text string" if with_text else ""), id_col, text_col)
