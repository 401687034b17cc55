"""Exact substring dedup by longest-previous-factor arrays.

A byte goes if a string of ``width`` bytes that covers it also starts earlier.
In suffix order, the longest earlier match of a suffix is with its previous or
next smaller position; where that longest previous factor reaches ``width``,
the suffix's first ``width`` bytes are a later copy.  Only suffixes that can
reach it are sorted: two equal windows of ``width`` bytes have the same
minimizer, an anchor of ``gram`` bytes, so suffixes are dealt by anchor and each
anchor's are put in suffix order together (see ``_repeats``).  Segments and hot
windows that are equal as a whole are settled before, by the same arrays over
their order by hash, where equal ones stand together as in suffix order.

Defined cases: a null or empty text has no bytes and keeps none; matches never
cross documents; a null id counts as the largest; rows with one id count in
order of their texts, and a repeated row is a later copy; an empty table gives
no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as R
from . import _vec as V

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
OUT_TEXT = OUT + ", kept binary"


def previous_factor(positions: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """By rank: the match with the previous smaller position in suffix order, 0 where there is none.

    All ranks at once: each points to the rank before, and while that has a larger position and something
    is still shared, to what that one points to; the least common prefix on the way is the match."""
    n = len(positions)
    prev, low = np.arange(n) - 1, np.asarray(lcp, np.int64).copy()
    if n:
        low[0] = 0
    at = np.flatnonzero(low > 0)
    at = at[positions[prev[at]] > positions[at]]
    while len(at):
        j = prev[at]
        low[at], prev[at] = np.minimum(low[at], low[j]), prev[j]
        at = at[low[at] > 0]
        at = at[positions[prev[at]] > positions[at]]
    return low


def longest_previous_factor(positions: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """By rank in suffix order: the longest match with an earlier position, the better one of the previous and
    of the next smaller position; ``lcp[k]`` is between ranks k - 1 and k."""
    lcp = np.asarray(lcp, np.int64)
    back = np.append(np.zeros(min(1, len(lcp)), np.int64), lcp[1:][::-1])
    return np.maximum(previous_factor(positions, lcp), previous_factor(positions[::-1], back)[::-1])


@dataclass
class Bytes(R.Scheme):
    width: int = 100
    gram: int = 32
    sub: int = 4_000_000

    def read(self, buf, off):
        return buf, off

    def anchors(self, block):
        buf, off = block
        w, parts = self.width, []
        size = np.diff(off)
        if not (size >= w).any():
            return tuple(np.empty(0, t) for t in (np.int64, V.U64, V.U64, np.int64, np.int64))
        for lo in range(0, max(1, len(buf) - w + 1), self.sub):
            part = buf[lo : lo + self.sub + w - 1]
            m = len(part) - w + 1
            if m <= 0:
                continue
            h = V.prefix(part)
            g = V.rolling(h, self.gram)
            v = (g & V.U64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(g), dtype=V.U64)
            span, have = w - self.gram + 1, 1
            while 2 * have <= span:
                v = np.minimum(v[:-have], v[have:])
                have *= 2
            if have < span:
                v = np.minimum(v[: len(v) - (span - have)], v[span - have :])
            at = (v[:m] & V.U64(0xFFFFFF)).astype(np.int64)
            ok = np.zeros(m + 1, dtype=np.int32)
            begin, end = np.clip(off[:-1] - lo, 0, m), np.clip(off[1:] - lo - w + 1, 0, m)
            live = end > begin
            np.add.at(ok, begin[live], 1)
            np.add.at(ok, end[live], -1)
            valid = np.cumsum(ok[:-1]) > 0
            cut = valid.copy()
            cut[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
            cut[begin[live]] = True
            stop = valid.copy()
            stop[:-1] &= cut[1:] | ~valid[1:]
            a, b = np.flatnonzero(cut), np.flatnonzero(stop) + 1
            row = np.searchsorted(off, a + lo, "right") - 1
            parts.append((row, g[at[a]], V.spans(h, a, b + w - 1), a + lo - off[row], b - a))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def later(self, order, same, doc):
        # what equals the entry before it shares a factor with it; sorted by hash instead of suffix, equal ones stand together too
        return longest_previous_factor(order, same.astype(np.int64)) > 0

    def payload(self, block, row, a, n):
        buf, off = block
        return buf[off[row] + a : off[row] + a + n + self.width - 1].tobytes()

    def windows(self, block, rows, starts):
        buf, off = block
        at = off[rows] + starts
        return V.spans(V.prefix(buf), at, at + self.width)

    def equal_earlier(self, group, doc, n, payloads):
        w = self.width
        buf = np.frombuffer(b"".join(payloads), np.uint8)
        base = np.concatenate([[0], np.cumsum(n + w - 1)])[:-1]
        at = V.ragged(base, n)
        g = np.repeat(np.cumsum(np.append(True, group[1:] != group[:-1])) - 1, n)
        out = np.zeros(len(at), dtype=bool)
        # suffixes whose window occurs once need no place in the order
        key = V.mix(V.spans(V.prefix(buf), at, at + w) ^ V.mix(g.astype(V.U64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        k = np.flatnonzero(count[inverse] > 1)
        if len(k):
            suffixes = np.ndarray((len(buf) - w + 1,), dtype=f"S{w}", buffer=buf, strides=(1,))[at[k]]
            order = np.lexsort((k, suffixes, g[k]))
            s, gg = suffixes[order], g[k][order]
            # common prefixes below the width can't make a factor of it and count as none
            lcp = np.zeros(len(k), np.int64)
            lcp[1:] = np.where((s[1:] == s[:-1]) & (gg[1:] == gg[:-1]), w, 0)
            out[k[order]] = longest_previous_factor(k[order], lcp) >= w
        return out


def dedup(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """What is left of each document without later copies of strings of ``width`` bytes; ``with_text`` adds the bytes."""
    gram = max(1, min(32, width // 3))
    scheme = Bytes(width=width, gram=gram)

    def finish(block, buf, off, rows, starts, counts):
        gone = R.cover(len(buf), off[rows] + starts, counts + width - 1)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        edge[off[:-1][off[:-1] < len(buf)]] = gone[off[:-1][off[:-1] < len(buf)]]
        total, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
        kept = []
        for i in range(len(off) - 1):
            own = buf[off[i] : off[i + 1]]
            kept.append((own[~gone[off[i] : off[i + 1]]] if total[off[i + 1]] > total[off[i]] else own).tobytes())
        cols = [V.col(block, "id"), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]), pa.array(spans[off[1:]] - spans[off[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(cols, names)

    return R.repeats(docs, scheme, finish, OUT_TEXT if with_text else OUT, id_col, text_col)
