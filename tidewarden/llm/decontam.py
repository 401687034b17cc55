"""Benchmark decontamination by latent semantic retrieval.

Words are features where the benchmark has them, so a document is the sequence
of its benchmark words, and passages are windows of it.  Their TF-IDF vectors
are decomposed by a distributed randomised SVD: one pass multiplies a random
basis by A'A, the driver orthonormalises the small result, a second pass gives
the projected Gram matrix, whose eigenvectors rotate the basis.  Each passage
is compared with all benchmark items by cosine in that space; candidates are
checked by the longest common subsequence of their words with the item, and
where that is partial, by that of the item's last third, its answer.

What the space misses (its rank is bounded, and words that planted copies make
frequent carry no weight) is found by an exact bound: a copy may lack so many
words of an item and no more, so of the rarest words one beyond that number
occurs in it, of those two beyond two, and so on (``probes``).

What is gathered on the driver has the size of the benchmark's vocabulary times
the rank, both bounded by parameters.

Defined cases: a null or empty text is clean; an empty benchmark makes all
clean; items without a word are left out; items of fewer than ``short`` words
must occur as a whole; repeated rows are judged each; extra columns are ignored
or, by ``keep_clean``, kept.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._state import checkpoint, unused

OUT = "doc_id long, r long, kept boolean, item_id long, lcs_share double, start long"
#: Punctuation and digits separate words like white space.
_NORM = V.LOWER.copy()
_NORM[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text in lower case, and row offsets into them."""
    buf, off = V.buffer(pc.utf8_lower(texts))
    buf = _NORM[buf]
    s, e, rows = V.words(buf, off)
    return (V.spans(V.prefix(buf), s, e) if len(s) else np.empty(0, V.U64)), rows


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        m = places.get(x, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Benchmark:
    """Items as sequences of word numbers, 0 for none; small, and shipped to tasks."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = pa.array([t for _, t in items], pa.string())
        h, rows = word_hashes(texts)
        self.vocab = np.unique(h)
        numbers = np.searchsorted(self.vocab, h) + 1
        seqs = [(i, numbers[rows[k] : rows[k + 1]]) for k, (i, _) in enumerate(items)]
        self.items = [(i, s) for i, s in seqs if len(s)]

    def number(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(h), np.uint16)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0).astype(np.uint16)


def encode(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """doc_id, r and ``words``, the numbers of its words in the benchmark's vocabulary."""

    def run(batches):
        for block in V.blocks(batches, "text"):
            h, rows = word_hashes(V.col(block, "text"))
            w = bench.number(h)
            raw = [w[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([V.col(block, "doc_id"), V.col(block, "r"), pa.array(raw, pa.binary())], ["doc_id", "r", "words"])

    return docs.mapInArrow(run, "doc_id long, r long, words binary")


def _passages(block: pa.RecordBatch, size: int):
    """All words of a block, the passage of each, and each row's offset."""
    raw, off = V.buffer(V.col(block, "words"))
    words, rows = raw.view(np.uint16), off // 2
    count = np.diff(rows)
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(words)) - rows[row]
    first = np.concatenate([[0], np.cumsum(-(-count // size))])
    return words, first[row] + inside // size, rows


def _document_frequency(encoded: DataFrame, n: int, size: int) -> tuple[np.ndarray, int]:
    """In how many disjoint passages each word occurs, and the number of passages."""

    def run(batches):
        df, total = np.zeros(n + 1, np.int64), 0
        for batch in batches:
            for block in V.blocks([batch], "words"):
                words, passage, _ = _passages(block, size)
                if len(words):
                    pairs = np.unique((passage[words > 0] << 16) | words[words > 0])
                    df += np.bincount(pairs & 0xFFFF, minlength=n + 1)
                    total += int(passage[-1]) + 1
        df[0] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(df)], ["word", "n"])

    got = encoded.select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the vocabulary's size
    df = np.zeros(n + 1)
    for r in got:
        df[r.word] = r.n
    return df, int(df[0])


def probes(bench: Benchmark, df: np.ndarray, share: float, part: float, answer: float, short: int, hits: int = 3) -> list[tuple[int, np.ndarray, int, int]]:
    """Item, words, hits and span: any copy that ``search`` accepts has so many of the words within the span.

    A share of the whole item, or of its last third, its answer, has to be there; so of its
    rarest words, as many as may be missing and ``hits`` more, at least ``hits`` are."""
    out = []
    for k, (_, s) in enumerate(bench.items):
        m = len(s)
        if m < short:  # these occur as a whole
            rarest = s[np.argsort(df[s], kind="stable")[:hits]]
            out.append((k, np.unique(rarest), len(rarest), m))
            continue
        tail = s[-max(1, m // 3) :]
        for x, least in ((s, share), (tail, answer)) if part < share else ((s, share),):
            need = max(1, math.ceil(least * len(x) - 1e-9))
            j = min(hits, need)
            rarest = x[np.argsort(df[x], kind="stable")[: len(x) - need + j]]
            out.append((k, np.unique(rarest), j, m + m // 2))
    return out


class _Probing:
    """Places of probes in blocks of documents, by an index from words to probes."""

    def __init__(self, found: list[tuple[int, np.ndarray, int, int]], n: int):
        word = np.concatenate([x[1] for x in found]) if found else np.empty(0, np.int64)
        probe = np.repeat(np.arange(len(found)), [len(x[1]) for x in found])
        self.count = np.bincount(word, minlength=n + 1)
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.probe = probe[np.argsort(word, kind="stable")]
        self.item, self.need, self.span = (np.array([x[c] for x in found], np.int64) for c in (0, 2, 3))

    def places(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, first and last word (in the row) of what may be a copy; places that overlap are one."""
        at = np.flatnonzero(self.count[words])
        each = self.count[words[at]]
        q = self.probe[V.ragged(self.start[words[at]], each)]
        p = np.repeat(at, each)
        order = np.argsort(q, kind="stable")
        q, p = q[order], p[order]
        r = np.searchsorted(rows, p, "right") - 1
        i = np.flatnonzero(np.arange(len(q)) + self.need[q] <= len(q))
        e = i + self.need[q[i]] - 1
        near = (q[e] == q[i]) & (r[e] == r[i]) & (p[e] - p[i] < self.span[q[i]])
        i, e = i[near], e[near]
        item, row, lo, hi, span = self.item[q[i]], r[i], p[i], p[e], self.span[q[i]]
        order = np.lexsort((lo, item, row))
        item, row, lo, hi, span = item[order], row[order], lo[order], hi[order], span[order]
        new = np.ones(len(lo), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (lo[1:] - lo[:-1] >= span[1:])
        at = np.flatnonzero(new)
        last = np.maximum.reduceat(hi, at) if len(at) else hi
        return row[at], item[at], lo[at] - rows[row[at]], last - rows[row[at]]


def _gram_times(encoded: DataFrame, basis: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """A'A times a basis, A being all disjoint passages' TF-IDF vectors: summed in tasks, then by slices of rows in two levels."""
    n, rank = basis.shape
    slices, groups = 16, max(1, math.isqrt(encoded.rdd.getNumPartitions()))
    scaled = (weight[:, None] * basis).astype(np.float32)
    weight32 = weight.astype(np.float32)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        total = np.zeros((n, rank))
        for batch in batches:
            for block in V.blocks([batch], "words", 200_000):
                words, passage, _ = _passages(block, size)
                k = np.flatnonzero(weight[words] > 0)
                if not len(k):
                    continue
                w, p = words[k].astype(np.int64), passage[k]
                start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                a = np.add.reduceat(scaled[w], start, axis=0)  # passages times basis
                number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
                order = np.argsort(w, kind="stable")
                ws = w[order]
                at = np.flatnonzero(np.append(True, ws[1:] != ws[:-1]))
                total[ws[at]] += np.add.reduceat(a[number[order]], at, axis=0) * weight32[ws[at], None]
        parts = np.array_split(total.astype(np.float32), slices)
        group = (task.partitionId() if task else 0) % groups
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices)), pa.array([group] * slices), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "part", "sum"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("slice").to_pylist(), batch.column("sum").to_pylist(), strict=True):
                x = np.frombuffer(x, np.float32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([0] * len(sums), pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["slice", "part", "sum"])

    schema = "slice long, part long, sum binary"
    level = encoded.select("words").mapInArrow(run, schema).repartition(slices * groups, "slice", "part").mapInArrow(add, schema)
    got = level.repartition(slices, "slice").mapInArrow(add, schema).collect()  # a row for each slice
    parts = {r["slice"]: np.frombuffer(bytes(r["sum"]), np.float32).astype(np.float64) for r in got}
    return np.concatenate([parts[k].reshape(-1, rank) for k in sorted(parts)]) if parts else np.zeros((n, rank))


def latent_space(encoded: DataFrame, bench: Benchmark, size: int = 64, rank: int = 224, max_df: float = 0.005, rarest: int = 6, seed: int = 7, counted: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """Word vectors: IDF weight times right singular vector; row 0 is zero."""
    n = len(bench.vocab)
    df, total = counted or _document_frequency(encoded, n, size)
    idf = np.log((1 + total) / (1 + df))
    idf[0] = 0.0
    # words of more than this part of passages carry no weight, but for the rarest of each item
    # (all words of an item that many documents hold are frequent), nor, where too few are left, for the rarer half
    drop = df > max(max_df * total, float(np.median(df[1:])) if n else 0.0)
    for _, s in bench.items:
        drop[s[np.argsort(df[s], kind="stable")[:rarest]]] = False
    idf[drop] = 0.0
    rank = max(1, min(rank, n, len(bench.items) + 24))
    omega = np.random.default_rng(seed).standard_normal((n + 1, rank))
    q, _ = np.linalg.qr(_gram_times(encoded, omega, idf, size))
    gram = q.T @ _gram_times(encoded, q, idf, size)
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    v = q @ turn[:, values > 1e-9 * max(float(values[-1]), 1e-30)]
    return (idf[:, None] * v).astype(np.float32)


def search(encoded: DataFrame, bench: Benchmark, vectors: np.ndarray, windows: tuple[tuple[int, int], ...] = ((64, 16), (24, 8)), cosine: float = 0.45, share: float = 0.7, part: float = 0.5, answer: float = 0.8, short: int = 8, df: np.ndarray | None = None) -> DataFrame:
    """Per document the best item that it holds, if any: whether it is kept, the item, the share of it found and where.

    ``df``, how frequent each word is, makes the exact search cheap; what it finds doesn't depend on it."""
    items = [s for _, s in bench.items]
    ids = [i for i, _ in bench.items]
    targets = np.stack([vectors[s].sum(axis=0) for s in items]) if items else np.zeros((0, vectors.shape[1]), np.float32)
    norms = np.linalg.norm(targets, axis=1)
    targets = targets / np.maximum(norms, 1e-12)[:, None]
    lists = [s.tolist() for s in items]
    heavy = (vectors != 0).any(axis=1)
    probing = _Probing(probes(bench, np.zeros(len(bench.vocab) + 1) if df is None else df, share, part, answer, short), len(bench.vocab))

    lengths = np.array([len(x) for x in lists], np.int64)
    held_by = np.zeros((len(items), len(bench.vocab) + 1), dtype=bool)  # bounded by the benchmark: items times words
    for k, x in enumerate(items):
        held_by[k, x] = True

    def check(words: np.ndarray, k: int, lo: int, hi: int) -> tuple[float, int]:
        """Share of the item in a region of a row."""
        item = lists[k]
        m = len(item)
        own = held_by[k][words[lo:hi]]
        region = words[lo:hi].tolist()
        if m < short:
            hit = next((j for j in range(len(region) - m + 1) if region[j : j + m] == item), None)
            return (1.0, lo + hit) if hit is not None else (0.0, -1)
        best, at = 0.0, -1
        held = np.concatenate([[0], np.cumsum(own)])
        first = np.arange(0, max(1, len(region) - m), max(1, m // 4))
        last = np.minimum(first + m + m // 2, len(region))
        for a in first[held[last] - held[first] >= part * m].tolist():  # a subsequence can't be longer than what both have
            x = region[a : a + m + m // 2]
            s = lcs(item, x) / m
            if s < share and s >= part:
                tail = item[-max(1, m // 3) :]
                if lcs(tail, x) < answer * len(tail):
                    s = 0.0
            if s > best:
                best, at = s, lo + a
        return (best, at) if best >= part else (0.0, -1)

    def merged(row, item, lo, hi):
        """Regions of a row for an item that overlap are one."""
        order = np.lexsort((lo, item, row))
        row, item, lo, hi = row[order], item[order], lo[order], hi[order]
        if not len(row):
            return row, item, lo, hi
        group = row * np.int64(len(items)) + item
        # the furthest end so far in the group: positions are below 2**32
        number = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
        reach = np.maximum.accumulate((number << 32) + hi) - (number << 32)
        new = np.append(True, (group[1:] != group[:-1]) | (lo[1:] > reach[:-1]))
        at = np.flatnonzero(new)
        return row[at], item[at], lo[at], np.maximum.reduceat(hi, at)

    def promising(words, rows, row, item, lo, hi):
        """Regions that hold at least as many of the item's words as a match needs."""
        keep = []
        size = hi - lo
        done = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(done, done[at] + 4_000_000, "right")) - 1)
            n = size[at:to]
            own = held_by[np.repeat(item[at:to], n), words[V.ragged(rows[row[at:to]] + lo[at:to], n)]]
            count = np.add.reduceat(own.astype(np.int64), np.cumsum(n) - n)
            keep.append(at + np.flatnonzero(count >= part * lengths[item[at:to]]))
            at = to
        k = np.concatenate(keep) if keep else np.empty(0, np.int64)
        return row[k], item[k], lo[k], hi[k]

    def tried(words, rows, found) -> dict[int, tuple[float, int, int]]:
        """The best item of each row, from regions by row and item."""
        best: dict[int, tuple[float, int, int]] = {}
        for r, t, a, z in zip(*(x.tolist() for x in promising(words, rows, *merged(*found))), strict=True):
            s, at = check(words[rows[r] : rows[r + 1]], t, a, z)
            if s > 0 and (r not in best or (s, -t) > (best[r][0], -best[r][1])):
                best[r] = (s, t, at)
        return best

    def run(batches):
        for batch in batches:
            for block in V.blocks([batch], "words", 200_000):
                raw, off = V.buffer(V.col(block, "words"))
                words, rows = raw.view(np.uint16), off // 2
                best, found = {}, []
                if len(items) and len(words):
                    k = np.flatnonzero(heavy[words])
                    cum = np.zeros((len(k) + 1, vectors.shape[1]), np.float32)
                    np.cumsum(vectors[words[k]], axis=0, out=cum[1:])
                    count = np.diff(rows)
                    for size, stride in windows:
                        # windows by row: at every stride, the last one where the row ends
                        n = np.where(count > 0, 1 + np.maximum(0, -(-(count - size) // stride)), 0)
                        row = np.repeat(np.arange(len(count)), n)
                        lo = V.ragged(np.zeros(len(n), np.int64), n) * stride
                        hi = np.minimum(lo + size, count[row])
                        a, z = np.searchsorted(k, rows[row] + lo), np.searchsorted(k, rows[row] + hi)
                        live = np.flatnonzero(z > a)
                        # neighbouring windows with the same words of weight are one
                        new = np.ones(len(live), dtype=bool)
                        new[1:] = (a[live[1:]] != a[live[:-1]]) | (z[live[1:]] != z[live[:-1]])
                        live = live[new]
                        for at in range(0, len(live), 8192):
                            part_ = live[at : at + 8192]
                            x = cum[z[part_]] - cum[a[part_]]
                            x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                            w, t = np.nonzero(x @ targets.T >= cosine)
                            # a region is a window widened by half of the item's length
                            p, half = part_[w], lengths[t] // 2
                            found.append((row[p], t, np.maximum(0, lo[p] - half), np.minimum(hi[p] + half, count[row[p]])))
                    row, item, lo, hi = probing.places(words, rows)
                    # a copy around its first or last hit begins or ends at most its span away
                    more = lengths[item] + lengths[item] // 2
                    found.append((row, item, np.maximum(0, lo - more), np.minimum(hi + more + 1, count[row])))
                    best = tried(words, rows, [np.concatenate(x) for x in zip(*found, strict=True)])
                got = [best.get(r) for r in range(block.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [V.col(block, "doc_id"), V.col(block, "r"), pa.array([g is None for g in got]), pa.array([None if g is None else ids[g[1]] for g in got], pa.int64()), pa.array([0.0 if g is None else g[0] for g in got], pa.float64()), pa.array([None if g is None else g[2] for g in got], pa.int64())],
                    ["doc_id", "r", "kept", "item_id", "lcs_share", "start"],
                )

    return encoded.mapInArrow(run, OUT)


def read_benchmark(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", most_items: int = 200_000, most_words: int = 60_000, most_cells: int = 1 << 26) -> list[Benchmark]:
    """The items, in parts of at most ``most_words`` different words and ``most_cells`` items times words: what a task holds.

    All items come to the driver, so more than ``most_items`` are an error."""
    rows = bench.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"the benchmark has over {most_items} items")
    items = sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    parts, part, words = [], [], set()
    for item in items:
        own = set(word_hashes(pa.array([item[1]]))[0].tolist())
        if part and (len(words | own) > most_words or (len(part) + 1) * len(words | own) > most_cells):
            parts.append(part)
            part, words = [], set()
        part.append(item)
        words |= own
    return [Benchmark(x) for x in [*parts, part]]


def judge(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """doc_id, kept, item_id, lcs_share, start (in words) of every row."""
    text = F.col(text_col).cast("string")
    parts = read_benchmark(bench, **bounds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.xxhash64(text) if len(parts) > 1 else F.lit(0).cast("long")).alias("r"), text.alias("text"))
    if len(parts) == 1:
        return _judge(rows, parts[0]).drop("r")
    # the best item of all parts, by id and text
    found = reduce(DataFrame.unionByName, [_judge(rows, b).where("not kept") for b in parts])
    best = F.max_by(F.struct("item_id", "lcs_share", "start"), F.struct("lcs_share", -F.coalesce("item_id", F.lit(1 << 62))))
    best = found.groupBy(F.col("doc_id").alias("g"), F.col("r").alias("h")).agg(best.alias("x"))
    both = rows.select("doc_id", "r").join(best, F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("r") == F.col("h")), "left")
    return both.select("doc_id", F.col("x").isNull().alias("kept"), "x.item_id", F.coalesce("x.lcs_share", F.lit(0.0)).alias("lcs_share"), "x.start")


def _judge(rows: DataFrame, b: Benchmark) -> DataFrame:
    encoded = checkpoint(encode(rows, b))
    if not b.items:
        return search(encoded, b, np.zeros((1, 1), np.float32))
    counted = _document_frequency(encoded, len(b.vocab), 64)
    return search(encoded, b, latent_space(encoded, b, counted=counted), df=counted[0])


def keep_clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without a benchmark passage, with all their columns; rows of one id are told apart by a hash of their text."""
    key = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("r"), F.col(text_col).cast("string").alias("text"))
    gone = reduce(DataFrame.unionByName, [_judge(rows, b).where("not kept").select("doc_id", "r") for b in read_benchmark(bench)])
    g, h = unused(docs, "g_id", "g_r")
    gone = gone.distinct().toDF(g, h)
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(g)) & (key == F.col(h)), "left_anti")
