"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is summed over all its segmentations by the forward
algorithm; no piece spans two words, so a text's is the product over its words,
and each distinct word of a block is scored once.  Bytes are pieces too, so
every text has a segmentation.

Defined cases: a null text, or one without any letter, is ``und`` with score 0;
repeated rows give repeated results; an empty table gives no row; without any
labelled row all texts are ``und``; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vec as V
from ._state import checkpoint

#: Bytes of a run of a long word when pieces are counted; every byte of a text counts.
RUN = 64
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


class Vocabulary:
    """Pieces as byte strings, found by the hash of a span."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = {bytes([b]) for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                # a word's mark of its start is a space here, as it stands before each word
                pieces.add(sp.id_to_piece(i).replace("▁", " ").encode())
        self.pieces = sorted(pieces)
        self.tables = []
        for size in range(1, max(map(len, self.pieces)) + 1):
            own = [k for k, p in enumerate(self.pieces) if len(p) == size]
            raw = np.frombuffer(b"".join(self.pieces[k] for k in own), np.uint8)
            h = V.prefix(raw)
            at = np.arange(len(own), dtype=np.int64) * size
            keys = V.spans(h, at, at + size) if own else np.empty(0, V.U64)
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array(own, np.int64)[order]))

    def marks(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a piece of that size has some first and last byte, and some low bits of its hash."""
        known = self.__dict__.setdefault("_marks", {})
        if size not in known:
            keys, own = self.tables[size - 1]
            ends, low = np.zeros((256, 256), dtype=bool), np.zeros(1 << 16, dtype=bool)
            ends[[self.pieces[k][0] for k in own], [self.pieces[k][-1] for k in own]] = True
            low[(keys & V.U64(0xFFFF)).astype(np.int64)] = True
            known[size] = ends, low
        return known[size]

    def find(self, h: np.ndarray, start: np.ndarray, size: int, buf: np.ndarray | None = None) -> np.ndarray:
        """Piece numbers of the spans of one size, -1 where there is none; with the bytes, few spans are looked up."""
        keys, own = self.tables[size - 1]
        out = np.full(len(start), -1, np.int64)
        if not len(keys):
            return out
        ends, low = self.marks(size)
        k = np.arange(len(start)) if buf is None else np.flatnonzero(ends[buf[start], buf[start + size - 1]])
        got = V.spans(h, start[k], start[k] + size)
        some = np.flatnonzero(low[(got & V.U64(0xFFFF)).astype(np.int64)])
        k, got = k[some], got[some]
        at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
        hit = keys[at] == got
        out[k[hit]] = own[at[hit]]
        return out


def spaced_words(buf: np.ndarray, off: np.ndarray):
    """The distinct words, each as a span of a new buffer with a space before it, and their occurrences by row."""
    s, e, rows = V.words(buf, off)
    _, first, inverse = np.unique(V.spans(V.prefix(buf), s, e), return_index=True, return_inverse=True)
    size = e[first] - s[first]
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    out[V.ragged(starts + 1, size)] = buf[V.ragged(s[first], size)]
    return out, starts, ends, inverse, rows


#: Bytes of words whose sums stay within doubles, and the factor a byte that keeps them there.
SHORT, LIFT = 48, 2.5


def forward(vocab: Vocabulary, logp: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log likelihood of each word for each language (columns of ``logp``).

    Short words by plain sums, each byte lifted by a constant; long ones, and those whose sum is 0, by logarithms."""
    out = np.zeros((len(starts), logp.shape[1]))
    size = ends - starts
    short = np.flatnonzero(size <= SHORT)
    if len(short):
        lifted = np.exp(logp + LIFT * np.array([len(p) for p in vocab.pieces])[:, None])
        got = _sums(vocab, lifted, buf, starts[short], size[short], False)
        with np.errstate(divide="ignore"):
            out[short] = np.log(got) - LIFT * size[short][:, None]
    long = np.flatnonzero((size > SHORT) | ~np.isfinite(out).all(axis=1))
    if len(long):
        out[long] = _sums(vocab, logp, buf, starts[long], size[long], True)
    return out


def _sums(vocab: Vocabulary, weight: np.ndarray, buf: np.ndarray, starts: np.ndarray, size: np.ndarray, logs: bool) -> np.ndarray:
    """The forward algorithm over all words at once, in logarithms or not."""
    n, k = len(starts), weight.shape[1]
    out = np.zeros((n, k))
    h = V.prefix(buf)
    order = np.argsort(-size, kind="stable")  # words of at least t bytes come first
    starts, size = starts[order], size[order]
    longest = len(vocab.tables)
    ring = np.full((longest + 1, n, k), -np.inf if logs else 0.0)
    ring[0] = 0.0 if logs else 1.0
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
    for t in range(1, int(size[0]) + 1):
        m = int(live[t - 1])
        got = np.full((m, k), -np.inf if logs else 0.0)
        for length in range(1, min(longest, t) + 1):
            piece = vocab.find(h, starts[:m] + (t - length), length, buf)
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                before, own = ring[(t - length) % (longest + 1)][hit], weight[piece[hit]]
                got[hit] = np.logaddexp(got[hit], before + own) if logs else got[hit] + before * own
        ring[t % (longest + 1)][:m] = got
        ends_here = slice(int(live[t]) if t < len(live) else 0, m)
        out[order[ends_here]] = got[ends_here]
    return out


def backward_counts(vocab: Vocabulary, p: np.ndarray, buf, starts, ends, weight) -> np.ndarray:
    """Expected counts of pieces under one language's probabilities, by forward and backward sums (probabilities scaled by word)."""
    h = V.prefix(buf)
    size = ends - starts
    longest = len(vocab.tables)
    total = np.zeros(len(vocab.pieces))
    # a long word, as in scripts that don't part them, counts in runs, so that the tables stay small
    parts = -(-size // RUN)
    first = V.ragged(np.zeros(len(size), np.int64), parts) * RUN
    starts, weight = np.repeat(starts, parts) + first, np.repeat(weight, parts)
    size = np.minimum(np.repeat(size, parts) - first, RUN)
    for at in range(0, len(starts), 20_000):
        s, n, w = starts[at : at + 20_000], size[at : at + 20_000], weight[at : at + 20_000]
        top = int(n.max()) if len(n) else 0
        edges = []  # (end position, rows, length, pieces)
        alpha = np.zeros((top + 1, len(s)))
        alpha[0] = 1.0
        for t in range(1, top + 1):
            rows = np.flatnonzero(n >= t)
            for length in range(1, min(longest, t) + 1):
                piece = vocab.find(h, s[rows] + (t - length), length, buf)
                hit = piece >= 0
                r, q = rows[hit], piece[hit]
                if len(r):
                    edges.append((t, r, length, q))
                    alpha[t, r] += alpha[t - length, r] * p[q]
        beta = np.zeros((top + 1, len(s)))
        beta[n, np.arange(len(s))] = 1.0
        z = np.maximum(alpha[n, np.arange(len(s))], 1e-300)
        for t, r, length, q in reversed(edges):
            flow = beta[t, r] * p[q]
            beta[t - length, r] += flow
            total += np.bincount(q, alpha[t - length, r] * flow / z[r] * w[r], len(total))
    return total


def sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """(doc_id, lang) of the ``per_lang`` documents of each language of smallest hashed id, repeated ones once.

    Hashes below a bound that takes a few more than that are enough, so no language is sorted as a whole."""
    ids = rows.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id"))
    counted = ids.groupBy("lang").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    want, more = per_lang + 12 * math.isqrt(per_lang) + 64, 1
    while True:
        # the hash as a share of its range
        share = (F.col("h").cast("double") / float(1 << 64)) + 0.5
        low = ids.join(counted, "lang").where(share * F.col("n") <= want * more)
        chosen = low.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang)
        short = counted.join(chosen.groupBy("lang").agg(F.count("*").alias("got")), "lang", "left").where(F.coalesce("got", F.lit(0)) < F.least("n", F.lit(per_lang)))
        if short.isEmpty():
            return chosen.select("doc_id", "lang")
        more *= 4


def train(docs: DataFrame, model_path: str, per_lang: int = 1500, rounds: int = 3, smooth: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages and their log piece probabilities, by expectation maximisation.

    Fitted on ``per_lang`` documents of each language, those of smallest hashed
    id (a documented bound). ``docs`` has doc_id, text and lang; its rows with
    null are left out. A language costs a column of the vocabulary's size.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    chosen = checkpoint(sample(rows, per_lang))
    if chosen.isEmpty():
        return [], np.empty((0, 0))
    chosen = rows.join(chosen, ["doc_id", "lang"]).select("lang", "text")

    def count(batches):
        """Distinct words of each block and language with their counts."""
        for block in V.blocks(batches, "text"):
            names = np.array(V.col(block, "lang").to_pylist(), dtype=object)
            for lang in sorted(set(names.tolist())):
                part = block.filter(pa.array(names == lang))
                buf, starts, ends, inverse, _ = spaced_words(*V.buffer(V.col(part, "text")))
                n = np.bincount(inverse, minlength=len(starts))
                raw = buf.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(starts), pa.string()), pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    def fit(key, pdf):
        vocab = Vocabulary(model_path)
        sizes = pdf.word.str.len().to_numpy()
        buf = np.frombuffer(b"".join(pdf.word), np.uint8)
        ends = np.cumsum(sizes)
        starts, w = ends - sizes, pdf.n.to_numpy().astype(float)
        # start: long pieces are likelier, as counts of a greedy segmentation would have it
        p = np.array([4.0 ** min(len(x), 6) for x in vocab.pieces])
        p /= p.sum()
        for _ in range(rounds):
            c = backward_counts(vocab, p, buf, starts, ends, w) + smooth
            p = c / c.sum()
        return pd.DataFrame({"lang": [key[0]], "logp": [np.log(p).tolist()]})

    counted = chosen.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = {r.lang: r.logp for r in counted.groupBy("lang").applyInPandas(fit, "lang string, logp array<double>").collect()}
    langs = sorted(got)
    return langs, np.array([got[x] for x in langs]).T.copy()


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, model_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; ``docs`` has doc_id, text, held_out."""

    def run(batches):
        vocab = Vocabulary(model_path)
        for block in V.blocks(batches, "text"):
            buf, off = V.buffer(V.col(block, "text"))
            texts = V.col(block, "text").to_pylist()
            wbuf, starts, ends, inverse, rows = spaced_words(buf, off)
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if langs:
                each = np.empty((len(starts), len(langs)))
                by_size = np.argsort(ends - starts, kind="stable")  # so that one long word doesn't hold up the rest
                step = max(256, 200_000 // len(langs))  # what ``forward`` holds is words times languages times the longest piece
                for at in range(0, len(by_size), step):
                    k = by_size[at : at + step]
                    each[k] = forward(vocab, logp, wbuf, starts[k], ends[k])
                cum = np.concatenate([np.zeros((1, len(langs))), np.cumsum(each[inverse], axis=0)])
                for i, text in enumerate(texts):
                    if text is None or not any(map(str.isalpha, text)):
                        continue
                    total = cum[rows[i + 1]] - cum[rows[i]]
                    best = int(np.argmax(total))  # the first in order of name wins a tie
                    names[i], scores[i] = langs[best], 1.0 / float(np.exp(np.minimum(total - total[best], 0.0)).sum())
            yield pa.RecordBatch.from_arrays([V.col(block, "doc_id"), V.col(block, "held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("held_out").cast("boolean").alias("held_out")).mapInArrow(run, OUT)


def accuracy(pred: DataFrame, truth: DataFrame) -> float:
    """Share of held-out rows with a known language that are predicted right."""
    both = pred.where("held_out").join(truth.where("lang is not null").select("doc_id", "lang"), "doc_id")
    return both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first().a or math.nan
