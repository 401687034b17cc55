"""Substring operators against brute force, hot paths included."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidewarden.llm import _repeats, substring, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 5))) for _ in range(30)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passages = [text(70) for _ in range(3)]
    docs = [(k, text(rnd.randrange(0, 60)) + "\n" + rnd.choice([*passages, ""]) + " " + text(rnd.randrange(0, 60))) for k in range(60)]
    docs += [(100, docs[3][1]), (101, docs[3][1].replace("a", "b", 1)), (102, ""), (103, None), (104, passages[0] * 3), (105, "x" * 400), (106, "\x00" * 250)]
    rnd.shuffle(docs)
    return docs


def brute_bytes(docs, width):
    seen, out = set(), {}
    for i, t in sorted(docs):
        y = (t or "").encode()
        gone = bytearray(len(y))
        for k in range(len(y) - width + 1):
            s = y[k : k + width]
            if s in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(s)
        kept = bytes(c for c, g in zip(y, gone) if not g)
        out[i] = (len(y), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(docs, width):
    first, out = {}, {}
    for i, t in sorted(docs):
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot,cap", [(32, 4096), (1, 1)])
def test_bytes(spark, monkeypatch, hot, cap):
    docs = corpus()
    real = _repeats.repeats
    monkeypatch.setattr(_repeats, "repeats", lambda *a, **k: real(*a, **k, hot=hot, cap=cap))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df).collect()}
    assert got == brute_bytes(docs, 100)


@pytest.mark.parametrize("hot,cap", [(32, 4096), (1, 1)])
def test_words(spark, monkeypatch, hot, cap):
    docs = corpus(2)
    real = _repeats.repeats
    monkeypatch.setattr(_repeats, "repeats", lambda *a, **k: real(*a, **k, hot=hot, cap=cap))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(df).collect()}
    assert got == brute_words(docs, 50)


def test_long_documents_in_parts():
    """Blocks cut inside a document give anchors for every window."""
    rnd = np.random.default_rng(0)
    buf = rnd.integers(97, 100, 5000).astype(np.uint8)
    off = np.array([0, 2000, 2050, 5000])
    for sub in (700, 10**6):
        s = suffix.Bytes(sub=sub)
        row, _, _, a, n = s.anchors(s.read(buf, off))
        windows = sorted((r, x) for r, b, m in zip(row, a, n) for x in range(b, b + m))
        assert windows == [(0, x) for x in range(1901)] + [(2, x) for x in range(2851)]


def test_longest_previous_factor():
    text = "abracadabra_abracadabra"
    sa = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda i, j: next((k for k in range(len(text)) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or max(i, j) + k >= len(text)), 0)
    lcp = np.array([0] + [common(a, b) for a, b in zip(sa, sa[1:])])
    got = suffix.longest_previous_factor(np.array(sa), lcp)
    for k, i in enumerate(sa):
        assert got[k] == max([common(i, j) for j in range(i)], default=0)
    for width in (1, 3, 6):
        # cut at a width, factors of that width stay what they are
        cut = suffix.longest_previous_factor(np.array(sa), np.where(np.asarray(lcp) >= width, width, 0))
        assert ((cut >= width) == (got >= width)).all()


def test_difference_cover():
    for v in (2, 7, 13, 21, 31):
        d = substring.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert len(substring.difference_cover(31)) == 6


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, anchor string, pk int")
    assert suffix.dedup(empty).count() == 0 and substring.dedup(empty).count() == 0
    one = spark.createDataFrame([(None, "a " * 60, "x", 1), (4, "a " * 60, "y", 2)], "doc_id long, text string, seg string, r int")
    got = {r.doc_id: r.n_removed for r in substring.dedup(one).collect()}
    assert got == {4: 0, None: 60}
    assert sorted(r.n_removed for r in suffix.dedup(one).collect()) == [118, 120]
    twice = spark.createDataFrame([(1, "b " * 60), (1, "b " * 60)], "doc_id long, text string")
    assert [r.n_removed for r in substring.dedup(twice).collect()] == [0, 0]
