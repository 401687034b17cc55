"""Near-duplicates, lines, decontamination against brute force."""

import random
import re

import numpy as np
import pytest

from tidewarden.llm import _graph, decontam, lines, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def families(seed, n=8):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(n):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 120))]
        for _ in range(rnd.randrange(1, 7)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append(" ".join(w))
    docs += ["", None, "one two", "ONE two", "a b c d e", "A B\tC D  e", " ", docs[0], docs[0]]
    return list(enumerate(docs))


def brute_components(docs, share=75):
    sets = {}
    for i, t in docs:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates(spark, block):
    docs = families(block)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, lead string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, block=block).collect()}
    assert got == brute_components(docs)
    kept = {r.doc_id for r in minhash.keep_first(df).collect()}
    assert kept == {i for i, x in got.items() if x[2]}


def test_near_duplicates_of_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "q")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, 3, False), (2, 2, True), (3, 3, True), (3, 3, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_all_pairs_within_the_distance_meet():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 16, (200, minhash.PLACES)).astype(np.uint16)
    b = a.copy()
    for k in range(200):
        at = rnd.choice(minhash.PLACES, minhash.FAR, replace=False)
        b[k, at] ^= rnd.integers(1, 1 << 16, minhash.FAR).astype(np.uint16)
    x, y = minhash.chunk_keys(a), minhash.chunk_keys(b)
    assert (x == y).any(axis=1).all()
    place = minhash.meeting_place(a != b)
    same = x == y
    assert same[np.arange(200), place].all()
    assert ((x & np.uint64(127)) == np.arange(minhash.PLACES, dtype=np.uint64)).all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in _graph.components(df).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert _graph.components(df.limit(0)).count() == 0


def test_lines(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(150)]
    near = [*long[:70], word(), *long[71:]]
    docs = [(1, "Alpha beta gamma 12.\nshort\n\n" + " ".join(long)), (2, "alpha, BETA gamma 34\nshort\n" + " ".join(near) + "\nown words are left here"), (3, "alpha beta gamma 99"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in docs], "doc_id long, text string, node string, n_chars long")
    got = {r.doc_id: (r.n_lines, r.removed_lines) for r in lines.dedup(df).collect()}
    assert got == {1: (2, ""), 2: (3, "0,2"), 3: (1, "0"), 4: (0, ""), 5: (0, "")}
    kept = {r.doc_id: (r.text, r.n_chars) for r in lines.keep_first(df).collect()}
    assert set(kept) == {1, 2, 4, 5} and kept[2] == ("short\nown words are left here", 29)
    assert lines.dedup(df.limit(0)).count() == 0


def test_line_keys_meet():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
    for flips in (1, 2, 3):
        b = a.copy()
        for k in range(300):
            for bit in rnd.choice(64, flips, replace=False):
                b[k] ^= np.uint64(1) << np.uint64(bit)
        blocks = lambda x: [(x >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in lines.BLOCKS]
        same = np.array([x == y for x, y in zip(blocks(a), blocks(b))])
        assert (same.sum(axis=0) >= 2).all()


def test_edit_band():
    rnd = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 12))) for _ in range(2))
        t = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(t[j] + 1, new[-1] + 1, t[j - 1] + (x != y)))
            t = new
        for most in (0, 1, 3, 12):
            assert lines.close(a, b, most) == (t[-1] <= most)


def test_lcs():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(a, b) == t[-1][-1]


def test_decontamination(spark):
    rnd = random.Random(6)
    vocab = [f"v{k}" for k in range(3000)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, text(rnd.randrange(15, 60))) for k in range(20)] + [(20, "tiny one"), (21, ""), (22, None)]
    docs, leaked = [], set()
    for k in range(200):
        t = text(rnd.randrange(0, 300))
        if k % 4 == 0:
            x = items[rnd.randrange(20)][1].split()
            for _ in range(len(x) // 12):
                x[rnd.randrange(len(x))] = rnd.choice(vocab)
            t = f"{t} {' '.join(x).upper()} {text(rnd.randrange(0, 300))}"
            leaked.add(k)
        docs.append((k, t))
    docs += [(900, "it has a Tiny, one in it"), (901, "tiny but not one"), (902, None), (903, "")]
    leaked.add(900)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.judge(df, bench).collect()
    assert {r.doc_id for r in got if not r.kept} == leaked and len(got) == len(docs)
    assert {r.doc_id for r in decontam.keep_clean(df, bench).collect()} == {i for i, _ in docs} - leaked
    assert decontam.judge(df, bench.limit(0)).where("not kept").count() == 0
    assert decontam.judge(df.limit(0), bench).count() == 0
