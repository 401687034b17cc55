"""Nothing is left out: planted copies and links against brute force."""

import inspect
import random

import corpus_pipeline
from tidewarden.llm import decontam, lines, queries


def test_decontamination_of_skewed_copies(spark):
    """Copies are found whatever other copies make frequent, and where the space has no direction for them."""
    rnd = random.Random(12)
    vocab = [f"v{k}" for k in range(900)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, text(rnd.randrange(15, 60))) for k in range(120)]
    docs, leaked = [], set()
    for k, item in [*items, *(x for x in items[:6] for _ in range(80))]:
        for part in (0, 5):
            x = list(item)
            for at in rnd.sample(range(len(x)), len(x) // part if part else 0):
                x[at] = rnd.choice(vocab)
            leaked.add(len(docs))
            docs.append((len(docs), " ".join(text(rnd.randrange(0, 120)) + x + text(rnd.randrange(0, 120)))))
    docs += [(len(docs) + k, " ".join(text(200))) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    assert {r.doc_id for r in decontam.judge(df, bench).where("not kept").collect()} == leaked


def test_decontamination_steps():
    """Windows overlap by three quarters and two thirds."""
    assert inspect.signature(decontam.search).parameters["windows"].default == ((64, 16), (24, 8))


def test_short_lines_go(spark, tmp_path):
    """The query and the pipeline's stage take exact later copies of lines of any number of words, but not blank ones."""
    docs = [(1, "Menu\n\nread more\nMenu"), (2, "menu!\n\nread, more\na b c\nnew"), (3, "a b c\n...")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.removed_lines) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, "3"), 2: (4, "0,2"), 3: (1, "0")}
    kept = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, df, str(tmp_path)).collect()}
    assert kept == {1: "Menu\n\nread more", 2: "\na b c\nnew", 3: "..."}


def test_lines_against_all_pairs(spark):
    """Groups of lines linked by edit similarity 0.9 keep their first line only, be they short or long, common or rare."""
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    texts = []
    for n in [9, 10, 11, 12, 15, 19, 20, 21, 30, 45, 61, 90, 130] * 4:
        base = [rnd.choice(vocab) for _ in range(n)]
        for _ in range(5):
            x = list(base)
            for _ in range(rnd.randrange(0, max(2, n // 8))):
                at = rnd.randrange(len(x))
                x[at : at + rnd.randrange(2)] = [rnd.choice(vocab)] * rnd.randrange(2)
            texts.append(" ".join(x))
    # one common phrase in lines that differ otherwise, more than are compared two by two
    texts += [" ".join(["w1", "w2", "w3", "w4", "w5", "w6", *(rnd.choice(vocab) for _ in range(8))]) for _ in range(90)]
    rnd.shuffle(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = {w: chr(0x100 + k) for k, w in enumerate({w for t in texts for w in t.replace("w", "v").split()})}
    codes = ["".join(named[w] for w in t.replace("w", "v").split()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if lines.close(codes[i], codes[j], int(max(len(codes[i]), len(codes[j])) * 0.1 + 1e-9)):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    gone = {i for i in range(len(texts)) if find(i) != i}
    assert 100 < len(gone) < len(texts) - 100
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are all one in a line
    df = spark.createDataFrame([(i, t.translate(letters)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for block in (1024, 16):
        assert {r.doc_id for r in lines.removed_lines(df, min_words=1, block=block)[0].where("removed").collect()} == gone


def test_shared_run():
    assert [lines.shared_run(n, 0.9) for n in (1, 8, 9, 10, 12, 19, 20, 50)] == [0, 0, 5, 5, 6, 6, 6, 8]
