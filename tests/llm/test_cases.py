"""Rows that share an id or have none, columns of any name, empty tables, long and deep inputs."""

import random
import time

import numpy as np
import pytest
from test_repeats import brute_bytes, brute_words

import corpus_pipeline
from tidewarden.llm import decontam, html, langid, lines, minhash, quality, substring, suffix
from tidewarden.llm.queries import tokenizer

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("ident", [7, None])
def test_rows_of_one_id(spark, ident):
    """They count in order of their texts; a null id is the largest."""
    rnd = random.Random(3)
    shared = " ".join(rnd.choice(["aa", "b", "cc d"]) for _ in range(70))
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(30)) + shared * (k % 3) + " x" * (k % 5) for k in range(120)]
    rows = [(ident, t) for t in [*texts, texts[1], texts[1]]] + [(1, shared), (9, "y " + shared)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    ranked = [(k, rows[i][1]) for k, i in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda x: str(x)
    want = sorted(((rows[order[k]][0], *v) for k, v in brute_bytes(ranked, 100).items()), key=key)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df).collect()), key=key) == want
    # a repeat has to begin in a document of a smaller id, so rows of one id don't take each other's words
    words = brute_words([(i if i is not None else 99, t) for i, t in [(1, shared), (9, "y " + shared)]], 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(df).where("doc_id in (1, 9)").collect()}
    assert got[1] == words[1] and (ident is not None or got[9] == words[9])


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents whose other columns have the names that operators use inside."""
    names = ["q_s", "q_lang", "q_kept", "cell", "m0", "l00", "row", "id", "id_", "gone", "gone_id_", "key", "g_id", "g_r", "comp", "c0", "q_z0"]
    rnd = random.Random(5)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(n))
    rows = []
    for i in range(60):
        t = text(80) + "\n" + text(60)
        rows.append((i, t, "en", "s", len(t), *(f"{c}{i}" for c in names)))
    rows += [(60, rows[0][1], "en", "s", 1, *names), (61, None, None, None, None, *names), (None, "", "en", "s", 0, *names)]
    return spark.createDataFrame(rows, TABLE + "".join(f", {c} string" for c in names)), names


def test_names_of_columns(spark, clashing):
    df, names = clashing
    bench = spark.createDataFrame([(1, " ".join(df.first().text.split()[3:40]))], "item_id long, text string")
    made = {
        "quality": quality.keep_good(df),
        "lines": lines.keep_first(df, min_words=1),
        "near": minhash.keep_first(df),
        "clean": decontam.keep_clean(df, bench),
    }
    for name, out in made.items():
        assert out.columns == df.columns, name
        rows = [r for r in out.collect() if r.doc_id is not None and r.doc_id < 60]
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name
        made[name] = {r.doc_id for r in out.select("doc_id").collect()}
    assert {61, None} & made["quality"] == set() and {61, None} <= made["lines"] & made["near"] & made["clean"]
    assert 60 not in made["near"] | made["lines"] and made["clean"] & {0, 60} == set()
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {r.doc_id for r in quality.judge(df).where("kept").collect()}


def test_stages_of_empty_tables(spark, clashing, small):
    df = clashing[0].limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, small)
        assert out.columns == df.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, small).count() == 0


def test_deep_pages():
    """Time grows with the page, whatever is left open."""
    w = html.DEFAULT_WEIGHTS
    for a, b in (("<div>", "</x>"), ("<div>", "</b>"), ("<b>", "<p>"), ("<li>", "<td>"), ("<a><b>", "</p>"), ("<div class=a>", "</div>")):
        began = time.process_time()
        html.extract(a * 30_000 + "some words here" + b * 30_000, w)
        assert time.process_time() - began < 5, a


def test_article_without_its_label():
    """What is learned from labelled pages finds the text of others; classes that say little don't drop paragraphs."""
    page = '<html><body><div class="{c}">{a}</div><{t}><h1>Head</h1><p class="social studies">{b}</p><p class="reply-count tags">{b}</p></{t}><{t}><p>{b}</p></{t}><div class="foot-note">{a}</div></body></html>'
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    w = html.learn([page.format(c="box", a=text(12), b=text(40), t="article").replace("foot-note", "box") for _ in range(10)])
    assert w.classes["box"] < html.OUTSIDE
    a, b = text(9), text(30)
    got = html.extract(page.format(c="box", a=a, b=b, t="section").replace("foot-note", "box"), w)
    assert got == f"Head {b} {b} {b}"


def test_language_of_odd_rows(spark):
    path = tokenizer("piece_bpe_32k.model")
    rows = [(k, "der die das und nicht " * 5 if k % 2 else "the of and to in " * 5, "de" if k % 2 else "en", "x") for k in range(40)]
    train = spark.createDataFrame([*rows, (None, "the the", "en", "y"), (50, None, "en", "z"), (51, "漢" * 500, "zh", "z")], "doc_id long, text string, lang string, lang_pred string")
    langs, logp = langid.train(train, path, per_lang=15)
    assert langs == ["de", "en", "zh"] and np.allclose(np.exp(logp).sum(axis=0), 1)
    odd = spark.createDataFrame([(1, "the of", True, "a"), (1, "the of", True, "a"), (None, "und nicht", False, "b"), (2, "漢" * 3000, True, "c"), (3, None, None, "d"), (4, "7", True, "e")], "doc_id long, text string, held_out boolean, score string")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in langid.predict(odd, langs, logp, path).collect())
    assert got == [(0, "de"), (1, "en"), (1, "en"), (2, "zh"), (3, "und"), (4, "und")]
    assert langid.predict(odd.limit(0), langs, logp, path).count() == 0 and langid.train(train.limit(0), path)[0] == []


def test_benchmark_in_parts(spark):
    """A benchmark that is too large for a task is searched in parts, with the same result."""
    rnd = random.Random(9)
    text = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    items = [(k, text(30)) for k in range(12)]
    docs = [(k, " ".join(text(60) + items[k % 12][1] * (k % 3 == 0) + text(40))) for k in range(40)] + [(3, "other"), (None, " ".join(items[1][1]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    whole = sorted(map(str, decontam.judge(df, bench).select("doc_id", "kept", "item_id").collect()))
    assert len(decontam.read_benchmark(bench, most_words=80)) > 2
    assert sorted(map(str, decontam.judge(df, bench, most_words=80).select("doc_id", "kept", "item_id").collect())) == whole
