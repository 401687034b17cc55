"""Pages, conversations, quality, language, packing."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewarden.llm import _vec, chat, html, langid, packing, quality
from tidewarden.llm.queries import tokenizer

BPE = tokenizer("byte_bpe_50k.json")


@given(st.text(alphabet="<>/s[]INST\\|im_ende \n", max_size=60))
@settings(max_examples=300)
def test_escape(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)


def test_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "b\\n\n<|end|>\n"), (1, 1, "user", None), (1, None, "system", "ä<|turn|>"), (2, 0, "odd\nrole\\x", "t"), (None, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns = chat.format_turns(df, BPE)
    got = {r.conv_id: r for r in chat.digest(turns, BPE).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda x: (x[0] or 0, -1 if x[1] is None else x[1])):
        by.setdefault(c, []).append((r or "", x or ""))
    for c, ts in by.items():
        r, loss = got[c], "".join(x for role, x in ts if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(ts), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(a, b)) for a, b in ts)
    assert chat.digest(chat.format_turns(df.limit(0), BPE), BPE).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<%s><h1>Head &amp; more</h1><p>One   <b>two</b>three<br>four &lt;x&gt; &eacute;<p>Five<div class="newsletter">Sign up</div><table><tr><td>six<td>seven</table>
<aside>side</aside><form><input value="q"><button>Send</button></form><p>Eight nine ten eleven twelve.</p><section class="comments"><p>I agree!</p></section></%s><footer>&copy; end</footer>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div id="content"'])
def test_page(tag):
    w = html.learn([PAGE % ("article", "article")] * 5)
    assert html.extract(PAGE % (tag, tag.split()[0]), w) == "Head & more One twothree four <x> é Five six seven Eight nine ten eleven twelve."


def test_page_corners(spark):
    assert html.extract(None, html.DEFAULT_WEIGHTS) == html.extract("", html.DEFAULT_WEIGHTS) == html.extract("<p></p><script>x", html.DEFAULT_WEIGHTS) == ""
    assert html.extract("just text &am; x&nbsp;y", html.DEFAULT_WEIGHTS) == "just text &am; x y"
    assert html.best_region([-1.0, 2.0, -1.0, 2.0, -9.0, 1.0]) == (1, 4) and html.best_region([-1.0]) == (0, 0)
    df = spark.createDataFrame([(1, "u", PAGE % ("article", "article"), 3), (2, None, None, 4), (2, "v", "<article>a b", 5)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.n_chars, r.text) for r in html.extract_pages(df, html.fit(df)).collect())
    assert [x[:2] for x in got[1:]] == [(2, 0), (2, 3)] and [x[2] for x in got[1:]] == ["", "a b"] and got[0][0] == 1
    assert html.extract_pages(df.limit(0), html.fit(df.limit(0))).count() == 0


def test_quality_statistics(spark):
    rnd = random.Random(1)
    words = ["a", "bé", "#c", "d$%", "e"]
    texts = [None, "", "   ", "a a a a a a", "x y\nx y\n\nz\nx y"] + ["".join(rnd.choice(words) + rnd.choice([" ", "\n", " \t", "\x0b"]) for _ in range(rnd.randrange(1, 90))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, rnd.choice(["en", None]), rnd.choice(["s", None]), 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, q_z0 int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(rep)), t
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.judge(df.limit(0)).count() == 0


def test_quality_outliers(spark):
    """Planted outliers go and the rest stays, also where a third of a cell is junk; parameters match a direct computation."""
    rnd = random.Random(2)
    word = lambda a, b: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(a, b)))
    rows = []
    for i in range(900):
        junk = i % 9 < 2
        rows.append((i, " ".join(word(2, 8) + ("###" if junk else "") for _ in range(rnd.randrange(60, 200))), "en", f"s{i % 2}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert all(got[i] == (i % 9 >= 2) for i in got)
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, k in got.items() if k}
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.75, 4), 4) - 0.75) < 1e-9 and abs(quality.chi2_quantile(0.75, 4) - 5.385) < 1e-3
    # one concentration step against numpy
    stats = quality.keyed_stats(df).cache()
    celled, cells = quality._with_cells(stats, 200)
    part = stats.where("not q_base_failed").join(cells, ["q_lang", "q_source"]).select("cell", *[f"q_z{i}" for i in range(4)])
    start = quality._start(part)
    step = {r.cell: r for r in quality._concentrate(part, start, 0.75).collect()}
    p, z = start.toPandas().set_index("cell"), part.toPandas()
    for cell, g in z.groupby("cell"):
        x = g[[f"q_z{i}" for i in range(4)]].to_numpy()
        m = p.loc[cell, [f"m{i}" for i in range(4)]].to_numpy(float)
        low = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                low[i, j] = p.loc[cell, f"l{i}{j}"]
        d = (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0)
        b = np.floor(np.log(d + 1e-9) * 20)
        keep = np.zeros(len(b), bool)
        for v in sorted(set(b)):
            if (b < v).sum() < 0.75 * len(b):
                keep |= b == v
        cov = np.cov(x[keep].T, bias=True) + np.diag(np.square(quality.FLOORS))
        want = np.linalg.cholesky(cov)
        assert np.allclose([step[cell][f"m{i}"] for i in range(4)], x[keep].mean(axis=0))
        assert np.allclose([step[cell][f"l{i}{j}"] for i in range(4) for j in range(i + 1)], [want[i, j] for i in range(4) for j in range(i + 1)], atol=1e-6)


class Toy(langid.Vocabulary):
    def __init__(self, pieces):
        self.pieces = sorted(pieces)
        self.tables = []
        for size in range(1, 5):
            own = [k for k, p in enumerate(self.pieces) if len(p) == size]
            raw = np.frombuffer(b"".join(self.pieces[k] for k in own), np.uint8)
            at = np.arange(len(own), dtype=np.int64) * size
            keys = _vec.spans(_vec.prefix(raw), at, at + size) if own else np.empty(0, np.uint64)
            o = np.argsort(keys)
            self.tables.append((keys[o], np.array(own, np.int64)[o]))


def test_forward_sums_all_segmentations():
    vocab = Toy([b" ", b"a", b"b", b"ab", b" a", b"ba", b"bab", b" aba"])
    rnd = np.random.default_rng(1)
    p = rnd.random((len(vocab.pieces), 2))
    p /= p.sum(axis=0)
    index = {x: k for k, x in enumerate(vocab.pieces)}

    def total(w, lang):
        return 1.0 if not w else sum(p[index[w[:k]], lang] * total(w[k:], lang) for k in range(1, 5) if w[:k] in index and len(w) >= k)

    ws = [b" a", b" abab", b" bbbaab", b" b"]
    buf = np.frombuffer(b"".join(ws), np.uint8)
    ends = np.cumsum([len(w) for w in ws])
    starts = ends - [len(w) for w in ws]
    got = langid.forward(vocab, np.log(p), buf, starts, ends)
    for k, w in enumerate(ws):
        assert np.allclose(np.exp(got[k]), [total(w, 0), total(w, 1)])
    c = langid.backward_counts(vocab, p[:, 0], buf, starts, ends, np.ones(4))
    assert abs(sum(c[k] * len(x) for k, x in enumerate(vocab.pieces)) - len(buf)) < 1e-6


def test_language(spark, small):
    from tidewarden.llm.queries import op9_language_id

    out = op9_language_id(spark, small)
    assert langid.accuracy(out, spark.read.parquet(f"{small}/documents.parquet")) > 0.95
    path = tokenizer("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, None, True), (2, "123 !?", False), (3, "the and of", True), (4, "", True)], "doc_id long, text string, held_out boolean")
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, [], np.empty((0, 0)), path).collect()} == dict.fromkeys((1, 2, 3, 4), "und")


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    rnd = random.Random(3)
    parts = ["word", "Wörter", " ", "  ", "\n", "\n\n", "\t", " ", "　", " ", "\u0085", "…", "’s", "'ll", "123", "!?", "<|endoftext|>", "é", "漢字", "\x1c", "\x0b", "🙂"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 40))) for _ in range(400)]
    encode = packing.ChunkEncoder(BPE, keep=50)
    for at in range(0, 400, 40):
        some = texts[at : at + 40]
        ids, off = encode(*_vec.buffer(pa.array(some)))
        for k, x in enumerate(some):
            assert ids[off[k] : off[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_packing(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(1000, None), (1001, "")]
    df = spark.createDataFrame([(i, x, 5) for i, x in docs], "doc_id long, text string, offset int").repartition(3)
    rows = packing.pack(df, BPE).collect()
    seqs, pieces = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for spans in seqs.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0  # no padding at all
    for i, x in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        at = 0
        for start, n, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n]))
            at += n
        assert at == len(ids)
    assert packing.pack(df.limit(0), BPE).count() == 0
