"""Quality rules: base rules and robust multivariate outliers, in DataFrame functions alone.

Each document has a vector of four transformed statistics.  For every cell, a
language and source, location and scatter are estimated by the minimum
covariance determinant: from several starts (medians and quartile ranges, signs,
hyperbolic tangents, the inner half), concentration steps take the mean and
covariance of the 75 % of rows of least Mahalanobis distance; two steps from
each start, then the two best go on until no determinant falls any more, and the
least determinant wins.  Rows beyond a quantile of the chi-square distribution
are rejected.  A step is one aggregation by cell, start and distance bin: sums
merge before the shuffle, so a cell with a third of all rows is no hot key.

Defined cases: a null text has no words and fails the base rule; null language
or source counts as a value of its own; cells of fewer than ``min_cell`` rows
are pooled by language, then overall; repeated rows are judged each; an empty
table gives no row; extra columns are ignored or, by ``keep_good``, kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._state import checkpoint, drop

WS = " \t\n\x0b\x0c\r"
DIMS = 4
#: Statistics as they are named in the result.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least standard deviation of each transformed statistic, so that a constant one rejects nothing by itself.
FLOORS = (0.06, 0.12, 0.3, 0.3)


#: Columns of location and scatter.
NAMES = [f"m{i}" for i in range(DIMS)] + [f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more: sort windows by hash, mark equal neighbours, add up what they cover."""

    def from_sorted(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a).h == F.get(s, b).h, F.lit(False))
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        at = F.sort_array(F.transform(hits, lambda k: F.get(s, k).i))
        zero = F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("end"))
        step = lambda acc, x: F.struct((acc.n + x + 3 - F.greatest(acc.end, x)).cast("int").alias("n"), (x + 3).cast("int").alias("end"))
        return F.aggregate(at, zero, step, lambda acc: acc.n)

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return let(F.sort_array(windows), from_sorted)

    return F.when(F.size(words) >= 4, of(words)).otherwise(F.lit(0))


def _text_stats(text: Column) -> Column:
    plain = F.trim(text, F.lit(WS))
    words = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WS, "") != "")
    return F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))).alias("w"),
        F.length(F.translate(text, WS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The statistics, the base verdict and the transformed vector beside a table's columns (prefixed ``q_``)."""
    s = docs.withColumn("q_s", _text_stats(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    s = s.withColumns({"q_n_words": F.col("q_s.w.n"), "q_word_chars": F.col("q_s.word_chars"), "q_n_symbols": F.col("q_s.n_symbols"), "q_n_dup_lines": F.col("q_s.n_dup_lines"), "q_n_repeat_words": F.col("q_s.w.r")}).drop("q_s")
    n, c = F.greatest("q_n_words", F.lit(1)), F.greatest("q_word_chars", F.lit(1))
    return s.withColumns(
        {
            "q_base_failed": (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words")),
            "q_z0": F.log(c / n),
            "q_z1": F.log(1 + 20 * F.col("q_n_symbols") / c),
            "q_z2": F.log(1 + 200 * F.col("q_n_dup_lines") / (n + 100)),
            "q_z3": F.log(1 + 20 * F.col("q_n_repeat_words") / (n + 100)),
        }
    )


def chi2_cdf(x: float, df: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(df // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return lo


def consistency(h: float, df: int = DIMS) -> float:
    """Factor that makes the covariance of the inner part ``h`` right for normal data."""
    return h / chi2_cdf(chi2_quantile(h, df), df + 2)


def _cholesky(cov: dict[tuple[int, int], Column]) -> list[tuple[str, Column]]:
    """Columns l{i}{j}, in an order in which each needs earlier ones only."""
    out = []
    for i in range(DIMS):
        for j in range(i + 1):
            rest = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            x = cov[i, j] - rest
            out.append((f"l{i}{j}", F.sqrt(F.greatest(x, F.lit(1e-12))) if i == j else x / F.col(f"l{j}{j}")))
    return out


def _keys(params: DataFrame) -> list[str]:
    """Parameters are by cell, or by cell and start."""
    return [c for c in ("cell", "start") if c in params.columns]


def _parameters(moments: DataFrame) -> DataFrame:
    """Location m{i}, Cholesky factor l{i}{j} from count n, sums s{i} and s{i}{j}; the scatter has its floors."""
    keys = _keys(moments)
    out = moments.select(*keys, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMS)], "n", *[f"s{i}{j}" for i in range(DIMS) for j in range(i + 1)])
    cov = {(i, j): F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(DIMS) for j in range(i + 1)}
    for name, x in _cholesky(cov):
        out = out.withColumn(name, x)
    return out.select(*keys, *NAMES)


def _distance(prefix: str = "q_") -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i in range(DIMS):
        y.append((F.col(f"{prefix}z{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _with_cells(stats: DataFrame, min_cell: int) -> tuple[DataFrame, DataFrame]:
    """Cells of the rows that estimates use, and the map from (language, source) to cell."""
    keyed = stats.groupBy("q_lang", "q_source").agg(F.sum(F.when(~F.col("q_base_failed"), 1).otherwise(0)).alias("n"))
    by_lang = Window.partitionBy("q_lang")
    small = F.col("n") < min_cell
    keyed = keyed.withColumn("small", F.sum(F.when(small, F.col("n")).otherwise(0)).over(by_lang))
    key = lambda *x: F.concat_ws("\x1f", *x)
    cells = keyed.select("q_lang", "q_source", F.when(~small, key(F.lit("c"), "q_lang", "q_source")).when(F.col("small") >= min_cell, key(F.lit("l"), "q_lang")).otherwise(F.lit("all")).alias("cell"))
    return stats.join(cells, ["q_lang", "q_source"]), cells


def _start(rows: DataFrame) -> DataFrame:
    """Location and scatter by medians and quartile ranges, exact to a bin of 0.02."""
    long = rows.select("cell", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.floor(F.col(f"q_z{i}") * 50).alias("b")) for i in range(DIMS)])).alias("x")).groupBy("cell", "x.d", "x.b").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cell", "d")
    cum = long.withColumns({"c": F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)), "t": F.sum("n").over(w)})
    q = lambda p: (F.min(F.when(F.col("c") >= p * F.col("t"), F.col("b"))) + 0.5) / 50
    each = cum.groupBy("cell", "d").agg(q(0.5).alias("m"), ((q(0.75) - q(0.25)) / 1.349).alias("s"))
    pick = lambda name, i: F.max(F.when(F.col("d") == i, F.col(name)))
    wide = each.groupBy("cell").agg(*[pick("m", i).alias(f"m{i}") for i in range(DIMS)], *[pick("s", i).alias(f"d{i}") for i in range(DIMS)])
    diagonal = [(F.sqrt(F.col(f"d{i}") ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    return wide.select("cell", *[f"m{i}" for i in range(DIMS)], *diagonal)


def _sums(z: list[Column]) -> list[Column]:
    return [F.sum(x).alias(f"s{i}") for i, x in enumerate(z)] + [F.sum(z[i] * z[j]).alias(f"s{i}{j}") for i in range(DIMS) for j in range(i + 1)]


def _starts(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Parameters by cell and start: those given, and scatters about the same medians from signs, tangents and the inner half."""
    scaled = rows.join(first, "cell").select("cell", *[((F.col(f"q_z{i}") - F.col(f"m{i}")) / F.col(f"l{i}{i}")).alias(f"y{i}") for i in range(DIMS)])
    norm = F.sqrt(sum((F.col(f"y{i}") ** 2 for i in range(DIMS)), F.lit(1e-12)))
    pairs = [(i, j) for i in range(DIMS) for j in range(i + 1)]
    scores = []
    for k, of in enumerate((lambda y: y / norm, F.tanh), 1):
        scores.append(scaled.groupBy("cell").agg(F.count("*").alias("n"), *_sums([of(F.col(f"y{i}")) for i in range(DIMS)])).withColumn("start", F.lit(k)))
    # correlations of bounded scores; a small share of the identity keeps them regular
    r = {(i, j): F.col(f"s{i}{j}") / F.col("n") for i, j in pairs}
    d = [F.sqrt(r[i, i] + 1e-6) for i in range(DIMS)]
    both = scores[0].unionByName(scores[1]).select("cell", "start", *[(0.95 * r[i, j] / (d[i] * d[j]) + (0.05 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in pairs])
    # written first: their roots in one expression with the sums are too much code
    both = checkpoint(both).join(first.select("cell", *[f"m{i}" for i in range(DIMS)], *[F.col(f"l{i}{i}").alias(f"d{i}") for i in range(DIMS)]), "cell")
    for name, x in _cholesky({(i, j): F.col(f"c{i}{j}") for i, j in pairs}):
        both = both.withColumn(name, x)
    # back in the scales of the statistics
    both = both.select("cell", "start", *[f"m{i}" for i in range(DIMS)], *[(F.col(f"d{i}") * F.col(f"l{i}{j}")).alias(f"l{i}{j}") for i, j in pairs])
    return first.withColumn("start", F.lit(0)).unionByName(both).unionByName(_concentrate(rows, first, 0.5).withColumn("start", F.lit(3)))


def _concentrate(rows: DataFrame, params: DataFrame, h: float) -> DataFrame:
    """One step: moments by cell (and start) and distance bin, the bins up to the part ``h`` of rows, new parameters."""
    keys = _keys(params)
    binned = rows.join(params, "cell").select(*keys, *[f"q_z{i}" for i in range(DIMS)], F.floor(F.log(_distance() + 1e-9) * 20).alias("b"))
    bins = binned.groupBy(*keys, "b").agg(F.count("*").alias("n"), *_sums([F.col(f"q_z{i}") for i in range(DIMS)]))
    w = Window.partitionBy(*keys)
    inner = bins.withColumns({"before": F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "t": F.sum("n").over(w)}).where(F.col("before") < h * F.col("t"))
    names = ["n", *[f"s{i}" for i in range(DIMS)], *[f"s{i}{j}" for i in range(DIMS) for j in range(i + 1)]]
    return _parameters(inner.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in names]))


def _log_det() -> Column:
    return sum((F.log(F.col(f"l{i}{i}")) for i in range(DIMS)), F.lit(0.0)) * 2


def _best(params: DataFrame, n: int) -> DataFrame:
    """Of each cell, the starts of least determinant."""
    order = Window.partitionBy("cell").orderBy(_log_det(), "start")
    return params.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def least_determinant(rows: DataFrame, h: float, trial_steps: int = 2, best: int = 2, settled: float = 1e-3) -> DataFrame:
    """Parameters by cell: a few steps from every start, the best go on while a determinant falls, the least one wins."""
    first = checkpoint(_start(rows))
    params = checkpoint(_starts(rows, first), first)
    for _ in range(trial_steps):
        params = checkpoint(_concentrate(rows, params, h), params)
    params = checkpoint(_best(params, best), params)
    while True:
        # a start whose step doesn't lower its determinant is left as it is
        step = checkpoint(_concentrate(rows, params, h))
        both = step.withColumn("after", _log_det()).join(params.select("cell", "start", _log_det().alias("before")), ["cell", "start"])
        new = checkpoint(both.where(F.col("after") < F.col("before") - settled).select(*step.columns), step)
        if new.isEmpty():
            return checkpoint(_best(params, 1).drop("start"), params, new)
        params = checkpoint(params.join(new.select("cell", "start"), ["cell", "start"], "left_anti").unionByName(new), params, new)


def keyed_stats(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    null = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return with_stats(docs.withColumns({"q_lang": null(lang_col), "q_source": null(source_col)}), text_col)


def estimate(stats: DataFrame, h: float = 0.75, min_cell: int = 200) -> tuple[DataFrame, DataFrame]:
    """Parameters by cell, and the cells of (language, source), from checkpointed statistics."""
    celled, cells = _with_cells(stats, min_cell)
    cells = checkpoint(cells)
    rows = stats.where(~F.col("q_base_failed")).join(cells, ["q_lang", "q_source"]).select("cell", *[f"q_z{i}" for i in range(DIMS)])
    return least_determinant(rows, h), cells


def judged(stats: DataFrame, params: DataFrame, cells: DataFrame, h: float = 0.75, tail: float = 1e-9, most_broadcast: int = 20_000) -> DataFrame:
    """Adds q_distance (squared) and q_kept.

    Parameters of up to ``most_broadcast`` languages and sources (a few MB) are
    broadcast, so that texts needn't move; more are joined by shuffle."""
    known = cells.join(params, "cell", "left")
    if cells.count() <= most_broadcast:
        known = F.broadcast(known)
    both = stats.join(known, ["q_lang", "q_source"], "left")
    d = _distance() / consistency(h)
    out = both.withColumn("q_distance", d)
    keep = F.coalesce(F.col("q_distance") <= chi2_quantile(1 - tail, DIMS), F.lit(True))
    return out.withColumn("q_kept", ~F.col("q_base_failed") & keep).drop("cell", *NAMES)


def judge(docs: DataFrame, id_col: str = "doc_id", **names: str) -> DataFrame:
    """doc_id, statistics, base_failed, distance and kept of every row."""
    renamed = docs.select(F.col(id_col).alias("q_id"), *[F.col(names.get(c, c)).alias(c) for c in ("text", "lang", "source")])
    stats = checkpoint(keyed_stats(renamed).drop("text", "lang", "source"))
    params, cells = estimate(stats)
    out = judged(stats, params, cells)
    return out.select(F.col("q_id").cast("long").alias("doc_id"), *[F.col(f"q_{s}").alias(s) for s in STATS], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_distance").alias("distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns, whatever those are called.

    Statistics are made once: they are written beside the rows that pass the base rule."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = {c: f"row.{n}" for c, n in zip(docs.columns, names, strict=True)}
    rows = docs.toDF(*names).select(F.struct(*names).alias("row"))
    rows = checkpoint(keyed_stats(rows, own["lang"], own["source"], own["text"]).where(~F.col("q_base_failed")))
    small = checkpoint(rows.select("q_lang", "q_source", "q_base_failed", *[f"q_z{i}" for i in range(DIMS)]))
    params, cells = estimate(small)
    drop(small)
    return judged(rows, params, cells).where("q_kept").select("row.*").toDF(*docs.columns)
