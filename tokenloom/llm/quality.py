"""Quality rules: base rules, then robust multivariate outliers.

Per text a handful of counts becomes a vector of seven transformed statistics. For each
(language, source) the minimum-covariance-determinant estimate of centre and scatter is
found over all rows that pass the base rules: concentration steps from two deterministic
starts (median/MAD and classical), the better determinant wins, then one reweighting.
Rows whose Mahalanobis distance exceeds a chi-squared quantile are rejected.

Statistics are integers (1/1024 units), so all sums are exact and the estimates don't
depend on how rows are partitioned. A concentration step is one pass over the narrow
statistics table that sums moments by (group, start, distance bucket): partial sums are
combined before the shuffle, so a hot group costs no more than another, and from the
bucket sums alone come the h-th smallest distance and the moments of all rows up to it
(rows of that bucket, 1/32 octave wide, enter together).

Cases: null or empty text has no words and fails the base rules; null language or source
is a group like any other; (language, source) pairs of fewer than ``min_rows`` usable rows
share one estimate per language, and those still too few one estimate overall; with
fewer than that, nothing is rejected beyond the base rules. Repeated rows count as often
as they occur. Texts of any length are read whole. Further columns are kept as they are,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import checked_broadcast, discard, quoted, returned, written
from .tokencache import forget

UNIT = 1024
DIMS = ("symbols", "word_length", "upper", "punctuation", "dup_lines", "repeats", "digits")
#: Standard deviation added to each statistic: what counts as no difference at all. More
#: than half of the rows have no repeated lines, no repeats and no digits, so every robust
#: scale of these three is 0 and the floor decides: a sixth of the largest value (a seventh
#: for digits), so that each of them alone can pass the cut.
FLOOR = (0.25, 0.25, 0.25, 0.25, 0.4, 0.3, 0.4)
P = len(DIMS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS, UPPER, LETTER, DIGIT, PUNCT = (np.zeros(256, bool) for _ in range(5))
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = True
LETTER[0xC0:] = True  # first bytes of characters beyond ASCII
DIGIT[48:58] = True
PUNCT[[c for c in range(33, 127) if not (chr(c).isalnum() or SYMBOLS[c])]] = True


def _repeated(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once within its document."""
    key = tk.mix(h ^ tk.mix(of.astype(np.uint64) + tk.U(1)))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _distinct(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per document."""
    key = np.unique(np.stack([of.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
    return np.bincount(key[0].astype(np.int64), minlength=n)


def chunk_stats(ch: tk.Chunk) -> dict[str, np.ndarray]:
    """Counts and the statistic vector (integers) of each document of a chunk."""
    n, buf, offs = ch.n, ch.buf, ch.offs
    starts, ends, first = tk.words(ch)
    n_words = np.diff(first)
    of_word = np.repeat(np.arange(n), n_words)
    char = ~tk.CONT[buf]
    word_chars = tk.counts_below(char & ~tk.SEP[buf], offs)
    n_symbols = tk.counts_below(SYMBOLS[buf], offs)
    h = tk.span_hashes(buf, starts, ends)
    g, gfirst = tk.shingles(h, first)
    of_g = np.repeat(np.arange(n), np.diff(gfirst))
    again = np.flatnonzero(_repeated(g, of_g))
    at = again + (first[:-1] - gfirst[:-1])[of_g[again]]
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[at + i] = True
    n_repeat = tk.counts_below(covered, first)
    ls, le, lfirst = tk.lines(ch)
    some = np.concatenate([[0], np.cumsum(~tk.SEP[buf])])
    has = some[le] > some[ls]
    of_line = np.repeat(np.arange(n), np.diff(lfirst))[has]
    n_lines = np.bincount(of_line, minlength=n)
    n_dup = n_lines - _distinct(tk.span_hashes(buf, ls[has], le[has]), of_line, n)
    chars, wc = np.maximum(word_chars, 1), np.maximum(n_words, 1)
    letters = np.maximum(tk.counts_below(LETTER[buf], offs), 1)
    x = np.stack(
        [
            np.log1p(100 * n_symbols / chars),
            4 * np.log(np.maximum(word_chars, 1) / wc),
            np.log1p(20 * tk.counts_below(UPPER[buf], offs) / letters),
            np.log1p(20 * tk.counts_below(PUNCT[buf], offs) / chars),
            np.log1p(10 * n_dup / np.maximum(n_lines, 1)),
            np.log1p(10 * n_repeat / wc),
            np.log1p(20 * tk.counts_below(DIGIT[buf], offs) / chars),
        ]
    )
    x = np.rint(x * UNIT).astype(np.int64)
    return dict(zip(COUNTS, (n_words, word_chars, n_symbols, n_dup, n_repeat))) | {f"x{i}": x[i] for i in range(P)}


def _with_stats(text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            for ch in tk.chunks(col):
                s = chunk_stats(ch)
                part = b.slice(ch.lo, ch.n)
                arrays = [part.column(part.schema.get_field_index(k)) for k in keep]
                arrays.append(pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in s.values()], list(s)))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, STAT])

    return run


STAT = "_stat"
_STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in (*COUNTS, *(f"x{i}" for i in range(P)))) + ">"


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the struct ``_stat``."""
    df = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.select(*keep).schema), f"{STAT} {_STRUCT}"])
    return df.mapInArrow(returned(_with_stats("text", keep)), schema)


def base_failed(s: str = STAT, min_words: int = 50, repeat_percent: int = 50) -> Column:
    w = F.col(f"{s}.n_words")
    return (w < min_words) | (100 * F.col(f"{s}.n_repeat_words") > repeat_percent * w)


# == chi-squared ==


def chi2_cdf(x: float, k: float) -> float:
    """Regularised lower incomplete gamma function P(k/2, x/2), by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = 1
    while term > total * 1e-17:
        term *= z / (a + n)
        total += term
        n += 1
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(fraction: float, k: int) -> float:
    """Factor on the scatter of the ``fraction`` of normal rows that are nearest."""
    return fraction / chi2_cdf(chi2_quantile(fraction, k), k + 2) if fraction < 1 else 1.0


# == the estimates ==

_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_PAR = [*(f"m{i}" for i in range(P)), *(f"k{i}_{j}" for i, j in _PAIRS), "logdet"]
_KEY = ("_lang", "_source")
_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in _PAIRS)]


def _inverse(scale: float, floors: tuple[float, ...]):
    """Rows of sums to centre, inverse scatter and log-determinant (1/1024 units in, 1 out)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in it:
            n = d["n"].to_numpy(np.float64)
            mean = np.stack([d[f"s{i}"].to_numpy(np.float64) for i in range(P)], 1) / n[:, None]
            cov = np.empty((len(d), P, P))
            for i, j in _PAIRS:
                cov[:, i, j] = cov[:, j, i] = d[f"q{i}_{j}"].to_numpy(np.float64) / n - mean[:, i] * mean[:, j]
            cov = cov / UNIT**2 * scale
            cov[:, range(P), range(P)] = np.maximum(cov[:, range(P), range(P)], 0) + np.square(floors)
            out = {k: d[k] for k in (*_KEY, "start")}
            out |= {f"m{i}": mean[:, i] / UNIT for i in range(P)}
            inv = np.linalg.inv(cov)
            out |= {f"k{i}_{j}": inv[:, i, j] * (1 if i == j else 2) for i, j in _PAIRS}
            yield pd.DataFrame(out | {"logdet": np.linalg.slogdet(cov)[1]})

    return run


_PAR_SCHEMA = "_lang string, _source string, start int, " + ", ".join(f"{c} double" for c in _PAR)


def _d2(x: str = "") -> Column:
    d = [F.col(f"{x}x{i}") / UNIT - F.col(f"m{i}") for i in range(P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + F.col(f"k{i}_{j}") * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    aggs += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in _PAIRS]
    return rows.groupBy(*_KEY, *by).agg(*aggs)


def _step(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """One concentration step for every group and start."""
    bucket = F.floor(F.log2(_d2() + 1e-6) * 32).cast("int")
    b = _moments(rows.join(checked_broadcast(params), list(_KEY)).withColumn("bucket", bucket), "start", "bucket")
    from pyspark.sql import Window

    w = Window.partitionBy(*_KEY, "start")
    b = b.withColumn("before", F.sum("n").over(w.orderBy("bucket")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    b = b.where(F.col("before") < F.ceil(F.col("all") * share))
    s = b.groupBy(*_KEY, "start").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return s.mapInPandas(_inverse(consistency(share, P), FLOOR), _PAR_SCHEMA)


def _scoped(counts: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source) to the key of the estimate that judges it; narrower ones first."""
    from pyspark.sql import Window

    nul = F.lit("\x00null")
    c = counts.select("lang", "source", "n", F.coalesce("lang", nul).alias("_l"), F.coalesce("source", nul).alias("_s"))
    own = F.col("n") >= min_rows
    rest = F.when(~own, F.col("n")).otherwise(0)
    c = c.withColumn("_nl", F.sum(rest).over(Window.partitionBy("_l")))
    by_lang = F.col("_nl") >= min_rows
    return c.select(
        "lang", "source",
        F.when(own | by_lang, F.col("_l")).otherwise(F.lit("\x00all")).alias("_lang"),
        F.when(own, F.col("_s")).otherwise(F.lit("\x00all")).alias("_source"),
    )


def fit(stats: DataFrame, share: float = 0.5, steps: int = 100, tolerance: float = 1e-3, min_rows: int = 100, trim: float = 0.975) -> DataFrame:
    """The estimates, one row per (lang, source) that they judge. ``stats``: written rows of
    lang, source and ``_stat``. A step that doesn't lower its determinant is
    not taken; steps end when none falls by more than ``tolerance`` (relative). Raises if
    ``steps`` of them aren't enough."""
    usable = stats.where(~base_failed())
    counts = usable.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    scope = written(_scoped(counts, min_rows), "scope")
    same = lambda a, b: a["lang"].eqNullSafe(b["lang"]) & a["source"].eqNullSafe(b["source"])
    sc = checked_broadcast(scope)
    rows = usable.join(sc, same(usable, sc)).select(*_KEY, *[F.col(f"{STAT}.x{i}").alias(f"x{i}") for i in range(P)])
    med = rows.groupBy(*_KEY).agg(*[F.expr(f"percentile(x{i}, 0.5)").alias(f"c{i}") for i in range(P)])
    med = written(med, "medians")
    dev = rows.join(checked_broadcast(med), list(_KEY))
    mad = dev.groupBy(*_KEY).agg(*[F.expr(f"percentile(abs(x{i} - c{i}), 0.5)").alias(f"a{i}") for i in range(P)], *[F.first(f"c{i}").alias(f"c{i}") for i in range(P)])
    var = [(F.col(f"a{i}") * 1.4826 / UNIT) ** 2 + FLOOR[i] ** 2 for i in range(P)]
    first = mad.select(
        *_KEY, F.lit(0).alias("start"), *[(F.col(f"c{i}") / UNIT).alias(f"m{i}") for i in range(P)],
        *[((1 / var[i]) if i == j else F.lit(0.0)).alias(f"k{i}_{j}") for i, j in _PAIRS], F.lit(1e9).alias("logdet"),
    )
    classic = _moments(rows).withColumn("start", F.lit(1)).mapInPandas(_inverse(1.0, FLOOR), _PAR_SCHEMA)
    params = written(first.unionByName(classic.withColumn("logdet", F.lit(1e9))), "params")
    table = params
    for _ in range(steps):
        new = _step(rows, params, share)
        both = params.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
        rest = [c for c in params.columns if c not in (*_KEY, "start")]
        both = both.groupBy(*_KEY, "start").agg(F.min_by(F.struct(*rest), F.struct("logdet", "turn")).alias("p"), (F.max_by("logdet", -F.col("turn")) - F.min("logdet")).alias("fell"))
        both = written(both.select(*_KEY, "start", "p.*", "fell"), "params")
        moved = both.agg(F.max("fell")).first()[0]
        discard(table)
        table, params = both, both.drop("fell")
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError(f"estimates still move after {steps} steps")
    best = params.groupBy(*_KEY).agg(F.min_by(F.struct(*[c for c in params.columns if c not in _KEY]), F.struct("logdet", "start")).alias("p")).select(*_KEY, "p.*")
    best = written(best, "raw")
    near = rows.join(checked_broadcast(best), list(_KEY)).where(_d2() <= chi2_quantile(trim, P))
    s = _moments(near).withColumn("start", F.lit(0))
    final = written(s.mapInPandas(_inverse(consistency(trim, P), FLOOR), _PAR_SCHEMA), "final")
    return written(scope.join(final.drop("start", "logdet"), list(_KEY)).drop(*_KEY), "judges")


def judge(stats: DataFrame, judges: DataFrame, cut: float) -> DataFrame:
    """``stats`` (lang, source, ``_stat`` and others) with base_failed, distance and kept."""
    j = checked_broadcast(judges).withColumnsRenamed({"lang": "_jl", "source": "_js"})
    d = stats.join(j, stats["lang"].eqNullSafe(j["_jl"]) & stats["source"].eqNullSafe(j["_js"]), "left")
    failed = base_failed()
    dist = F.when(~failed & F.col("m0").isNotNull(), F.sqrt(_d2(f"{STAT}.")))
    return d.select(*stats.columns, failed.alias("base_failed"), dist.alias("distance")).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= math.sqrt(cut))
    )


#: Rows beyond this probability of the chi-squared distribution are outliers: the share of
#: clean rows that are rejected, were statistics normal.
TAIL = 1e-3


def rules(docs: DataFrame, tail: float = TAIL, **how) -> DataFrame:
    """doc_id, counts, base_failed, kept and distance of every document."""
    s = written(with_stats(docs, ["doc_id", "lang", "source"]), "stats")
    d = judge(s, fit(s, **how), chi2_quantile(1 - tail, P))
    return d.select("doc_id", *[F.col(f"{STAT}.{c}").alias(c) for c in COUNTS], "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, tail: float = TAIL, **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Statistics are made
    anew in the scan that filters, so no text is shuffled."""
    judges = fit(written(with_stats(docs, ["lang", "source"]), "stats"), **how)
    names = {c: c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}  # no name can clash
    d = docs.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()], "lang", "source")
    good = judge(with_stats(d, d.columns), judges, chi2_quantile(1 - tail, P)).where("kept")
    return good.select(*[F.col(n).alias(c) for c, n in names.items()])
