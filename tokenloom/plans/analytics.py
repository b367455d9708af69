"""Analytics over texts, ids and measurements, as DataFrame plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import shape
from ..tokenizer import Tokenizer

BUCKETS = (1_000, 2_000, 4_000, 8_000, 16_000, 32_000, 64_000, 128_000)


def totals(df: DataFrame, text: str, tokens: str, ms: str | None = None, baseline_ms: str | None = None) -> DataFrame:
    """Inputs, bytes, tokens; with durations also MB/s and the speedup over a baseline."""
    b = F.sum(F.octet_length(F.col(text))).alias("n_bytes")
    aggs = [F.count(F.lit(1)).alias("n_inputs"), b, F.sum(F.col(tokens).cast("long")).alias("n_tokens")]
    out = df.agg(*aggs, *[F.sum(c).alias(n) for c, n in ((ms, "ms"), (baseline_ms, "baseline_ms")) if c])
    if ms:
        out = out.withColumn("mb_per_s", F.col("n_bytes") / 1e6 / (F.col("ms") / 1e3)).withColumn("ms_per_input", F.col("ms") / F.col("n_inputs"))
    if ms and baseline_ms:
        out = out.withColumn("speedup", F.col("baseline_ms") / F.col("ms"))
    return out


def piece_stats(counted: DataFrame) -> DataFrame:
    """Of (piece, n): total, distinct, bytes, long (over 50 bytes) and short (up to 4 bytes)
    pieces, the longest, and index percentiles of the length: the value at position
    floor(p * total) of all occurrences in order. Lengths have few values, so the order is
    that of a length histogram: one small table, however many pieces there are."""
    w = F.octet_length("piece")
    c = counted.select(w.cast("long").alias("w"), "n")
    hist = c.groupBy("w").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    rows = F.array_sort(F.collect_list(F.struct("w", "n")))
    out = hist.agg(
        F.sum("n").alias("total"), F.sum("d").alias("distinct_pieces"), F.sum(F.col("w") * F.col("n")).alias("n_bytes"),
        F.coalesce(F.sum(F.when(F.col("w") > 50, F.col("n"))), F.lit(0)).alias("long_pieces"), F.coalesce(F.sum(F.when(F.col("w") > 50, F.col("w") * F.col("n"))), F.lit(0)).alias("long_bytes"),
        F.coalesce(F.sum(F.when(F.col("w") <= 4, F.col("n"))), F.lit(0)).alias("short_pieces"), F.max("w").alias("longest"), rows.alias("h"),
    )

    def at(p: float) -> Column:
        k = F.floor(F.col("total") * p)
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
        step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + x["n"] > k), x["w"]).otherwise(s["v"]).alias("v"))
        return F.aggregate("h", zero, step, lambda s: s["v"])

    return out.withColumns({"median": at(0.5), "p95": at(0.95), "p99": at(0.99)}).drop("h")


def latency(df: DataFrame, ms: str, tokens: str | None = None) -> DataFrame:
    """Requests, mean, exact interpolated median and p99 of a duration, and rates."""
    v = F.col(ms)
    out = df.where(v.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean_ms"), F.percentile(v, 0.5).alias("median_ms"), F.percentile(v, 0.99).alias("p99_ms"),
        (F.count(F.lit(1)) / (F.sum(v) / 1000)).alias("req_per_s"), *([(F.sum(tokens) / (F.sum(v) / 1000)).alias("tok_per_s")] if tokens else []),
    )
    return out


def bucket(n: Column, edges: tuple[int, ...] = BUCKETS) -> Column:
    """Smallest edge that a length doesn't exceed; null beyond the last."""
    out = F.lit(None).cast("int")
    for e in reversed(edges):
        out = F.when(n <= e, e).otherwise(out)
    return out


def length_buckets(df: DataFrame, n: str, edges: tuple[int, ...] = BUCKETS) -> DataFrame:
    return df.groupBy(bucket(F.col(n), edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(n).cast("long")).alias("n_tokens"))


def allocate(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers that sum to ``total`` in the given proportions: largest remainders."""
    whole = sum(shares.values())
    exact = {k: total * v / whole for k, v in shares.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def bucket_prompts(df: DataFrame, tok: Tokenizer, key: str, ids: str, edges: tuple[int, ...] = BUCKETS, prefix: list[int] | None = None) -> DataFrame:
    """A prompt per row and bucket: ids adjusted to the middle of each bucket (after an
    optional shared prefix) and decoded."""
    lows = (0, *edges[:-1])
    shared = F.array(*[F.lit(i) for i in prefix or []]).cast("array<int>")
    each = F.array(*[F.struct(F.lit(hi).alias("bucket"), F.lit((lo + hi) // 2).alias("target")) for lo, hi in zip(lows, edges)])
    x = df.select(key, F.col(ids).alias("_ids"), F.explode(each).alias("_b"))
    fit = F.concat(shared, shape.fitted(F.col("_ids"), F.greatest(F.col("_b.target") - len(prefix or []), F.lit(0))))
    return x.select(key, "_b.bucket", "_b.target", fit.alias("ids")).withColumn("prompt", tok.decode("ids"))


def first_turns(df: DataFrame, key: str, order: str, role: str, text: str, who: tuple[str, ...] = ("human", "user"), least: int = 1) -> DataFrame:
    """The first turn of each conversation by one of ``who``, stripped, if it has ``least``
    characters. ``min_by`` keeps one turn per key before the shuffle; nothing is sorted."""
    mine = df.where(F.col(role).isin(*who) & F.col(text).isNotNull())
    out = mine.groupBy(key).agg(F.trim(F.min_by(text, order)).alias("prompt"))
    return out.where(F.length("prompt") >= least)


def compared(df: DataFrame, variant: str, value: str, baseline: str, other: str, *by: str) -> DataFrame:
    """Medians of a measure for two variants side by side, and the change in percent."""
    g = df.where(F.col(variant).isin(baseline, other)).groupBy(*by)
    mid = lambda v: F.percentile(F.when(F.col(variant) == v, F.col(value)), 0.5)
    out = g.agg(mid(baseline).alias("baseline_p50"), mid(other).alias("other_p50"))
    return out.withColumn("change_percent", 100 * (F.col("other_p50") - F.col("baseline_p50")) / F.col("baseline_p50"))


def matrix(spark, **parameters: list) -> DataFrame:
    """All combinations of small parameter lists, one run a row."""
    out = None
    for name, values in parameters.items():
        d = spark.createDataFrame([(v,) for v in values], [name])
        out = d if out is None else out.crossJoin(F.broadcast(d))  # lists of a call
    return out
