"""Truncation, padding and merging of encodings, all as Column expressions.

An encoding is struct<ids, attention_mask, type_ids, special_tokens_mask, n_sequences>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.spec import Padding, TokenizerError, Truncation

ARRAYS = ("ids", "attention_mask", "type_ids", "special_tokens_mask")
_INTS = "array<int>"


def cut(a: Column, n: int | Column, direction: str = "right") -> Column:
    """The first n elements, or the last n for direction left."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(a, F.lit(1) if direction == "right" else F.greatest(F.size(a) - n, F.lit(0)) + 1, n)


def truncated(ids: Column, t: Truncation | None) -> Column:
    return ids if t is None else cut(ids, t.max_length, t.direction)


def target_length(size: Column, p: Padding, longest: Column | None = None) -> Column:
    """Length to pad to: the fixed one or the batch's, at least the ids', rounded up."""
    base = F.greatest(size if longest is None else longest, F.lit(p.length or 0)) if p.length is not None or longest is not None else size
    base = F.greatest(base, size)
    m = p.pad_to_multiple_of
    return (F.ceil(base / m) * m).cast("int") if m else base.cast("int")


def filled(a: Column, target: Column, value: int, direction: str) -> Column:
    more = F.array_repeat(F.lit(value), F.greatest(target - F.size(a), F.lit(0)).cast("int"))
    return F.concat(a, more) if direction == "right" else F.concat(more, a)


def ones(a: Column, value: int = 1) -> Column:
    return F.transform(a, lambda _: F.lit(value))


def encoding(ids: Column, mask: Column | None = None) -> Column:
    """An encoding of ids alone; the mask is all ones unless given."""
    whole = F.struct(
        ids.cast(_INTS).alias("ids"), (ones(ids) if mask is None else mask).cast(_INTS).alias("attention_mask"),
        ones(ids, 0).alias("type_ids"), ones(ids, 0).alias("special_tokens_mask"), F.lit(1).alias("n_sequences"),
    )
    return F.when(ids.isNotNull(), whole)


def _each(e: Column, f) -> Column:
    parts = [f(e[a], a).alias(a) for a in ARRAYS]
    return F.when(e.isNotNull(), F.struct(*parts, e["n_sequences"].alias("n_sequences")))


def encoding_cut(e: Column, n: int, direction: str = "right") -> Column:
    return _each(e, lambda a, _: cut(a, n, direction))


def encoding_padded(e: Column, target: Column | int, pad_id: int = 0, *, pad_type_id: int = 0, direction: str = "right") -> Column:
    if direction not in ("right", "left"):
        raise TokenizerError(f"unknown direction: {direction}")
    target = F.lit(target) if isinstance(target, int) else target
    value = {"ids": pad_id, "type_ids": pad_type_id}
    return _each(e, lambda a, name: filled(a, target, value.get(name, 0), direction))


def padded(e: Column, p: Padding | None, longest: Column | None = None) -> Column:
    if p is None:
        return e
    return encoding_padded(e, target_length(F.size(e["ids"]), p, longest), p.pad_id, pad_type_id=p.pad_type_id, direction=p.direction)


def pad_batches(df: DataFrame, column: str, p: Padding, *batch: str) -> DataFrame:
    """Pad the encodings of ``column`` to one length per batch (``batch`` columns; a batch is
    padded as a whole, so its rows meet, and are encoded once). Without batch columns the
    longest is an aggregate of its own, one row for the whole table, which isn't gathered."""
    size = F.size(F.col(f"{column}.ids"))
    if batch:
        both = df.withColumn("_longest", F.max(size).over(Window.partitionBy(*batch)))
    else:
        both = df.crossJoin(F.broadcast(df.agg(F.max(size).alias("_longest"))))  # one row
    return both.withColumn(column, padded(F.col(column), p, F.col("_longest"))).select(*df.columns)


def merged(df: DataFrame, column: str, order: str, *by: str) -> DataFrame:
    """The encodings of each group put together in order. A merged encoding is one value, so
    a group meets in one task, as it must."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(column).alias("_e"))))
    part = lambda a: F.flatten(F.transform("_p", lambda x: x["_e"][a])).alias(a)
    flat = [part(a) for a in ARRAYS]
    n = F.aggregate("_p", F.lit(0), lambda s, x: s + x["_e"]["n_sequences"]).alias("n_sequences")
    return df.where(F.col(column).isNotNull()).groupBy(*by).agg(parts.alias("_p")).select(*by, F.struct(*flat, n).alias(column))


def mismatches(a: Column, b: Column) -> Column:
    """Positions at which two id arrays differ; beyond the shorter one all differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))


def fitted(ids: Column, target: int | Column) -> Column:
    """Ids truncated, or repeated as often as it takes, to a length; empty ids stay empty."""
    target = F.lit(target) if isinstance(target, int) else target
    times = F.ceil(target / F.greatest(F.size(ids), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(ids, times)), F.lit(1), target)
