"""Readers of text corpora: one text per item, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHARE = "conversations array<struct<from:string,value:string>>"


def flattened(turns: Column, role: str = "from", text: str = "value") -> Column:
    """``[role]: text`` of every turn with a text, joined by an empty line."""
    kept = F.filter(turns, lambda t: F.coalesce(t[text], F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda t: F.concat(F.lit("["), F.coalesce(t[role], F.lit("")), F.lit("]: "), t[text])), "\n\n")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Items with a list of turns (JSON, an array of objects or one a line) to ``text``."""
    d = spark.read.schema(_SHARE).option("multiLine", True).json(path)
    return d.select(flattened(F.col("conversations")).alias("text")).where("text != ''")


def read_contexts(spark: SparkSession, path: str, column: str = "context") -> DataFrame:
    """Items with one long text (JSON) to ``text``."""
    d = spark.read.schema(f"`{column}` string").option("multiLine", True).json(path)
    return d.select(F.col(column).alias("text")).where("text is not null and text != ''")


def flatten_turns(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Rows of turns to one text per ``key``. A conversation's turns meet in one task, as
    they must to make one string; conversations are bounded, not the table."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("from"), F.col(text).alias("value"))))
    return df.groupBy(key).agg(flattened(turns).alias("text"))
