"""Even work for tables too small to be split by their files."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a table, per core of the cluster, up to which it is dealt out anew.
SMALL = 32 << 20


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """``df``, in one partition per core if it is small (by the plan's own size estimate): a
    file of one row group would keep a single core busy with Python. Larger tables are
    left as they are scanned, so nothing is shuffled at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * small else df
