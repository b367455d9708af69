"""What the operators share: the shared folder, written tables, files and small helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of three longs at most that may be broadcast; it is always
#: checked by a count, and beyond it the same join is done by a shuffle.
BROADCAST_ROWS = 200_000

SEP_CLASS = r"[\x20\x09-\x0D]"


_LOCAL: dict[str, str] = {}
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share. Where that is
    unset, a temporary folder serves a session without a cluster (tests, a laptop), and on a
    cluster this raises. Folders that the process has made go when it ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tokenloom-")
            _MADE.add(_LOCAL[app])
        root = _LOCAL[app]
    path = f"{root.rstrip('/')}/tokenloom-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def discard(*paths: str | DataFrame | None) -> None:
    """Delete folders, or tables of ``written``, that no plan reads any more."""
    for p in paths:
        p = getattr(p, "_tokenloom_path", p)
        if isinstance(p, str):
            fs, path = open_fs(p)
            try:
                fs.delete_dir(path)
            except (FileNotFoundError, OSError):
                pass
            _MADE.discard(p)


@atexit.register
def _discard_all() -> None:
    discard(*list(_MADE))


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and an
    executor that is lost takes no part of it along."""
    folder = shared_dir(df.sparkSession)
    df.write.parquet(f"{folder}/{name}")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._tokenloom_path = folder
    return out


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it to have at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def keyed_join(rows: DataFrame, small: DataFrame, on: str | list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small`` (written; one row a key, ``weight`` = how many of ``rows``
    have it). Up to ``BROADCAST_ROWS`` keys are broadcast. Beyond it, the keys of more than
    their share of rows are (fewer than ``BROADCAST_ROWS`` can be, as weights add up to the
    rows at most), and the rest, none of which is hot, is shuffled."""
    limit = BROADCAST_ROWS
    if small.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(small), on, how)
    most = (small.agg(F.sum(weight)).first()[0] or 0) // max(limit, 1) + 1
    hot = F.broadcast(small.where(F.col(weight) > most))
    rest = rows.join(hot.select(*([on] if isinstance(on, str) else on)), on, "left_anti").join(small.where(F.col(weight) <= most), on, how)
    return rows.join(hot, on).unionByName(rest)


def give_back() -> None:
    """Memory that this process has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def returned(f):
    """``f`` of ``mapInArrow``; when a task ends, its free memory goes back. Spark keeps every
    worker that a stage needed at once, so an executor holds idle ones beside those at work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def quoted(name: str) -> str:
    """A column's name as SQL writes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def empty_if_null(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI; plain paths are local ones."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("/") else f"file://{uri}")


def write_file(uri: str, data: bytes) -> None:
    """Write under another name, then rename: a task that is repeated (its output is the
    same) replaces the file whole, and no reader sees half of one."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def arrow_schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def dealt(df: DataFrame, by: Column, most: int) -> DataFrame:
    """``df`` in at most ``most`` partitions by a number: dealt out in turn, not by its hash, so
    none gets several numbers while others have none."""
    n = max(1, min(most, partitions(df.sparkSession)))
    return df.repartitionById(n, F.pmod(by, F.lit(n)).cast("int"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
