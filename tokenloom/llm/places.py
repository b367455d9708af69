"""Decisions brought to rows where they lie, so that no text is moved to meet them.

A row of a parquet file has a place: the file (a 64-bit hash of its path) and the row's
number in it, which every scan of the file sees alike. What an operator decides in narrow
tables is shuffled by place, and written as one small file for each block of ``BLOCK``
rows; a second scan of the texts opens the file of the block that it reads. A table that
isn't read straight from parquet files is written to the shared folder first.

No block file holds more than the answers of ``BLOCK`` rows, so hot keys, sources or
groups make none of them large. Files are written whole and renamed; a repeated task
writes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import open_fs, partitions, quoted, returned, shared_dir, write_file, written

BLOCK = 1 << 16
FILE, ROW = "__x_file", "__x_row"


def _direct(df: DataFrame) -> bool:
    """Whether ``df`` is a scan with columns and filters only: one row a row of a file."""
    plan = df._jdf.queryExecution().analyzed()
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return kind == "LogicalRelation"


def _with_place(df: DataFrame, *cols: str) -> DataFrame:
    meta = df.metadataColumn("_metadata")
    place = F.xxhash64(meta["file_path"]).alias(FILE), meta["row_index"].cast("long").alias(ROW)
    return df.select(*[F.col(quoted(c)) for c in cols], *place)


def standing(df: DataFrame) -> DataFrame:
    """``df`` itself if its rows have places, else a written copy."""
    try:
        if _direct(df):
            _with_place(df).schema  # noqa: B018
            return df
    except AnalysisException:  # files of another kind
        pass
    return written(df, "rows")


def placed(df: DataFrame, *cols: str) -> DataFrame:
    """``cols`` of a ``standing`` table, then each row's place."""
    return _with_place(df, *cols)


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush():
            t = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            write_file(f"{folder}/{at[0] & (1 << 64) - 1:016x}-{at[1]}.arrow", sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_pydict({"rows": pa.array([t.num_rows], pa.int64())})

        for b in batches:
            f, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.flatnonzero((f[1:] != f[:-1]) | (k[1:] != k[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(f)]):
                if hi > lo:
                    if at != (f[lo], k[lo]):
                        if held:
                            yield flush()
                        at, held = (int(f[lo]), int(k[lo])), []
                    held.append(pa.RecordBatch.from_arrays(b.columns[2:], b.schema.names[2:]).slice(lo, hi - lo))
        if held:
            yield flush()

    return run


def store(answers: DataFrame, block: int = BLOCK) -> str:
    """Write ``answers`` (``FILE``, ``ROW`` or a block's first row, other columns) by block;
    the folder of the block files."""
    folder = shared_dir(answers.sparkSession)
    rest = [c for c in answers.columns if c != FILE]
    a = answers.select(FILE, F.expr(f"{ROW} div {block}").alias("__x_block"), *rest)
    a = a.repartition(partitions(answers.sparkSession), FILE, "__x_block").sortWithinPartitions(FILE, "__x_block", *rest)
    written(a.mapInArrow(returned(_store(folder)), "rows long"), "stored")
    return folder


class Answers:
    """A task's view of a folder of block files; one block is held at a time."""

    def __init__(self, folder: str, size: int = BLOCK):
        self.folder, self.size, self.at, self.table = folder, size, None, None

    def block(self, file: int, block: int) -> pa.Table | None:
        if self.at != (file, block):
            fs, path = open_fs(f"{self.folder}/{file & (1 << 64) - 1:016x}-{block}.arrow")
            try:
                with fs.open_input_stream(path, compression=None) as f:
                    self.table = pa.ipc.open_stream(f.read()).read_all()
            except FileNotFoundError:
                self.table = None
            self.at = (file, block)
        return self.table

    def blocks(self, files: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, pa.Table | None]]:
        """Runs lo to hi of a batch's rows that lie in one block, with its answers."""
        k = rows // self.size
        new = np.flatnonzero((files[1:] != files[:-1]) | (k[1:] != k[:-1])) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(files)]):
            if hi > lo:
                yield lo, hi, self.block(int(files[lo]), int(k[lo]))

    def find(self, files: np.ndarray, rows: np.ndarray, *columns: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which rows of a batch have an answer (by ``ROW``), and its ``columns`` of longs."""
        hit = np.zeros(len(rows), bool)
        out = {c: np.zeros(len(rows), np.int64) for c in columns}
        for lo, hi, t in self.blocks(files, rows):
            if t is not None:
                have = t.column(ROW).to_numpy()
                at = np.minimum(np.searchsorted(have, rows[lo:hi]), len(have) - 1)
                hit[lo:hi] = have[at] == rows[lo:hi]
                for c in columns:
                    out[c][lo:hi] = t.column(c).to_numpy()[at]
        return hit, out


def _listed(folder: str, stay: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(folder)
        for b in batches:
            hit, _ = answers.find(b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays(b.columns[:-2], b.schema.names[:-2]).filter(pa.array(hit == stay))

    return run


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a ``standing`` table whose place isn't in ``gone`` (``FILE``, ``ROW``), with
    all columns: a filter in the scan."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    plain = placed(df, *names).toDF(*names.values(), FILE, ROW)
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names.values(), df.schema)])
    return plain.mapInArrow(returned(_listed(store(gone.select(FILE, ROW)), False)), schema).toDF(*names)
