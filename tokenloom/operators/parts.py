"""Arrow functions that take a few rows at a time, whatever Spark puts into a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts or ids that a function is given at once (one row at least).
PART = 1 << 20
#: Bytes of an element of an array of strings, about.
STRING = 16


def parts(batch: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    """Slices of a batch of strings or arrays of up to ``PART`` bytes."""
    if isinstance(batch, pa.ChunkedArray):
        for chunk in batch.chunks:
            yield from parts(chunk)
        return
    if pa.types.is_list(batch.type) or pa.types.is_large_list(batch.type):
        value = batch.type.value_type
        size, each = pc.list_value_length(batch), value.bit_width // 8 if pa.types.is_primitive(value) else STRING
    else:
        size, each = pc.binary_length(batch), 1
    upto = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * each)
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PART, "right")))
        yield batch.slice(at, end - at)
        at = end


def in_parts(kind: T.DataType, f: Callable[[pa.Array], pa.Array]):
    """``f`` as an Arrow function of one column. A batch has 10,000 rows, however long; in
    parts, neither what ``f`` builds nor what it returns grows with their length."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in parts(batch):
                yield f(part)

    return run
