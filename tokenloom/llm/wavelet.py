"""Token ids in wavelet-matrix files, one per shard of consecutive doc_ids.

Texts are tokenised once into a written table (two bytes an id where the vocabulary
allows). Its narrow columns are cut into at most ``RANGES`` ranges in doc_id order, tokens
are summed per range, and neighbouring ranges are merged into parts of about
``shard_tokens`` ids; so every part's first position among all ids is known before it is
written. A part is sorted by doc_id and cut into shards (one, unless ranges hold more), each
stored as bit planes (the wavelet matrix), each with rank samples and compressed by zstd. The file alone answers
access (the id at a position), rank and count (occurrences of an id in a range), select
(position of its k-th occurrence) and gives whole documents back.

Cases: null or empty text is its end id alone; rows without a doc_id come last; repeated
ids follow each other in any order (a hot id, or many rows without one, fill several
ranges, which rows' numbers tell apart); an empty table writes no file. A document of any
length is encoded whole; one longer than ``shard_tokens`` makes its shard longer. Further columns aren't looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import empty_if_null, read_file, shared_dir, write_file, written
from .tokencache import default_path, forget, word_ids

SHARD_TOKENS = 1 << 23
RANGES = 1 << 16
LAST, NO_ID = (1 << 63) - 1, 1 << 62  # rows without an id come last
SAMPLE = 8  # words of 64 bits per rank sample
_HEAD = struct.Struct("<4sIQQQQ")


class WaveletMatrix:
    """``build(ids)``, then ``access``, ``rank``, ``count``, ``select``, ``decode``."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        planes, zeros, a = [], [], ids
        for shift in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << shift)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64))
            z = len(a) - int(np.count_nonzero(one))
            zeros.append(z)
            b = np.empty_like(a)
            b[:z] = a[~one]
            b[z:] = a[one]
            a = b
        return cls(len(ids), planes, zeros)

    @property
    def ranks(self) -> list[np.ndarray]:
        """Ones before every ``SAMPLE``-th word of each plane."""
        if self._ranks is None:
            self._ranks = []
            for p in self.planes:
                c = np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)])
                self._ranks.append(c[::SAMPLE].copy())
        return self._ranks

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        p, w = self.planes[level], i >> 6
        s = w // SAMPLE
        n = int(self.ranks[level][s]) + int(np.bitwise_count(p[s * SAMPLE : w]).sum())
        return n + (int(p[w]) & ((1 << (i & 63)) - 1)).bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 6]) >> (i & 63) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for level, z in enumerate(self.zeros):
            b, ones = self._bit(level, i), self._ones(level, i)
            v = v << 1 | b
            i = z + ones if b else i - ones
        return v

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        bits = len(self.planes)
        if token >> bits:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (z + a, z + b) if token >> (bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _find(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th (from 0) one or zero of a plane: by its rank samples, then words."""
        r = self.ranks[level]
        before = r if one else np.arange(len(r)) * 64 * SAMPLE - r
        w = (int(np.searchsorted(before, k, "right")) - 1) * SAMPLE
        k -= int(before[w // SAMPLE])
        p = self.planes[level]
        while True:
            word = int(p[w]) if one else ~int(p[w]) & (1 << 64) - 1
            c = word.bit_count()
            if k < c:
                break
            k, w = k - c, w + 1
        for _ in range(k):
            word &= word - 1
        return w * 64 + (word & -word).bit_length() - 1

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i, bits = lo + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            one = bool(token >> (bits - 1 - level) & 1)
            i = self._find(level, i - self.zeros[level] if one else i, one)
        return i

    def decode(self) -> np.ndarray:
        """All ids: the planes' partitions are undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            w = np.empty_like(v)
            z = self.zeros[level]
            w[~one] = v[:z]
            w[one] = v[z:] | kind(1 << (len(self.planes) - 1 - level))
            v = w
        return v


class Shard:
    """A file: doc_ids, their lengths, the first position among all ids, the matrix."""

    def __init__(self, base: int, doc_ids: np.ndarray, no_id: int, lengths: np.ndarray, matrix: WaveletMatrix):
        self.base, self.doc_ids, self.no_id, self.lengths, self.matrix = base, doc_ids, no_id, lengths, matrix

    def to_bytes(self) -> bytes:
        z = zstandard.ZstdCompressor(1).compress
        m = self.matrix
        sections = [z(self.doc_ids.astype("<i8").tobytes()), z(self.lengths.astype("<i8").tobytes()), z(np.array(m.zeros, "<u8").tobytes())]
        sections += [z(p.tobytes()) for p in m.planes] + [z(r.astype("<u8").tobytes()) for r in m.ranks]
        head = _HEAD.pack(b"WMX1", len(m.planes), self.base, m.n, len(self.doc_ids), self.no_id)
        return b"".join([head, struct.pack(f"<{len(sections)}Q", *map(len, sections)), *sections])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, bits, base, n, docs, no_id = _HEAD.unpack_from(data)
        if magic != b"WMX1":
            raise ValueError("not a token file")
        sizes = struct.unpack_from(f"<{3 + 2 * bits}Q", data, _HEAD.size)
        at, out, unz = _HEAD.size + 8 * len(sizes), [], zstandard.ZstdDecompressor().decompress
        for s in sizes:
            out.append(unz(data[at : at + s]))
            at += s
        planes = [np.frombuffer(x, np.uint64) for x in out[3 : 3 + bits]]
        m = WaveletMatrix(n, planes, np.frombuffer(out[2], "<u8").astype(int).tolist())
        m._ranks = [np.frombuffer(x, "<u8").astype(np.int64) for x in out[3 + bits :]]
        return cls(base, np.frombuffer(out[0], "<i8"), no_id, np.frombuffer(out[1], "<i8"), m)


def with_end(ids: np.ndarray, offs: np.ndarray, end: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of documents with the end id behind each one's, and their offsets."""
    upto = offs + np.arange(len(offs))
    out = np.empty(int(upto[-1]), kind)
    inner = np.ones(len(out), bool)
    inner[upto[1:] - 1] = False
    out[inner] = ids
    out[~inner] = end
    return out, upto


def binaries(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column of data[offs[i] : offs[i + 1]] without a copy a row."""
    at = (offs * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _tokenise(path: str, end: int, wide: bool):
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_ids(path)
        for b in batches:
            for ch in tk.chunks(b.column(1)):
                ids, offs = with_end(*enc.encode_chunk(ch), end, kind)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(ch.lo, ch.n), pa.array(np.diff(offs)), binaries(ids, offs)], ["doc_id", "n", "ids"])

    return run


class Ranges:
    """Ranges of rows in (doc_id, uid) order, rows without an id last, and the parts that
    they make up: consecutive ranges of about ``shard_tokens`` ids together."""

    def __init__(self, o: np.ndarray, u: np.ndarray, tokens: np.ndarray, shard_tokens: int):
        self.o, self.u = o, u  # of the first row of each range
        before = np.cumsum(tokens) - tokens
        first = np.unique(before // shard_tokens, return_index=True)[1]
        self.part = np.searchsorted(first, np.arange(len(o)), "right") - 1
        self.base = before[first]

    def of(self, o: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The part of each row."""
        lo, hi = np.searchsorted(self.o, o, "left"), np.searchsorted(self.o, o, "right")
        at = lo - 1
        for v in np.unique(o[hi > lo]).tolist():  # ids with which ranges begin: decided by the row
            mine = np.flatnonzero(o == v)
            i, j = lo[mine[0]], hi[mine[0]]
            at[mine] = i - 1 + np.searchsorted(self.u[i:j], u[mine], "right")
        return self.part[np.maximum(at, 0)]


def ranges(t: DataFrame, shard_tokens: int) -> Ranges | None:
    """Cut the narrow columns of ``t`` into ranges of about equal row counts (at most
    ``RANGES`` of them reach the driver, three numbers each, whatever the table holds)."""
    total = t.agg(F.sum("n")).first()[0]
    if not total:
        return None
    count = min(RANGES, 8 * -(-total // shard_tokens))
    cut = t.select("o", "u", "n").repartitionByRange(count, "o", "u").select(F.spark_partition_id().alias("p"), "o", "u", "n")
    rows = cut.groupBy("p").agg(F.min(F.struct("o", "u")).alias("low"), F.sum("n").alias("s")).select("low.*", "s").orderBy("o", "u").collect()
    return Ranges(*(np.array([r[i] for r in rows], np.int64) for i in range(3)), shard_tokens)


def _write(folder: str, wide: bool, bits: int, shard_tokens: int, bases):
    kind = np.dtype("<u4" if wide else "<u2")
    most = shard_tokens + shard_tokens // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part, files, base = None, 0, 0
        held, docs, lengths, parts = 0, [], [], []

        def flush():
            nonlocal held, files, base, docs, lengths, parts
            ids, n, doc = np.concatenate(parts), np.concatenate(lengths), pa.concat_arrays(docs)
            held, docs, lengths, parts = 0, [], [], []
            s = Shard(base, doc.fill_null(0).to_numpy(), doc.null_count, n, WaveletMatrix.build(ids, bits))
            path = f"{folder}/tokens-{part:06d}-{files:04d}.wmx"
            data = s.to_bytes()
            write_file(path, data)
            base, files = base + len(ids), files + 1
            return pa.RecordBatch.from_pydict({"path": pa.array([path]), "size": pa.array([len(data)], pa.int64())})

        for b in batches:
            which, n = b.column(0).to_numpy(), b.column(2).to_numpy()
            buf, offs = tk.string_buffers(b.column(3))
            ids, upto = buf.view(kind), offs // kind.itemsize
            at = 0
            while at < b.num_rows:
                if which[at] != part:
                    if parts:
                        yield flush()
                    part, files, base = int(which[at]), 0, int(bases.value[which[at]])
                stop = int(np.searchsorted(which[at:], part, "right")) + at  # sorted by part
                stop = min(stop, int(np.searchsorted(upto, upto[at] + most - held, "left")))
                stop = max(stop, at + 1)
                docs.append(b.column(1).slice(at, stop - at))
                lengths.append(n[at:stop])
                parts.append(ids[upto[at] : upto[stop]].copy())
                held += len(parts[-1])
                at = stop
                if held >= most:
                    yield flush()
        if parts:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        for path in b.column(0).to_pylist():
            s = Shard.from_bytes(read_file(path))
            ids = s.matrix.decode()
            ends = np.cumsum(s.lengths)
            starts = ends - s.lengths
            crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(starts.tolist(), ends.tolist())]
            missing = np.arange(len(ends)) >= len(ends) - s.no_id
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.doc_ids, mask=missing), pa.array(starts + s.base), pa.array(s.lengths), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write all ids of ``docs`` below ``folder``; the table of files (path, size)."""
    spark, path = docs.sparkSession, path or default_path()
    vocab = max(word_ids(path).tok.get_vocab_size(), end + 1)
    wide = vocab > 1 << 16
    t = docs.select("doc_id", empty_if_null("text").alias("text")).mapInArrow(_tokenise(path, end, wide), "doc_id long, n long, ids binary")
    uid = F.monotonically_increasing_id()
    t = t.select("*", F.coalesce("doc_id", F.lit(LAST)).alias("o"), (F.when(F.col("doc_id").isNull(), NO_ID).otherwise(0) + uid).alias("u"))
    t = written(t, "tokens")
    r = ranges(t, shard_tokens)
    if r is None:
        return spark.createDataFrame([], "path string, size long")
    shared, bases = spark.sparkContext.broadcast(r), spark.sparkContext.broadcast(r.base)
    of = F.pandas_udf(lambda o, u: pd.Series(shared.value.of(o.to_numpy(), u.to_numpy()).astype("int32")), "int").asNondeterministic()
    rows = t.withColumn("part", of("o", "u"))
    rows = rows.repartitionById(len(r.base), "part").sortWithinPartitions("part", "o", "u").select("part", "doc_id", "n", "ids")
    return written(rows.mapInArrow(_write(folder, wide, (vocab - 1).bit_length(), shard_tokens, bases), "path string, size long"), "files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    paths = files.select("path")
    n = max(1, min(paths.count(), 1 << 16))
    return paths.repartition(n, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the ids of all documents to the shared folder and read them back."""
    return read_tokens(write_tokens(docs, shared_dir(docs.sparkSession) + "/ids"))
