"""Line dedup by a sharded minimal perfect hash over distinct line hashes.

A line's key is stripped of ``[\\x20\\x09-\\x0D]`` at both ends and lower-cased (A-Z). Keys
of ``least`` code points or more are hashed twice (64 bits each). The first scan writes,
for each chunk of texts, its distinct keys with their number of documents; sums over all
chunks (partial before the shuffle) give every distinct key its count and its smallest
doc_id. All distinct keys go to shards by their hash. A shard's file holds a minimal perfect
hash (levels of bit arrays with ranks) over the first hash and, at its numbers, 16 bits of
the second hash as the fingerprint, a count that stops at 255, and for keys of two or more
documents, by rank, the smallest doc_id. As every key that is ever looked up is in the
index, a number can't belong to another key: fingerprints guard against damage only, and
keys that share the first hash are kept with both hashes beside the arrays.

A chunk's distinct keys, not its lines, are then sent to the shards (salted, so a hot key
is no hot task) and probe the arrays; what is found twice comes back to the block of rows
that asked (``places``), a small file each. The second scan looks its lines up in its
block's file and drops a line unless its document is the one that the array named. No
text and no line is joined, and the plan is the same at every size.

Cases: null or empty text has one empty line; keys that occur only within one document
(or only in rows of one doc_id) stay; a key of which no row has an id stays everywhere;
rows without an id lose the lines that a document with an id holds. Repeated rows are
treated alike. A text or a line of any length is looked at whole. An empty table gives an
empty result. Further columns, whatever their names, are kept as they are by ``texts``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .common import dealt, discard, read_file, shared_dir, write_file, written
from .places import BLOCK, FILE, ROW, Answers, placed, standing, store

SHARD_KEYS = 1 << 18
SALTS = 8
NO_ID, LAST = -(1 << 63), (1 << 63) - 1
_SALT = tk.mix(np.arange(1, 257, dtype=np.uint64) * tk.U(0xC2B2AE3D27D4EB4F))
VAL2_LOWER = _SALT[tk.LOWER]


# == the minimal perfect hash ==


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1: at each level the keys that meet no other key take
    their bit, the rest go on to the next; a key's number is the rank of its bit."""

    GAMMA = 1.5

    def __init__(self, n: int, levels: list[np.ndarray]):
        self.n, self.levels = n, levels
        self.ranks, total = [], 0
        for words in levels:
            c = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.ranks.append(np.concatenate([[0], c[:-1]]) + total)
            total += int(c[-1])

    @staticmethod
    def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        h = tk.mix(keys ^ tk.mix(np.array([level + 1], np.uint64)))
        return ((h >> tk.U(32)) * tk.U(bits) >> tk.U(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.unique(np.asarray(keys, np.uint64)), []
        n = len(left)
        while len(left):
            bits = max(64, -(-int(len(left) * cls.GAMMA) // 64) * 64)
            at = cls._at(left, len(levels), bits)
            alone = np.bincount(at, minlength=bits)[at] == 1
            words = np.zeros(bits // 64, np.uint64)
            a = at[alone]
            np.bitwise_or.at(words, a >> 6, tk.U(1) << (a & 63).astype(np.uint64))
            levels.append(words)
            left = left[~alone]
        return cls(n, levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key of the set; of others any number, or -1."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (words, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                break
            at = self._at(keys[todo], level, len(words) * 64)
            w, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (w >> bit & tk.U(1)).astype(bool)
            below = np.bitwise_count(w & ((tk.U(1) << bit) - tk.U(1)))
            out[todo[hit]] = (rank[at >> 6] + below)[hit]
            todo = todo[~hit]
        return out


class LineShard:
    """One shard: the hash and the arrays at its numbers. ``owners`` are of the keys with a
    count of two or more, in the order of their numbers."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray, extra: dict[tuple[int, int], tuple[int, int]]):
        self.mph, self.prints, self.counts, self.owners, self.extra = mph, prints, counts, owners, extra
        self.rank = np.cumsum(counts > 1) - 1

    @staticmethod
    def print_of(h2: np.ndarray) -> np.ndarray:
        return (h2 >> tk.U(48)).astype(np.uint16)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> LineShard:
        """Of distinct keys that share ``h1``, the first is at its number, and the others (as
        good as never there) in a list searched by both hashes."""
        order = np.lexsort((h2, h1))
        h1, h2, counts, owners = h1[order], h2[order], np.minimum(counts[order], 255), owners[order]
        first = np.concatenate([[True], h1[1:] != h1[:-1]]) if len(h1) else np.zeros(0, bool)
        mph = PerfectHash.build(h1[first])
        at = mph.lookup(h1[first])
        p, c, o = np.empty(mph.n, np.uint16), np.empty(mph.n, np.uint8), np.empty(mph.n, np.int64)
        p[at], c[at], o[at] = cls.print_of(h2[first]), counts[first], owners[first]
        extra = {(int(a), int(b)): (int(n), int(w)) for a, b, n, w in zip(h1[~first], h2[~first], counts[~first], owners[~first])}
        return cls(mph, p, c, o[c > 1], extra)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each key (0: not in the shard), and the document that keeps its line
        where the count is two or more."""
        at = self.mph.lookup(h1)
        in_it = at >= 0
        in_it[in_it] = self.prints[at[in_it]] == self.print_of(h2[in_it])
        count, own = np.zeros(len(h1), np.int64), np.full(len(h1), NO_ID)
        count[in_it] = self.counts[at[in_it]]
        again = np.flatnonzero(count > 1)
        own[again] = self.owners[self.rank[at[again]]]
        for (a, b), (n, w) in self.extra.items():
            mine = (h1 == tk.U(a)) & (h2 == tk.U(b))
            count[mine], own[mine] = n, w
        return count, own

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<4sQIQQ", b"LMPH", self.mph.n, len(self.mph.levels), len(self.owners), len(self.extra))]
        parts += [struct.pack("<Q", len(w)) + w.tobytes() for w in self.mph.levels]
        parts += [a.tobytes() for a in (self.owners, self.prints, self.counts)]
        parts += [struct.pack("<QQqq", *k, *v) for k, v in self.extra.items()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> LineShard:
        magic, n, levels, again, extra = struct.unpack_from("<4sQIQQ", data)
        if magic != b"LMPH":
            raise ValueError("not a shard of lines")
        at, words = struct.calcsize("<4sQIQQ"), []
        for _ in range(levels):
            (k,) = struct.unpack_from("<Q", data, at)
            words.append(np.frombuffer(data, np.uint64, k, at + 8))
            at += 8 + 8 * k
        arrays = []
        for t, k in ((np.int64, again), (np.uint16, n), (np.uint8, n)):
            arrays.append(np.frombuffer(data, t, k, at))
            at += arrays[-1].nbytes
        more = {tuple(x[:2]): tuple(x[2:]) for x in (struct.unpack_from("<QQqq", data, at + 32 * i) for i in range(extra))}
        return cls(PerfectHash(n, words), arrays[1], arrays[2], arrays[0], more)


# == lines ==


def line_keys(ch: tk.Chunk, least: int):
    """Starts, ends, first line per document, and for the lines whose key is long enough:
    their numbers and two hashes."""
    starts, ends, first = tk.lines(ch)
    ink = np.flatnonzero(~tk.SEP[ch.buf])
    a = np.searchsorted(ink, starts)
    z = np.searchsorted(ink, ends)
    some = np.flatnonzero(z > a)
    ks, ke = ink[a[some]], ink[z[some] - 1] + 1
    chars = np.concatenate([[0], np.cumsum(~tk.CONT[ch.buf])])
    long = chars[ke] - chars[ks] >= least
    some, ks, ke = some[long], ks[long], ke[long]
    return starts, ends, first, some, tk.span_hashes(ch.buf, ks, ke, tk.VAL_LOWER), tk.span_hashes(ch.buf, ks, ke, VAL2_LOWER)


def _hashes(least: int, size: int):
    """Distinct keys of each chunk and block of rows: documents, smallest and largest id,
    documents without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            file, block = b.column(2).to_numpy(), b.column(3).to_numpy() // size
            for ch in tk.chunks(b.column(1)):
                _, _, first, at, h1, h2 = line_keys(ch, least)
                if not len(h1):
                    continue
                doc = np.searchsorted(first, at, "right") - 1
                ids = b.column(0).slice(ch.lo, ch.n)
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(NO_ID).to_numpy()
                f, k = file[ch.lo : ch.hi], block[ch.lo : ch.hi]
                run_of = np.cumsum(np.concatenate([[False], (f[1:] != f[:-1]) | (k[1:] != k[:-1])]))[doc]
                order = np.lexsort((doc, h2, h1, run_of))
                h1, h2, doc, run_of = h1[order], h2[order], doc[order], run_of[order]
                new_key = np.ones(len(h1), bool)
                new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (run_of[1:] != run_of[:-1])
                new = new_key.copy()
                new[1:] |= doc[1:] != doc[:-1]
                h1, h2, doc, new_key = h1[new], h2[new], doc[new], new_key[new]
                cut = np.flatnonzero(new_key)
                lo = np.where(none[doc], LAST, ids[doc])
                n_ids = np.add.reduceat((~none[doc]).astype(np.int64), cut)
                mn, mx = np.minimum.reduceat(lo, cut), np.maximum.reduceat(ids[doc], cut)
                n = np.diff(np.concatenate([cut, [len(h1)]]))
                mask = n_ids == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[cut].view(np.int64)), pa.array(h2[cut].view(np.int64)), pa.array(n), pa.array(mn, mask=mask), pa.array(mx, mask=mask),
                        pa.array(n - n_ids), pa.array(f[doc[cut]]), pa.array(k[doc[cut]] * size),
                    ],
                    ["h1", "h2", "n", "lo", "hi", "no_id", FILE, ROW],
                )

    return run


def _build(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def flush():
            h1, h2, n, own = (np.concatenate([x[i] for x in held]) for i in range(4))
            data = LineShard.build(h1.view(np.uint64), h2.view(np.uint64), n, own).to_bytes()
            write_file(f"{folder}/lines-{shard}.bin", data)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "size": pa.array([len(data)], pa.int64())})

        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            s = cols[0]
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if shard is not None and s[lo] != shard:
                    yield flush()
                    held = []
                shard = int(s[lo])
                held.append([c[lo:hi] for c in cols[1:]])
        if held:
            yield flush()

    return run


class LineIndex:
    """The shards in a folder, and the keys of each chunk that they were made from."""

    def __init__(self, folder: str, shards: int, keys: DataFrame):
        self.folder, self.shards, self.keys = folder, shards, keys

    @staticmethod
    def _shard(shards: int):
        return F.pmod(F.col("h2"), F.lit(shards)).cast("int").alias("shard")

    @classmethod
    def build(cls, docs: DataFrame, least: int = 10, shard_keys: int = SHARD_KEYS, block: int = BLOCK) -> LineIndex:
        """``docs``: doc_id, text and place."""
        spark = docs.sparkSession
        schema = f"h1 long, h2 long, n long, lo long, hi long, no_id long, {FILE} long, {ROW} long"
        keys = written(docs.mapInArrow(_hashes(least, block), schema), "keys")
        shards = max(1, -(-keys.count() // shard_keys))
        g = keys.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("no_id").alias("no_id"))
        several = F.col("lo").isNotNull() & ((F.col("lo") < F.col("hi")) | (F.col("no_id") > 0))
        count = F.when(several, F.greatest("n", F.lit(2))).otherwise(1)
        g = g.select(cls._shard(shards), "h1", "h2", count.alias("n"), F.coalesce("lo", F.lit(NO_ID)).alias("owner"))
        folder = shared_dir(spark)
        g = dealt(g, F.col("shard"), shards).sortWithinPartitions("shard")
        written(g.mapInArrow(_build(folder), "shard int, size long"), "built")
        return cls(folder, shards, keys)

    def repeated(self) -> DataFrame:
        """The keys of two or more documents in each block of rows: place, h1, h2, owner."""
        salt = F.pmod(F.xxhash64(FILE, ROW), F.lit(SALTS)).cast("int")
        k = self.keys.select(self._shard(self.shards), salt.alias("salt"), "h1", "h2", FILE, ROW)
        k = dealt(k, F.col("shard").cast("long") * SALTS + F.col("salt"), self.shards * SALTS).sortWithinPartitions("shard").drop("salt")
        return k.mapInArrow(_probe(self.folder), f"h1 long, h2 long, owner long, {FILE} long, {ROW} long")


def _probe(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, s = None, None
        for b in batches:
            shard = b.column(0).to_numpy()
            h1, h2 = (b.column(i).to_numpy().view(np.uint64) for i in (1, 2))
            count, own = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if shard[lo] != have:
                    have = shard[lo]
                    s = LineShard.from_bytes(read_file(f"{folder}/lines-{have}.bin"))
                count[lo:hi], own[lo:hi] = s.probe(h1[lo:hi], h2[lo:hi])
            if (count == 0).any():
                raise RuntimeError("a shard doesn't hold a key that it was made from")
            part = pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(own), b.column(3), b.column(4)], ["h1", "h2", "owner", FILE, ROW])
            yield part.filter(pa.array(count > 1))

    return run


def _owner(t: pa.Table, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a block's table (sorted by both hashes as signed numbers), and their owner."""
    a, b, own = (t.column(c).to_numpy() for c in ("h1", "h2", "owner"))
    h1, h2 = h1.view(np.int64), h2.view(np.int64)
    at = np.searchsorted(a, h1)
    hit, out = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
    todo = np.flatnonzero(at < len(a))
    while len(todo):  # more than once for keys that share the first hash only
        i = at[todo]
        todo = todo[a[i] == h1[todo]]
        i = at[todo]
        same = b[i] == h2[todo]
        hit[todo[same]], out[todo[same]] = True, own[i[same]]
        todo = todo[~same]
        at[todo] += 1
        todo = todo[at[todo] < len(a)]
    return hit, out


def _drop(folder: str, block: int, least: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(folder, block)
        for b in batches:
            file, row = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            for ch in tk.chunks(b.column(1)):
                starts, ends, first, at, h1, h2 = line_keys(ch, least)
                ids = b.column(0).slice(ch.lo, ch.n).fill_null(NO_ID).to_numpy()
                gone = np.zeros(len(starts), bool)
                for lo, hi, t in answers.blocks(file[ch.lo : ch.hi], row[ch.lo : ch.hi]):
                    if t is not None:
                        x, z = np.searchsorted(at, [first[lo], first[hi]])
                        hit, own = _owner(t, h1[x:z], h2[x:z])
                        doc = np.searchsorted(first, at[x:z], "right") - 1
                        gone[at[x:z][hit & (own != ids[doc])]] = True
                yield _rewritten(b.slice(ch.lo, ch.n), ch, starts, ends, first, gone, texts)

    return run


def _rewritten(part: pa.RecordBatch, ch: tk.Chunk, starts, ends, first, gone, texts: bool) -> pa.RecordBatch:
    data, s, e, f = ch.buf.tobytes(), starts.tolist(), ends.tolist(), first.tolist()
    dropped = tk.counts_below(gone, first)
    out = []
    for d in range(ch.n):
        if not dropped[d]:
            out.append(data[s[f[d]] : e[f[d + 1] - 1]])
        else:
            out.append(b"\n".join([data[s[i] : e[i]] for i in range(f[d], f[d + 1]) if not gone[i]]))
    last = pa.array([x.decode() for x in out], pa.string()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
    cols = [*part.columns[2:-2], pa.array(np.diff(first)), pa.array(dropped.astype(np.int64)), last]
    return pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])


def dedup(docs: DataFrame, keep: list[str], texts: bool, least: int = 10, shard_keys: int = SHARD_KEYS, block: int = BLOCK) -> DataFrame:
    """``keep`` columns, n_lines, n_dropped and the rest of each text (``texts``; it comes
    last) or its SHA-256."""
    docs = standing(docs)
    index = LineIndex.build(placed(docs, "doc_id", "text"), least, shard_keys, block)
    folder = store(index.repeated(), block)
    discard(index.keys, index.folder)
    shown = [k for k in keep if k != "text" or not texts]
    kinds = {f.name: f.dataType for f in docs.schema}
    names = [*shown, "n_lines", "n_dropped", "text" if texts else "kept_sha256"]
    types = [*(kinds[k] for k in shown), T.LongType(), T.LongType(), T.StringType()]
    plain = [f"c{i}" for i in range(len(names))]  # no name can clash
    rows = placed(docs, "doc_id", "text", *shown)
    rows = rows.toDF(*[f"i{i}" for i in range(len(rows.columns))])
    return rows.mapInArrow(_drop(folder, block, least, texts), T.StructType([T.StructField(n, t) for n, t in zip(plain, types)])).toDF(*names)
