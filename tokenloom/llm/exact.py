"""Exact dedup of normalised texts against immutable snapshots and within a new batch.

A snapshot is a folder: its distinct digests (digest, row that stays, rows) and, for
each shard of the digest space, a static binary fuse filter. An incoming batch is first
aggregated to distinct digests, so copies never meet in one task; each shard's digests
are screened by that shard's filter, which one task loads at a time. Negatives are
certainly new and are only grouped among themselves; positives join the snapshot's exact
buckets.

Members of a bucket are then compared byte for byte. A task of the scan compares the
members that it meets with the first one of their bucket and sends that one on; buckets are
salted by the root of their size, each part is compared and sends one text on, and these
are compared with each other: no text is copied, and no task meets a bucket whole. A
bucket of unequal bytes (equal digests by chance) is grouped anew by its bytes. Rows are
told apart by their place (``places``), never by their doc_id.

Cases: texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one
space; null counts as empty, and empty texts are equal to each other. Of repeated rows
(equal id and text) exactly one stays; rows of one id with different texts are documents
of their own. Rows with a null id stay only where no row of the group has an id. Texts of
any length are read whole. An empty table gives an empty result. Other columns, whatever
their names, aren't looked at, and ``unique`` keeps them as they are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import checked_broadcast, dealt, discard, keyed_join, partitions, read_file, returned, shared_dir, write_file, written
from .fuse import FuseFilter
from .places import FILE, ROW, Answers, placed, standing, store, without
from .tokencache import forget

SHARD_KEYS = 1 << 18
HELD = 64 << 20


def normalised(ch: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with every run of white space made one space."""
    sep = tk.SEP[ch.buf]
    inner = np.empty(len(sep), bool)
    if len(sep):
        inner[0] = False
        np.logical_and(sep[1:], sep[:-1], out=inner[1:])
        inner[ch.offs[:-1][ch.offs[:-1] < len(sep)]] = False
    keep = ~inner
    upto = np.concatenate([[0], np.cumsum(keep)])
    return np.where(sep, np.uint8(32), ch.buf)[keep], upto[ch.offs]


def _digest(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for ch in tk.chunks(b.column(1)):
                buf, offs = normalised(ch)
                data, at = memoryview(buf), offs.tolist()
                out = [hashlib.sha256(data[s:e]).digest() for s, e in zip(at, at[1:])]
                part = b.slice(ch.lo, ch.n)
                full = pa.array([d.hex() for d in out] if size < 32 else [None] * len(out), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[:size] for d in out], pa.binary()), full, part.column(2), part.column(3)], ["doc_id", "digest", "full", FILE, ROW])

    return run


def digests(docs: DataFrame, size: int = 32) -> DataFrame:
    """doc_id, SHA-256 of each normalised text, and place; ``size`` < 32 cuts the digest short
    (tests make collisions by it) and gives the whole one in ``full``."""
    return placed(docs, "doc_id", "text").mapInArrow(returned(_digest(size)), f"doc_id long, digest binary, full string, {FILE} long, {ROW} long")


def _build(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = None, []

        def flush():
            f = FuseFilter.build(np.concatenate(keys))
            data = f.to_bytes()
            write_file(f"{folder}/filter-{shard}.bin", data)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "keys": pa.array([f.n], pa.int64()), "size": pa.array([len(data)], pa.int64())})

        for b in batches:
            s, k = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if shard is not None and s[lo] != shard:
                    yield flush()
                    keys = []
                shard = int(s[lo])
                keys.append(k[lo:hi])
        if keys:
            yield flush()

    return run


def _screen(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, flt = None, None
        for b in batches:
            s, k = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            maybe = np.zeros(len(s), bool)
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if s[lo] != shard:
                    shard = s[lo]
                    try:
                        flt = FuseFilter.from_bytes(read_file(f"{folder}/filter-{shard}.bin"))
                    except FileNotFoundError:  # a shard without keys
                        flt = FuseFilter.build(np.zeros(0, np.uint64))
                maybe[lo:hi] = flt.contains(k[lo:hi])
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(maybe)], [*b.schema.names[2:], "maybe"])

    return run


def _keyed(df: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("digest")
    df = df.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), key.alias("key"), *df.columns)
    return dealt(df, F.col("shard"), shards).sortWithinPartitions("shard")


_DISTINCT = f"digest binary, n long, first struct<id_null:boolean,doc_id:bigint,{FILE}:bigint,{ROW}:bigint>"


def distinct_digests(rows: DataFrame, *by: str) -> DataFrame:
    """digest, rows and the row that stays (smallest id, then the first in place)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("id_null"), "doc_id", FILE, ROW))
    return rows.groupBy(*(by or ["digest"])).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))


class Snapshot:
    """An immutable set of digests in a shared folder, with one filter per shard."""

    def __init__(self, folder: str, shards: int, rows: DataFrame):
        self.folder, self.shards, self.rows = folder, shards, rows

    @classmethod
    def build(cls, rows: DataFrame, shard_keys: int = SHARD_KEYS, folder: str | None = None) -> Snapshot:
        """Of ``digests`` rows; ``folder`` is a new one in shared storage."""
        folder = folder or shared_dir(rows.sparkSession)
        distinct_digests(rows).write.parquet(f"{folder}/digests")
        found = rows.sparkSession.read.schema(_DISTINCT).parquet(f"{folder}/digests")
        shards = max(1, -(-found.count() // shard_keys))
        _keyed(found.select("digest"), shards).select("shard", "key").mapInArrow(returned(_build(f"{folder}/filters")), "shard int, keys long, size long").write.parquet(f"{folder}/built")
        write_file(f"{folder}/snapshot.json", json.dumps({"shards": shards}).encode())
        return cls(folder, shards, found)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Snapshot:
        """A snapshot that was built earlier."""
        return cls(folder, json.loads(read_file(f"{folder}/snapshot.json"))["shards"], spark.read.schema(_DISTINCT).parquet(f"{folder}/digests"))

    def screen(self, incoming: DataFrame) -> DataFrame:
        """Distinct incoming digests with ``maybe``: false is certain absence."""
        return _keyed(incoming, self.shards).mapInArrow(returned(_screen(f"{self.folder}/filters")), f"{_DISTINCT}, maybe boolean")

    def split(self, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Distinct incoming digests that are in the snapshot (with its row that stays as
        ``held``, and its rows ``n_held``), and those that aren't."""
        screened = written(self.screen(incoming), "screened")
        maybe = screened.where("maybe").drop("maybe")
        old = self.rows.select("digest", F.col("n").alias("n_held"), F.col("first").alias("held"))
        hits = written(old.join(checked_broadcast(maybe), "digest"), "hits")
        false_hits = maybe.join(checked_broadcast(hits.select("digest")), "digest", "left_anti")
        return hits, screened.where("not maybe").drop("maybe").unionByName(false_hits)


def new_texts(docs: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """The rows of a batch whose text no snapshot has, one of each group of equal texts
    (equal SHA-256; a stored snapshot keeps no texts to compare bytes with)."""
    docs = standing(docs)
    rows = written(digests(docs), "digests")
    fresh = distinct_digests(rows)
    for s in snapshots:
        fresh = written(s.split(fresh)[1], "fresh")
    stay = fresh.select(F.col(f"first.{FILE}").alias(FILE), F.col(f"first.{ROW}").alias(ROW))
    return without(docs, rows.select(FILE, ROW).join(checked_broadcast(stay), [FILE, ROW], "left_anti"))


def _groups(rows: DataFrame, shard_keys: int) -> DataFrame:
    """Digest, rows and the row that stays, of every digest of two rows or more."""
    snap = Snapshot.build(rows.where("not incoming"), shard_keys)
    hits, fresh = snap.split(distinct_digests(rows.where("incoming")))
    hits = hits.select("digest", F.col("n").alias("n1"), F.col("first").alias("first1"))
    met = snap.rows.join(checked_broadcast(hits), "digest", "left")
    met = met.select("digest", (F.col("n") + F.coalesce("n1", F.lit(0))).alias("n"), F.least("first", F.coalesce("first1", "first")).alias("first"))
    return met.unionByName(fresh).where("n > 1")


def _members(folder: str, collapse: bool):
    """Normalised texts of the rows that have an answer: each of them (with its place), or in a
    task one a bucket, and a mark for each that differs from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(folder)
        held: dict[int, bytes] = {}
        size = 0
        for b in batches:
            files, rows = b.column(2).to_numpy(), b.column(3).to_numpy()
            hit, col = answers.find(files, rows, "g", "salts")
            for ch in tk.chunks(b.column(1).filter(pa.array(hit))):
                at = np.flatnonzero(hit)[ch.lo : ch.hi]
                buf, offs = normalised(ch)
                data, o = buf.tobytes(), offs.tolist()
                texts = [data[s:e] for s, e in zip(o, o[1:])]
                g, salt, mixed = col["g"][at], (tk.mix(rows[at].view(np.uint64)) % col["salts"][at].view(np.uint64)).astype(np.int32), np.zeros(len(at), bool)
                if collapse:
                    send = []
                    for i, (k, t) in enumerate(zip(g.tolist(), texts)):
                        if (first := held.get(k)) is None:
                            if size > HELD:
                                held, size = {}, 0
                            held[k] = t
                            size += len(t) + 100
                            send.append(i)
                        elif first != t:
                            mixed[i] = True
                            send.append(i)
                    at, g, salt, mixed, texts = at[send], g[send], salt[send], mixed[send], [texts[i] for i in send]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(g), pa.array(salt), pa.array(mixed), pa.array(texts, pa.binary()), pa.array(files[at]), pa.array(rows[at])],
                    ["doc_id", "g", "salt", "mixed", "t", FILE, ROW],
                )

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, salt, mixed, text) sorted by both: the first of each run, mixed if any is or differs."""
    at = text = None
    mixed = False
    for b in batches:
        out = []
        for g, salt, m, t in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (g, salt) != at:
                if at is not None:
                    out.append((at[0], mixed, text))
                at, mixed, text = (g, salt), m, t
            else:
                mixed = mixed or m or t != text
        yield _heads(out)
    if at is not None:
        yield _heads([(at[0], mixed, text)])


def _heads(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    g, m, t = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(m, pa.bool_()), pa.array(t, pa.binary())], ["g", "mixed", "t"])


def _unequal(docs: DataFrame, members: str) -> DataFrame:
    """The buckets (g) that hold unequal texts."""
    schema = f"doc_id long, g long, salt int, mixed boolean, t binary, {FILE} long, {ROW} long"
    t = placed(docs, "doc_id", "text").mapInArrow(returned(_members(members, True)), schema).select("g", "salt", "mixed", "t")
    for part in ("salt", None):  # parts of a bucket, then their first texts
        t = t if part else t.select("g", F.lit(0).alias("salt"), "mixed", "t")
        t = t.repartition(partitions(docs.sparkSession), "g", "salt").sortWithinPartitions("g", "salt").mapInArrow(returned(_compared), "g long, mixed boolean, t binary")
        if part:
            t = t.withColumn("salt", F.lit(0)).select("g", "salt", "mixed", "t")
    return written(t.where("mixed").select("g").distinct(), "unequal")


def _decided(docs: DataFrame, digest_size: int, shard_keys: int) -> DataFrame:
    """Of every row of a ``standing`` table: place, doc_id, text_sha256, and its group's rows
    (null: one) and row that stays."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    mid = None if lo is None else lo + (hi - lo) // 2
    rows = written(digests(docs, digest_size), "digests")
    rows = rows.withColumn("incoming", F.coalesce(F.col("doc_id") > F.lit(mid).cast("long"), F.lit(True)))
    g = written(_groups(rows, shard_keys).withColumn("g", F.monotonically_increasing_id()), "groups")
    members = keyed_join(rows.select("digest", FILE, ROW), g.select("digest", "n", "g"), "digest", "n")
    members = store(members.select(FILE, ROW, "g", F.ceil(F.sqrt("n")).cast("long").alias("salts")))
    odd = _unequal(docs, members)
    discard(members)
    sha = F.coalesce("full", F.lower(F.hex("digest"))).alias("text_sha256")
    out = keyed_join(rows, g, "digest", "n", "left").select(FILE, ROW, "doc_id", sha, "n", "first", "g")
    if odd.isEmpty():
        return out.drop("g")
    # equal digests, unequal bytes: all rows of such a bucket are grouped by their bytes
    odd = checked_broadcast(odd)
    again = store(out.join(odd, "g").select(FILE, ROW, "g", F.lit(1).cast("long").alias("salts")))
    schema = f"doc_id long, g long, salt int, mixed boolean, t binary, {FILE} long, {ROW} long"
    t = written(placed(docs, "doc_id", "text").mapInArrow(returned(_members(again, False)), schema), "again")
    exact = t.select("g", "t", FILE, ROW).join(distinct_digests(t, "g", "t"), ["g", "t"]).select(FILE, ROW, "n", "first")
    anew = out.join(odd, "g").drop("n", "first", "g").join(exact, [FILE, ROW])
    return out.join(odd, "g", "left_anti").drop("g").unionByName(anew)


def groups(docs: DataFrame, digest_size: int = 32, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The lower
    half of the id range is the snapshot, the rest (and null ids) the incoming batch."""
    return _shown(_decided(standing(docs), digest_size, shard_keys)).drop(FILE, ROW)


def _shown(d: DataFrame) -> DataFrame:
    alone = F.col("n").isNull()
    first = (F.col(f"first.{FILE}") == F.col(FILE)) & (F.col(f"first.{ROW}") == F.col(ROW))
    keep = F.when(alone, F.col("doc_id")).otherwise(F.coalesce(F.col("first.doc_id"), F.col("doc_id")))
    return d.select(FILE, ROW, "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | first).alias("kept"), "text_sha256")


def unique(docs: DataFrame, digest_size: int = 32, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = standing(docs)
    return without(docs, _shown(_decided(docs, digest_size, shard_keys)).where("not kept"))
