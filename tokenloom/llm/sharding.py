"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Rows are hashed into ``SLOTS`` slots, and bytes are summed per slot (a partial sum a task, so
a table of at most ``SLOTS`` rows reaches the driver). Version 1 of the map deals slots
out in turn before any row is seen. ``resized`` edits it, for new sizes or another number of
shards, by moving as few slots as it takes to even the shards out (largest first, each to
the shard with the fewest bytes), and writes the next version; rows are placed by it. A map
is a small JSON file per version in the shared folder, and earlier versions stay.

Places within a shard are gapless: each task numbers its rows per shard, and the counts
per (task, shard) give every task its first place. No row is sorted and no shard is
gathered.

Cases: null text has size 1 and checksum 0; null ids and repeated rows are hashed like
others (repeated rows share a slot); texts of any length are read whole; an empty table gives an empty result and a map of
slots without bytes. Further columns aren't looked at.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import checked_broadcast, read_file, shared_dir, write_file, written

SLOTS = 4096


def _sized(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = tk.string_buffers(b.column(1))
            view, at = memoryview(buf), offs.tolist()
            crc = np.array([zlib.crc32(view[s:e]) for s, e in zip(at, at[1:])], np.int64)
            ids = b.column(0)
            known = ids.fill_null(0).to_numpy().view(np.uint64)
            h = tk.mix(tk.mix(known + tk.U(1)) ^ (crc.astype(np.uint64) << tk.U(20)) ^ np.diff(offs).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(offs) + 1), pa.array(crc), pa.array((h % tk.U(slots)).astype(np.int32))],
                ["doc_id", "size", "text_crc32", "virtual_slot"],
            )

    return run


def assign(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each slot: largest slots first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = np.zeros(len(sizes), np.int32)
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + int(sizes[i]), s))
    return out


def rebalance(old: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """``old`` edited for ``shards`` shards: slots of shards that are gone, and of shards
    above the mean only as many as bring them down to it, go to the lightest shards."""
    goal = sizes.sum() / shards
    out, loose = old.copy(), []
    load = np.zeros(shards, np.int64)
    for s in range(int(old.max(initial=0)) + 1):
        mine = np.flatnonzero(old == s)
        mine = mine[np.argsort(-sizes[mine], kind="stable")]
        if s >= shards:
            loose += mine.tolist()
            continue
        total = int(sizes[mine].sum())
        for i in mine.tolist():  # largest first: the fewest slots that bring it down
            if 0 < int(sizes[i]) <= total - goal:
                total -= int(sizes[i])
                loose.append(i)
        load[s] = total
    heap = [(int(x), s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for i in sorted(loose, key=lambda i: (-int(sizes[i]), i)):
        x, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (x + int(sizes[i]), s))
    return out


class SlotMap:
    """A versioned slot-to-shard map in a folder: ``map-<version>.json``."""

    def __init__(self, folder: str, version: int, shards: int, slot_to_shard: np.ndarray, sizes: np.ndarray):
        self.folder, self.version, self.shards, self.slot_to_shard, self.sizes = folder, version, shards, slot_to_shard, sizes

    @classmethod
    def create(cls, folder: str, sizes: np.ndarray, shards: int) -> SlotMap:
        return cls(folder, 1, shards, assign(sizes, shards), sizes)._save()

    @classmethod
    def dealt(cls, folder: str, slots: int, shards: int) -> SlotMap:
        """A first map, made before sizes are known: slots in turn."""
        return cls(folder, 1, shards, np.arange(slots, dtype=np.int32) % shards, np.zeros(slots, np.int64))._save()

    def resized(self, shards: int, sizes: np.ndarray | None = None) -> SlotMap:
        sizes = self.sizes if sizes is None else sizes
        return SlotMap(self.folder, self.version + 1, shards, rebalance(self.slot_to_shard, sizes, shards), sizes)._save()

    def _save(self) -> SlotMap:
        data = {"version": self.version, "shards": self.shards, "slot_to_shard": self.slot_to_shard.tolist(), "bytes": self.sizes.tolist()}
        write_file(f"{self.folder}/map-{self.version}.json", json.dumps(data).encode())
        return self

    @classmethod
    def load(cls, folder: str, version: int) -> SlotMap:
        d = json.loads(read_file(f"{folder}/map-{version}.json"))
        return cls(folder, d["version"], d["shards"], np.array(d["slot_to_shard"], np.int32), np.array(d["bytes"], np.int64))


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row."""
    return docs.select("doc_id", "text").mapInArrow(_sized(slots), "doc_id long, size long, text_crc32 long, virtual_slot int")


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> np.ndarray:
    out = np.zeros(slots, np.int64)
    for v, n in rows.groupBy("virtual_slot").agg(F.sum("size")).collect():  # at most ``slots`` rows
        out[v] = n
    return out


def _placed(slot_to_shard: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            shard = slot_to_shard[b.column(3).to_numpy()]
            at = np.zeros(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                mine = shard == s
                n = int(mine.sum())
                at[mine] = seen[s] + np.arange(n)
                seen[s] += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard), pa.array(at), pa.array(np.full(len(at), pid, np.int32))], [*b.schema.names, "shard", "at", "pid"])

    return run


def place(rows: DataFrame, m: SlotMap) -> DataFrame:
    """``rows`` (written, of ``sized``) with their shard and gapless place in it."""
    schema = "doc_id long, size long, text_crc32 long, virtual_slot int, shard int, at long, pid int"
    t = written(rows.mapInArrow(_placed(m.slot_to_shard), schema), "placed")
    n = t.groupBy("pid", "shard").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shard").orderBy("pid")
    before = written(n.select("pid", "shard", (F.sum("n").over(w) - F.col("n")).alias("before")), "before")
    return t.join(checked_broadcast(before), ["pid", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(m.version).alias("map_version"),
    )


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """Every row with its shard under version 2 of a map: the first, edited for the sizes."""
    rows = written(sized(docs, slots), "sized")
    m = SlotMap.dealt(shared_dir(docs.sparkSession) + "/maps", slots, shards)
    return place(rows, m.resized(shards, slot_sizes(rows, slots)))
