"""Packing of token sequences into windows by non-negative least squares.

Every document (its ids and an end id) is cut into full windows and a rest. The rests'
length histogram (at most ``WINDOW`` - 1 bins, counted over all documents) is all that the
driver sees: shallow length combinations that fill a window exactly are enumerated (all
pairs, and triples around the ``common`` most frequent lengths), their repeat counts are
solved for against the histogram by non-negative least squares, rounded, and what is left
is packed greedily, longest first; a remaining gap is filled by cutting a longer rest, so
that at most the last sequence isn't full. The plan is a list of runs "ranks r0 to r1 of
the rests of length c, from token s on, l tokens, go to sequences q, q+1, ... at offset o".
A rest's rank within its length comes from counts per (partition, length), so no window
function sees a hot length. Texts are tokenised once; ids of rests are kept (two bytes
each where the vocabulary allows) in the written table from which pieces are cut.

Cases: null or empty text is its end id alone; repeated rows are packed as often as they
occur; a null doc_id is packed like any other; an empty table gives no pieces. Further
columns aren't looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import checked_broadcast, empty_if_null, written
from .tokencache import default_path, word_ids
from .wavelet import binaries, with_end

WINDOW = 2048


def _tokenise(path: str, end: int, window: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid = word_ids(path), TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)
        full_before = 0
        for b in batches:
            for ch in tk.chunks(b.column(1)):
                ids, offs = with_end(*enc.encode_chunk(ch), end, "<u4")
                n = np.diff(offs)
                full, rest = n // window, n % window
                row = np.repeat(np.arange(ch.n), full)
                at = offs[row] + window * (np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full))
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * i : 4 * (i + window)]) for i in at.tolist()]
                by = np.argsort(rest, kind="stable")
                new = np.concatenate([[True], rest[by][1:] != rest[by][:-1]])
                rank = np.empty(ch.n, np.int64)
                rank[by] = np.arange(ch.n) - np.maximum.accumulate(np.where(new, np.arange(ch.n), 0)) + seen[rest[by]]
                seen += np.bincount(rest, minlength=window)
                left = np.ones(len(ids), bool)
                for i in at.tolist():
                    left[i : i + window] = False
                cols = [
                    b.column(0).slice(ch.lo, ch.n), pa.array(np.full(ch.n, pid, np.int32)), pa.array(n), pa.array(rest.astype(np.int32)), pa.array(rank),
                    pa.array(full_before + np.cumsum(full) - full),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]).astype(np.int32)), pa.array(crcs, pa.int64())),
                    binaries(ids[left].astype(kind), np.concatenate([[0], np.cumsum(rest)])),
                ]
                full_before += int(full.sum())
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "pid", "doc_tokens", "rest", "rank", "full_at", "crcs", "ids"])

    return run


# == the plan ==


def combinations(hist: np.ndarray, window: int, common: int = 96) -> np.ndarray:
    """Length combinations (rows of three, 0 for none) that fill a window exactly."""
    have = hist > 0
    a = np.arange(1, window // 2 + 1)
    a = a[have[a] & have[window - a]]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    top = np.sort(np.argsort(-hist, kind="stable")[:common])
    top = top[have[top]]
    x, y = np.meshgrid(top, top)
    z = window - x - y
    ok = (x <= y) & (z > 0)
    x, y, z = x[ok], y[ok], z[ok]
    ok = have[z]
    triples = np.sort(np.stack([x[ok], y[ok], z[ok]], 1), 1)
    return np.unique(np.concatenate([pairs, triples]).astype(np.int64), axis=0)


def nnls(cols: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts of the combinations that come nearest to the histogram
    in least squares: accelerated projected gradients on the sparse 0-3-entry columns."""
    k = len(cols)
    if k == 0:
        return np.zeros(0)
    size, flat = len(hist), cols.ravel()
    on = (flat > 0).astype(np.float64)
    times = lambda x: np.bincount(flat, np.repeat(x, 3) * on, size)
    back = lambda r: (r[flat] * on).reshape(k, 3).sum(1)
    bound = max(back(times(np.ones(k))).max(), 1.0)  # of the largest eigenvalue
    x = y = np.zeros(k)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - back(times(y) - hist) / bound, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


class Plan:
    """Runs (c, s, r0, r1, l, q, o) and the number of sequences that they fill."""

    def __init__(self, hist: np.ndarray, window: int = WINDOW):
        self.window, self.runs, self.sequences = window, [], 0
        # what is left: length -> lots [c, s, first rank, count]
        self.lots: dict[int, list[list[int]]] = {l: [[l, 0, 0, int(n)]] for l, n in enumerate(hist) if l and n}
        self.left = {l: int(n) for l, n in enumerate(hist) if l and n}
        cols = combinations(hist, window)
        x = nnls(cols, hist.astype(np.float64))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            self._emit([int(v) for v in cols[i] if v], int(np.rint(x[i])))
        self._greedy()

    def _take(self, length: int, count: int) -> Iterator[tuple[int, int, int, int]]:
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
        lots = self.lots[length]
        while count:
            c, s, r, n = lot = lots[-1]
            k = min(n, count)
            yield c, s, r, k
            count -= k
            lot[2] += k
            lot[3] -= k
            if not lot[3]:
                lots.pop()

    def _emit(self, lengths: list[int], most: int, gap: int = 0, cut: int = 0) -> int:
        """Sequences of these lengths, as often as stock lasts, ``most`` at most; the gap is
        filled with the heads of rests of length ``cut``. Returns how many."""
        need: dict[int, int] = defaultdict(int)
        for l in lengths:
            need[l] += 1
        if cut:
            need[cut] += 1
        times = min([most, *(self.left.get(l, 0) // m for l, m in need.items())])
        if times <= 0:
            return 0
        offset = 0
        for l in lengths:
            q = self.sequences
            for c, s, r, k in self._take(l, times):
                self.runs.append((c, s, r, r + k, l, q, offset))
                q += k
            offset += l
        if cut:
            q, rest = self.sequences, cut - gap
            tails = []
            for c, s, r, k in self._take(cut, times):
                self.runs.append((c, s, r, r + k, gap, q, offset))
                tails.append([c, s + gap, r, k])
                q += k
            self.lots.setdefault(rest, []).extend(tails)
            self.left[rest] = self.left.get(rest, 0) + times
        self.sequences += times
        return times

    def _greedy(self) -> None:
        while self.left:
            lengths = sorted(self.left)
            room, take = self.window, []
            used: dict[int, int] = defaultdict(int)
            hi = len(lengths)
            while room:
                hi = bisect.bisect_right(lengths, room, 0, hi)
                if not hi:
                    break
                l = lengths[hi - 1]
                k = min(room // l, self.left[l] - used[l])
                if k:
                    take += [l] * k
                    used[l] += k
                    room -= k * l
                hi -= 1
            cut = 0
            if room:
                cut = next((l for l in reversed(lengths) if l > room and self.left[l] > used[l]), 0)
            self._emit(take, 1 << 62, room, cut)

    def table(self) -> np.ndarray:
        runs = np.array(self.runs, np.int64).reshape(-1, 7)
        return runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]


def _pieces(runs, window: int, sequences: int, wide: bool):
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        key = (r[:, 0] * window + r[:, 1] << 40) + r[:, 2]
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            rest, rank = col["rest"].to_numpy().astype(np.int64), col["rank"].to_numpy() + col["before"].to_numpy()
            tokens, full_at = col["doc_tokens"].to_numpy(), col["full_at"].to_numpy() + col["full_before"].to_numpy()
            counts = col["crcs"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), counts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            rows, starts, lengths = [row], [nth * window], [np.full(len(row), window)]
            crcs, seqs, offs = [col["crcs"].flatten().to_numpy()], [sequences + full_at[row] + nth], [np.zeros(len(row), np.int64)]
            ids = col["ids"].to_pylist()
            at, s = np.flatnonzero(rest > 0), np.zeros(b.num_rows, np.int64)
            while len(at):
                i = np.searchsorted(key, (rest[at] * window + s[at] << 40) + rank[at], "right") - 1
                l = r[i, 4]
                rows.append(at)
                starts.append(counts[at] * window + s[at])
                lengths.append(l)
                seqs.append(r[i, 5] + rank[at] - r[i, 2])
                offs.append(r[i, 6])
                crcs.append(np.array([zlib.crc32(np.frombuffer(ids[d], kind)[p : p + m].astype("<u4").tobytes()) for d, p, m in zip(at.tolist(), s[at].tolist(), l.tolist())], np.int64))
                s[at] += l
                at = at[s[at] < rest[at]]
            rows = np.concatenate(rows)
            out = [np.concatenate(v).astype(np.int64) for v in (starts, lengths, crcs)]
            out += [tokens[rows], np.concatenate(seqs), np.concatenate(offs)]
            yield pa.RecordBatch.from_arrays([col["doc_id"].take(pa.array(rows)), *(pa.array(v, pa.int64()) for v in out)], names)

    return run


def pack(docs: DataFrame, path: str | None = None, end: int = 1, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark, path = docs.sparkSession, path or default_path()
    wide = max(word_ids(path).tok.get_vocab_size(), end + 1) > 1 << 16
    schema = "doc_id long, pid int, doc_tokens long, rest int, rank long, full_at long, crcs array<long>, ids binary"
    t = written(docs.select("doc_id", empty_if_null("text").alias("text")).mapInArrow(_tokenise(path, end, window, wide), schema), "tokens")
    counts = written(t.groupBy("pid", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("crcs")).alias("f")), "counts")
    hist = np.zeros(window, np.int64)
    for rest, n in counts.groupBy("rest").agg(F.sum("n")).collect():  # at most one row a length
        hist[rest] = n
    plan = Plan(hist, window)
    before = counts.select("pid", "rest", (F.sum("n").over(Window.partitionBy("rest").orderBy("pid")) - F.col("n")).alias("before"))
    full = counts.groupBy("pid").agg(F.sum("f").alias("f"))
    full = full.select("pid", (F.sum("f").over(Window.orderBy("pid")) - F.col("f")).alias("full_before"))  # one row a partition
    where = checked_broadcast(written(before.join(full, "pid"), "before"))
    placed = t.join(where, ["pid", "rest"]).select("doc_id", "doc_tokens", "rest", "rank", "full_at", "crcs", "ids", "before", "full_before")
    runs = spark.sparkContext.broadcast(plan.table())
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return placed.mapInArrow(_pieces(runs, window, plan.sequences, wide), ", ".join(f"{n} long" for n in names))
