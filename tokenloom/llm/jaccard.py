"""N-gram Jaccard self-join by signature trees.

A document's set is its distinct 3-word shingles (hashed, 64 bits); equal sets are one class
with a count. Classes meet in three steps, none of which decides a link:

1. Screen: ``BANDS`` bands of ``ROWS`` minima each; a class that shares no band with
   another has no link (two sets at the threshold of 70 % miss every band with probability
   (1 - 0.7**ROWS)**BANDS, below 1e-11, and closer ones with less). What is left is read
   again, and only that; classes that no chain of bands connects never meet again.
2. Groups: in each such chain, shingles are ordered by the number of classes that have them, rarest first (the
   at most 2 * ``SHARES`` most frequent ones last). Two sets that link share one of the first |x| - ceil(percent * |x|) + 1 shingles of each
   (exactly, no probability). Star edges from equal shingles of these prefixes make the
   groups. Texts that share boilerplate only have shingles of their own enough to fill
   their prefixes, so they form no group, however many they are.
3. Trees: within a group a signature tree is built: leaves are sets with a bitmap of their
   tokens (those that two sets of the group have), inner nodes hold the OR of eight
   children, size ranges and the largest number of tokens that share bits. A dual traversal
   keeps a pair of nodes only if sizes can match and the common bits allow the overlap that
   the smallest sizes need; pairs of leaves are verified exactly. Groups beyond ``BLOCK``
   shingles are split into blocks by size and hash, and all pairs of blocks of compatible
   sizes are traversed, each by its own task: exact at every size, without gathering a group.

The most frequent shingles take no part in the shuffle by shingle, large classes and hubs are
joined apart from the rest (``keyed_join``), and rows are told apart by place (``places``), so no text is shuffled.

Cases: null or empty text, or white space only, has an empty set: linked with nothing, its
own component. One or two words are one shingle. Rows without an id take part; their
``doc_id`` stays null, and a component of such rows alone has a null ``component_id``.
Repeated rows are documents of their own that share an id, and so are different texts under
one id. Texts of any length are read whole. An empty table gives an empty result. Further
columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import checked_broadcast, discard, keyed_join, partitions, returned, written
from .components import components, local_roots
from .places import FILE, ROW, Answers, placed, standing, store, without
from .tokencache import forget
from .wavelet import binaries

ROWS, BANDS = 4, 96
BLOCK = 1 << 20
SHARES = 1 << 17
#: Keys that a task connects at once, and pairs of nodes that a traversal expands at once (by FAN * FAN at most).
KEYS = 1 << 19
PAIRS = 1 << 12
_A = (tk.mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | tk.U(1)).astype(np.uint32)
_B = tk.mix(np.arange(7001, 7001 + ROWS * BANDS, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(ch: tk.Chunk, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a chunk, sorted; offsets."""
    starts, ends, first = tk.words(ch)
    h = tk.span_hashes(ch.buf, starts, ends, tk.VAL_LOWER)
    g, goffs = tk.shingles(h, first, width)
    n_words = np.diff(first)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    of = np.repeat(np.arange(ch.n), np.diff(goffs))
    if len(short):
        one = h[first[short]]
        two = np.where(n_words[short] > 1, h[np.minimum(first[short] + 1, len(h) - 1)], tk.U(0))
        s = tk.mix(tk.mix(one + n_words[short].astype(np.uint64)) ^ two * tk.U(0xE7037ED1A0B428DB))
        g, of = np.concatenate([g, s]), np.concatenate([of, short])
    order = np.argsort(g)
    order = order[np.argsort(of[order], kind="stable")]
    g, of = g[order], of[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    g, of = g[new], of[new]
    return g, np.searchsorted(of, np.arange(ch.n + 1))


def set_marks(g: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    c = np.zeros((2, len(g) + 1), np.uint64)
    np.cumsum(tk.mix(g), out=c[0, 1:])
    np.cumsum(tk.mix(g ^ tk.U(0x5851F42D4C957F2D)), out=c[1, 1:])
    d = c[:, offs[1:]] - c[:, offs[:-1]]
    return d[0].view(np.int64), d[1].view(np.int64)


def band_keys(g: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents x ``BANDS`` keys of the documents with a set (others: rows of zeros)."""
    n = len(offs) - 1
    some = np.flatnonzero(np.diff(offs) > 0)
    out = np.zeros((n, BANDS), np.uint64)
    if not len(some):
        return out
    x = (g >> tk.U(32)).astype(np.uint32) ^ g.astype(np.uint32)
    at = offs[some]
    t = np.empty_like(x)
    for b in range(BANDS):
        key = np.full(len(some), b, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            np.bitwise_xor(x, _B[i], out=t)
            np.multiply(t, _A[i], out=t)
            key = tk.mix(key) ^ np.minimum.reduceat(t, at).astype(np.uint64)
        out[some, b] = tk.mix(key)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        for ch in tk.chunks(b.column(1)):
            g, offs = shingle_sets(ch)
            sa, sb = set_marks(g, offs)
            keys = band_keys(g, offs).view(np.int64)
            n = np.diff(offs)
            kept = np.where(n > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(keys[n > 0].ravel()))
            ids, files, rows = (b.column(i).slice(ch.lo, ch.n) for i in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(sa), pa.array(sb), lists, files, rows], ["doc_id", "n", "sa", "sb", "bands", FILE, ROW])


def _stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest document, and distinct edges to it."""
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    low = np.minimum.reduceat(doc, cut)
    far = np.repeat(low, np.diff(np.concatenate([cut, [len(key)]])))
    e = np.unique(np.stack([doc, far], 1)[doc != far], axis=0)
    return key[cut], low, e[:, 0], e[:, 1]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, key or keys) to edges to the smallest node of each key met, and these."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        key, low, a, b = _stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        for kind, x, y in ((False, key, low), (True, a, b)):
            for i in range(0, len(x), 1 << 16):
                z = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[z]), kind)), pa.array(x[z]), pa.array(y[z])], ["edge", "x", "y"])

    size = 0
    for b in batches:
        node, key = b.column(0).to_numpy(), b.column(1)
        if pa.types.is_list(key.type):
            node = np.repeat(node, key.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            key = key.flatten()
        key = key.to_numpy()
        if len(key):
            held.append((key, node))
            size += len(key)
        if size > KEYS:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def star_edges(nodes: DataFrame, name: str, first=None) -> DataFrame:
    """Edges (a, b; written) that connect the nodes of each key of ``nodes`` (node, key or
    list of keys): first within a task, so a key sends few rows a task to the shuffle.
    ``first`` makes such rows of those of ``nodes``, in the same worker."""
    make = returned(_local_stars if first is None else lambda batches: _local_stars(first(batches)))
    stars = written(nodes.mapInArrow(make, "edge boolean, x long, y long"), "stars")
    heads = stars.where("not edge").select("x", "y").repartition(partitions(nodes.sparkSession), "x").sortWithinPartitions("x", "y")
    edges = stars.where("edge").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(heads.mapInArrow(returned(_sorted_stars), "a long, b long"))
    edges = written(edges.distinct(), name)
    discard(stars)
    return edges


def _sorted_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, document) sorted by both to distinct edges; a run may span batches."""
    last_key = last_doc = None
    for b in batches:
        key, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        new = np.concatenate([[True], key[1:] != key[:-1]])
        cut = np.flatnonzero(new)
        low = doc[cut].copy()
        if key[0] == last_key:
            low[0] = last_doc
        last_key, last_doc = key[-1], low[-1]
        far = np.repeat(low, np.diff(np.concatenate([cut, [len(key)]])))
        e = np.unique(np.stack([doc, far], 1)[doc != far], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])


# == signature trees ==


def need(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap at which sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


class Tree:
    """Levels from the leaves up: OR bitmaps, size ranges, spare tokens (tokens beyond the
    number of bits) of nodes of ``FAN`` children each."""

    FAN = 8

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, spare: np.ndarray):
        self.bits, self.lo, self.hi, self.spare = [bits], [sizes], [sizes], [spare]
        while len(self.bits[-1]) > 1:
            cut = np.arange(0, len(self.bits[-1]), self.FAN)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], cut, axis=0))
            self.lo.append(np.minimum.reduceat(self.lo[-1], cut))
            self.hi.append(np.maximum.reduceat(self.hi[-1], cut))
            self.spare.append(np.maximum.reduceat(self.spare[-1], cut))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes of ``level``, and for each the index of its parent in ``nodes``."""
        n = len(self.bits[level - 1])
        c = (nodes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        at = np.repeat(np.arange(len(nodes)), self.FAN)
        ok = c < n
        return c[ok], at[ok]


def _possible(x: Tree, y: Tree, lx: int, ly: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a link, and (for leaves) their common bits at least."""
    keep = (100 * x.hi[lx][i] >= percent * y.lo[ly][j]) & (100 * y.hi[ly][j] >= percent * x.lo[lx][i])
    at = np.flatnonzero(keep)
    step = max(1, (1 << 18) // x.bits[0].shape[1])
    for k in range(0, len(at), step):
        z = at[k : k + step]
        p, q = i[z], j[z]
        common = np.bitwise_count(x.bits[lx][p] & y.bits[ly][q]).sum(1, dtype=np.int64) + np.minimum(x.spare[lx][p], y.spare[ly][q])
        keep[z] = common >= need(x.lo[lx][p], y.lo[ly][q], percent)
    return keep


def traverse(x: Tree, y: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that the bounds can't rule out, in pieces; only i < j if x is y."""
    stack = [(len(x.bits) - 1, len(y.bits) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        lx, ly, i, j = stack.pop()
        if len(i) > PAIRS:
            half = len(i) // 2
            stack += [(lx, ly, i[:half], j[:half]), (lx, ly, i[half:], j[half:])]
            continue
        ok = _possible(x, y, lx, ly, i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if lx == 0 and ly == 0:
            if x is y:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        if lx >= ly:
            i, at = x.children(lx, i)
            j = j[at]
            lx -= 1
        if ly > lx or (x is y and ly == lx + 1):
            j, at = y.children(ly, j)
            i = i[at]
            ly -= 1
        if x is y:
            ok = i <= j
            i, j = i[ok], j[ok]
        stack.append((lx, ly, i, j))


MAX_BITS = 4096


def links(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of linked sets (indices); with ``side``, only pairs across the sides."""
    out = [(np.zeros(0, np.int64),) * 2, *linked(sets, sizes, side, percent)]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def linked(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``links`` in pieces: a group of near copies has a pair for any two of them, so they
    aren't held."""
    m = len(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    uniq, tok, cnt = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = cnt > 1
    tok = (np.cumsum(shared) - 1)[tok] * shared[tok] - ~shared[tok]
    of, tok = of[tok >= 0], tok[tok >= 0]
    universe = int(shared.sum())
    bits = min(max(64, -(-universe // 64) * 64), MAX_BITS)
    exact = universe <= bits
    word = np.zeros((m, bits // 64), np.uint64)
    at = tok % bits
    np.bitwise_or.at(word, (of, at >> 6), tk.U(1) << (at & 63).astype(np.uint64))
    kept = np.bincount(of, minlength=m)
    spare = kept - np.bitwise_count(word).sum(1, dtype=np.int64)
    first = np.searchsorted(of, np.arange(m + 1))
    low = np.where(kept > 0, tok[np.minimum(first[:-1], max(len(tok) - 1, 0))] if len(tok) else 0, -1)

    def tree(idx: np.ndarray) -> tuple[Tree, np.ndarray]:
        order = idx[np.lexsort((sizes[idx], low[idx]))]
        return Tree(word[order], sizes[order], spare[order]), order

    if side is None:
        x, ox = tree(np.arange(m))
        y, oy = x, ox
    else:
        if side.all() or not side.any():
            return
        x, ox = tree(np.flatnonzero(~side))
        y, oy = tree(np.flatnonzero(side))
    here = np.zeros(universe + 1, bool)
    for i, j in traverse(x, y, percent):
        i, j = ox[i], oy[j]
        if not exact:
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            ok = np.zeros(len(i), bool)
            cut = [0, *(np.flatnonzero(i[1:] != i[:-1]) + 1).tolist(), len(i)] if len(i) else []
            for lo, hi in zip(cut, cut[1:]):
                mine = tok[first[i[lo]] : first[i[lo] + 1]]
                here[mine] = True
                js = j[lo:hi]
                n = kept[js]
                pos = np.repeat(first[js] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hit = np.concatenate([[0], np.cumsum(here[tok[pos]])])
                end = np.cumsum(n)
                ok[lo:hi] = hit[end] - hit[end - n] >= need(sizes[i[lo]], sizes[js], percent)
                here[mine] = False
            i, j = i[ok], j[ok]
        yield i, j


def _member_sets(folder: str):
    """The sets of the rows that stand for a class; equal tokens of two chains differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        answers = Answers(folder)
        for b in batches:
            hit, col = answers.find(b.column(1).to_numpy(), b.column(2).to_numpy(), "chain", "node", "n", "m")
            for ch in tk.chunks(b.column(0).filter(pa.array(hit))):
                g, offs = shingle_sets(ch)
                at = np.flatnonzero(hit)[ch.lo : ch.hi]
                if (np.diff(offs) != col["n"][at]).any():
                    raise RuntimeError("a row isn't where it was")
                g = tk.mix(g ^ np.repeat(tk.mix(col["chain"][at].view(np.uint64)), np.diff(offs)))
                yield pa.RecordBatch.from_arrays([*(pa.array(col[c][at]) for c in ("node", "n", "m")), binaries(g, offs)], ["node", "n", "m", "tokens"])

    return run


def _flat(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a batch of sets, and how many each row has."""
    buf, offs = tk.string_buffers(b.column(column))
    return np.ascontiguousarray(buf).view(np.int64), np.diff(offs) // 8


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that make up more than their share of a batch, with their number there."""
    for b in batches:
        all_, _ = _flat(b, 0)
        t, c = np.unique(all_, return_counts=True)
        often = c > len(all_) / (2 * SHARES)
        yield pa.RecordBatch.from_arrays([pa.array(t[often]), pa.array(c[often])], ["token", "c"])


def _occurrences(frequent, hot: bool):
    """(token, node, n, rank) of the frequent tokens, or of the others (rank 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = frequent.value
        for b in batches:
            t, c = _flat(b, 2)
            at = np.searchsorted(tokens, t) if len(tokens) else np.zeros(len(t), np.int64)
            at = np.minimum(at, max(len(tokens) - 1, 0))
            known = tokens[at] == t if len(tokens) else np.zeros(len(t), bool)
            mine = known == hot
            rank = ranks[at[mine]] if hot else np.zeros(int(mine.sum()), np.int64)
            cols = [t[mine], np.repeat(b.column(0).to_numpy(), c)[mine], np.repeat(b.column(1).to_numpy(), c)[mine], rank]
            for i in range(0, len(cols[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in cols], ["token", "node", "n", "rank"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], step) -> Iterator[pa.RecordBatch]:
    """``step`` over whole runs of the first column of sorted batches of longs; the last run
    of a batch is held, as it may go on in the next."""
    held: list[np.ndarray] = []
    for b in batches:
        x = np.stack([c.to_numpy() for c in b.columns])
        if not x.shape[1]:
            continue
        if x[0, 0] != x[0, -1] or (held and held[-1][0, -1] != x[0, 0]):
            x = np.concatenate([*held, x], 1)
            last = int(np.searchsorted(x[0], x[0, -1]))
            yield from step(x[:, :last])
            held = [x[:, last:]]
        else:
            held.append(x)
    if held:
        yield from step(np.concatenate(held, 1))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, node, n) sorted by token, with the number of sets that have the token, if
    there are others than this."""

    def step(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if x.shape[1]:
            cut = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
            count = np.diff(np.concatenate([cut, [x.shape[1]]]))
            df = np.repeat(count, count)
            some = df > 1
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (*x[:3], df)], ["token", "node", "n", "rank"])

    return _runs(batches, step)


def _prefixes(percent: int):
    """Rows (node, n, token) of tokens that other sets have, sorted by node and rarest first, to
    those of each set's prefix. One set is held at a time."""
    return lambda batches: _runs(batches, lambda x: _first(x, percent))


def _first(x: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    if x.shape[1]:
        node, n, token = x
        cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        count = np.diff(np.concatenate([cut, [len(node)]]))
        prefix = n[cut] - -(-percent * n[cut] // 100) + 1
        take = np.clip(prefix - (n[cut] - count), 0, count)  # tokens of its own come first
        mine = np.arange(len(node)) - np.repeat(cut, count) < np.repeat(take, count)
        yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(token[mine])], ["node", "key"])


def _join_runs(percent: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        node, n, m = (np.array([r[i] for r in rows], np.int64) for i in (4, 5, 6))
        side = np.array([bool(r[3]) for r in rows]) if rows[0][1] != rows[0][2] else None
        deg, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for i, j in linked([np.frombuffer(r[7], np.uint64) for r in rows], n, side, percent):
            np.add.at(deg, i, m[j])
            np.add.at(deg, j, m[i])
            a, b = root[i], root[j]
            if (new := a != b).any():
                x, low = local_roots(a[new], b[new])
                at = np.arange(len(rows))
                at[x] = low
                root = at[root]
        some = np.flatnonzero(deg)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[some], node[root[some]], deg[some])], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for r in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    if r[:3] != at:
                        if len(rows) > 1 and (x := solve(rows)) is not None:
                            out.append(x)
                        at, rows = r[:3], []
                        if len(out) > 1000:
                            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                            out = []
                    rows.append(r)
        if len(rows) > 1 and (x := solve(rows)) is not None:
            out.append(x)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


def _tasks(members: DataFrame, block: int) -> DataFrame:
    """``members`` (comp, node, n, ...) with the traversals (i, j, side) that they take part in."""
    sizes = members.groupBy("comp").agg(F.sum("n").alias("total"))
    big = written(sizes.where(F.col("total") > block).select("comp"), "big")
    zero = [F.lit(0).cast("long").alias(c) for c in ("i", "j")]
    if big.isEmpty():
        return members.select("comp", *zero, F.lit(False).alias("side"), *members.columns[1:])
    b = checked_broadcast(big)
    small = members.join(b, "comp", "left_anti").select("comp", *zero, F.lit(False).alias("side"), *members.columns[1:])
    octave = F.floor(F.log2(F.col("n").cast("double")) * 8)
    large = members.join(b, "comp", "left_semi").withColumn("o", octave)
    subs = large.groupBy("comp", "o").agg(F.ceil(F.sum("n") / block).alias("subs"))
    subs = written(subs, "subs")
    large = large.join(checked_broadcast(subs), ["comp", "o"])
    large = large.withColumn("at", F.col("o") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("subs"))).drop("subs")
    blocks = subs.select("comp", "o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("s")).select("comp", "o", (F.col("o") * (1 << 32) + F.col("s")).alias("at"))
    other = blocks.select("comp", F.col("o").alias("o2"), F.col("at").alias("at2"))
    # sizes of a link differ by a factor of 10/7 at most: less than 4.2 eighths of an octave
    pairs = blocks.join(other, "comp").where("at <= at2 and o2 - o <= 5").select("comp", F.col("at").alias("i"), F.col("at2").alias("j"))
    pairs = written(pairs, "pairs")
    rest = members.columns[1:]
    left = large.join(pairs, (large["comp"] == pairs["comp"]) & (large["at"] == pairs["i"])).select(large["comp"], "i", "j", F.lit(False).alias("side"), *rest)
    right = large.join(pairs, (large["comp"] == pairs["comp"]) & (large["at"] == pairs["j"])).where("i != j").select(large["comp"], "i", "j", F.lit(True).alias("side"), *rest)
    return small.unionByName(left).unionByName(right)


def classes_of(sets: DataFrame) -> DataFrame:
    """Equal sets: their first row (smallest id, then place) and how many they are; written."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("id_null"), "doc_id", FILE, ROW)).alias("first")
    return written(sets.where("n > 0").groupBy("sa", "sb", "n").agg(first, F.count(F.lit(1)).alias("m")), "classes")


def members_of(docs: DataFrame, sets: DataFrame, classes: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """The classes that pass the screen, with their first row (node, n, m, sa, sb, first), and
    their sets (node, n, m, tokens); both written."""
    chains = components(star_edges(sets.where("n > 0").select("sa", "bands"), "near"), **how)
    members = classes.join(checked_broadcast(chains.select(F.col("node").alias("sa"), F.col("root").alias("chain"))), "sa")
    members = written(members.withColumn("node", F.monotonically_increasing_id()), "members")
    at = store(members.select(F.col(f"first.{FILE}").alias(FILE), F.col(f"first.{ROW}").alias(ROW), "chain", "node", "n", "m"))
    return members, written(placed(docs, "text").mapInArrow(returned(_member_sets(at)), "node long, n long, m long, tokens binary"), "tokens")


def frequent_tokens(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every token that makes up more than 1 / ``SHARES`` of all, and some of those that make
    up half of that or more: 2 * ``SHARES`` tokens at most. Their ranks come after all others'."""
    part = tokens.select("tokens").mapInArrow(returned(_frequent), "token long, c long")
    all_ = tokens.agg(F.sum("n")).first()[0] or 0
    t = part.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= all_ / (2 * SHARES)).orderBy("token").toArrow()
    return t.column("token").to_numpy(), t.column("c").to_numpy() + (1 << 40)


def groups_of(tokens: DataFrame, percent: int, **how) -> DataFrame:
    """(node, comp) of the sets that share a prefix token with another one."""
    spark, schema = tokens.sparkSession, "token long, node long, n long, rank long"
    frequent = spark.sparkContext.broadcast(frequent_tokens(tokens))
    t = tokens.select("node", "n", "tokens")
    rest = t.mapInArrow(returned(_occurrences(frequent, False)), schema).drop("rank")
    rest = rest.repartition(partitions(spark), "token").sortWithinPartitions("token").mapInArrow(returned(_ranked), schema)
    each = rest.unionByName(t.mapInArrow(returned(_occurrences(frequent, True)), schema))
    each = each.repartition(partitions(spark), "node").sortWithinPartitions("node", "rank", "token").select("node", "n", "token")
    return components(star_edges(each, "edges", _prefixes(percent)), **how).select("node", F.col("root").alias("comp"))


def join(docs: DataFrame, percent: int = 70, block: int = BLOCK, one_task: int | None = None) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id of every document. ``percent`` must be 70
    or more (the bands' guarantee, and the blocks' size ranges, hold from there)."""
    if percent < 70:
        raise ValueError("the bands are made for thresholds of 70 % and more")
    return _shown(_joined(standing(docs), percent, block, one_task))


def _shown(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.when(F.col("n_similar").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def _joined(docs: DataFrame, percent: int, block: int, one_task: int | None) -> DataFrame:
    """Of every row: doc_id, place, n, and where it has a link n_similar and its component's first row."""
    how = {} if one_task is None else {"one_task": one_task}
    schema = f"doc_id long, n long, sa long, sb long, bands array<long>, {FILE} long, {ROW} long"
    sets = written(placed(docs, "doc_id", "text").mapInArrow(returned(_sets), schema), "sets")
    classes = classes_of(sets)
    members, tokens = members_of(docs, sets, classes, **how)
    groups = written(groups_of(tokens, percent, **how), "groups")
    grouped = tokens.join(checked_broadcast(groups), "node")
    tasks = written(_tasks(written(grouped.select("comp", "node", "n"), "grouped"), block).select("comp", "i", "j", "side", "node"), "tasks")
    spread = tokens.join(checked_broadcast(tasks), "node").select("comp", "i", "j", "side", "node", "n", "m", "tokens")
    spread = spread.repartition(4 * partitions(docs.sparkSession), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    found = written(spread.mapInArrow(returned(_join_runs(percent)), "a long, b long, links long"), "links")
    discard(tokens, tasks)
    # Classes that link: their links and the first row of all that they reach.
    roots = components(found.select("a", "b"), **how)
    linked = roots.join(found.groupBy("a").agg(F.sum("links").alias("links")), F.col("node") == F.col("a"))
    linked = written(linked.join(members, "node").select("root", "links", "sa", "sb", "n", "m", "first"), "linked")
    low = written(linked.groupBy("root").agg(F.min("first").alias("low"), F.count(F.lit(1)).alias("c")), "lows")
    linked = keyed_join(linked, low, "root", "c").select("sa", "sb", "n", "links", F.col("low").alias("first0"))
    # Classes of several rows, or with links.
    answers = classes.join(checked_broadcast(written(linked, "linked_classes")), ["sa", "sb", "n"], "left").where("m > 1 or links is not null")
    answers = answers.select("sa", "sb", "n", "m", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("first0", "first").alias("first"))
    rows = sets.select("doc_id", FILE, ROW, "n", "sa", "sb")
    return keyed_join(rows, written(answers, "answers"), ["sa", "sb", "n"], "m", "left")


def similar(docs: DataFrame, percent: int = 70) -> DataFrame:
    """doc_id, n_shingles, n_similar and component_id of every document."""
    return join(docs, percent)


def one_of_each(docs: DataFrame, percent: int = 70) -> DataFrame:
    """The rows of ``docs`` that are the first of their component: smallest id, and of rows that
    repeat it the first in place."""
    docs = standing(docs)
    j = _joined(docs, percent, BLOCK, None)
    other = (F.col(f"first.{FILE}") != F.col(FILE)) | (F.col(f"first.{ROW}") != F.col(ROW))
    return without(docs, j.where(F.col("n_similar").isNotNull() & other))
