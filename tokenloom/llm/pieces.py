"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text (with the dummy space before it) is cut where no piece can reach across: before a
run of spaces, and around characters that no piece holds. Each distinct segment of a
chunk gets its lattice once: all of its substrings that are pieces are edges, and bytes
of characters without a piece are edges of their own. Forward filtering sums the weights
of all paths to every position; every occurrence then samples backwards from its end, edge
by edge, in proportion to path weights, which draws a whole segmentation exactly from
p(s) ~ exp(alpha * sum of piece scores). The random numbers are hashes of (seed, row key,
segment, step), so a row's sample is the same in any batch, partition or run. Occurrences
of a chunk are sampled side by side in numpy.

Scores: a unigram model's are log-probabilities already; a BPE model has only ranks, and
its piece of rank r gets -log(r + 1), its vocabulary being sorted by frequency.

Decoding joins the pieces' bytes and takes the dummy space off; the text's own U+2581 is
written by its bytes, so every text comes back as it was.

Cases: null or empty text has no pieces; null keys count as one key (with the text alone
deciding nothing: equal texts under it get equal samples), and repeated rows sample
alike; texts of any length are encoded whole. An empty table gives an empty result.
Further columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk

CHUNK = 4 << 20
SPACE = 32
GRAIN = 24  # bits of a random number and of a share: their sums with a position are exact
UNKNOWN = -12.0  # below the score of any piece of a usual vocabulary


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """The vocabulary of a model file, by hash and length; one per worker and file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = np.full(256, -1, np.int32)
        normal, scores = [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.bytes[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = piece.encode().replace("▁".encode(), b" ")
                normal.append(i)
                scores.append(sp.get_score(i))
        if (self.byte_ids < 0).any():
            raise ValueError("a lossless model needs its 256 byte pieces")
        scores = np.array(scores)
        ranked = np.array_equal(scores, np.rint(scores)) and scores.min() < -1000
        self.score = np.full(n, UNKNOWN)
        self.score[normal] = -np.log1p(scores.max() - scores + 1) if ranked else scores
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(self.bytes[i]) for i in normal])
        buf = np.frombuffer(b"".join(self.bytes[i] for i in normal), np.uint8)
        ends = np.cumsum(lengths)
        h = tk.span_hashes(buf, ends - lengths, ends)
        for l in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == l)
            order = at[np.argsort(h[at])]
            screen = np.zeros(1 << 18, bool)
            screen[(h[order] >> tk.U(46)).astype(np.int64)] = True
            self.by_length[l] = (h[order], np.array(normal, np.int32)[order], screen)
        self.spread = all(b" " not in self.bytes[i].lstrip(b" ") for i in normal)
        #: Bytes of one-byte characters that stand in no piece: segments end around them.
        held = np.zeros(256, bool)
        held[buf] = True
        self.alone = ~held
        self.alone[128:] = False
        self.alone[SPACE] = False
        self.bytes_of = np.array([len(b) for b in self.bytes])


_OPEN: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _OPEN:
        _OPEN[path] = PieceModel(path)
    return _OPEN[path]


def _uniform(key: np.ndarray, segment: np.ndarray, step: int) -> np.ndarray:
    h = tk.mix(tk.mix(key + (segment.astype(np.uint64) + tk.U(1)) * tk.U(0x9FB21C651E98DF25)) + tk.U((step + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
    return (h >> tk.U(64 - GRAIN)).astype(np.float64) * 2.0**-GRAIN


def _prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pw, inv = tk._powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    v = tk.VAL[buf]
    v *= pw[: len(buf)]
    np.cumsum(v, out=c[1:])
    return c, inv


def _spans(pre: np.ndarray, inv: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """``span_hashes`` of buf[at : at + length] from the sums of ``_prefix_hashes``."""
    return tk.mix((pre[at + length] - pre[at]) * inv[at] + tk.U(length * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


class Lattice:
    """Edges of many segments side by side. Positions of segment k are ``base[k]`` (its
    start) to ``base[k] + length``; edges into a position are contiguous, with the running
    share of each in ``reach`` = position + cumulative probability."""

    def __init__(self, model: PieceModel, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, alpha: float):
        n = ends - starts
        self.base = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
        total = int((n + 1).sum())
        seg = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        off = np.arange(len(seg)) - first[seg]
        at = starts[seg] + off  # in buf
        room = n[seg] - off
        froms, tos, ids = [], [], []
        lead = ~tk.CONT[buf[at]]
        known = np.zeros(len(at), bool)  # characters that are a piece of their own
        width = np.ones(len(at), np.int64)
        b = buf[at]
        width += (b >= 0xC0).astype(np.int64) + (b >= 0xE0) + (b >= 0xF0)
        pos = self.base[seg] + off
        pre, inv = _prefix_hashes(buf)
        left = np.flatnonzero(lead)
        for l in sorted(model.by_length):
            table, piece, screen = model.by_length[l]
            left = left[room[left] >= l]
            if not len(left):
                break
            h = _spans(pre, inv, at[left], l)
            maybe = screen[(h >> tk.U(46)).view(np.int64)]
            i, h = left[maybe], h[maybe]
            k = np.minimum(np.searchsorted(table, h), len(table) - 1)
            ok = table[k] == h
            i, k = i[ok], k[ok]
            froms.append(pos[i])
            tos.append(pos[i] + l)
            ids.append(piece[k])
            known[i[width[i] == l]] = True
        # A character that isn't a piece goes byte by byte.
        owner = np.cumsum(lead) - 1
        bare = np.flatnonzero(~known[np.flatnonzero(lead)][owner]) if len(lead) else np.zeros(0, np.int64)
        froms.append(pos[bare])
        tos.append(pos[bare] + 1)
        ids.append(model.byte_ids[b[bare]])
        f, t, p = (np.concatenate(x) for x in (froms, tos, ids))
        # By position, then start: one key, as no two edges have both in common. It comes in runs
        # that are sorted already, one a length, which a stable sort merges.
        order = np.argsort(t * (max(model.by_length) + 1) - (t - f), kind="stable")
        self.f, t, self.p = f[order], t[order], p[order]
        w = model.score[self.p] * alpha
        # Forward filtering: all segments advance one position a step.
        depth = t - np.repeat(self.base, n + 1)[t]
        log = np.full(total, -np.inf)
        log[self.base] = 0.0
        by = np.argsort(depth.astype(np.uint16) if n.max(initial=0) < 1 << 16 else depth, kind="stable")
        cuts = np.searchsorted(depth[by], np.arange(1, int(n.max(initial=0)) + 2))
        for lo, hi in zip(cuts, cuts[1:]):
            e = by[lo:hi]
            if len(e):
                to = t[e]
                new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                log[to[new]] = np.logaddexp.reduceat(log[self.f[e]] + w[e], new)
        share = np.exp(log[self.f] + w - log[t])
        share[~np.isfinite(share)] = 0.0
        # Shares in whole grains: their running sums are exact, so a row's sample has no bit
        # from its neighbours in the batch.
        upto = np.cumsum(np.bincount(t, minlength=total))
        start = np.concatenate([[0], upto[:-1]])
        c = np.concatenate([[0], np.cumsum(np.rint(share * 2.0**GRAIN).astype(np.int64))])
        self.reach = t + np.minimum(c[1:] - c[start][t], 1 << GRAIN) * 2.0**-GRAIN
        self.last = upto - 1
        self.end = self.base + n

    def sample(self, seg: np.ndarray, key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each occurrence of a segment, in order, and how many each has."""
        pos, alive = self.end[seg].copy(), np.arange(len(seg))
        done_at, done_id, step = [], [], 0
        origin = self.base[seg]
        while len(alive):
            u = _uniform(key[alive], number[alive], step)
            here = pos[alive]
            e = np.minimum(np.searchsorted(self.reach, here + u, "right"), self.last[here])
            done_at.append(alive)
            done_id.append(self.p[e])
            pos[alive] = self.f[e]
            alive = alive[pos[alive] > origin[alive]]
            step += 1
        if not done_at:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        count = np.zeros(len(seg), np.int64)
        for a in done_at:
            count[a] += 1
        end = np.cumsum(count)
        out = np.empty(int(end[-1]), np.int32)
        for k, (a, i) in enumerate(zip(done_at, done_id)):
            out[end[a] - 1 - k] = i
        return out, count


def _prefixed(ch: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with the dummy space before every text that isn't empty."""
    size = np.diff(ch.offs)
    more = (size > 0).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(size + more)])
    buf = np.full(int(offs[-1]), SPACE, np.uint8)
    keep = np.ones(len(buf), bool)
    keep[offs[:-1][more > 0]] = False
    buf[keep] = ch.buf
    return buf, offs


def sample_chunk(model: PieceModel, ch: tk.Chunk, keys: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a chunk, and the offsets of each."""
    buf, offs = _prefixed(ch)
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(ch.n + 1, np.int64)
    cut = np.zeros(len(buf), bool)
    if model.spread:
        space = buf == SPACE
        cut[1:] = space[1:] & ~space[:-1]
    alone = model.alone[buf]
    cut |= alone
    cut[1:] |= alone[:-1]
    cut[offs[:-1][offs[:-1] < len(buf)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(buf))
    doc = np.searchsorted(offs, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, offs)[doc]
    _, one, which = np.unique(tk.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    lattice = Lattice(model, buf, starts[one], ends[one], alpha)
    # Occurrences of a segment side by side: their lookups fall on the same few edges.
    by = np.argsort(which, kind="stable")
    sampled, n = lattice.sample(which[by], keys[doc[by]], number[by])
    count = np.empty_like(n)
    count[by] = n
    upto = np.concatenate([[0], np.cumsum(count)])
    ids = np.empty_like(sampled)
    ids[np.arange(len(sampled)) + np.repeat(upto[by] - (np.cumsum(n) - n), n)] = sampled
    return ids, upto[np.searchsorted(starts, offs)]


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    known = ids.fill_null(-1).cast(pa.int64()).to_numpy().view(np.uint64)
    return tk.mix(known ^ tk.mix(np.array([seed + 1], np.uint64)))


def decode_ids(model: PieceModel, ids: np.ndarray) -> bytes:
    """UTF-8 of a text from its ids."""
    return b"".join([model.bytes[i] for i in ids.tolist()])[1:]


def _encode(path: str, seed: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in batches:
            keys = row_keys(b.column(0), seed)
            for ch in tk.chunks(b.column(1), CHUNK):
                ids, offs = sample_chunk(model, ch, keys[ch.lo : ch.hi], alpha)
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(ch.lo, ch.n), lists], ["doc_id", "ids"])

    return run


def _digests(path: str, seed: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in batches:
            keys = row_keys(b.column(0), seed)
            for ch in tk.chunks(b.column(1), CHUNK):
                ids, offs = sample_chunk(model, ch, keys[ch.lo : ch.hi], alpha)
                at, crc, sha = offs.tolist(), [], []
                for s, e in zip(at, at[1:]):
                    crc.append(zlib.crc32(ids[s:e].astype("<u4").tobytes()))
                    sha.append(hashlib.sha256(decode_ids(model, ids[s:e])).hexdigest())
                cols = [b.column(0).slice(ch.lo, ch.n), pa.array(np.diff(offs)), pa.array(crc, pa.int64()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str | None = None, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """doc_id and the ids of a sampled segmentation of every text."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path or default_path(), seed, alpha), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of ``encode``'s rows."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in batches:
            texts = [None if i is None else decode_ids(model, np.array(i, np.int64)).decode() for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned ids) and decoded_sha256 (of the
    UTF-8 that the ids decode to) of every document: encoded and decoded in one pass."""
    return docs.select("doc_id", "text").mapInArrow(_digests(path or default_path(), seed, alpha), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
