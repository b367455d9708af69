"""Byte-pair encoding of pieces: plain Python, shipped to workers once.

Merges are applied lowest rank first, leftmost among equals. One short piece is scanned;
a long one keeps a heap of candidate merges over a linked list; many pieces are merged
side by side in numpy, one merge of every piece a round.
"""

from __future__ import annotations

import heapq

import numpy as np

from ..functions.bytes_map import BYTE_TO_CHAR
from ..sources.spec import TokenizerError, UnsupportedComponent

SCAN = 48
_NEVER = 1 << 22


class BPE:
    def __init__(self, vocab: dict[str, int], merges: list, ignore_merges: bool = False):
        if not vocab:
            raise TokenizerError("empty vocabulary")
        if sorted(vocab.values()) != list(range(len(vocab))):
            raise TokenizerError("ids of the vocabulary must be 0, 1, 2, ...")
        for t in vocab:
            if len(t) > 16383 and len(t.encode()) > 0xFFFF:
                raise TokenizerError("token longer than 65535 bytes")
        self.vocab, self.ignore_merges = vocab, bool(ignore_merges)
        self.tokens = [""] * len(vocab)
        for t, i in vocab.items():
            self.tokens[i] = t
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parsed = []
        for rank, m in enumerate(merges):
            left, right = m.split(" ", 1) if isinstance(m, str) and " " in m else m if not isinstance(m, str) and len(m) == 2 else self._bad(m)
            try:
                key, new = (vocab[left], vocab[right]), vocab[left + right]
            except KeyError as e:
                raise TokenizerError(f"merge of a token out of the vocabulary: {e.args[0]!r}") from e
            self.merges[key] = (rank, new)  # of equal pairs the last counts
            self.parsed.append((rank, *key, new))
        self.byte_ids = [vocab.get(BYTE_TO_CHAR[b]) for b in range(256)]
        self._orphan: dict[str, bool] = {}
        pairs = sorted(((a << 32 | b), r, n) for (a, b), (r, n) in self.merges.items())
        self._keys, self._ranks, self._news = (np.array([x[i] for x in pairs], np.int64) for i in range(3))

    @staticmethod
    def _bad(m):
        raise TokenizerError(f"bad merge: {m!r}")

    @classmethod
    def from_config(cls, c: dict) -> BPE:
        kind = c.get("type", "BPE" if "merges" in c and "vocab" in c else None)
        if kind != "BPE":
            raise UnsupportedComponent("model", kind)
        return cls(c.get("vocab") or {}, c.get("merges") or [], c.get("ignore_merges") or False)

    def merged(self, ids: list[int], least: int = 1) -> list[int]:
        """Merge until nothing applies (or ``least`` symbols are left)."""
        if len(ids) > SCAN and least == 1:
            return self._merged_long(ids)
        get = self.merges.get
        ids = list(ids)
        while len(ids) > least:
            best = None
            for i, pair in enumerate(zip(ids, ids[1:])):
                m = get(pair)
                if m is not None and (best is None or m[0] < best[0]):
                    best = (m[0], i, m[1])
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        n = len(ids)
        sym, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, p, m[1]) for i, p in enumerate(zip(ids, ids[1:])) if (m := get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, pair, new = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != pair[0] or j >= n or sym[j] != pair[1]:
                continue
            sym[i], sym[j] = new, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if m := get((new, sym[k])):
                    heapq.heappush(heap, (m[0], i, (new, sym[k]), m[1]))
            if (h := prv[i]) >= 0 and (m := get((sym[h], new))):
                heapq.heappush(heap, (m[0], h, (sym[h], new), m[1]))
        return [s for s in sym if s >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or ``_NEVER``) and merged id of pairs."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), max(len(self._keys) - 1, 0))
        if not len(self._keys):
            return np.full(len(key), _NEVER), at
        hit = self._keys[at] == key
        return np.where(hit, self._ranks[at], _NEVER), self._news[at]

    def merged_many(self, ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """``merged`` of many pieces, given one after the other."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lengths)
        who = np.flatnonzero(lengths > 0)
        n = lengths[who]
        sym = ids
        last = np.cumsum(n) - 1
        rank, new = np.full(len(sym), _NEVER), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], new[:-1] = self._rank(sym[:-1], sym[1:])
        rank[last] = _NEVER
        index = np.arange(len(sym))
        while len(who):
            start = np.cumsum(n) - n
            best = np.minimum.reduceat(rank * (1 << 40) + index[: len(sym)], start)
            go = best < _NEVER << 40
            if not go.all():
                for k in np.flatnonzero(~go).tolist():
                    out[who[k]] = sym[start[k] : start[k] + n[k]]
                keep = np.repeat(go, n)
                shift = np.cumsum(keep) - 1
                sym, rank, new = sym[keep], rank[keep], new[keep]
                best, who, n = best[go], who[go], n[go]
                if not len(who):
                    break
                at = shift[best & (1 << 40) - 1]
            else:
                at = best & (1 << 40) - 1
            sym = sym.copy()
            sym[at] = new[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            # the pair that ended at the right half now starts at the merged symbol
            rank[at] = rank[at + 1]
            sym, rank, new = sym[keep], rank[keep], new[keep]
            at = at - np.arange(len(at))
            n = n - 1
            end = np.cumsum(n)
            right = at[at + 1 < end]
            rank[at] = _NEVER
            if len(right):
                rank[right], new[right] = self._rank(sym[right], sym[right + 1])
            left = at[at > end - n] - 1
            if len(left):
                rank[left], new[left] = self._rank(sym[left], sym[left + 1])
        return out

    def is_orphan(self, token: str) -> bool:
        """A token that merging its characters doesn't come near: it sticks above two symbols.
        Single characters, and tokens with characters out of the vocabulary, aren't."""
        known = self._orphan.get(token)
        if known is None:
            ids = [self.vocab.get(c) for c in token]
            known = len(ids) > 2 and None not in ids and len(self.merged(ids, 2)) > 2
            self._orphan[token] = known
        return known

    def encode_chars(self, piece: str) -> list[int]:
        """A piece of table characters; a whole token is itself unless it is an orphan."""
        i = self.vocab.get(piece)
        if i is not None and not self.is_orphan(piece):
            return [i]
        try:
            return self.merged([self.vocab[c] for c in piece])
        except KeyError as e:
            raise TokenizerError(f"character {e.args[0]!r} not in vocabulary") from None

    def encode_raw(self, piece: str) -> list[int]:
        """A raw piece by its bytes; whole tokens only where merges are ignored."""
        data = piece.encode()
        if self.ignore_merges:
            i = self.vocab.get("".join([BYTE_TO_CHAR[b] for b in data]))
            if i is not None:
                return [i]
        ids = [self.byte_ids[b] for b in data]
        if None in ids:
            raise TokenizerError(f"byte 0x{data[ids.index(None)]:02X} has no token")
        return self.merged(ids)

    def may_neighbour(self, a: int, b: int) -> bool:
        """Whether two ids can stand side by side in an encoding: merging both tokens'
        characters together gives the two back."""
        ids = [self.vocab.get(c) for c in self.tokens[a] + self.tokens[b]]
        return None not in ids and self.merged(ids) == [a, b]
