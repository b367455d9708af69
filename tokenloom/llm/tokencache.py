"""Token ids of whole texts by the ``tokenizers`` library, one library call a distinct piece.

The vocabulary of ``word_bpe_49k.json`` drops white space, and none of its steps looks
across ASCII white space: NFC composes nothing with it, its pattern matches none of it,
and no added token holds any. So the ids of a text are those of its words (cut at
``[\\x20\\x09-\\x0D]``) in order, and the ids of a word of ASCII and Latin-1 letters are
those of its pieces after lower-casing. A chunk of texts is cut into pieces by a few numpy
passes over its bytes; pieces of up to 15 bytes are looked up side by side in a table
whose keys are the bytes themselves (so no two pieces can be confused), and only a piece
that the table doesn't hold goes to the library's model. Longer pieces, and words of
other characters (whole), are kept in a dictionary. ``WordIds`` looks at the tokenizer
file and uses the library on whole texts where this doesn't hold. When a memory is full,
what was met most since it was last full stays; results never depend on it.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np

from . import textkernel as tk
from .common import give_back

_OPEN: dict[str, WordIds] = {}


def default_path() -> str:
    """The place of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_ids(path: str) -> WordIds:
    """This process's encoder for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]


def forget() -> None:
    """Give this process's encoders up, and their memory back to the machine: for stages of
    a worker that has tokenised before and won't now."""
    if _OPEN:
        _OPEN.clear()
        gc.collect()
        give_back()


_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# == bytes of plain words: ASCII, and the letters of two bytes that begin with C3 ==

SPACE, LETTER, DIGIT, PUNCT, OTHER, WHOLE = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[33:127] = PUNCT
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = CLASS[0xC3] = LETTER
CLASS[tk.SEP] = SPACE
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False  # the signs of multiplication and division
_UPPER_C3 = np.zeros(256, np.uint8)
_UPPER_C3[0x80:0x9F] = 0x20
_UPPER_C3[0x97] = 0
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
SHORT = 15
_PAD = 24


def _byte_chars() -> dict[int, int]:
    """Byte (as a Latin-1 character) to its printable stand-in, where they differ."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in same)}


def _within(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the disjoint spans."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def cut(ch: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of a chunk: starts, ends, whether each is a whole word for the library,
    and the bytes in lower case (with ``_PAD`` zeros behind them)."""
    n, buf = len(ch.buf), ch.buf
    low = np.zeros(n + _PAD, np.uint8)
    low[:n] = tk.LOWER[buf]
    kind = np.zeros(n + _PAD, np.uint8)
    kind[:n] = CLASS[buf]
    starts, ends, _ = tk.words(ch)
    after = np.flatnonzero(buf == 0xC3) + 1
    if len(after):
        c = buf[after]
        low[after] = c + _UPPER_C3[c]
        kind[after[_AFTER_C3[c]]] = LETTER
    odd = np.flatnonzero(kind[:n] == OTHER)
    mark = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124)) if n else odd  # "<|" may begin an added token
    odd = np.concatenate([odd, mark])
    if len(odd):
        w = np.unique(np.searchsorted(starts, odd, "right") - 1)
        kind[:n][_within(n, starts[w], ends[w])] = WHOLE
    new = np.zeros(n + _PAD, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= kind == DIGIT
    word = np.zeros(n + _PAD, bool)
    word[starts] = True
    new |= word
    new &= kind != SPACE
    q = np.flatnonzero((buf == 39) & new[:n] & (kind[:n] == PUNCT))
    if len(q):  # 's 't 'm 'd 're 've 'll, where a piece begins
        a, b = low[q + 1], low[q + 2]
        one = ((a == 115) | (a == 116) | (a == 109) | (a == 100)) & ~word[q + 1]
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~word[q + 1] & ~word[q + 2]
        new[q[one | two] + 1] = False
        for at in (q[one] + 2, q[two] + 3):
            new[at[kind[at] == LETTER]] = True
    at = np.flatnonzero(new)
    end = np.minimum(np.append(at[1:], n)[: len(at)], ends[np.searchsorted(starts, at, "right") - 1]) if len(at) else at
    return at, end, kind[at] == WHOLE, low


class Runs:
    """Runs of ids by number, in one array."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count, self.hits, self.n = (*(np.zeros(1 << 14, np.int64) for _ in range(3)), 0)

    def add(self, ids: list[int], counts: np.ndarray) -> int:
        """Runs of these lengths, one after the other; the first one's number."""
        n, used = self.n + len(counts), self.used + len(ids)
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.start):
            self.start, self.count, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.hits))
        self.flat[self.used : used] = ids
        self.count[self.n : n] = counts
        self.start[self.n : n] = self.used + np.cumsum(counts) - counts
        first, self.n, self.used = self.n, n, used
        return first

    def joined(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs one after the other, and where each run begins (n + 1)."""
        count = self.count[runs]
        upto = np.zeros(len(runs) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        return self.flat[np.repeat(self.start[runs] - upto[:-1], count) + np.arange(upto[-1])], upto

    def kept(self, which: np.ndarray) -> None:
        ids, upto = self.joined(which)
        n = len(which)
        self.flat[: len(ids)], self.used, self.n = ids, len(ids), n
        self.start[:n], self.count[:n], self.hits[:] = upto[:-1], np.diff(upto), 0


class PieceTable:
    """Pieces of up to ``SHORT`` bytes (as two words, the length in the last byte) to their
    runs: open addressing, all lookups and insertions of a chunk side by side."""

    def __init__(self, bits: int = 19):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.a, self.b, self.run = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * tk.U(0x9E3779B97F4A7C15))) * tk.U(0xD6E8FEB86659FD93)
        h ^= h >> tk.U(32)
        h *= tk.U(0xD6E8FEB86659FD93)
        return (h >> tk.U(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The run of each piece; -1 of one that isn't held."""
        at = self._slot(a, b)
        out = self.run[at]
        todo = np.flatnonzero((out >= 0) & ((self.a[at] != a) | (self.b[at] != b)))
        while len(todo):
            s = (at[todo] + 1) & ((1 << self.bits) - 1)
            at[todo] = s
            r = self.run[s]
            out[todo] = r
            todo = todo[(r >= 0) & ((self.a[s] != a[todo]) | (self.b[s] != b[todo]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, runs: np.ndarray) -> None:
        """Distinct pieces that aren't held."""
        at = self._slot(a, b)
        todo = np.arange(len(a))
        while len(todo):
            s = at[todo]
            free = self.run[s] < 0
            _, first = np.unique(s[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            i, s = todo[mine], s[mine]
            self.a[s], self.b[s], self.run[s] = a[i], b[i], runs[i]
            todo = np.delete(todo, mine)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)


class WordIds:
    """Encode texts as uint32 ids. ``pieces`` and ``words`` bound what is remembered."""

    def __init__(self, path: str, pieces: int = 1 << 19, words: int = 50_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.limit, self.word_limit = path, pieces, words
        self.tok = Tokenizer.from_file(path)
        self.by_word = self._check(path)
        self.model = self.tok.model
        self.shown = np.arange(256, dtype="<u2")
        for byte, char in _byte_chars().items():
            self.shown[byte] = char
        self.runs, self.table = Runs(), PieceTable(max(4, (2 * pieces - 1).bit_length()))
        self.words: dict[tuple[bool, bytes], int] = {}

    @staticmethod
    def _check(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        norm = (j.get("normalizer") or {}).get("normalizers") or []
        pre = (j.get("pre_tokenizer") or {}).get("pretokenizers") or []
        return (
            [n.get("type") for n in norm] == ["NFC", "Replace", "Lowercase"]
            and (norm[1]["pattern"], norm[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and (pre[0].get("behavior"), pre[0].get("invert")) == ("Removed", True)
            and pre[0]["pattern"] == {"Regex": _PATTERN}
            and not pre[1].get("add_prefix_space")
            and not pre[1].get("use_regex", True)
            and j.get("post_processor") is None
            and not j["model"].get("ignore_merges")
            and all(a["content"].startswith("<|") and not re.search(r"\s", a["content"]) and not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in j["added_tokens"])
        )

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _pieces(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
        """New runs of pieces (bytes as their stand-ins go to the model); the first one's number."""
        shown, model = self.shown[low].tobytes().decode("utf-16-le"), self.model.tokenize
        ids, upto = [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            ids += [t.id for t in model(shown[s:e])]
            upto.append(len(ids))
        return self.runs.add(ids, np.diff(upto, prepend=0))

    def _make_room(self) -> None:
        """Before a chunk: of a full memory what was met most since it was last full stays, at
        most half of the room; words beyond the table all go."""
        r, t, least = self.runs, self.table, 1
        if r.n < self.limit and len(self.words) < self.word_limit and r.used < 8 * self.limit:
            return
        again = np.flatnonzero(r.hits[: r.n] > least)
        while len(again) > self.limit // 2 or r.count[again].sum() > 4 * self.limit:
            least *= 2
            again = again[r.hits[again] > least]
        at = np.flatnonzero(t.run >= 0)
        at = at[np.isin(t.run[at], again)]
        a, b, runs = t.a[at], t.b[at], np.searchsorted(again, t.run[at]).astype(np.int32)
        self.words = {}
        r.kept(again)
        t.clear()
        t.add(a, b, runs)

    def _other(self, data: bytes, low: np.ndarray, whole: bool, s: int, e: int) -> int:
        """A piece that the table can't hold."""
        key = (whole, data[s:e] if whole else low[s:e].tobytes())
        run = self.words.get(key)
        if run is None:
            if whole:
                ids = self._whole(key[1].decode())
                run = self.runs.add(ids, np.array([len(ids)]))
            else:
                run = self._pieces(low[s:e], np.zeros(1, int), np.full(1, e - s))
            if e - s <= 256 and len(self.words) < self.word_limit:
                self.words[key] = run
        return run

    def encode_chunk(self, ch: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk, and the offsets of each text's (n + 1)."""
        if not self.by_word:
            data, at = ch.buf.tobytes(), ch.offs.tolist()
            ids = [np.array(self._whole(data[s:e].decode()), np.uint32) for s, e in zip(at, at[1:])]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])
        self._make_room()
        at, end, whole, low = cut(ch)
        size = end - at
        plain = ~whole & (size <= SHORT)
        eight = np.ndarray((len(low) - 7,), "<u8", low, 0, (1,))  # eight bytes from every place
        runs = np.empty(len(at), np.int32)
        p, n = at[plain], size[plain]
        a = eight[p] & _MASK[np.minimum(n, 8)]
        b = eight[p + 8] & _MASK[np.maximum(n - 8, 0)] | n.astype(np.uint64) << tk.U(56)
        found = self.table.find(a, b)
        new = np.flatnonzero(found < 0)
        if len(new):
            both = np.stack([a[new], b[new]], 1).copy().view("V16").ravel()
            _, first, which = np.unique(both, return_index=True, return_inverse=True)
            one = new[first]
            made = self._pieces(low, p[one], p[one] + n[one]) + np.arange(len(one), dtype=np.int32)
            found[new] = made[which.ravel()]
            if self.runs.n <= len(self.table.run) * 3 // 4:
                self.table.add(a[one], b[one], made)
        runs[plain] = found
        rest = np.flatnonzero(~plain)
        if len(rest):
            data = ch.buf.tobytes()
            runs[rest] = [self._other(data, low, w, s, e) for w, s, e in zip(whole[rest].tolist(), at[rest].tolist(), end[rest].tolist())]
        self.runs.hits[: self.runs.n] += np.bincount(runs, minlength=self.runs.n)
        ids, upto = self.runs.joined(runs)
        return ids, upto[np.searchsorted(at, ch.offs)]

    def encode(self, text: bytes) -> bytes:
        """The ids of one UTF-8 text as little-endian uint32."""
        return self.encode_chunk(tk.Chunk(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)])))[0].astype("<u4").tobytes()
