"""Vectorised text kernels over Arrow string buffers.

A whole Arrow batch is looked at as one ``uint8`` array plus document offsets, so
words, lines and their 64-bit hashes cost a few numpy passes a byte and no Python
object a word. Batches are walked in chunks of about ``CHUNK`` bytes (one document at
least), which bounds the temporaries whatever the batch holds.

Hashes are polynomials mod 2**64 over random byte values, finished with a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

SEP = np.zeros(256, bool)
SEP[[9, 10, 11, 12, 13, 32]] = True
CONT = (np.arange(256) & 0xC0) == 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, on an array of uint64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


VAL = mix(np.arange(1, 257, dtype=np.uint64) * U(_P))
VAL_LOWER = VAL[LOWER]

_pw = np.ones(1, np.uint64)
_ipw = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ipw
    if len(_pw) < n:
        m = max(n, CHUNK * 2)
        a, b = np.full(m, U(_P)), np.full(m, U(_PINV))
        a[0] = b[0] = 1
        _pw, _ipw = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pw, _ipw


class Chunk:
    """Documents ``lo`` to ``hi`` of a batch: ``buf`` (uint8) and ``offs`` (from 0)."""

    __slots__ = ("lo", "hi", "buf", "offs")

    def __init__(self, lo: int, hi: int, buf: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.buf, self.offs = lo, hi, buf, offs

    @property
    def n(self) -> int:
        return self.hi - self.lo


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(col: pa.Array, target: int = CHUNK) -> Iterator[Chunk]:
    buf, offs = string_buffers(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, "right")) - 1)
        yield Chunk(lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VAL) -> np.ndarray:
    """64-bit hash of each buf[start:end]; ``values`` maps bytes (``VAL_LOWER`` folds A-Z)."""
    pw, ipw = _powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    v = values[buf]
    v *= pw[: len(buf)]
    np.cumsum(v, out=c[1:])
    h = (c[ends] - c[starts]) * ipw[starts]
    h += (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(h)


def words(ch: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each document the
    index of its first word (n + 1 values)."""
    if len(ch.buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(ch.n + 1, np.int64)
    word = ~SEP[ch.buf]
    first = np.empty(len(word), bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    inner = ch.offs[:-1]
    inner = inner[inner < len(word)]
    first[inner] = True
    last = np.empty(len(word), bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    last[inner[inner > 0] - 1] = True
    first &= word
    last &= word
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ch.offs)


def lines(ch: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and for each document the index of its
    first line (n + 1 values); an empty text has one empty line."""
    nl = np.flatnonzero(ch.buf == 10)
    before = np.searchsorted(nl, ch.offs)  # newlines before each document
    first = before + np.arange(ch.n + 1)
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    of = np.searchsorted(ch.offs, nl, "right") - 1  # document of each newline
    at = np.arange(len(nl)) + of  # line that each newline ends
    ends[at] = nl
    starts[at + 1] = nl + 1
    starts[first[:-1]] = ch.offs[:-1]
    ends[first[1:] - 1] = ch.offs[1:]
    return starts, ends, first


def shingles(h: np.ndarray, first: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` words of each document, and the index of each
    document's first window; documents with fewer words have none."""
    k = np.diff(first)
    n = np.maximum(k - width + 1, 0)
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], n)
    g = h[at] * U(0xA0761D6478BD642F)
    for i in range(1, width):
        g = (g ^ (g >> U(29))) * U(0xE7037ED1A0B428DB) + h[at + i]
    return mix(g), out


def counts_below(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many true values of ``mask`` lie in each [at[i], at[i+1])."""
    pos = np.flatnonzero(mask)
    return np.diff(np.searchsorted(pos, at))
