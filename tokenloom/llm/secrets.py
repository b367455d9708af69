"""Secret scans: fixed patterns, and a battery of randomness tests for strings without one.

Strings of 20 or more characters of the usual alphabets get an inferred encoding (hex,
letters of one or both cases, base32, base36, base64 / base64url; a string that fits none
as a whole is cut at ``/ + _ -``). Their code values are tested for uniformity over the
alphabet (chi-squared), for runs of character classes, for serial correlation, and for the
letter transitions that the corpus' own words have and random letters don't. Fisher's
method combines the four p-values of "drawn at random" into one score.

A secret is a discovery, so the null hypothesis is ordinary text: the first scan also
counts letter pairs over all texts, and from them strings like identifiers and paths
(words joined, digits and separators between them; numbers for hex) are simulated, for
each encoding and length class that occurs, at the class' smallest length. The share of
them that score at least as random is a string's p-value, exact up to the simulation.
Within each encoding and length class the Benjamini-Hochberg rule at level ``q`` (over a
table of fixed size: encoding, length class, score bin) decides which strings are held to be
random: ``q`` bounds the expected share of ordinary strings among those found. What is found
is a ``random`` span unless it overlaps a pattern's span or stands in a URL.

Cases: null text is empty and has no spans; repeated rows and equal strings count as
often as they occur (a string of copies is evidence as often as it is copied, which
moves only the bar of its class); an empty table gives an empty result. Texts are scanned
whole, of any length. Further columns, whatever their names, are kept as they are by
``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .common import written
from .places import FILE, ROW, Answers, placed, standing, store
from .tokencache import forget

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST = 20
_STRING = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_PART = re.compile(r"[A-Za-z0-9]{20,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("assign", "access", "hex", "random")
IN_HEX, IN_STRING = np.zeros(256, bool), np.zeros(256, bool)
IN_HEX[list(b"0123456789abcdef")] = True
IN_STRING[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True

BINS = 128  # of a quarter of a bit of the odds each
CLASSES = 16
_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
ENCODINGS = {
    "hex": (_DIGITS + "abcdef", re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+")),
    "hex_upper": (_DIGITS + "ABCDEF", re.compile(r"(?=.*[0-9])(?=.*[A-F])[0-9A-F]+")),
    "lower": (_LOWER, re.compile(r"[a-z]+")),
    "upper": (_UPPER, re.compile(r"[A-Z]+")),
    "letters": (_UPPER + _LOWER, re.compile(r"[A-Za-z]+")),
    "base32": (_UPPER + "234567", re.compile(r"(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+")),
    "base36": (_DIGITS + _LOWER, re.compile(r"(?=.*[0-9])(?=.*[a-z])[a-z0-9]+")),
    "base36_upper": (_DIGITS + _UPPER, re.compile(r"(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+")),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", re.compile(r"(?=.*[0-9+/])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+")),
    "base64url": (_UPPER + _LOWER + _DIGITS + "-_", re.compile(r"(?=.*[0-9_-])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+")),
}
NAMES = list(ENCODINGS)


class Alphabet:
    """Code values, character classes and letters of an encoding."""

    def __init__(self, chars: str):
        self.chars, self.size = chars, len(chars)
        self.code = np.zeros(128, np.int64)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        self.one_case = chars in (_LOWER, _UPPER)  # classes are vowels and consonants then
        kind = (lambda c: int(c in "aeiouyAEIOUY")) if self.one_case else (lambda c: 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3)
        self.kind = np.array([kind(c) for c in chars])
        self.letter = np.array([ord(c.lower()) - 97 if c.isalpha() else 26 for c in chars])
        share = np.bincount(self.kind) / len(chars)
        self.change = 1 - float((share**2).sum())

    def codes(self, s: str) -> np.ndarray:
        return self.code[np.frombuffer(s.encode(), np.uint8)][None]


ALPHABETS = {k: Alphabet(a) for k, (a, _) in ENCODINGS.items()}


def infer(s: str) -> str | None:
    """The narrowest encoding that a string fits, or None (numbers, paths)."""
    return next((k for k, (_, r) in ENCODINGS.items() if r.fullmatch(s)), None)


def length_class(n: int) -> int:
    return min(CLASSES - 1, int(4 * math.log2(n / LEAST) + 1e-9))


def class_length(c: int) -> int:
    """The smallest length of a class."""
    return next(n for n in range(LEAST, 1 << 20) if length_class(n) >= c)


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2)).astype(float)


def _above(z: np.ndarray) -> np.ndarray:
    return _erfc(z / math.sqrt(2)).astype(float) / 2


class Ordinary:
    """What ordinary text is like, from counts of letter pairs (27 x 27; 26 is no letter)."""

    def __init__(self, pairs: np.ndarray):
        p = (pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True)
        self.upto = np.cumsum(p, 1)
        inner = p[:26, :26] / p[:26, :26].sum(1, keepdims=True)
        self.weight = np.zeros((27, 27))
        self.weight[:26, :26] = np.log2(26 * inner)
        self.mean, self.sd = float(self.weight[:26, :26].mean()), max(float(self.weight[:26, :26].std()), 1e-9)
        self._tails: dict[tuple[str, int], np.ndarray] = {}

    def battery(self, v: np.ndarray, a: Alphabet) -> list[np.ndarray]:
        """p-values of "drawn at random" of strings of one length (rows of code values):
        uniformity, runs of classes, serial correlation, transitions between letters."""
        m, n = v.shape
        counts = np.bincount((v + np.arange(m)[:, None] * a.size).ravel(), minlength=m * a.size).reshape(m, a.size)
        k = a.size - 1
        x = (counts**2).sum(1) * a.size / n - n
        uniform = _above(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))  # Wilson and Hilferty's cube root
        kind = a.kind[v]
        changes = (kind[:, 1:] != kind[:, :-1]).sum(1)
        z = (changes - (n - 1) * a.change) / math.sqrt((n - 1) * a.change * (1 - a.change))
        runs = _above(z if a.one_case else -z)  # words alternate vowels more than chance does, and classes less
        y = v - v.mean(1, keepdims=True)
        var = (y**2).sum(1)
        r = np.where(var > 0, (y[:, 1:] * y[:, :-1]).sum(1) / np.maximum(var, 1e-9), 1.0)
        serial = _two_sided((r + 1 / n) * math.sqrt(n))
        letter = a.letter[v]
        both = ((letter[:, 1:] < 26) & (letter[:, :-1] < 26)).sum(1)
        z = (self.weight[letter[:, :-1], letter[:, 1:]].sum(1) - both * self.mean) / (self.sd * np.sqrt(np.maximum(both, 1)))
        steps = np.where((both >= 5) & (a.size > 16), _above(z), 1.0)
        return [uniform, runs, serial, steps]

    def bins(self, v: np.ndarray, a: Alphabet) -> np.ndarray:
        """Score bins: the higher, the more like random. Fisher's combination; an even
        number of degrees of freedom has a closed tail."""
        s = -sum(np.log(np.maximum(p, 1e-300)) for p in self.battery(v, a))
        p = np.exp(-s) * (1 + s + s**2 / 2 + s**3 / 6)
        odds = np.log2(np.maximum(p, 1e-300)) - np.log2(np.maximum(1 - p, 1e-16))
        return np.clip(np.floor(4 * odds) + 80, 0, BINS - 1).astype(np.int64)

    def simulated(self, name: str, n: int, m: int) -> np.ndarray:
        """``m`` ordinary strings of an encoding and length, the same in every run."""
        rng, a = np.random.default_rng([NAMES.index(name), n]), ALPHABETS[name]
        if name.startswith("hex"):
            return self._numbers(rng, n, m)
        of = lambda chars: np.array([a.code[ord(c)] if c in a.chars else -1 for c in chars])
        low, up, digits = of(_LOWER), of(_UPPER), of(_DIGITS)
        digits, signs = digits[digits >= 0], np.array([i for i, c in enumerate(a.chars) if not c.isalnum()])
        mixed = low[0] >= 0 and up[0] >= 0
        out = np.empty((m, n), np.int64)
        state, new, number = np.full(m, 26), np.ones(m, bool), np.zeros(m, np.int64)
        for i in range(n):
            step = (self.upto[state] < rng.random(m)[:, None]).sum(1)
            end = step >= 26
            if len(digits):
                number = np.where((number == 0) & end & (rng.random(m) < 0.3), rng.integers(1, 5, m), number)
            sign = end & (number == 0) & (rng.random(m) < (0.3 if len(signs) else 0))
            first = (self.upto[26] < rng.random(m)[:, None] * self.upto[26, 25]).sum(1)
            c = np.minimum(np.where(end, first, step), 25)
            one = np.where((end | new) & (rng.random(m) < 0.8), up[c], low[c]) if mixed else (low if low[0] >= 0 else up)[c]
            if len(digits):
                one = np.where(number > 0, digits[rng.integers(0, len(digits), m)], one)
            if len(signs):
                one = np.where(sign, signs[rng.integers(0, len(signs), m)], one)
            out[:, i] = one
            new = (number > 0) | sign
            state = np.where(new, 26, c)
            number = np.maximum(number - 1, 0)
        return out

    @staticmethod
    def _numbers(rng: np.random.Generator, n: int, m: int) -> np.ndarray:
        """Numbers, counters and short words in hexadecimal digits."""
        out = np.empty((m, n), np.int64)
        digit, letter = rng.integers(0, 10, m), np.zeros(m, bool)
        often = np.array([10, 14, 13, 12, 11, 15])
        for i in range(n):
            letter = np.where(rng.random(m) < 0.2, rng.random(m) < 0.25, letter)
            u = rng.random(m)
            digit = np.where(u < 0.3, digit, np.where(u < 0.5, (digit + 1) % 10, rng.integers(0, 10, m)))
            out[:, i] = np.where(letter, often[np.minimum((rng.random(m) ** 2 * 6).astype(int), 5)], digit)
        return out

    def tail(self, name: str, c: int) -> np.ndarray:
        """Of each score bin, the p-value of a string of length class ``c`` in it."""
        if (name, c) not in self._tails:
            m = 1 << (16 if c < 4 else 14)
            n = np.bincount(self.bins(self.simulated(name, class_length(c), m), ALPHABETS[name]), minlength=BINS)
            self._tails[name, c] = (1 + np.cumsum(n[::-1])[::-1]) / (m + 1)
        return self._tails[name, c]


def base_spans(text: str, has_hex: bool = True) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if has_hex:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


def _long_runs(inside: np.ndarray, offs: np.ndarray, least: int) -> np.ndarray:
    """Per document, whether ``least`` bytes in a row are inside (some of the next one's
    bytes may count; it only selects documents for the exact search)."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = z - a >= least
    out = np.zeros(len(offs) - 1, bool)
    for x in (a[long], z[long] - 1):
        out[np.searchsorted(offs, x, "right") - 1] = True
    # a run may reach over more than two documents
    lo, hi = np.searchsorted(offs, a[long], "right") - 1, np.searchsorted(offs, z[long] - 1, "right") - 1
    for x, y in zip(lo[hi - lo > 1], hi[hi - lo > 1]):
        out[x : y + 1] = True
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, string) of the strings that fit an encoding, outside patterns and URLs."""
    urls = [(m.start(), m.end()) for m in _WORD.finditer(text) if "://" in m[0]] if "://" in text else []
    taken = sorted([(a, z) for _, a, z in base] + urls)
    starts = [a for a, _ in taken]
    reach = list(itertools.accumulate((z for _, z in taken), max))
    out = []
    for m in _STRING.finditer(text):
        whole = infer(m[0].rstrip("="))
        for s, e in [m.span()] if whole else [p.span() for p in _PART.finditer(text, *m.span())]:
            k = bisect.bisect_left(starts, e)
            if (k == 0 or reach[k - 1] <= s) and infer(text[s:e].rstrip("=")):
                out.append((s, e, text[s:e].rstrip("=")))
    return out


def letter_pairs(ch: tk.Chunk) -> np.ndarray:
    """Counts of neighbours (27 x 27: a-z, and 26 for all else and for a text's edge)."""
    code = _LETTER[ch.buf]
    if not len(code):
        return np.zeros(729, np.int64)
    out = np.bincount(code[:-1].astype(np.int64) * 27 + code[1:], minlength=729)
    cut = np.unique(ch.offs[1:-1])
    cut = cut[(cut > 0) & (cut < len(code))]
    before, after = code[cut - 1].astype(np.int64), code[cut].astype(np.int64)
    out -= np.bincount(before * 27 + after, minlength=729)
    before, after = np.append(before, code[-1]), np.append(after, code[0])
    return out + np.bincount(before * 27 + 26, minlength=729) + np.bincount(26 * 27 + after, minlength=729)


_LETTER = np.full(256, 26, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(26)
_SCANNED = f"doc_id long, base string, s array<int>, e array<int>, x array<string>, {FILE} long, {ROW} long, pairs array<long>"
_NAMES = ["doc_id", "base", "s", "e", "x", FILE, ROW, "pairs"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (``pairs`` null), and a row of letter pairs at the end."""
    forget()
    pairs = np.zeros(729, np.int64)
    kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
    for b in batches:
        for ch in tk.chunks(b.column(1)):
            pairs += letter_pairs(ch)
            has_hex = _long_runs(IN_HEX[ch.buf], ch.offs, 24).tolist()
            has_string = _long_runs(IN_STRING[ch.buf], ch.offs, LEAST).tolist()
            data, at = ch.buf.tobytes(), ch.offs.tolist()
            base, cand = [], []
            for d in range(ch.n):
                text = data[at[d] : at[d + 1]].decode()
                spans = base_spans(text, has_hex[d])
                base.append(spans)
                cand.append(candidates(text, spans) if has_string[d] else [])
            cols = [b.column(0).slice(ch.lo, ch.n), pa.array([joined(x) for x in base])]
            cols += [pa.array([[c[i] for c in x] for x in cand], k) for i, k in enumerate(kinds)]
            cols += [b.column(i).slice(ch.lo, ch.n) for i in (2, 3)] + [pa.nulls(ch.n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, _NAMES)
    none = [pa.nulls(1, k) for k in (pa.int64(), pa.string(), *kinds, pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays([*none, pa.array([pairs.tolist()], pa.list_(pa.int64()))], _NAMES)


def families(x: list[str], model: Ordinary) -> list[tuple[int, int, int]]:
    """(encoding, length class, score bin) of candidate strings."""
    out = []
    for t in x:
        name = infer(t)
        a = ALPHABETS[name]
        out.append((NAMES.index(name), length_class(len(t)), int(model.bins(a.codes(t), a)[0])))
    return out


def bars(counts: np.ndarray, model: Ordinary, q: float) -> np.ndarray:
    """Per encoding and length class the first score bin that is held to be random:
    Benjamini-Hochberg, a string's p-value being that of its bin; ``BINS`` if none is."""
    out = np.full(counts.shape[:2], BINS)
    for k, c in zip(*np.nonzero(counts.sum(2))):
        at_least = np.cumsum(counts[k, c][::-1])[::-1]  # strings of this bin or above
        ok = np.flatnonzero((counts[k, c] > 0) & (model.tail(NAMES[k], int(c)) <= q * at_least / at_least[0]))
        if len(ok):
            out[k, c] = ok[0]
    return out


def _counted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [y for x in b.column(0).to_pylist() for y in families(x, model.value)]
            yield pa.RecordBatch.from_arrays([pa.array([y[i] for y in f], pa.int32()) for i in range(3)], ["k", "c", "p"])

    return run


class Judge:
    """The model of ordinary text and the bars of a corpus."""

    def __init__(self, model: Ordinary, bar: np.ndarray):
        self.model, self.bar = model, bar

    @classmethod
    def of(cls, scanned: DataFrame, q: float) -> Judge:
        spark = scanned.sparkSession
        pairs = np.zeros(729)
        # both tables are of a fixed size: 27 x 27, and encodings x length classes x bins
        for i, n in scanned.where("pairs is not null").select(F.posexplode("pairs").alias("i", "n")).groupBy("i").agg(F.sum("n")).collect():
            pairs[i] = n
        model = Ordinary(pairs.reshape(27, 27))
        some = scanned.where(F.size("x") > 0).select("x").mapInArrow(_counted(spark.sparkContext.broadcast(model)), "k int, c int, p int")
        counts = np.zeros((len(NAMES), CLASSES, BINS), np.int64)
        for k, c, p, n in some.groupBy("k", "c", "p").agg(F.count(F.lit(1))).collect():
            counts[k, c, p] = n
        return cls(model, bars(counts, model, q))

    def spans(self, base: str, s: list[int], e: list[int], x: list[str]) -> list[tuple[str, int, int]]:
        spans = [(k, int(a), int(z)) for k, a, z in (i.split(":") for i in base.split(",") if i)]
        if x:
            spans += [("random", a, z) for a, z, (k, c, p) in zip(s, e, families(x, self.model)) if p >= self.bar[k, c]]
        return sorted(spans, key=lambda i: (i[1], KINDS.index(i[0])))


def _finish(judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[list[int]] = [[], [], []]
            sha, spans = [], []
            for r in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                for i in range(3):
                    n[i].append(r[0].count(KINDS[i] + ":"))
                sha.append(hashlib.sha256(r[0].encode()).hexdigest())
                spans.append(joined(judge.value.spans(*r)) if r[1] else r[0])
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


Q = 0.01


def _judged(docs: DataFrame, q: float):
    """What the scan of a ``standing`` table found (a row per document), and the broadcast judge."""
    s = written(placed(docs, "doc_id", "text").mapInArrow(_scan, _SCANNED), "scanned")
    return s.where("pairs is null"), s.sparkSession.sparkContext.broadcast(Judge.of(s, q))


def scan(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every document."""
    s, judge = _judged(standing(docs), q)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return s.select("doc_id", "base", "s", "e", "x").mapInArrow(_finish(judge), schema)


def _found(judge):
    """Place, starts and ends of the spans of each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [judge.value.spans(*r) for r in zip(*(b.column(i).to_pylist() for i in range(4)))]
            cols = [pa.array([[x[i] for x in sp] for sp in spans], pa.list_(pa.int32())) for i in (1, 2)]
            out = pa.RecordBatch.from_arrays([b.column(4), b.column(5), *cols], [FILE, ROW, "s", "e"])
            yield out.filter(pa.array([len(sp) > 0 for sp in spans], pa.bool_()))

    return run


def _redact(folder: str, text_at: int, chars_at: int | None, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        answers = Answers(folder)
        for b in batches:
            cols, names = b.columns[:-2], b.schema.names[:-2]
            files, rows = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            new: dict[int, str] = {}
            for lo, hi, t in answers.blocks(files, rows):
                if t is not None:
                    have = t.column(ROW).to_numpy()
                    for i in np.flatnonzero(np.isin(have, rows[lo:hi])).tolist():
                        at = lo + int(np.searchsorted(rows[lo:hi], have[i]))
                        text, done, parts = b.column(text_at)[at].as_py(), 0, []
                        for s, e in zip(t.column("s")[i].as_py(), t.column("e")[i].as_py()):
                            if s >= done:
                                parts += [text[done:s], mark]
                            done = max(done, e)
                        new[at] = "".join([*parts, text[done:]])
            if new:
                at = pa.array(sorted(new))
                mask = np.zeros(b.num_rows, bool)
                mask[sorted(new)] = True
                cols[text_at] = pc.replace_with_mask(cols[text_at], pa.array(mask), pa.array([new[i] for i in sorted(new)], cols[text_at].type))
                if chars_at is not None:
                    known = cols[chars_at]
                    cols[chars_at] = pc.replace_with_mask(known, pa.array(mask), pa.array([len(new[i]) for i in at.to_pylist()], known.type))
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def redact(docs: DataFrame, q: float = Q, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (and ``n_chars`` made to fit). Spans
    are found once and come back to the texts by place."""
    docs = standing(docs)
    s, judge = _judged(docs.select(F.lit(None).cast("long").alias("doc_id"), "text") if "doc_id" not in docs.columns else docs, q)
    found = s.select("base", "s", "e", "x", FILE, ROW).mapInArrow(_found(judge), f"{FILE} long, {ROW} long, s array<int>, e array<int>")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name can clash
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names.values(), docs.schema)])
    rows = placed(docs, *names).toDF(*names.values(), FILE, ROW)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return rows.mapInArrow(_redact(store(found), docs.columns.index("text"), chars, mark), schema).toDF(*names)
