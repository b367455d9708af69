"""Pre-tokenizers: ``Split``, ``ByteLevel`` and sequences of them.

Every one works on a Python string (``pieces``) and as a Column expression (``column``).
The Column form needs no fold: of a text the matches and the gaps around them are two
arrays (``regexp_extract_all`` and ``split``), and each behaviour is an element-wise
combination of the two.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bytes_map import encode_column, encode_text
from ..sources.spec import TokenizerError, UnsupportedComponent
from .parts import in_parts

BEHAVIOURS = ("Removed", "Isolated", "MergedWithPrevious", "MergedWithNext", "Contiguous")
_L, _N = r"\p{L}", r"\p{N}"
_TAIL = (r"\s+(?!\S)", r"\s+")
#: Contractions, letters, numbers, others (each with a space before it), white space.
_ENDINGS = ("[sdmt]", "ll|ve|re")
CLASSIC = "|".join((*(f"'(?i:{e})" for e in _ENDINGS), f" ?{_L}+", f" ?{_N}+", rf" ?[^\s{_L}{_N}]+", *_TAIL))
_SCRIPTS = ("Han", "Latin", "Greek", "Cyrillic", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Thai", "Devanagari")


def java_pattern(p: str) -> str:
    """The same pattern for the JVM: Unicode classes, and its names of scripts."""
    for s in _SCRIPTS:
        p = p.replace(r"\p{%s}" % s, r"\p{Is%s}" % s)
    return f"(?U)(?:{p})"


def _compiled(p: str):
    try:
        return regex.compile(p, regex.V1 if "&&" in p else regex.V0)
    except regex.error as e:
        raise TokenizerError(f"bad pattern: {e}") from e


def _by_python(step, c: Column) -> Column:
    """Pieces by the step's own matcher, for patterns that the JVM would cut otherwise."""

    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else step.pieces(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return in_parts(T.ArrayType(T.StringType()), pieces)(c)


class Split:
    def __init__(self, pattern: str, behaviour: str = "Isolated", invert: bool = False):
        if behaviour not in BEHAVIOURS:
            raise TokenizerError(f"unknown split behavior: {behaviour}")
        self.pattern, self.behaviour, self.invert = pattern, behaviour, bool(invert)
        self._find = _compiled(pattern)
        #: A pattern that may match nothing cuts gaps in the JVM; such texts go to Python.
        self.native = self._find.match("") is None and "(?<" not in pattern and "\\b" not in pattern

    @classmethod
    def from_config(cls, c: dict) -> Split:
        p = c.get("pattern")
        if not isinstance(p, dict) or len(p) != 1 or next(iter(p)) not in ("String", "Regex"):
            raise TokenizerError(f"split pattern must be a String or a Regex: {p}")
        key, value = next(iter(p.items()))
        return cls(regex.escape(value, special_only=True) if key == "String" else value, c.get("behavior", "Isolated"), c.get("invert", False))

    def _zip(self, text: str):
        gaps, found, at = [], [], 0
        for m in self._find.finditer(text):
            if m.end() > m.start():
                gaps.append(text[at : m.start()])
                found.append(m[0])
                at = m.end()
        return [*gaps, text[at:]], found

    def pieces(self, text: str) -> list[str]:
        gaps, found = self._zip(text)
        how = self._how()
        if how == "gaps":
            out = gaps
        elif how == "found":
            out = found
        elif how == "before":
            out = [g + m for g, m in zip(gaps, [*found, ""])]
        elif how == "after":
            out = [m + g for g, m in zip(gaps, ["", *found])]
        else:
            out = [x for pair in zip(gaps, [*found, ""]) for x in pair]
            if how == "runs":
                out = self._merged(gaps, found)
        return [p for p in out if p]

    @staticmethod
    def _merged(gaps: list[str], found: list[str]) -> list[str]:
        out, run = [], ""
        for g, m in zip(gaps, [*found, ""]):
            if g:
                out += [run, g]
                run = ""
            run += m
        return [*out, run]

    def _how(self) -> str:
        b, inv = self.behaviour, self.invert
        if b == "Removed":
            return "found" if inv else "gaps"
        if b == "MergedWithPrevious":
            return "after" if inv else "before"
        if b == "MergedWithNext":
            return "before" if inv else "after"
        return "runs" if b == "Contiguous" else "both"

    def column(self, c: Column) -> Column:
        if not self.native:
            return _by_python(self, c)
        how = self._how()
        p = java_pattern(self.pattern if how != "runs" else f"(?:{self.pattern})+")
        gaps, found = F.split(c, p, -1), F.regexp_extract_all(c, F.lit(p), F.lit(0))
        if how == "gaps":
            out = gaps
        elif how == "found":
            out = found
        else:
            empty = F.array(F.lit(""))
            found = F.concat(empty, found) if how == "after" else F.concat(found, empty)
            if how in ("before", "after"):
                out = F.zip_with(gaps, found, lambda g, m: F.concat(g, m) if how == "before" else F.concat(m, g))
            else:
                out = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(g, m)))
        return F.filter(out, lambda x: x != "")


class ByteLevel:
    def __init__(self, add_prefix_space: bool = True, trim_offsets: bool = True, use_regex: bool = True):
        self.add_prefix_space, self.trim_offsets, self.use_regex = add_prefix_space, trim_offsets, use_regex
        self._find = regex.compile(CLASSIC) if use_regex else None
        self.native = True

    @property
    def bulk(self) -> bool:
        return not (self.add_prefix_space or self.use_regex)

    def raw(self, text: str) -> list[str]:
        """Pieces before their bytes are mapped."""
        if not text:
            return []
        if self.add_prefix_space and text[0] != " ":
            text = " " + text
        return self._find.findall(text) if self.use_regex else [text]

    def pieces(self, text: str) -> list[str]:
        return [encode_text(p) for p in self.raw(text)]

    def raw_column(self, c: Column) -> Column:
        if self.add_prefix_space:
            c = F.when((c != "") & ~c.startswith(" "), F.concat(F.lit(" "), c)).otherwise(c)
        if self.use_regex:
            return F.regexp_extract_all(c, F.lit(java_pattern(CLASSIC)), F.lit(0))
        return F.filter(F.array(c), lambda x: x != "")

    def column(self, c: Column) -> Column:
        return F.transform(self.raw_column(c), encode_column)


class Sequence:
    def __init__(self, steps: list):
        self.steps = steps
        self.native = all(s.native for s in steps)

    def pieces(self, text: str) -> list[str]:
        out = [text] if text else []
        for s in self.steps:
            out = [p for x in out for p in s.pieces(x)]
        return out

    def column(self, c: Column) -> Column:
        if not self.native:
            return _by_python(self, c)
        out = F.filter(F.array(c), lambda x: x != "")
        for s in self.steps:
            out = F.flatten(F.transform(out, s.column))
        return out


def build(config: dict | None):
    if not config:
        return None
    kind = config.get("type")
    if kind == "Split":
        return Split.from_config(config)
    if kind == "ByteLevel":
        return ByteLevel(*(bool(config.get(k, True)) for k in ("add_prefix_space", "trim_offsets", "use_regex")))
    if kind == "Sequence":
        return Sequence([build(c) for c in config.get("pretokenizers") or []])
    raise UnsupportedComponent("pre-tokenizer", kind)
