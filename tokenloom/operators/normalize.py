"""Normalizers: NFC and sequences of it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T

from ..sources.spec import UnsupportedComponent
from .parts import in_parts


def nfc_text(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def build(config: dict | None) -> list[Callable[[str], str]]:
    """Functions to apply in order."""
    if not config:
        return []
    kind = config.get("type")
    if kind == "NFC":
        return [nfc_text]
    if kind == "Sequence":
        return [f for c in config.get("normalizers") or [] for f in build(c)]
    raise UnsupportedComponent("normalizer", kind)


def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else nfc_text(t) for t in texts.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """NFC of a string column; ASCII and normal texts pass through."""
    return in_parts(T.StringType(), _nfc)(c)
