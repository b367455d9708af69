"""The byte-to-character table of byte-level BPE, as Python tables and as Column expressions.

188 bytes stand for themselves; the other 68 become the characters from U+0100 on, in
byte order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
MOVED = [b for b in range(256) if b not in _PLAIN]
BYTE_TO_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(MOVED)}
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()}
TABLE = {b: ord(c) for b, c in BYTE_TO_CHAR.items()}
_SRC = "".join(chr(b) for b in MOVED)
_DST = "".join(BYTE_TO_CHAR[b] for b in MOVED)
LAST = max(map(ord, CHAR_TO_BYTE))


def encode_text(text: str) -> str:
    """Characters of the table for the UTF-8 bytes of a text."""
    return text.encode().decode("latin-1").translate(TABLE)


def decode_bytes(text: str) -> bytes:
    """Bytes of a string of table characters. A character beyond the table's last stands for
    its own UTF-8 bytes; one below it that isn't in the table becomes a zero byte."""
    out = bytearray()
    for c in text:
        b = CHAR_TO_BYTE.get(c)
        if b is not None:
            out.append(b)
        elif ord(c) > LAST:
            out += c.encode()
        else:
            out.append(0)
    return bytes(out)


_BACK = {ord(c): b for c, b in CHAR_TO_BYTE.items()}


def raw_text(shown: str) -> str:
    """The text of a string that ``encode_text`` made."""
    return shown.translate(_BACK).encode("latin-1").decode()


def decode_text(text: str) -> str:
    return decode_bytes(text).decode("utf-8", "replace")


def encode_column(c: Column) -> Column:
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), _SRC, _DST)


_ZERO = "".join(chr(i) for i in range(LAST + 1) if chr(i) not in CHAR_TO_BYTE)
_NUL = "\u0144"  # the first character beyond the table stands for a zero byte on the way


def decode_column(c: Column) -> Column:
    """JVM-side inverse for strings without characters beyond the table."""
    latin = F.translate(F.translate(c, _ZERO, _NUL * len(_ZERO)), _DST + _NUL, _SRC + "\0")
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
