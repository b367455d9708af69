"""Pieces of DuckDB SQL for the toy tokenizers: pre-tokenization by RE2, byte pairs by
replacing pairs of bracketed hex bytes in the order of their ranks."""

from __future__ import annotations

from ..functions.bytes_map import BYTE_TO_CHAR
from . import toy

WS = r"\s\x{0b}\x{85}\x{a0}\p{Z}"
CUT = "\ue000"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def classic_pieces(text: str) -> str:
    """List of pieces of the classic pattern. RE2 has no look-ahead, so white space before
    its last character and a word is cut off by a mark first."""
    marked = f"regexp_replace({text}, '([{WS}]+)([{WS}][^{WS}])', '\\1{CUT}\\2', 'g')"
    p = rf"'(?i:[sdmt])|'(?i:ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}{CUT}]+|[{WS}]+|{CUT}"
    return f"list_filter(regexp_extract_all({marked}, {quoted(p)}), lambda x: x <> '{CUT}')"


_OTHER = r"\p{L}\p{N}"
SIMPLE = "|".join((r" ?\p{L}+", r" ?\p{N}+", f" ?[^\\s{_OTHER}]+", r"\s+"))


def simple_pieces(text: str) -> str:
    p = rf" ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+"
    return f"regexp_extract_all({text}, {quoted(p)})"


def _hex(s: str) -> str:
    return s.encode().hex().upper()


def piece_tokens(piece: str, whole: list[str]) -> str:
    """List of hex tokens of a piece; ``whole`` pieces are tokens of their own."""
    out = f"regexp_replace(hex(encode({piece})), '(..)', '<\\1>', 'g')"
    for a, b in toy.MERGES:
        out = f"replace({out}, '<{_hex(a)}><{_hex(b)}>', '<{_hex(a + b)}>')"
    for w in whole:
        out = f"CASE WHEN {piece} = {quoted(w)} THEN '<{_hex(w)}>' ELSE {out} END"
    return f"regexp_extract_all({out}, '[0-9A-F]+')"


def vocab_values() -> str:
    tokens = [f"{b:02X}" for b in range(256)] + [_hex(a + b) for a, b in toy.MERGES] + [_hex(w) for w in toy.WHOLE]
    return ", ".join(f"('{t}', {i})" for i, t in enumerate(tokens))


def ids_cte(source: str, key: str, text: str = "text", fused: bool = False) -> str:
    """CTEs ending in ``enc`` (key, ids list) and ``counted`` (piece, n_tokens, ...)."""
    pieces = simple_pieces(f"coalesce({text}, '')") if fused else classic_pieces(f"coalesce({text}, '')")
    whole = toy.WHOLE if fused else toy.WHOLE[:1]
    return f"""
voc(token, id) AS (VALUES {vocab_values()}),
cut AS (SELECT {key}, {pieces} AS ps FROM {source}),
pc AS (SELECT {key}, unnest(range(len(ps))) AS i, unnest(ps) AS piece FROM cut),
dp AS (SELECT piece, unnest(range(len(ts))) AS j, unnest(ts) AS token FROM (SELECT piece, {piece_tokens('piece', whole)} AS ts FROM (SELECT DISTINCT piece FROM pc))),
pid AS (SELECT piece, list(id ORDER BY j) AS ids FROM dp JOIN voc USING (token) GROUP BY piece),
agg AS (SELECT {key}, flatten(list(ids ORDER BY i)) AS ids FROM pc JOIN pid USING (piece) GROUP BY {key}),
enc AS (SELECT s.{key}, coalesce(ids, []) AS ids FROM {source} s LEFT JOIN agg USING ({key}))"""


def byte_char_list() -> str:
    return "[" + ", ".join(quoted(BYTE_TO_CHAR[b]) for b in range(256)) + "]"


def split_lists(text: str, pattern: str) -> str:
    return f"regexp_split_to_array({text}, {quoted(pattern)}) AS g, regexp_extract_all({text}, {quoted(pattern)}) AS m"
