"""Incremental decoding of token streams.

``DecodeState`` is the pure step: ids that don't yet end in whole characters are held
back, and a step gives the text that its ids complete. ``decode_stream`` runs it with
one state per stream key in Structured Streaming. State stays small: once text is out, only
the ids since the last emitted text are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.spec import TokenizerError
from ..tokenizer import Tokenizer

BROKEN = "\ufffd"


@dataclass
class DecodeState:
    """``ids`` may start as those of a prompt: its text isn't emitted again."""

    ids: list[int] = field(default_factory=list)
    prefix: str = ""
    prefix_index: int = 0

    def step(self, new: int | list[int], decode: Callable[[list[int]], str]) -> str | None:
        if not self.prefix and self.ids:
            text = decode(self.ids)
            if not text.endswith(BROKEN):
                self.prefix, self.prefix_index = text, len(self.ids)
        self.ids = self.ids + ([new] if isinstance(new, int) else list(new))
        text = decode(self.ids)
        if len(text.encode()) <= len(self.prefix.encode()) or text.endswith(BROKEN):
            return None
        if not text.startswith(self.prefix):
            raise TokenizerError("Invalid prefix encountered: the decoded text no longer starts with what was emitted")
        out, kept = text[len(self.prefix) :], len(self.ids) - self.prefix_index
        self.ids = self.ids[self.prefix_index :]
        self.prefix, self.prefix_index = decode(self.ids), kept
        return out


class DecodeStream:
    """One stream: ``step(tokenizer, id or ids)`` gives completed text or None."""

    def __init__(self, ids: list[int] | None = None, skip_special_tokens: bool = False):
        self.state, self.skip = DecodeState(list(ids or [])), skip_special_tokens

    def step(self, tokenizer: Tokenizer, new: int | list[int]) -> str | None:
        return self.state.step(new, lambda ids: tokenizer.engine.decode(ids, self.skip))


_STATE = "ids array<int>, prefix string, prefix_index int"


def decode_stream(df: DataFrame, tokenizer: Tokenizer, key: str = "stream_id", seq: str = "seq", token: str = "token_id", skip_special_tokens: bool = False, prompt: str | None = None) -> DataFrame:
    """(key, seq, chunk) for every step of a streaming ``df`` that completes text. Steps of a
    micro-batch are taken in the order of ``seq``; a stream's rows must not arrive out of
    order across micro-batches. Null tokens complete nothing. ``prompt`` names a column of id
    arrays: those of a stream's first row (null: none) come before its tokens, and their text
    isn't emitted."""
    shipped = tokenizer.shipped
    kind = df.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e = shipped.engine()
        s = DecodeState()
        if state.exists:
            ids, prefix, index = state.get
            s = DecodeState([int(i) for i in ids], prefix, int(index))
        rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
        if prompt is not None and not state.exists and len(rows) and rows[prompt].iloc[0] is not None:
            s = DecodeState([int(i) for i in rows[prompt].iloc[0]])
        out = []
        for at, t in zip(rows[seq], rows[token]):
            if pd.isna(t):
                continue
            chunk = s.step(int(t), lambda ids: e.decode(ids, skip_special_tokens))
            if chunk is not None:
                out.append((k[0], at, chunk))
        state.update((s.ids, s.prefix, s.prefix_index))
        yield pd.DataFrame(out, columns=[key, seq, "chunk"])

    return df.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{seq}` long, chunk string", _STATE, "append", GroupStateTimeout.NoTimeout)
