"""``tokenizer.json`` to plain data classes, on the driver.

Unknown stage types are parsed like any other JSON and refused when the stage is built,
with ``UnsupportedComponent``. Nothing here needs Spark.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any


class TokenizerError(ValueError):
    """The configuration or the input can't be used."""


class UnsupportedComponent(TokenizerError):
    """A stage of a type that the engine doesn't run."""

    def __init__(self, stage: str, kind: Any):
        super().__init__(f"unsupported {stage} type: {kind}")
        self.stage, self.kind = stage, kind


@dataclass(frozen=True)
class AddedToken:
    """Matched in raw text before anything else. The three flags about surrounding white
    space and words are kept for writing back; matching doesn't look at them."""

    id: int
    content: str
    special: bool = False
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = False


@dataclass(frozen=True)
class Truncation:
    max_length: int
    direction: str = "right"
    stride: int = 0
    strategy: str = "longest_first"

    def __post_init__(self):
        if self.direction not in ("right", "left"):
            raise TokenizerError(f"unknown direction: {self.direction}")


@dataclass(frozen=True)
class Padding:
    """``length`` None: pad to the longest of the batch."""

    length: int | None = None
    direction: str = "right"
    pad_id: int = 0
    pad_type_id: int = 0
    pad_token: str = "[PAD]"
    pad_to_multiple_of: int | None = None

    def __post_init__(self):
        if self.direction not in ("right", "left"):
            raise TokenizerError(f"unknown direction: {self.direction}")


@dataclass
class TokenizerSpec:
    """The five stages as parsed, added tokens, and call-time truncation and padding."""

    model: dict[str, Any]
    normalizer: dict[str, Any] | None = None
    pre_tokenizer: dict[str, Any] | None = None
    post_processor: dict[str, Any] | None = None
    decoder: dict[str, Any] | None = None
    added_tokens: list[AddedToken] = field(default_factory=list)
    truncation: Truncation | None = None
    padding: Padding | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        tokens = [{"id": t.id, "content": t.content, "single_word": t.single_word, "lstrip": t.lstrip, "rstrip": t.rstrip, "normalized": t.normalized, "special": t.special} for t in self.added_tokens]
        trunc = self.truncation and {"direction": self.truncation.direction.capitalize(), "max_length": self.truncation.max_length, "strategy": _STRATEGY_OUT.get(self.truncation.strategy, self.truncation.strategy), "stride": self.truncation.stride}
        pad = self.padding and {
            "strategy": "BatchLongest" if self.padding.length is None else {"Fixed": self.padding.length},
            "direction": self.padding.direction.capitalize(), "pad_to_multiple_of": self.padding.pad_to_multiple_of,
            "pad_id": self.padding.pad_id, "pad_type_id": self.padding.pad_type_id, "pad_token": self.padding.pad_token,
        }
        return {
            **self.extra, "truncation": trunc, "padding": pad, "added_tokens": tokens, "normalizer": self.normalizer,
            "pre_tokenizer": self.pre_tokenizer, "post_processor": self.post_processor, "decoder": self.decoder, "model": self.model,
        }

    def to_json(self, pretty: bool = False) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, indent=2 if pretty else None)

    def save(self, path: str, *, pretty=True) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json(pretty))


_STRATEGY_OUT = {"longest_first": "LongestFirst", "only_first": "OnlyFirst", "only_second": "OnlySecond"}
_STRATEGY_IN = {v: k for k, v in _STRATEGY_OUT.items()}


def _truncation(d: dict | None) -> Truncation | None:
    if not d:
        return None
    return Truncation(int(d["max_length"]), str(d.get("direction", "Right")).lower(), int(d.get("stride", 0)), _STRATEGY_IN.get(d.get("strategy"), d.get("strategy") or "longest_first"))


def _padding(d: dict | None) -> Padding | None:
    if not d:
        return None
    s = d.get("strategy")
    return Padding(int(s["Fixed"]) if isinstance(s, dict) else None, str(d.get("direction", "Right")).lower(), int(d.get("pad_id", 0)), int(d.get("pad_type_id", 0)), d.get("pad_token", "[PAD]"), d.get("pad_to_multiple_of"))


def from_dict(d: dict[str, Any]) -> TokenizerSpec:
    if not isinstance(d, dict) or not isinstance(d.get("model"), dict):
        raise TokenizerError("no model in the tokenizer file")
    known = {"truncation", "padding", "added_tokens", "normalizer", "pre_tokenizer", "post_processor", "decoder", "model"}
    tokens = []
    for t in d.get("added_tokens") or []:
        flags = {k: bool(t.get(k, False)) for k in "normalized rstrip lstrip single_word special".split()}
        tokens.append(AddedToken(int(t["id"]), str(t["content"]), **flags))
    return TokenizerSpec(
        d["model"], d.get("normalizer"), d.get("pre_tokenizer"), d.get("post_processor"), d.get("decoder"), tokens,
        _truncation(d.get("truncation")), _padding(d.get("padding")), {k: v for k, v in d.items() if k not in known},
    )


def from_json(text: str | bytes) -> TokenizerSpec:
    try:
        return from_dict(json.loads(text))
    except json.JSONDecodeError as e:
        raise TokenizerError(f"not JSON: {e}") from e


def from_file(path: str) -> TokenizerSpec:
    with open(path, "rb") as f:
        return from_json(f.read())


def checked_name(name: str) -> str:
    """A model name that is used as a path must not climb out of its folder."""
    if ".." in name:
        raise TokenizerError(f"bad model name: {name}")
    return name


def from_model(name: str, folder: str) -> TokenizerSpec:
    """``<folder>/<name>/tokenizer.json``: models come from a local mirror, never a network."""
    return from_file(f"{folder.rstrip('/')}/{checked_name(name)}/tokenizer.json")
