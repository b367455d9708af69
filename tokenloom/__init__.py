"""Text tokenization and token analytics as Spark operators."""

import importlib

_HOMES = {"Tokenizer": ".tokenizer"} | {n: ".sources.spec" for n in ("AddedToken", "Padding", "TokenizerError", "TokenizerSpec", "Truncation", "UnsupportedComponent")}
__all__ = [*_HOMES]


def __getattr__(name: str):  # workers import submodules alone
    if name in _HOMES:
        return getattr(importlib.import_module(_HOMES[name], __name__), name)
    raise AttributeError(name)
