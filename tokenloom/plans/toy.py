"""Small hand-made tokenizers: 256 byte tokens in byte order and a few merges.

They load like any file and are small enough to be written into SQL, which is how the
encode and decode queries are checked.
"""

from __future__ import annotations

from ..functions.bytes_map import BYTE_TO_CHAR, encode_text
from ..sources.spec import TokenizerSpec, from_dict
from ..tokenizer import Tokenizer

MERGES: list[tuple[str, str]] = [
    ("t", "h"), ("i", "n"), ("e", "r"), ("a", "n"), ("th", "e"), ("o", "n"), ("e", "s"), ("r", "e"), ("e", "n"), ("in", "g"),
    ("an", "d"), ("t", "i"), ("ti", "on"), ("o", "u"), ("o", "r"), ("a", "t"), ("e", "d"), ("c", "h"), ("i", "e"), ("s", "t"),
    ("l", "e"), (" ", "the"), (" ", "d"), (" ", "a"), (" ", "o"), ("d", "e"), ("u", "n"), ("s", "ch"), ("q", "u"), ("l", "l"),
    ("m", "en"), ("men", "t"), (" ", "re"), (" ", "in"), ("er", "e"),
]
#: Whole tokens that merges don't build.
WHOLE = [" of", "tionally"]
ADDED = [("<p>", False), ("</p>", False), ("<title>", False), ("</title>", False), ("<|end|>", True)]
START, STOP = "<|start|>", "<|stop|>"


def vocab() -> dict[str, int]:
    tokens = [BYTE_TO_CHAR[b] for b in range(256)]
    tokens += [encode_text(a + b) for a, b in MERGES] + [encode_text(w) for w in WHOLE]
    return {t: i for i, t in enumerate(tokens)}


def spec(fused: bool = False, nfc: bool = False, added: bool = False, template: bool = False, pattern: str | None = None) -> TokenizerSpec:
    v = vocab()
    n = len(v)
    names = [c for c, _ in ADDED] if added else []
    extra = [{"id": n + i, "content": c, "special": s} for i, (c, s) in enumerate(ADDED)] if added else []
    split = [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    whole = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    post = None
    if template:
        post = {"type": "TemplateProcessing", "single": [dict(SpecialToken={"id": START}), dict(Sequence={"id": "A"}), dict(SpecialToken={"id": STOP})]}
        post["special_tokens"] = {s: {"id": s, "ids": [n + len(names) + i], "tokens": [s]} for i, s in enumerate((START, STOP))}
        extra += [{"id": n + len(names) + i, "content": s, "special": True} for i, s in enumerate((START, STOP))]
    return from_dict({
        "model": {"type": "BPE", "vocab": v, "merges": [[encode_text(a), encode_text(b)] for a, b in MERGES], "ignore_merges": fused},
        "normalizer": {"type": "NFC"} if nfc else None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": split} if fused else whole,
        "post_processor": post, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "added_tokens": extra,
    })


def tokenizer(**how) -> Tokenizer:
    return Tokenizer(spec(**how))
