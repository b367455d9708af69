"""The compiled pipeline in plain Python: text to ids and back. Built on the driver from a
spec, shipped to workers once, independent of Spark."""

from __future__ import annotations

import numpy as np

from ..functions.bytes_map import BYTE_TO_CHAR, decode_bytes, encode_text, raw_text
from ..sources.spec import TokenizerError, TokenizerSpec, UnsupportedComponent
from . import added, normalize, postproc, pretok
from .bpe import BPE

#: Pieces beyond so many characters are merged one at a time, with a heap.
LONG = 64
#: Characters of texts whose unknown pieces are encoded together.
BATCH = 4 << 20
_DECODERS = ("ByteLevel", "Fuse", "Sequence")


def _byte_level(config: dict | None) -> bool:
    """Whether a decoder maps characters back to bytes."""
    if not config:
        return False
    kind = config.get("type")
    if kind not in _DECODERS:
        raise UnsupportedComponent("decoder", kind)
    if kind == "Sequence":
        return any([_byte_level(c) for c in config.get("decoders") or []])
    return kind == "ByteLevel"


def _text_of(token: str) -> str | None:
    try:
        text = raw_text(token)
    except UnicodeError:
        return None
    return text if encode_text(text) == token else None


class Engine:
    """``encode``, ``pieces``, ``decode`` of single texts. Known pieces of up to ``LONG``
    characters are remembered, ``memory`` of them and those of two batches at most: of two
    halves the older is forgotten when the newer is full, but for what was met again.
    Results don't depend on it."""

    def __init__(self, spec: TokenizerSpec, memory: int = 200_000):
        self.added = added.AddedTokens(spec.added_tokens)
        self.normalizers = normalize.build(spec.normalizer)
        self.pretok = pretok.build(spec.pre_tokenizer)
        self.model = BPE.from_config(spec.model)
        self.templates = postproc.build(spec.post_processor)
        self.byte_level = _byte_level(spec.decoder)
        self.memory = memory
        p = self.pretok
        steps = p.steps if isinstance(p, pretok.Sequence) else []
        #: Split then bulk bytes: pieces stay raw and the model starts from bytes.
        self.fused = len(steps) == 2 and isinstance(steps[0], pretok.Split) and isinstance(steps[1], pretok.ByteLevel) and steps[1].bulk
        #: ByteLevel alone cuts raw pieces; their bytes are mapped once per distinct piece.
        self.raw = self.fused or isinstance(p, pretok.ByteLevel)
        self._known: dict[str | int, bytes] = {}
        self._older: dict[str | int, bytes] = {}
        #: Tokens by the text that they stand for; those that aren't UTF-8 are no text.
        self._whole = {t: i for i, x in enumerate(self.model.tokens) if (t := _text_of(x)) is not None} if self.raw else {}
        self._byte_ids = np.array([-1 if i is None else i for i in self.model.byte_ids], np.int64)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_older": {}}

    def split(self, text: str) -> list[str]:
        p = self.pretok
        if self.fused:
            return p.steps[0].pieces(text)
        if p is None:
            return [text] if text else []
        return p.raw(text) if self.raw else p.pieces(text)

    # == encode ==

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece as ``cuts`` gives it."""
        if self.fused:
            return self.model.encode_raw(piece)
        if self.raw:
            piece = "".join([BYTE_TO_CHAR[b] for b in piece.encode()])
        return self.model.encode_chars(piece)

    def cuts(self, text: str) -> list[str | int]:
        """Pieces (before their bytes are mapped, where that is the last step) and added ids."""
        out: list[str | int] = []
        for seg in self.added.split(text):
            if isinstance(seg, int):
                out.append(seg)
                continue
            for f in self.normalizers:
                seg = f(seg)
            out += self.split(seg)
        return out

    def pieces(self, text: str) -> list[str]:
        """Shown pieces: table characters for byte-level tokenizers, contents for added ids."""
        show = (lambda p: "".join([BYTE_TO_CHAR[b] for b in p.encode()])) if self.raw else (lambda p: p)
        return [self.added.by_id[p] if isinstance(p, int) else show(p) for p in self.cuts(text)]

    def _learn(self, pieces: list[str | int]) -> dict[str | int, bytes]:
        """Ids of distinct pieces, as native uint32 bytes."""
        out: dict[str | int, bytes] = {}
        short: list[str] = []
        model = self.model
        for p in pieces:
            if isinstance(p, int):
                out[p] = np.array([p], np.uint32).tobytes()
            elif not self.raw or len(p) > LONG:
                out[p] = np.array(self.piece_ids(p), np.uint32).tobytes()
            else:
                whole = None
                if not self.fused or model.ignore_merges:
                    whole = self._whole.get(p)
                    if whole is not None and not self.fused and model.is_orphan(model.tokens[whole]):
                        whole = None
                if whole is None:
                    short.append(p)
                else:
                    out[p] = np.array([whole], np.uint32).tobytes()
        if short:
            data = [p.encode() for p in short]
            ids = self._byte_ids[np.frombuffer(b"".join(data), np.uint8)]
            if (ids < 0).any():
                for p in short:
                    self.piece_ids(p)  # raises for the byte in question
            merged = model.merged_many(ids, np.array([len(d) for d in data], np.int64))
            for p, x in zip(short, merged):
                out[p] = x.astype(np.uint32).tobytes()
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of texts as native uint32 bytes; null stays null. Pieces that aren't known yet
        are encoded side by side."""
        out: list[bytes | None] = []
        at = 0
        while at < len(texts):
            size, cuts = 0, []
            while at < len(texts) and size < BATCH:
                t = texts[at]
                size += len(t or "")
                cuts.append(None if t is None else self.cuts(t))
                at += 1
            some = set().union(*(c for c in cuts if c))
            if len(self._known) > self.memory // 2:
                self._older, self._known = self._known, {}
            fresh = some - self._known.keys()
            again = fresh & self._older.keys()
            fresh -= again
            self._known.update([(p, self._older[p]) for p in again])
            self._known.update(self._learn(list(fresh)))
            get = self._known.__getitem__
            out += [None if c is None else b"".join(map(get, c)) for c in cuts]
            for p in fresh:
                if isinstance(p, str) and len(p) > LONG:
                    del self._known[p]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as native uint32 bytes."""
        return self.encode_many([text])[0]

    def encode(self, text: str, add_special_tokens: bool = False) -> list[int]:
        ids = np.frombuffer(self.encode_bytes(text), np.uint32).tolist()
        return postproc.apply(self.templates, ids) if add_special_tokens else ids

    # == lookups ==

    @property
    def vocab_size(self) -> int:
        """Model and added tokens; a token in both counts twice."""
        return len(self.model.tokens) + len(self.added)

    def token_to_id(self, token: str):
        i = self.added.by_content.get(token)
        return self.model.vocab.get(token) if i is None else i

    def id_to_token(self, i: int) -> str | None:
        t = self.added.by_id.get(i)
        return t if t is not None else self.model.tokens[i] if 0 <= i < len(self.model.tokens) else None

    def vocab(self) -> dict[str, int]:
        return self.model.vocab | self.added.by_content

    # == decode ==

    def token_bytes(self) -> dict[int, bytes]:
        """What each id adds to the bytes of a decoded text."""
        to = decode_bytes if self.byte_level else str.encode
        return {i: to(t) for i, t in enumerate(self.model.tokens)} | {i: to(t) for i, t in self.added.by_id.items()}

    def decode(self, ids, skip_special_tokens=False) -> str:
        parts = []
        for i in ids:
            if skip_special_tokens and i in self.added.special_ids:
                continue
            t = self.id_to_token(i)
            if t is None:
                raise TokenizerError(f"unknown token id: {i}")
            parts.append(t)
        return self.decode_tokens(parts)

    def decode_tokens(self, tokens) -> str:
        text = "".join(tokens)
        return decode_bytes(text).decode("utf-8", "replace") if self.byte_level else text
