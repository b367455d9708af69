"""``Tokenizer``: a loaded tokenizer as Column and DataFrame operators.

Two plans encode a column. Row-wise (``encode``) one Arrow function turns each text into
ids; set-wise (``piece_counts``, ``token_counts``) pieces are cut by JVM expressions, each
distinct piece is encoded once, and aggregates join the result, so no id array is built.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.bytes_map import encode_column, raw_text
from .operators import postproc, shape
from .operators.engine import Engine
from .operators.normalize import nfc
from .operators.parts import in_parts
from .sources import spec as S

_ENGINES: dict[str, Engine] = {}


class _Shipped:
    """A spec that a worker turns into an engine once."""

    def __init__(self, spec: S.TokenizerSpec):
        self.data = zlib.compress(pickle.dumps(spec), 1)
        self.key = hashlib.sha256(self.data).hexdigest()

    def engine(self) -> Engine:
        if self.key not in _ENGINES:
            if len(_ENGINES) >= 4:
                _ENGINES.clear()
            _ENGINES[self.key] = Engine(pickle.loads(zlib.decompress(self.data)))
        return _ENGINES[self.key]


def _lists(parts: list[bytes | None]) -> pa.Array:
    """uint32 bytes per row to array<int>."""
    n = np.array([0 if p is None else len(p) // 4 for p in parts], np.int64)
    offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    values = np.frombuffer(b"".join([p for p in parts if p]), np.int32)
    if any(p is None for p in parts):
        mask = pa.array([p is None for p in parts])
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(values), mask=mask)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values))


def encoder(shipped: _Shipped):
    """Texts to ids, as a function of a column."""

    def encode(texts: pa.Array) -> pa.Array:
        return _lists(shipped.engine().encode_many(texts.to_pylist()))

    return in_parts(T.ArrayType(T.IntegerType()), encode)


def counter(shipped: _Shipped):
    """Numbers of ids of texts, as a function of a column."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else len(x) // 4 for x in shipped.engine().encode_many(texts.to_pylist())], pa.int32())

    return in_parts(T.IntegerType(), count)


def cutter(shipped: _Shipped):
    """Texts to shown pieces, as a function of a column."""

    def pieces(texts: pa.Array) -> pa.Array:
        e = shipped.engine()
        return pa.array([None if t is None else e.pieces(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return in_parts(T.ArrayType(T.StringType()), pieces)


def decoder(shipped: _Shipped, skip: bool):
    """Ids to texts, as a function of a column."""

    def decode(rows: pa.Array) -> pa.Array:
        e = shipped.engine()
        number, tokens = _table(shipped.key, e)
        some = rows.fill_null(pa.scalar([], rows.type)) if rows.null_count else rows
        ids = some.flatten().cast(pa.int64()).fill_null(-1).to_numpy()
        at = number[np.clip(ids, -1, len(number) - 1)]  # the last one stands for ids beyond
        if (at < 0).any():
            raise S.TokenizerError(f"unknown token id: {ids[np.argmax(at < 0)]}")
        upto = np.concatenate([[0], np.cumsum(some.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        if skip and e.added.special_ids:
            keep = ~np.isin(ids, np.array(sorted(e.added.special_ids)))
            at, upto = at[keep], np.concatenate([[0], np.cumsum(keep)])[upto]
        _, offs, data = tokens.take(pa.array(at)).buffers()
        ends = np.frombuffer(offs, np.int64, len(at) + 1)[upto]
        nulls = rows.is_null().to_numpy(zero_copy_only=False) if rows.null_count else None
        try:
            out = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), data]).cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # somewhere bytes make no characters
            text, ends = data.to_pybytes(), ends.tolist()
            out = pa.array([text[x:z].decode("utf-8", "replace") for x, z in zip(ends, ends[1:])], pa.string())
        return out if nulls is None else pc.if_else(pa.array(~nulls), out, pa.scalar(None, pa.string()))

    return in_parts(T.StringType(), decode)


class Tokenizer:
    """``Tokenizer.from_file(path)``; then ``df.select(tok.encode("text"))`` and so on."""

    def __init__(self, spec: S.TokenizerSpec):
        self.spec = spec
        self.engine = Engine(spec)
        self._shipped: _Shipped | None = None

    from_spec = classmethod(lambda cls, spec: cls(spec))

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        return cls(S.from_file(path))

    @classmethod
    def from_json(cls, text: str | bytes) -> Tokenizer:
        return cls(S.from_json(text))

    from_bytes = from_json

    @classmethod
    def from_model(cls, name: str, folder: str) -> Tokenizer:
        return cls(S.from_model(name, folder))

    def __getstate__(self):
        return {"spec": self.spec}

    def __setstate__(self, d):
        self.__init__(d["spec"])

    @property
    def shipped(self) -> _Shipped:
        if self._shipped is None:
            self._shipped = _Shipped(self.spec)
        return self._shipped

    # == options: each gives a new tokenizer ==

    def _with(self, **changes) -> Tokenizer:
        return Tokenizer(S.TokenizerSpec(**(self.spec.__dict__ | changes)))

    def with_truncation(self, max_length: int | None, direction: str = "right", stride: int = 0, strategy: str = "longest_first") -> Tokenizer:
        """Truncate to a length, or not at all (None)."""
        return self._with(truncation=None if max_length is None else S.Truncation(max_length, direction, stride, strategy))

    def with_padding(self, padding: S.Padding | None) -> Tokenizer:
        return self._with(padding=padding)

    def with_post_processor(self, config: dict | None) -> Tokenizer:
        return self._with(post_processor=config)

    def to_json(self, pretty: bool = False) -> str:
        return self.spec.to_json(pretty)

    def save(self, path: str, *, pretty=True) -> None:
        self.spec.save(path, pretty=pretty)

    def describe(self) -> str:
        """One line per stage of the pipeline."""
        kind = lambda c: "none" if not c else c.get("type") if c.get("type") != "Sequence" else "Sequence[" + ", ".join(str(kind(x)) for x in next((v for v in c.values() if isinstance(v, list)), [])) + "]"
        s = self.spec
        rows = [("added tokens", str(len(self.engine.added))), ("normalizer", kind(s.normalizer)), ("pre-tokenizer", kind(s.pre_tokenizer)), ("model", f"BPE, {len(self.engine.model.tokens)} tokens, {len(self.engine.model.parsed)} merges"), ("post-processor", kind(s.post_processor)), ("decoder", kind(s.decoder)), ("fused", str(self.engine.fused).lower())]
        return "\n".join(f"{k}: {v}" for k, v in rows)

    def step_kinds(self) -> set[tuple[str, str]]:
        """(stage, type) of every step, nested ones too."""
        out: set[tuple[str, str]] = set()

        def walk(stage: str, c):
            if isinstance(c, dict):
                if isinstance(c.get("type"), str):
                    out.add((stage, c["type"]))
                for v in c.values():
                    for x in v if isinstance(v, list) else [v]:
                        walk(stage, x)

        for stage in ("normalizer", "pre_tokenizer", "post_processor", "decoder"):
            walk(stage, getattr(self.spec, stage))
        out.add(("model", self.spec.model.get("type", "BPE")))
        return out

    # == row-wise ==

    def ids(self, text: Column | str) -> Column:
        """Ids of a text column without the post-processor; null in, null out."""
        return encoder(self.shipped)(F.col(text) if isinstance(text, str) else text)

    def encode(self, text: Column | str, add_special_tokens: bool = False) -> Column:
        ids = self.ids(text)
        return self.post_process(ids) if add_special_tokens else ids

    def count(self, text: Column | str) -> Column:
        """Number of ids; only the count leaves Python."""
        return counter(self.shipped)(F.col(text) if isinstance(text, str) else text)

    def post_process(self, ids: Column, add_special_tokens: bool = True) -> Column:
        return postproc.apply_column(self.engine.templates, ids) if add_special_tokens else ids

    def post_process_encoding(self, e: Column, add_special_tokens: bool = True) -> Column:
        """An encoding struct with the template's ids around its own; its mask is all ones."""
        return shape.encoding(self.post_process(e["ids"], add_special_tokens))

    def num_special_tokens_to_add(self, is_pair: bool = False) -> int:
        return 0 if is_pair else postproc.added(self.engine.templates)

    def encoding(self, text: Column | str, add_special_tokens: bool = False) -> Column:
        """Encode, truncate and pad (to a fixed length) to an encoding struct."""
        e = shape.encoding(shape.truncated(self.encode(text, add_special_tokens), self.spec.truncation))
        return shape.padded(e, self.spec.padding)

    def encode_batches(self, df: DataFrame, text: str, *batch: str, add_special_tokens: bool = False, column: str = "encoding") -> DataFrame:
        """``df`` with encodings padded to one length per batch (the whole table without
        batch columns)."""
        e = shape.encoding(shape.truncated(self.encode(text, add_special_tokens), self.spec.truncation))
        out = df.withColumn(column, e)
        return out if self.spec.padding is None else shape.pad_batches(out, column, self.spec.padding, *batch)

    def total_counts(self, df: DataFrame, text: str, *by: str) -> DataFrame:
        """(by..., n_tokens), counted text by text: only sums are shuffled. ``token_counts``
        gives the same set-wise; this one is faster unless few pieces make up all texts."""
        n = df.select(*by, self.count(text).alias("_n"))
        return n.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_tokens"))

    # == set-wise ==

    def native_pieces(self, text: Column) -> Column | None:
        """array<string> of shown pieces by JVM expressions (NFC alone is an Arrow function);
        None where the tokenizer needs Python: patterns that the JVM cuts otherwise, or added
        tokens before a normalizer."""
        added = self.engine.added
        if self.engine.pretok is not None and not self.engine.pretok.native:
            return None
        if len(added):
            if self.engine.normalizers or self.engine.pretok is None:
                return None
            names = F.create_map(*[F.lit(x) for kv in added.by_id.items() for x in kv])
            cut = lambda x: F.when(x["token_id"].isNull(), self.engine.pretok.column(x["text"])).otherwise(F.array(F.element_at(names, x["token_id"])))
            parts = F.flatten(F.transform(added.split_column(text), cut))
            # most texts hold no added token: one look spares them the arrays of segments
            return F.when(text.rlike(added.java_pattern()), parts).otherwise(self.engine.pretok.column(text))
        if self.engine.normalizers:
            text = nfc(text)
        if self.engine.pretok is None:
            return F.filter(F.array(text), lambda x: x != "")
        return self.engine.pretok.column(text)

    def pieces(self, text: Column | str) -> Column:
        """Shown pieces of a text column."""
        text = F.col(text) if isinstance(text, str) else text
        native = self.native_pieces(text)
        if native is not None:
            return native
        return cutter(self.shipped)(text)

    def piece_ids(self, piece: Column | str) -> Column:
        """Ids of single shown pieces."""
        shipped = self.shipped

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def ids(pieces: pa.Array) -> pa.Array:
            return _lists(_shown_ids(shipped.engine(), pieces.to_pylist()))

        return ids(F.col(piece) if isinstance(piece, str) else piece)

    def _unmapped(self, text: Column) -> Column | None:
        """array<string> of pieces before their bytes are mapped, where that is the last step
        and the JVM can cut them."""
        e = self.engine
        if not e.raw or len(e.added) or not e.pretok.native:
            return None
        if e.normalizers:
            text = nfc(text)
        return e.pretok.steps[0].column(text) if e.fused else e.pretok.raw_column(text)

    def _counted(self, df: DataFrame, text: str, *by: str) -> tuple[DataFrame, bool]:
        """``piece_counts``, and whether the pieces' bytes are still to be mapped."""
        pieces = self._unmapped(F.col(text))
        raw = pieces is not None
        return df.select(*by, F.explode(pieces if raw else self.pieces(text)).alias("piece")).groupBy(*by, "piece").agg(F.count(F.lit(1)).alias("n")), raw

    def piece_counts(self, df: DataFrame, text: str, *by: str) -> DataFrame:
        """(by..., piece, n): occurrences of each piece, counted before the shuffle. Bytes are
        mapped after that, once per piece."""
        counted, raw = self._counted(df, text, *by)
        return counted.withColumn("piece", encode_column(F.col("piece"))) if raw else counted

    def piece_table(self, counted: DataFrame) -> DataFrame:
        """(piece, ids) of the distinct pieces of ``counted``, each encoded once."""
        return counted.select("piece").distinct().select("piece", self.piece_ids("piece").alias("ids"))

    def token_counts(self, df: DataFrame, text: str, *by: str) -> DataFrame:
        """(by..., n_tokens) without building any text's ids. Texts are read and cut once; the
        number of ids of a group's pieces is asked where they were counted, without a join."""
        counted, raw = self._counted(df, text, *by)
        shipped = self.shipped

        @F.arrow_udf(T.LongType())
        def size(pieces: pa.Array) -> pa.Array:
            e = shipped.engine()
            pieces = pieces.to_pylist()
            if not raw:
                return pa.array([len(x) // 4 for x in _shown_ids(e, pieces)], pa.int64())
            ids = e._learn(list(set(pieces)))
            return pa.array([len(ids[p]) // 4 for p in pieces], pa.int64())

        total = F.sum(F.col("n") * size("piece"))
        return counted.groupBy(*by).agg((total if by else F.coalesce(total, F.lit(0))).alias("n_tokens"))

    def token_frequencies(self, df: DataFrame, text: str) -> DataFrame:
        """(token_id, n) over all texts: pieces are counted first, then their ids."""
        counted = self.piece_counts(df, text)
        ids = counted.select("n", F.explode(self.piece_ids("piece")).alias("token_id"))
        return ids.groupBy("token_id").agg(F.sum("n").alias("n"))

    # == decode ==

    def decode(self, ids: Column | str, skip_special_tokens: bool = False) -> Column:
        """Text of an id array; an unknown id fails the query."""
        return decoder(self.shipped, skip_special_tokens)(F.col(ids) if isinstance(ids, str) else ids)

    def decode_tokens(self, tokens: Column | str) -> Column:
        """Text of an array of token strings."""
        shipped = self.shipped

        def decode(rows: pa.Array) -> pa.Array:
            e = shipped.engine()
            return pa.array([None if r is None else e.decode_tokens(r) for r in rows.to_pylist()], pa.string())

        return in_parts(T.StringType(), decode)(F.col(tokens) if isinstance(tokens, str) else tokens)

    # == tables and lookups ==

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        """(token, id, special, added) of all tokens, added ones instead of the model's."""
        a = self.engine.added
        rows = [(t, i, i in a.special_ids, t in a.by_content) for t, i in self.engine.vocab().items()]
        return spark.createDataFrame(pa.table({k: [r[j] for r in rows] for j, k in enumerate(("token", "id", "special", "added"))}))

    def merges_table(self, spark: SparkSession) -> DataFrame:
        cols = list(zip(*self.engine.model.parsed)) or [[]] * 4
        return spark.createDataFrame(pa.table({k: pa.array(list(c), pa.int64()) for k, c in zip(("rank", "left_id", "right_id", "merged_id"), cols)}))

    def orphans(self) -> list[str]:
        return [t for t in self.engine.model.vocab if self.engine.model.is_orphan(t)]

    def vocab_size(self) -> int:
        return self.engine.vocab_size

    def token_to_id(self, token: str):
        return self.engine.token_to_id(token)

    def id_to_token(self, i: int) -> str | None:
        return self.engine.id_to_token(i)

    def is_special_token(self, i: int) -> bool:
        return i in self.engine.added.special_ids

    def added_tokens_decoder(self) -> dict[int, S.AddedToken]:
        return {t.id: t for t in self.spec.added_tokens}


def _shown_ids(e: Engine, pieces: list[str | None]) -> list[bytes | None]:
    """Ids of shown pieces as uint32 bytes; they are encoded side by side."""
    raw: dict[str, str | int] = {}
    for p in pieces:
        if p is not None and p not in raw:
            i = e.added.by_content.get(p)
            raw[p] = i if i is not None else raw_text(p) if e.raw else p
    ids = e._learn(list(set(raw.values())))
    return [None if p is None else ids[raw[p]] for p in pieces]


_TABLES: dict[str, tuple[np.ndarray, pa.LargeBinaryArray]] = {}


def _table(key: str, e: Engine) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """Id to number (-1: none, and so is the last), and all tokens' bytes by number."""
    if key not in _TABLES:
        if len(_TABLES) >= 4:
            _TABLES.clear()
        known = e.token_bytes()
        number = np.full(max(known, default=-1) + 2, -1, np.int64)
        number[list(known)] = np.arange(len(known))
        _TABLES[key] = number, pa.array(known.values(), pa.large_binary())
    return _TABLES[key]
