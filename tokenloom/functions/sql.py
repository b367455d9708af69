"""SQL functions of a tokenizer: ``register(spark, tokenizer, prefix="tok")`` gives

tok_encode(text), tok_encode_special(text), tok_decode(ids), tok_decode_clean(ids),
tok_count(text), tok_pieces(text), and the table function tok_explode(text).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import postproc
from ..operators.parts import in_parts
from ..tokenizer import Tokenizer, counter, cutter, decoder, encoder


def register(spark: SparkSession, tokenizer: Tokenizer, prefix: str = "tok") -> None:
    shipped = tokenizer.shipped
    templates = tokenizer.engine.templates

    def encode_special(texts: pa.Array) -> pa.Array:
        e = shipped.engine()
        return pa.array([None if t is None else postproc.apply(templates, e.encode(t)) for t in texts.to_pylist()], pa.list_(pa.int32()))

    @F.udtf(returnType="pos: int, piece: string, token_id: int")
    class Explode:
        def eval(self, text: str):
            if text is not None:
                e, pos = shipped.engine(), 0
                for p in e.cuts(text):
                    shown = e.added.by_id[p] if isinstance(p, int) else p
                    for i in [p] if isinstance(p, int) else e.piece_ids(p):
                        yield pos, shown, i
                        pos += 1

    named = {"encode": encoder(shipped), "encode_special": in_parts(T.ArrayType(T.IntegerType()), encode_special), "decode": decoder(shipped, False), "decode_clean": decoder(shipped, True), "count": counter(shipped), "pieces": cutter(shipped)}
    for name, f in named.items():
        spark.udf.register(f"{prefix}_{name}", f)
    spark.udtf.register(f"{prefix}_explode", Explode)
