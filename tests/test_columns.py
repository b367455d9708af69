"""Column operators: nulls, empty texts, shaping, batches, plans, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tokenloom import Padding
from tokenloom.operators import normalize, shape
from tokenloom.plans import analytics, catalogue, toy
from tokenloom.sources import corpora, sinks


def test_nulls_and_empty_texts(spark):
    t = toy.tokenizer(template=True, added=True)
    d = spark.createDataFrame([(1, None), (2, ""), (3, "the")], "i int, text string")
    r = d.select("i", t.encode("text").alias("a"), t.encode("text", True).alias("b"), t.count("text").alias("n"), t.pieces("text").alias("p"), t.encoding("text").alias("e"), t.decode(t.encode("text")).alias("d")).orderBy("i").collect()
    assert (r[0].a, r[0].b, r[0].n, r[0].p, r[0].e, r[0].d) == (None,) * 6
    start, stop = t.token_to_id(toy.START), t.token_to_id(toy.STOP)
    assert (r[1].a, r[1].b, r[1].n, r[1].p, r[1].d) == ([], [start, stop], 0, [], "")
    assert d.select(t.post_process_encoding(t.encoding("text")).alias("e")).where("e is not null and size(e.ids) > 2").first().e.attention_mask == [1] * len(r[2].b)
    assert r[2].b == [start, *r[2].a, stop] and r[2].d == "the"


def test_padding_vector(spark):
    d = spark.range(1).select(F.array(*map(F.lit, (10, 20, 30))).alias("ids"))
    e = shape.encoding_padded(shape.encoding(F.col("ids")), 5, pad_type_id=1)
    r = d.select(e.alias("e")).first().e
    assert (r.ids, r.attention_mask, r.type_ids, r.n_sequences) == ([10, 20, 30, 0, 0], [1, 1, 1, 0, 0], [0, 0, 0, 1, 1], 1)
    c = d.select(shape.encoding_cut(shape.encoding(F.col("ids")), 2, "left").alias("e"), shape.cut(F.col("ids"), 0).alias("z"), shape.cut(F.col("ids"), 0, "left").alias("y")).first()
    assert c.e.ids == [20, 30] and c.z == [] and c.y == []


def test_padding_of_the_whole_table(spark):
    t = toy.tokenizer().with_padding(Padding(pad_to_multiple_of=4))
    d = spark.createDataFrame([("x",), ("xyzxyz",), (None,)], "text string")
    sizes = [r.n for r in t.encode_batches(d, "text").select(F.size("encoding.ids").alias("n")).where("n >= 0").collect()]
    assert sizes == [8, 8]


def test_both_plans_agree(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = toy.tokenizer()
    rows = d.agg(F.sum(t.count("text"))).first()[0]
    assert t.token_counts(d, "text").first().n_tokens == rows
    assert t.token_frequencies(d, "text").agg(F.sum("n")).first()[0] == rows
    tagged = toy.tokenizer(added=True)
    assert tagged.token_counts(d, "text").first().n_tokens == rows


def test_scan_reads_two_columns(spark, sf_dir):
    plan = catalogue.token_count_by_lang(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan or "ReadSchema: struct<lang:string,text:string>" in plan


def test_empty_table(spark):
    d = spark.createDataFrame([], "lang string, text string")
    t = toy.tokenizer()
    assert t.token_counts(d, "text", "lang").collect() == []
    assert t.token_counts(d, "text").first().n_tokens == 0
    assert d.select(t.encode("text")).collect() == []


def test_streams_keep_state_between_batches(spark, tmp_path):
    from tokenloom.streaming.decode_stream import decode_stream

    t = toy.tokenizer()
    ids = t.engine.encode("été and the thing")
    half = len(ids) // 2
    schema = "stream_id long, seq long, token_id int"
    for k, part in enumerate((ids[:half], ids[half:])):
        rows = [(s, k * half + i, x) for s in (1, 2) for i, x in enumerate(part)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = decode_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), t)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    for s in (1, 2):
        assert "".join(r.chunk for r in rows if r.stream_id == s) == "été and the thing"


def test_sources_and_sinks(spark, tmp_path):
    items = [{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": ""}, {"from": "gpt", "value": "yo"}]}, {"conversations": []}]
    (tmp_path / "s.json").write_text(json.dumps(items))
    assert [r.text for r in corpora.read_conversations(spark, str(tmp_path / "s.json")).collect()] == ["[human]: hi\n\n[gpt]: yo"]
    (tmp_path / "c.json").write_text(json.dumps([{"context": "long"}, {"other": 1}]))
    assert [r.text for r in corpora.read_contexts(spark, str(tmp_path / "c.json")).collect()] == ["long"]
    d = spark.createDataFrame([(0, 5, 2, 1.0, 0.5)], ", ".join(f"{c} {'double' if 'ms' in c else 'long'}" for c in sinks.MEASURES))
    sinks.write_measures(d, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).columns == list(sinks.MEASURES)
    path = sinks.save_vocabulary(toy.vocab(), str(tmp_path / "v"), "toy")
    assert path.endswith("toy-vocab.json") and json.load(open(path)) == toy.vocab()


def test_allocation():
    assert analytics.allocate(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert sum(analytics.allocate(97, {"x": 0.5, "y": 0.3, "z": 0.2}).values()) == 97


def test_unknown_id_fails_the_query(spark):
    with pytest.raises(Exception, match="unknown token id"):
        spark.range(1).select(toy.tokenizer().decode(F.array(F.lit(999_999)))).collect()


def test_merging_and_adjusting(spark):
    t = toy.tokenizer()
    d = spark.createDataFrame([(1, "b", "x"), (1, "a", "the"), (2, "a", None)], "k int, o string, text string").withColumn("e", t.encoding("text"))
    rows = shape.merged(d, "e", "o", "k").collect()
    assert len(rows) == 1 and rows[0].e.ids == t.engine.encode("the") + t.engine.encode("x") and rows[0].e.n_sequences == 2
    r = spark.range(1).select(shape.fitted(F.array(F.lit(1), F.lit(2)), 5).alias("a"), shape.fitted(F.array().cast("array<int>"), 5).alias("b")).first()
    assert r.a == [1, 2, 1, 2, 1] and r.b == []


def test_pieces_with_added_tokens_stay_in_the_jvm(spark):
    t = toy.tokenizer(added=True)
    d = spark.createDataFrame([(0, "<p>the nation</p> é"), (1, "plain text"), (2, None), (3, ""), (4, "<p><p>")], "i int, text string")
    df = d.select("i", "text", t.pieces("text").alias("p"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r.p == (None if r.text is None else t.engine.pieces(r.text))
    ids = {r.piece: r.ids for r in t.piece_table(df.select(F.explode("p").alias("piece"))).collect()}
    for r in df.where("text is not null").collect():
        assert [i for p in r.p for i in ids[p]] == t.engine.encode(r.text)


def test_decode_of_odd_arrays(spark):
    from pyspark.errors import PythonException

    t = toy.tokenizer(template=True)
    start = t.token_to_id(toy.START)
    df = spark.createDataFrame([(1, [72, start, 105]), (2, []), (3, None), (4, [0xC3, 0xA9, 0xC3])], "i long, ids array<int>").coalesce(1)
    shown = [r[0] for r in df.orderBy("i").select(t.decode("ids")).collect()]
    plain = [r[0] for r in df.orderBy("i").select(t.decode("ids", True)).collect()]
    assert shown == ["H" + toy.START + "i", "", None, "é\ufffd"] and plain == ["Hi", "", None, "é\ufffd"]
    for bad in (10**6, -1, None):
        with pytest.raises(PythonException, match="unknown token id"):
            spark.createDataFrame([([1, bad],)], "ids array<int>").select(t.decode("ids")).collect()


def test_a_split_that_may_match_nothing(spark):
    from tokenloom.operators.pretok import Sequence, Split

    df = spark.createDataFrame([("small ring",), ("",), (None,)], "t string").coalesce(1)
    s = Split("[aeiou]*", "Isolated")
    assert [r[0] for r in df.select(s.column(F.col("t"))).collect()] == [["sm", "a", "ll r", "i", "ng"], [], None]
    assert [r[0] for r in df.select(Sequence([Split(" ", "Removed"), s]).column(F.col("t"))).collect()] == [["sm", "a", "ll", "r", "i", "ng"], [], None]


def test_long_batches_are_taken_in_parts(spark):
    """A batch of many rows never reaches the function as a whole; rows and nulls stay in place."""
    import pyarrow as pa

    from tokenloom.operators import parts

    texts = pa.array(["a" * 400_000, None, "", "é" * 300_000, "b" * (3 << 20), *["c" * 1000] * 3000])
    got = list(parts.parts(texts))
    assert pa.concat_arrays(got).equals(texts) and len(got) == 5
    assert all(sum(map(len, map(str.encode, filter(None, p.to_pylist())))) <= parts.PART or len(p) == 1 for p in got)
    lists = pa.array([[1] * 200_000, None, [], *[[2] * 100_000] * 9], pa.list_(pa.int32()))
    assert [len(p) for p in parts.parts(lists)] == [3, 2, 2, 2, 2, 1]
    assert [len(p) for p in parts.parts(pa.chunked_array([["a"], [], ["b", "c"]]))] == [1, 2]

    t = toy.tokenizer()
    d = spark.createDataFrame([(i, None if i % 7 == 3 else f"the é thing {i} " * (i % 5) * 4000) for i in range(60)], "k int, text string").coalesce(1)
    out = d.select("k", "text", t.decode(t.encode("text")).alias("back")).collect()
    assert len(out) == 60 and all(r.text == r.back for r in out)
    seen = spark.createDataFrame([([0xC3, 0xA9],), ([0xC3],), (None,), ([],), ([0x61, 0xFF],)], "ids array<int>").coalesce(1)
    assert [r.s for r in seen.select(t.decode("ids").alias("s")).collect()] == ["é", "�", None, "", "a�"]


def test_counting_goes_through_batches_in_parts(spark):
    import pyarrow as pa

    from tokenloom.tokenizer import counter

    t = toy.tokenizer()
    texts = ["the thing " * 10_000] * 40 + [None, ""]
    got = list(counter(t.shipped).func(iter([pa.array(texts), pa.array(["x"])])))
    assert [len(g) for g in got] == [10, 10, 10, 12, 1]
    n = len(t.engine.encode(texts[0]))
    assert pa.concat_arrays(got).to_pylist() == [n] * 40 + [None, 0, 1]


@pytest.mark.parametrize("how", [{}, {"nfc": True}, {"fused": True, "pattern": " ?\\p{L}+|\\s+|[^\\s\\p{L}]+"}, {"added": True}])
def test_set_wise_counts_read_texts_once(spark, sf_dir, how):
    t = toy.tokenizer(**how)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(-1, None, "<p>é the</p>"), (-2, "x", None), (-3, "x", ""), (-4, "y", "\U0001f600 İ")], docs.schema)
    got = t.token_counts(docs, "text", "lang")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    d = docs.union(odd)
    want = {r.lang: r.n for r in d.groupBy("lang").agg(F.sum(t.count("text")).alias("n")).collect() if r.n}
    assert {r.lang: r.n_tokens for r in t.token_counts(d, "text", "lang").collect()} == want
    assert t.token_counts(d, "text").first().n_tokens == sum(want.values())
    pieces = d.select(F.explode(t.pieces("text")).alias("piece")).groupBy("piece").count()
    assert sorted(t.piece_counts(d, "text").collect()) == sorted(pieces.collect())


def test_every_function_of_texts_takes_parts(spark):
    """With a full vocabulary's decode, what cuts, normalizes and joins takes a MB at a time too."""
    import pyarrow as pa

    from tokenloom.tokenizer import cutter, decoder

    try:
        t = catalogue.full()
    except ImportError:
        t = toy.tokenizer()
    text = "the thing é " * 10_000
    ids = t.engine.encode(text)
    got = list(decoder(t.shipped, False).func(iter([pa.array([ids] * 40 + [None, []], pa.list_(pa.int32()))])))
    assert len(got) > 1 and pa.concat_arrays(got).to_pylist() == [text] * 40 + [None, ""]
    got = list(cutter(t.shipped).func(iter([pa.array([text] * 40 + [None])])))
    assert len(got) > 1 and pa.concat_arrays(got).to_pylist() == [t.engine.pieces(text)] * 40 + [None]
    apart = "e\u0301 " * 400_000
    d = spark.createDataFrame([(k, apart if k % 2 else None) for k in range(6)], "k int, text string").coalesce(1)
    n = normalize.nfc(F.col("text"))
    assert [r.n for r in d.select(n.alias("n")).collect()] == [None, "\u00e9 " * 400_000] * 3


def test_roundtrip_encodes_once(spark, sf_dir):
    plan = catalogue.decode_roundtrip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("run(text#") == 1
