"""The registered queries of the tokenization engine, and the SQL that they are held against.

Arrays leave as strings or digests, counts as longs, so that both engines show the same
types.
"""

from __future__ import annotations

import functools
import os
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as sqlfun
from ..functions.bytes_map import decode_column, encode_column
from ..operators import shape
from ..operators.added import AddedTokens
from ..operators.normalize import nfc
from ..operators.pretok import ByteLevel, Split
from ..operators.spread import spread
from ..sources import corpora
from ..sources.spec import AddedToken, Padding
from ..streaming.decode_stream import decode_stream
from ..tokenizer import Tokenizer
from . import analytics, oracles, toy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def query(sql: str | None = None):
    def deco(f):
        add(f.__name__, f, sql)
        return f

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents; a table of one small file is dealt out to all cores."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


@functools.cache
def tok(**how) -> Tokenizer:
    return toy.tokenizer(**how)


def show(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def md5_list(c: Column) -> Column:
    return F.md5(F.array_join(c, "\x1f"))


SQL_MD5 = "md5(array_to_string({}, chr(31)))"
SQL_SHOW = "array_to_string({}, ' ')"


# == pre-tokenization ==


@query(f"SELECT doc_id, len(ps) AS n_pieces, {SQL_MD5.format('ps')} AS pieces_md5 FROM (SELECT doc_id, {oracles.classic_pieces('text')} AS ps FROM documents)")
def pretok_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", ByteLevel(False).raw_column(F.col("text")).alias("ps"))
    return d.select("doc_id", F.size("ps").cast("long").alias("n_pieces"), md5_list(F.col("ps")).alias("pieces_md5"))


_SPLITS = {
    "split_removed": ("part", "p_partkey", "p_name", r"[aeiou]+", "Removed", False),
    "split_isolated": ("part", "p_partkey", "p_name", r"[aeiou]+", "Isolated", False),
    "split_merged_with_previous": ("part", "p_partkey", "p_type", r"[AEIOU]", "MergedWithPrevious", False),
    "split_merged_with_next": ("part", "p_partkey", "p_type", r"[AEIOU]", "MergedWithNext", False),
    "split_contiguous": ("part", "p_partkey", "p_type", r"[A-M]", "Contiguous", False),
    "split_removed_inverted": ("events", "event_id", "props", r"[0-9]+", "Removed", True),
    "split_isolated_inverted": ("events", "event_id", "props", r"[0-9]+", "Isolated", True),
    "split_previous_inverted": ("events", "event_id", "props", r"[0-9]", "MergedWithPrevious", True),
    "split_next_inverted": ("events", "event_id", "props", r"[0-9]", "MergedWithNext", True),
    "split_contiguous_inverted": ("events", "event_id", "props", r"[0-9:{}]", "Contiguous", True),
}


def _split_sql(t: str, key: str, col: str, p: str, how: str, inv: bool) -> str:
    both = "flatten(list_transform(range(1, len(g) + 1), lambda i: [g[i], coalesce(m[i], '')]))"
    before = "list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(m[i], ''))"
    after = "list_transform(range(1, len(g) + 1), lambda i: coalesce(m[i - 1], '') || g[i])"
    after = after.replace("m[i - 1]", "(CASE WHEN i > 1 THEN m[i - 1] END)")
    if how == "Contiguous":
        p, ps = f"(?:{p})+", both
    elif how == "Removed":
        ps = "m" if inv else "g"
    else:
        ps = both if how == "Isolated" else before if (how == "MergedWithPrevious") != inv else after
    return f"SELECT {key}, len(ps) AS n_pieces, array_to_string(ps, '|') AS pieces FROM (SELECT {key}, list_filter({ps}, lambda x: x <> '') AS ps FROM (SELECT {key}, {oracles.split_lists(col, p)} FROM {t}))"


def _split_query(t: str, key: str, col: str, p: str, how: str, inv: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, t).select(key, Split(p, how, inv).column(F.col(col)).alias("ps"))
        return d.select(key, F.size("ps").cast("long").alias("n_pieces"), F.array_join("ps", "|").alias("pieces"))

    return run


for _name, _args in _SPLITS.items():
    add(_name, _split_query(*_args), _split_sql(*_args))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_brand, '#'), lambda x: x <> ''), '|') AS pieces FROM part")
def split_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Split.from_config({"pattern": {"String": "#"}, "behavior": "Removed"})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(s.column(F.col("p_brand")), "|").alias("pieces"))


@query("SELECT event_id, array_to_string(regexp_extract_all(props, '[0-9]|[a-z]+'), '|') AS pieces FROM events")
def pretok_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pretok import build

    steps = [{"type": "Split", "pattern": {"Regex": r"[^0-9a-z]+"}, "behavior": "Removed"}, {"type": "Split", "pattern": {"Regex": "[0-9]"}, "behavior": "Isolated"}]
    p = build({"type": "Sequence", "pretokenizers": steps})
    return table(spark, sf_dir, "events").select("event_id", F.array_join(p.column(F.col("props")), "|").alias("pieces"))


@query(f"""
SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: c[('0x' || h)::INT + 1]), '')) AS shown_md5
FROM documents, (SELECT {oracles.byte_char_list()} AS c)
""")
def bytelevel_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(encode_column(F.col("text"))).alias("shown_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def bytelevel_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(decode_column(encode_column(F.col("text")))).alias("text_md5"))


_ACUTE = "replace(replace(text, chr(233), 'e' || chr(769)), chr(243), 'o' || chr(769))"


@query(f"SELECT doc_id, md5(nfc_normalize({_ACUTE})) AS nfc_md5, strlen({_ACUTE}) - strlen(nfc_normalize({_ACUTE})) AS shrunk FROM documents")
def nfc_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.replace(F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u00f3"), F.lit("o\u0301"))
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", apart.alias("t")).select("doc_id", "t", nfc(F.col("t")).alias("n"))
    return d.select("doc_id", F.md5("n").alias("nfc_md5"), (F.octet_length("t") - F.octet_length("n")).cast("long").alias("shrunk"))


_TAGS = ["<title>", "</title>", "</p>", "<p>", "<p"]
_TAG_SQL = "'</title>|<title>|</p>|<p>|<p'"


@query(f"""
SELECT page_id, len(m) AS n_tokens, len(list_filter(g, lambda x: x <> '')) AS n_texts, array_to_string(list_transform(m, lambda x: list_position({_TAGS!r}, x)), ' ') AS token_ids,
    {SQL_MD5.format("list_filter(g, lambda x: x <> '')")} AS texts_md5
FROM (SELECT page_id, regexp_split_to_array(html, {_TAG_SQL}) AS g, regexp_extract_all(html, {_TAG_SQL}) AS m FROM pages)
""")
def added_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = AddedTokens([AddedToken(i + 1, t) for i, t in enumerate(_TAGS)])
    d = table(spark, sf_dir, "pages").select("page_id", a.split_column(F.col("html")).alias("s"))
    ids = F.filter(F.transform("s", lambda x: x["token_id"]), lambda x: x.isNotNull())
    texts = F.filter(F.transform("s", lambda x: x["text"]), lambda x: x.isNotNull())
    return d.select("page_id", F.size(ids).cast("long").alias("n_tokens"), F.size(texts).cast("long").alias("n_texts"), show(ids).alias("token_ids"), md5_list(texts).alias("texts_md5"))


# == encode ==

_DOCS = oracles.ids_cte("documents", "doc_id")
_FUSED = oracles.ids_cte("documents", "doc_id", fused=True)
_BENCH = oracles.ids_cte("benchmark", "item_id")
_N = len(toy.vocab())


def _benchmark(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", tok(**how).encode("text").alias("ids"))


@query(f"WITH {_DOCS} SELECT doc_id, len(ids) AS n_tokens, md5({SQL_SHOW.format('ids')}) AS ids_md5 FROM enc")
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", tok().encode("text").alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(show(F.col("ids"))).alias("ids_md5"))


@query(f"WITH {_FUSED} SELECT doc_id, len(ids) AS n_tokens, md5({SQL_SHOW.format('ids')}) AS ids_md5 FROM enc")
def encode_fused_ignore_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tok(fused=True, pattern=oracles.SIMPLE)
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", t.encode("text").alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(show(F.col("ids"))).alias("ids_md5"))


@query(f"WITH {_DOCS} SELECT lang, sum(len(ids))::BIGINT AS n_tokens FROM enc JOIN documents USING (doc_id) GROUP BY lang")
def token_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok().total_counts(documents(spark, sf_dir, "lang", "text"), "text", "lang")


@query(ORACLES["token_count_by_lang"])
def token_count_set_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces are counted per language; a language's distinct pieces are encoded once."""
    return tok().token_counts(documents(spark, sf_dir, "lang", "text"), "text", "lang")


@query(f"WITH {_DOCS} SELECT quality, toxic, count(*) AS n_docs, sum(len(ids))::BIGINT AS n_tokens FROM enc JOIN labels USING (doc_id) GROUP BY quality, toxic")
def token_count_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id").select("quality", "toxic", tok().count("text").alias("n"))
    return d.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))


@query(f"WITH {_DOCS} SELECT token_id, count(*) AS n FROM (SELECT unnest(ids)::INT AS token_id FROM enc) GROUP BY token_id ORDER BY n DESC, token_id LIMIT 50")
def token_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok().token_frequencies(documents(spark, sf_dir, "text"), "text").orderBy(F.desc("n"), "token_id").limit(50)


@query(f"""WITH {oracles.ids_cte("(SELECT page_id, unnest(range(len(g))) AS k, unnest(g) AS text, m FROM (SELECT page_id, regexp_split_to_array(html, '</title>|<title>|</p>|<p>') AS g, regexp_extract_all(html, '</title>|<title>|</p>|<p>') AS m FROM pages))", "page_id, k").replace("s.page_id, k,", "s.page_id, s.k, s.m,").replace("GROUP BY page_id, k)", "GROUP BY page_id, k)")}
SELECT page_id, md5({SQL_SHOW.format(f"flatten(list(list_concat(ids, CASE WHEN k < len(m) THEN [{_N} + list_position(['<p>', '</p>', '<title>', '</title>'], m[k + 1]) - 1] ELSE [] END) ORDER BY k))")}) AS ids_md5
FROM enc GROUP BY page_id""")
def encode_added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(show(tok(added=True).encode("html"))).alias("ids_md5"))


@query(f"WITH {_BENCH.replace('coalesce(text', 'nfc_normalize(coalesce(text')} SELECT item_id, {SQL_SHOW.format('ids')} AS ids FROM enc".replace("nfc_normalize(coalesce(text, '')", "nfc_normalize(coalesce(text, ''))"))
def encode_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir, nfc=True).select("item_id", show(F.col("ids")).alias("ids"))


@query(f"WITH {_DOCS} SELECT doc_id, md5(text) AS text_md5, len(ids) AS n_tokens FROM enc JOIN documents USING (doc_id)")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", tok().encode("text").alias("ids"))
    # else encoding is chained to decoding in one worker, and done again for the number of ids
    apart = F.concat("ids", F.array().cast("array<int>"))
    return d.select("doc_id", F.md5(tok().decode(apart)).alias("text_md5"), F.size("ids").cast("long").alias("n_tokens"))


@query("SELECT item_id, md5(text) AS skipped_md5, md5('<|start|>' || text || '<|stop|>') AS shown_md5 FROM benchmark")
def decode_skip_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tok(template=True)
    d = table(spark, sf_dir, "benchmark").select("item_id", t.encode("text", True).alias("ids"))
    return d.select("item_id", F.md5(t.decode("ids", True)).alias("skipped_md5"), F.md5(t.decode("ids")).alias("shown_md5"))


@query("SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def decode_token_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark").select("item_id", tok().pieces("text").alias("tokens"))
    return d.select("item_id", F.md5(tok().decode_tokens("tokens")).alias("text_md5"))


# == post-processing and shaping ==


@query(f"WITH {_BENCH} SELECT item_id, {SQL_SHOW.format(f'list_concat([{_N}], ids, [{_N + 1}])')} AS ids, 2 AS n_special FROM enc")
def template_special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tok(template=True)
    return table(spark, sf_dir, "benchmark").select("item_id", show(t.encode("text", True)).alias("ids"), F.lit(t.num_special_tokens_to_add()).alias("n_special"))


@query(f"WITH {_BENCH} SELECT item_id, {SQL_SHOW.format('ids[1:20]')} AS ids FROM enc")
def truncate_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).select("item_id", show(shape.cut(F.col("ids"), 20)).alias("ids"))


@query(f"WITH {_BENCH} SELECT item_id, {SQL_SHOW.format('ids[greatest(len(ids) - 20, 0) + 1:]')} AS ids FROM enc")
def truncate_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).select("item_id", show(shape.cut(F.col("ids"), 20, "left")).alias("ids"))


def _padded(spark: SparkSession, sf_dir: str, p: Padding) -> DataFrame:
    e = shape.padded(shape.encoding(F.col("ids")), p)
    d = _benchmark(spark, sf_dir).select("item_id", e.alias("e"))
    return d.select("item_id", show(F.col("e.ids")).alias("ids"), show(F.col("e.attention_mask")).alias("mask"), show(F.col("e.type_ids")).alias("type_ids"))


def _pad_sql(target: str, left: bool) -> str:
    more = lambda v: f"list_transform(range(greatest({target} - len(ids), 0)), lambda i: {v})"
    side = lambda a, v: SQL_SHOW.format(f"list_concat({more(v)}, {a})" if left else f"list_concat({a}, {more(v)})")
    return f"WITH {_BENCH} SELECT item_id, {side('ids', 7)} AS ids, {side('list_transform(ids, lambda i: 1)', 0)} AS mask, {side('list_transform(ids, lambda i: 0)', 1)} AS type_ids FROM enc"


add("pad_right", lambda s, d: _padded(s, d, Padding(length=160, pad_id=7, pad_type_id=1)), _pad_sql("160", False))
add("pad_left", lambda s, d: _padded(s, d, Padding(length=160, pad_id=7, pad_type_id=1, direction="left")), _pad_sql("160", True))
add("pad_multiple", lambda s, d: _padded(s, d, Padding(length=100, pad_id=7, pad_type_id=1, pad_to_multiple_of=64)), _pad_sql("(ceil(greatest(100, len(ids)) / 64)::INT * 64)", False))


@query(f"""
WITH {_BENCH}, b AS (SELECT item_id, item_id // 8 AS batch, ids[1:100] AS ids FROM enc), l AS (SELECT batch, max(len(ids)) AS longest FROM b GROUP BY batch)
SELECT item_id, batch, longest AS width, len(ids) AS n_real, {SQL_SHOW.format('list_concat(ids, list_transform(range(longest - len(ids)), lambda i: 0))')} AS ids FROM b JOIN l USING (batch)
""")
def batch_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tok().with_truncation(100).with_padding(Padding())
    d = table(spark, sf_dir, "benchmark").select("item_id", "text", F.expr("item_id div 8").alias("batch"))
    e = t.encode_batches(d, "text", "batch")
    real = F.aggregate("encoding.attention_mask", F.lit(0), lambda a, x: a + x)
    return e.select("item_id", "batch", F.size("encoding.ids").cast("long").alias("width"), real.cast("long").alias("n_real"), show(F.col("encoding.ids")).alias("ids"))


@query(f"WITH {_BENCH} SELECT item_id // 4 AS batch, count(*) AS n_sequences, sum(len(ids))::BIGINT AS n_ids, md5({SQL_SHOW.format('flatten(list(ids ORDER BY item_id))')}) AS ids_md5 FROM enc GROUP BY batch")
def encoding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark").select("item_id", F.expr("item_id div 4").alias("batch"), tok().encoding("text").alias("e"))
    m = shape.merged(d, "e", "item_id", "batch")
    return m.select("batch", F.col("e.n_sequences").cast("long").alias("n_sequences"), F.size("e.ids").cast("long").alias("n_ids"), F.md5(show(F.col("e.ids"))).alias("ids_md5"))


@query(f"WITH {_BENCH} SELECT item_id, {SQL_SHOW.format('list_resize(flatten(list_transform(range(ceil(300 / len(ids))::INT), lambda i: ids)), 300)')} AS ids FROM enc")
def adjust_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).select("item_id", show(shape.fitted(F.col("ids"), 300)).alias("ids"))


@query(f"WITH {_DOCS}, {_FUSED.replace('voc(', 'voc2(').replace('JOIN voc ', 'JOIN voc2 ').replace('cut AS', 'cut2 AS').replace('FROM cut)', 'FROM cut2)').replace('pc AS', 'pc2 AS').replace('FROM pc)', 'FROM pc2)').replace('dp AS', 'dp2 AS').replace('FROM dp ', 'FROM dp2 ').replace('pid AS', 'pid2 AS').replace('FROM pc JOIN pid ', 'FROM pc2 JOIN pid2 ').replace('agg AS', 'agg2 AS').replace('JOIN agg ', 'JOIN agg2 ').replace('enc AS', 'enc2 AS')} SELECT doc_id, len(list_filter(range(1, greatest(len(a.ids), len(b.ids)) + 1), lambda i: a.ids[i] IS DISTINCT FROM b.ids[i])) AS n_mismatched FROM enc a JOIN enc2 b USING (doc_id)")
def mismatch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tok(), tok(fused=True, pattern=oracles.SIMPLE)
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", a.encode("text").alias("a"), b.encode("text").alias("b"))
    return d.select("doc_id", shape.mismatches(F.col("a"), F.col("b")).cast("long").alias("n_mismatched"))


@query(f"WITH {_BENCH} SELECT item_id, {SQL_SHOW.format('ids[1:30]')} AS ids, {SQL_SHOW.format('list_transform(ids[1:30], lambda i: 1)')} AS mask, 1 AS n_sequences FROM enc")
def encoding_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shape.encoding_cut(shape.encoding(F.col("ids")), 30)
    d = _benchmark(spark, sf_dir).select("item_id", e.alias("e"))
    return d.select("item_id", show(F.col("e.ids")).alias("ids"), show(F.col("e.attention_mask")).alias("mask"), "e.n_sequences")


@query("SELECT item_id, 0 AS n_pieces, '' AS ids, 0 AS n_tokens, '' AS back FROM benchmark")
def empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tok()
    d = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 0).alias("text"))
    return d.select("item_id", F.size(t.pieces("text")).alias("n_pieces"), show(t.encode("text")).alias("ids"), t.count("text").alias("n_tokens"), t.decode(t.encode("text")).alias("back"))


@query(f"SELECT p_partkey, array_to_string({oracles.classic_pieces("' ' || p_name")}, '|') AS pieces FROM part")
def prefix_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No name begins with a space, so one is put before each."""
    p = ByteLevel(True)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(p.raw_column(F.col("p_name")), "|").alias("pieces"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '[aeiou]+|[^aeiou]+'), '|') AS pieces FROM part")
def split_where_nothing_may_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern with empty matches: these are passed over, so gaps stay whole."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(Split("[aeiou]*", "Isolated").column(F.col("p_name")), "|").alias("pieces"))


@query(f"WITH {_BENCH} SELECT item_id, {SQL_SHOW.format('ids')} AS ids, true AS same FROM enc")
def saved_and_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer from its JSON and one from its pickle encode as it did itself."""
    a, b = Tokenizer.from_json(tok().to_json()), pickle.loads(pickle.dumps(tok()))
    d = table(spark, sf_dir, "benchmark").select("item_id", a.encode("text").alias("ids"), b.encode("text").alias("b"))
    return d.select("item_id", show(F.col("ids")).alias("ids"), (F.col("ids") == F.col("b")).alias("same"))


# == vocabulary ==


@query("SELECT token, id, special, added FROM (VALUES " + ", ".join(f"({oracles.quoted(t)}, {i}, {i >= _N and dict((c, s) for c, s in toy.ADDED).get(t, False)}, {i >= _N})" for t, i in [*toy.vocab().items(), *((c, _N + k) for k, (c, _) in enumerate(toy.ADDED))]) + ") t(token, id, special, added)")
def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok(added=True).vocab_table(spark).select("token", F.col("id").cast("int").alias("id"), "special", "added")


@query(f"SELECT {_N + len(toy.ADDED)} AS vocab_size, {len(toy.MERGES)} AS n_merges, {_N} AS model_size")
def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tok(added=True)
    m = t.merges_table(spark).agg(F.count(F.lit(1)).cast("int").alias("n_merges"))
    return m.select(F.lit(t.vocab_size()).alias("vocab_size"), "n_merges", F.lit(len(t.engine.model.tokens)).alias("model_size"))


@query(f"WITH {_BENCH}, hexed AS (SELECT item_id, unnest(ids) AS id FROM enc) SELECT item_id, count(*) AS n_tokens, count(*) FILTER (id >= 256) AS n_merged FROM hexed GROUP BY item_id")
def id_to_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tok().vocab_table(spark).select(F.col("id").cast("int").alias("token_id"), "token")
    d = _benchmark(spark, sf_dir).select("item_id", F.explode("ids").alias("token_id")).join(F.broadcast(v), "token_id")  # a toy vocabulary
    return d.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.length("token") > 1).alias("n_merged"))


@query("SELECT unnest(['tionally']) AS token")
def orphan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tok().orphans()], "token string")


@query("SELECT * FROM (VALUES ('normalizer', 'NFC'), ('pre_tokenizer', 'ByteLevel'), ('pre_tokenizer', 'Sequence'), ('pre_tokenizer', 'Split'), ('decoder', 'ByteLevel'), ('model', 'BPE'), ('post_processor', 'TemplateProcessing')) t(stage, kind)")
def step_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = (tok(nfc=True), tok(fused=True, pattern=oracles.SIMPLE), tok(template=True))
    return spark.createDataFrame(sorted({k for t in toks for k in t.step_kinds()}), "stage string, kind string")


# == analytics ==


@query(f"""
WITH p AS (SELECT unnest({oracles.classic_pieces('text')}) AS piece FROM documents), w AS (SELECT piece, strlen(piece) AS w FROM p),
s AS (SELECT list(w ORDER BY w) AS v FROM w)
SELECT count(*) AS total, count(DISTINCT piece) AS distinct_pieces, sum(w)::BIGINT AS n_bytes, count(*) FILTER (w > 50) AS long_pieces, coalesce(sum(w) FILTER (w > 50), 0)::BIGINT AS long_bytes,
    count(*) FILTER (w <= 4) AS short_pieces, max(w) AS longest, any_value(v[floor(len(v) * 0.5)::BIGINT + 1]) AS median, any_value(v[floor(len(v) * 0.95)::BIGINT + 1]) AS p95, any_value(v[floor(len(v) * 0.99)::BIGINT + 1]) AS p99
FROM w, s
""")
def piece_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "text").select(F.explode(ByteLevel(False).raw_column(F.col("text"))).alias("piece"))
    return analytics.piece_stats(d.groupBy("piece").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_DOCS} SELECT count(*) AS n_inputs, sum(strlen(text))::BIGINT AS n_bytes, sum(len(ids))::BIGINT AS n_tokens FROM enc JOIN documents USING (doc_id)")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "text").select("text", tok().count("text").alias("n"))
    return analytics.totals(d, "text", "n")


@query(f"""
WITH {_DOCS}, n AS (SELECT len(ids) AS n FROM enc)
SELECT CASE {' '.join(f'WHEN n <= {e} THEN {e}' for e in analytics.BUCKETS)} END AS bucket, count(*) AS n, sum(n)::BIGINT AS n_tokens FROM n GROUP BY bucket
""".replace("AS bucket, count(*) AS n, sum(n)::BIGINT AS n_tokens FROM n GROUP BY bucket", "AS bucket, count(*) AS n, sum(n)::BIGINT AS n_tokens FROM n GROUP BY 1"))
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "text").select(tok().count("text").alias("len"))
    return analytics.length_buckets(d, "len")


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(count(value) / (sum(value) / 1000), 6) AS req_per_s FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analytics.latency(table(spark, sf_dir, "events"), "value")
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("mean_ms", "median_ms", "p99_ms", "req_per_s")])


@query("""
SELECT user_id, round(quantile_cont(value, 0.5) FILTER (event_type = 'click'), 6) AS baseline_p50, round(quantile_cont(value, 0.5) FILTER (event_type = 'error'), 6) AS other_p50
FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id
""")
def compared_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analytics.compared(table(spark, sf_dir, "events"), "event_type", "value", "click", "error", "user_id")
    return d.select("user_id", F.round("baseline_p50", 6).alias("baseline_p50"), F.round("other_p50", 6).alias("other_p50"))


@query("SELECT conv_id, md5(string_agg('[' || role || ']: ' || text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> '')) AS text_md5 FROM conversations GROUP BY conv_id")
def conversation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpora.flatten_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return d.select("conv_id", F.md5("text").alias("text_md5"))


@query("""
SELECT conv_id, md5(prompt) AS prompt_md5 FROM (SELECT conv_id, trim(arg_min(text, turn), ' ') AS prompt FROM conversations WHERE role IN ('human', 'user') AND text IS NOT NULL GROUP BY conv_id)
WHERE length(prompt) >= 20
""")
def first_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analytics.first_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", least=20)
    return d.select("conv_id", F.md5("prompt").alias("prompt_md5"))


@query(f"""
WITH {_BENCH}, b AS (SELECT item_id, ids, unnest([100, 200, 400]) AS bucket, unnest([50, 150, 300]) AS target FROM enc WHERE len(ids) > 0)
SELECT item_id, bucket, target, {SQL_SHOW.format('list_resize(flatten(list_transform(range(ceil(target / len(ids))::INT), lambda i: ids)), target)')} AS ids FROM b
""")
def bucket_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analytics.bucket_prompts(_benchmark(spark, sf_dir), tok(), "item_id", "ids", (100, 200, 400))
    return d.select("item_id", "bucket", "target", show(F.col("ids")).alias("ids"))


@query("SELECT model, batch, length FROM (SELECT unnest(['a', 'b']) AS model), (SELECT unnest([1, 8, 32]) AS batch), (SELECT unnest([512, 1024]) AS length)")
def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = analytics.matrix(spark, model=["a", "b"], batch=[1, 8, 32], length=[512, 1024])
    return m.select("model", F.col("batch").cast("int").alias("batch"), F.col("length").cast("int").alias("length"))


# == SQL functions and streaming ==


@query(f"WITH {_BENCH} SELECT item_id, {SQL_SHOW.format('ids')} AS ids, len(ids)::INT AS n, md5(text) AS back_md5 FROM enc JOIN benchmark USING (item_id)")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfun.register(spark, tok(), "toy")
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("toy_benchmark")
    return spark.sql("""
        SELECT item_id, array_join(CAST(toy_encode(text) AS ARRAY<STRING>), ' ') AS ids, toy_count(text) AS n, md5(toy_decode(toy_encode(text))) AS back_md5 FROM toy_benchmark
    """)


@query(f"WITH {_BENCH} SELECT item_id, pos::INT AS pos, id::INT AS token_id FROM (SELECT item_id, unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM enc)")
def sql_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqlfun.register(spark, tok(), "toy")
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("toy_benchmark")
    return spark.sql("SELECT item_id, pos, token_id FROM toy_benchmark, LATERAL toy_explode(text)")


def _stream_folder(spark: SparkSession) -> str:
    """A new folder in shared storage; a temporary one only without a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tokenloom-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT item_id AS stream_id, md5(substr(text, 1 + length(text) // 2)) AS text_md5 FROM benchmark")
def stream_decode_after_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of a text is the stream's prompt: only the rest is emitted."""
    folder = _stream_folder(spark)
    half = F.expr("length(text) div 2")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("stream_id"), tok().encode(F.col("text").substr(F.lit(1), half)).alias("prompt"), tok().encode(F.col("text").substr(half + 1, F.length("text"))).alias("ids"))
    b.select("stream_id", "prompt", F.posexplode("ids").alias("seq", "token_id")).withColumn("seq", F.col("seq").cast("long")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("stream_id long, prompt array<int>, seq long, token_id int").parquet(f"{folder}/in")
    return _streamed(spark, folder, decode_stream(stream, tok(), prompt="prompt"))


@query("SELECT item_id AS stream_id, md5(text) AS text_md5 FROM benchmark")
def stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token streams decoded step by step with state; the chunks of a stream make its text."""
    folder = _stream_folder(spark)
    ids = _benchmark(spark, sf_dir).select(F.col("item_id").alias("stream_id"), F.posexplode("ids").alias("seq", "token_id"))
    ids.select("stream_id", F.col("seq").cast("long").alias("seq"), "token_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("stream_id long, seq long, token_id int").parquet(f"{folder}/in")
    return _streamed(spark, folder, decode_stream(stream, tok()))


def _streamed(spark: SparkSession, folder: str, out: DataFrame) -> DataFrame:
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    chunks = spark.read.schema("stream_id long, seq long, chunk string").parquet(f"{folder}/out")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "")
    return chunks.groupBy("stream_id").agg(F.md5(text).alias("text_md5"))


# == a public vocabulary of full size ==


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def full(path: str | None = None) -> Tokenizer:
    """Byte-level BPE of 50,000 merges; the file stays where it is."""
    return Tokenizer.from_file(path or os.environ.get("TOKENLOOM_TOKENIZER") or public_tokenizer())


@query()
def encode_full_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", full().encode("text").alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(show(F.col("ids"))).alias("ids_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def decode_full_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text").select("doc_id", full().encode("text").alias("ids"))
    return d.select("doc_id", F.md5(full().decode("ids")).alias("text_md5"))


@query()
def token_count_full_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full().total_counts(documents(spark, sf_dir, "lang", "text"), "text", "lang")
