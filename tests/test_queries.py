import pytest

import __spark_entry__ as entry
from compare import oracle_rows, same_rows
from tokenloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf_dir, name):
    columns, rows = oracle_rows(sf_dir, catalogue.ORACLES[name])
    assert rows
    same_rows(catalogue.QUERIES[name](spark, sf_dir), columns, rows)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and all(r.n_tokens > 0 for r in rows)


def test_every_query_is_registered():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_full_vocabulary_against_the_library(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(catalogue.public_tokenizer())
    tok = catalogue.full()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("lang", "text", tok.encode("text").alias("ids"), tok.count("text").alias("n")).collect()
    counts = {}
    for r in rows:
        assert r.ids == lib.encode(r.text, add_special_tokens=False).ids
        assert r.n == len(r.ids)
        counts[r.lang] = counts.get(r.lang, 0) + r.n
    assert {r.lang: r.n_tokens for r in catalogue.token_count_full_vocabulary(spark, sf_dir).collect()} == counts
    by_set = tok.token_counts(docs, "text", "lang").collect()
    assert {r.lang: r.n_tokens for r in by_set} == counts
