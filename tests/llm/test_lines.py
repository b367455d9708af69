import numpy as np
import pytest

import brute
from rows import make
from tokenloom.llm import linededup as l
from tokenloom.llm import places


@pytest.mark.parametrize("how", [{}, {"shard_keys": 3}, {"shard_keys": 40}])
def test_against_brute_force(docs, texts, how):
    want = brute.kept_lines(list(enumerate(texts)))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in l.dedup(docs, ["doc_id"], False, **how).collect()}
    assert got == {i: (a, b, brute.sha(c)) for i, (a, b, c) in want.items()}
    assert sum(b for _, b, _ in want.values()) > 10


def test_texts_with_all_columns(docs, texts):
    rows = l.dedup(docs.select("doc_id", "text", "lang", "size"), ["doc_id", "text", "lang", "size"], True)
    want = brute.kept_lines(list(enumerate(texts)))
    assert {r.doc_id: r.text for r in rows.collect()} == {i: c for i, (_, _, c) in want.items()}


def test_edges(odd, empty, texts):
    assert l.dedup(empty, ["doc_id"], False).collect() == []
    rows = l.dedup(odd, ["doc_id"], False).collect()
    assert len(rows) == odd.count()
    long = [r for r in rows if r.doc_id is None and r.n_lines > 1]
    assert long and all(r.n_dropped > 0 for r in long)  # document 0 holds those lines


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 100_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    h = l.PerfectHash.build(keys)
    assert sorted(h.lookup(keys)) == list(range(len(keys)))
    prints = rng.integers(0, 1 << 63, len(keys), dtype=np.uint64)
    own, count = np.arange(len(keys)), np.where(np.arange(len(keys)) % 3, 2, 300)
    more = [np.concatenate([x, x[:1]]) for x in (keys, count)]
    built = l.LineShard.build(more[0], np.concatenate([prints, prints[:1] + np.uint64(1)]), more[1], np.concatenate([own, own[:1] - 7]))
    s = l.LineShard.from_bytes(built.to_bytes())
    found, owner = s.probe(keys, prints)
    assert (found == np.minimum(count, 255)).all() and (owner == own).all()
    found, owner = s.probe(keys[:1], prints[:1] + np.uint64(1))
    assert (found > 1).all() and (owner == -7).all()
    assert s.prints.itemsize == 2 and s.counts.itemsize == 1


def test_a_block_may_span_files_and_a_file_blocks(spark, texts, tmp_path):
    make(spark, texts).coalesce(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert places.standing(docs) is docs and places.standing(docs.unionByName(docs)) is not docs
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in l.dedup(docs, ["doc_id"], False, block=4).collect()}
    assert got == {i: (a, b, brute.sha(c)) for i, (a, b, c) in brute.kept_lines(list(enumerate(texts))).items()}


def test_long_texts_hot_lines_and_clashing_names(spark):
    hot = "this line is in every document"
    long = "\n".join(f"line number {i} of many" for i in range(100_000)) + "\n" + "x" * 2_000_000
    texts = [long, hot + "\n" + long, *[f"{hot}\nown line of {i}" for i in range(3000)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = rows.selectExpr("*", "'a' AS `odd``name`", "1 AS n_lines_", "2 AS __x_block")
    out = l.dedup(rows, ["doc_id", "text", "odd`name", "__x_block"], True)
    assert out.columns == ["doc_id", "odd`name", "__x_block", "n_lines", "n_dropped", "text"]
    want = brute.kept_lines(list(enumerate(texts)))
    assert {r.doc_id: r.text for r in out.collect()} == {i: c for i, (_, _, c) in want.items()}
