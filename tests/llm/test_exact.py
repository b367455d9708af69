import numpy as np
import pytest

import brute
from rows import make
from tokenloom.llm import common, exact
from tokenloom.llm.fuse import FuseFilter


def want(rows):
    by = {}
    for i, t in rows:
        by.setdefault(brute.normal(t), []).append(i)
    return {(i, min(by[brute.normal(t)]), len(by[brute.normal(t)]), i == min(by[brute.normal(t)]), brute.sha(brute.normal(t))) for i, t in rows}


@pytest.mark.parametrize("how", [{}, {"shard_keys": 7}, {"digest_size": 1}])
def test_groups(docs, texts, how):
    """With one-byte digests most buckets hold unequal texts, which the byte check takes apart."""
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.groups(docs, **how).collect()}
    assert got == want(list(enumerate(texts)))


def test_unique_keeps_rows_whole(docs, texts):
    got = exact.unique(docs)
    assert got.columns == docs.columns
    kept = {i for i, _, _, k, _ in want(list(enumerate(texts))) if k}
    assert {r.doc_id: r.text for r in got.collect()} == {i: texts[i] for i in kept}


def test_null_ids_and_repeated_rows(odd, texts, empty):
    g = exact.groups(odd).collect()
    assert len(g) == odd.count()
    by = {}
    for r in g:
        by.setdefault(r.text_sha256, []).append(r)
    for rs in by.values():
        assert sum(r.kept for r in rs) == 1 and {r.group_size for r in rs} == {len(rs)}
    left = exact.unique(odd).collect()
    assert sorted(brute.normal(r.text) for r in left) == sorted({brute.normal(r.text) for r in odd.collect()})
    assert exact.groups(empty).collect() == [] and exact.unique(empty).collect() == []


def test_a_hot_group(spark, monkeypatch):
    """Beyond the broadcast limit, hot keys are broadcast and the rest is shuffled."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    texts = ["one long copy of a text"] * 400 + [f"text {i // 2}" for i in range(60)] + ["other"]
    r = exact.groups(make(spark, texts)).collect()
    assert {(x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in r} == want(list(enumerate(texts)))


def test_an_id_with_two_texts(spark):
    d = make(spark, ["hello world", "hello world", "other", "hello  world", "x"], [1, 2, 2, 3, 4])
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact.groups(d).collect()}
    h, o, x = (brute.sha(t) for t in ("hello world", "other", "x"))
    assert got == {(1, h): (1, 3, True), (2, h): (1, 3, False), (2, o): (2, 1, True), (3, h): (1, 3, False), (4, x): (4, 1, True)}
    assert sorted((r.doc_id, r.text) for r in exact.unique(d).collect()) == [(1, "hello world"), (2, "other"), (4, "x")]


def test_long_texts(spark):
    long = "many words " * 300_000
    texts = [long, "a", long.replace(" ", "\t"), long + "x", "a"]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.groups(make(spark, texts)).collect()}
    assert got == want(list(enumerate(texts)))


def test_stored_snapshots(spark, docs, texts):
    rows = exact.digests(exact.standing(docs))
    stored = []
    for k in (0, 1):
        folder = common.shared_dir(spark)
        exact.Snapshot.build(rows.where(f"doc_id % 3 = {k}"), 7, folder)
        stored.append(exact.Snapshot.open(spark, folder))
    batch = docs.where("doc_id % 3 = 2")
    left = exact.new_texts(batch, stored)
    known = {brute.normal(t) for i, t in enumerate(texts) if i % 3 < 2}
    first = {}
    for i, t in enumerate(texts):
        if i % 3 == 2 and brute.normal(t) not in known:
            first.setdefault(brute.normal(t), i)
    assert sorted(r.doc_id for r in left.collect()) == sorted(first.values()) and left.columns == docs.columns


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    f = FuseFilter.from_bytes(FuseFilter.build(np.concatenate([keys, keys])).to_bytes())
    assert f.contains(keys).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
    assert f.contains(others).mean() < 0.01
    if n > 1000:
        assert 8 * len(f.to_bytes()) / n < 10.5
