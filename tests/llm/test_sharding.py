import zlib
from collections import defaultdict

import numpy as np

from tokenloom.llm import sharding as s
from tokenloom.llm.common import shared_dir


def test_rows(docs, texts):
    rows = s.shard(docs).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_bytes_are_even(spark, sf_dir):
    rows = s.shard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in rows]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * max(sizes)


def test_the_map_is_edited(spark, docs):
    rows = s.shard(docs).collect()
    assert {r.map_version for r in rows} == {2}
    sized = s.sized(docs).collect()
    sizes = s.slot_sizes(s.sized(docs))
    first = s.SlotMap.dealt(shared_dir(spark), s.SLOTS, 8)
    second = first.resized(8, sizes)
    assert (second.slot_to_shard[[r.virtual_slot for r in rows]] == [r.shard for r in rows]).all() and len(sized) == len(rows)
    moved = second.slot_to_shard != first.slot_to_shard
    assert 0 < moved.sum() < s.SLOTS / 8 and (sizes[moved] > 0).all()
    assert (s.SlotMap.load(first.folder, 1).slot_to_shard == first.slot_to_shard).all()


def test_edges(odd, empty):
    assert s.shard(empty).collect() == []
    assert s.shard(odd).count() == odd.count()


def test_versions(spark):
    sizes = np.random.default_rng(1).integers(1, 10_000, 4096)
    m = s.SlotMap.create(shared_dir(spark), sizes, 8)
    load = lambda x: np.bincount(x.slot_to_shard, x.sizes, x.shards)
    up = m.resized(9)
    moved = up.slot_to_shard != m.slot_to_shard
    assert (up.slot_to_shard[moved] == 8).mean() > 0.95 and moved.mean() < 0.15
    down = up.resized(5)
    for x in (m, up, down):
        assert np.ptp(load(x)) < 0.01 * load(x).mean()
        y = s.SlotMap.load(x.folder, x.version)
        assert (y.slot_to_shard == x.slot_to_shard).all() and y.shards == x.shards
    assert (m.version, up.version, down.version) == (1, 2, 3)
