import zlib

import numpy as np
import pytest

from tokenloom.llm import wavelet as w
from tokenloom.llm.common import read_file, shared_dir
from tokenloom.llm.tokencache import default_path


def library_ids(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_path())
    return [np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in rows]


@pytest.mark.parametrize("shard_tokens", [1 << 24, 500])
def test_files(spark, docs, texts, shard_tokens):
    files = w.write_tokens(docs, shared_dir(spark) + "/t", shard_tokens=shard_tokens)
    rows = w.read_tokens(files).orderBy("doc_id").collect()
    ids = library_ids(list(enumerate(texts)))
    at = 0
    for i, (r, x) in enumerate(zip(rows, ids, strict=True)):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    n = files.count()
    assert n == 1 if shard_tokens > 500 else n > 5
    whole = np.concatenate(ids)
    for f in files.collect()[:2]:
        s = w.Shard.from_bytes(read_file(f.path))
        part = whole[s.base : s.base + s.matrix.n]
        assert (s.matrix.decode() == part).all()
        assert s.matrix.access(len(part) - 1) == 2 and s.matrix.count(2) == (part == 2).sum()


@pytest.mark.parametrize("shard_tokens", [1 << 23, 100])
def test_edges(spark, odd, empty, shard_tokens):
    assert w.round_trip(empty).collect() == []
    odd = odd.unionByName(odd.where("doc_id is null or doc_id = 1")).unionByName(odd.where("doc_id is null or doc_id = 1"))
    rows = sorted(w.read_tokens(w.write_tokens(odd, shared_dir(spark), shard_tokens=shard_tokens)).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    ids = [r.doc_id for r in rows]
    known = [i for i in ids if i is not None]
    assert known == sorted(known) and ids[len(known) :] == [None] * (len(ids) - len(known)) and len(ids) == odd.count()


@pytest.mark.parametrize("n, top", [(1, 1), (3, 70_000), (513, 4), (5000, 300)])
def test_matrix(n, top):
    a = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    m = w.WaveletMatrix.build(a)
    assert (m.decode() == a).all()
    for i in {0, n // 2, n - 1}:
        assert m.access(i) == a[i]
    for t in {int(a[0]), int(a[-1]), 3, 10**6}:
        where = np.flatnonzero(a == t)
        assert m.count(t) == len(where)
        assert m.rank(t, n // 2) == (a[: n // 2] == t).sum()
        assert m.count(t, n // 3, n // 2) == (a[n // 3 : n // 2] == t).sum()
        for k in range(0, len(where), max(1, len(where) // 7)):
            assert m.select(t, k) == where[k]
        with pytest.raises(IndexError):
            m.select(t, len(where))
