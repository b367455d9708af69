import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from rows import make

from tokenloom.llm import packing
from tokenloom.llm import textkernel as tk
from tokenloom.llm.tokencache import WordIds, default_path


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def check(rows, docs, lib, window):
    """Pieces cover every id once, sequences are gapless, all but one is full."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, ps in by_doc.items():
        ids = np.array(lib.encode(docs[i] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    short = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += at < window
    assert short <= 1


@pytest.mark.parametrize("window", [2048, 64])
def test_pieces(docs, texts, lib, window):
    check(packing.pack(docs, window=window).collect(), dict(enumerate(texts)), lib, window)


def test_edges(odd, empty, lib):
    assert packing.pack(empty).collect() == []
    rows = packing.pack(odd).collect()
    total = sum(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r.length for r in rows) == total


def test_one_length_holds_a_third():
    rng = np.random.default_rng(3)
    hist = np.zeros(2048, np.int64)
    hist[1300] = 50_000
    hist[1:2048] += rng.integers(0, 60, 2047)
    plan = packing.Plan(hist)
    total = int((hist * np.arange(2048)).sum())
    assert plan.sequences == -(-total // 2048)
    runs = plan.table()
    assert sum((r[3] - r[2]) * r[4] for r in runs.tolist()) == total


def test_least_squares_reaches_the_histogram():
    hist = np.zeros(2048, np.int64)
    hist[[500, 1548, 1000, 48]] = [70, 70, 30, 30]
    cols = packing.combinations(hist, 2048)
    x = packing.nnls(cols, hist.astype(float))
    fit = np.bincount(cols.ravel(), np.repeat(x, 3), 2048)
    fit[0] = 0
    assert (x >= 0).all() and np.abs(fit - hist)[[500, 1548]].max() < 1


def test_cached_ids_are_the_librarys(lib):
    e = WordIds(default_path(), pieces=50)
    texts = ["Hello  World 123 it's", "ÀÉÎ naïve STRASSE", "汉字 mixed汉字text", "<|startoftext|>x a<|endoftext|>", "été", "a b c", "", "KK ſ İ", "!!!a-b_c...", "x" * 400]
    for t in texts:
        assert np.frombuffer(e.encode(t.encode()), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_chunks_of_mixed_texts_encode_as_the_library_does(lib):
    rng = random.Random(1)
    letters = list("abST'rRevLlDdmM019.,!<|>é É×÷ñ́ſİß\n\t\x1c  漢字“”—")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    e, at = WordIds(default_path(), pieces=64, words=20), 0
    for ch in tk.chunks(pa.array(texts), 1 << 12):
        ids, offs = e.encode_chunk(ch)
        for s, z in zip(offs[:-1], offs[1:]):
            assert ids[s:z].tolist() == lib.encode(texts[at], add_special_tokens=False).ids, texts[at]
            at += 1
    assert at == len(texts)


def test_a_text_longer_than_a_chunk(spark, lib):
    long = " ".join(f"Word{i % 977}, it's" for i in range(150_000)) + " " + "ab" * 300_000
    rows = packing.pack(make(spark, [long, "short", None])).collect()
    check(rows, {0: long, 1: "short", 2: None}, lib, 2048)
