import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa

from tokenloom.llm import pieces as p
from tokenloom.llm import textkernel as tk

ODD = ["", "▁ ▁", " a  b ", "\n\t\r", "日本語🎉 x", "\x00nul", "<0x0A><s>", "x" * 3000, "é café", "    ", "a\nb"]


def sampled(texts, keys, alpha=1.0):
    m = p.piece_model(p.default_path())
    out = []
    for ch in tk.chunks(pa.array(texts), p.CHUNK):
        ids, offs = p.sample_chunk(m, ch, keys[ch.lo : ch.hi], alpha)
        out += [ids[s:e] for s, e in zip(offs, offs[1:])]
    return m, out


def test_lossless(docs, texts):
    back = {r.doc_id: r.text for r in p.decode(p.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    m, out = sampled(ODD, np.arange(len(ODD), dtype=np.uint64))
    assert [p.decode_ids(m, x).decode() for x in out] == ODD


def test_library_decodes_the_same():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=p.default_path())
    plain = [t for t in ODD if "▁" not in t and t.strip(" ") == t and t]
    _, out = sampled(plain, np.arange(len(plain), dtype=np.uint64))
    assert [sp.decode(x.tolist()) for x in out] == plain


def every_path(m, text):
    """All segmentations of a short text by trying every substring, with their weights."""
    data = (" " + text).encode()
    by = {b: i for i, b in enumerate(m.bytes) if b and m.byte_ids[b[0]] != i}
    out = {}

    def go(at, path, w):
        if at == len(data):
            out[tuple(path)] = w
        for e in range(at + 1, len(data) + 1):
            if (i := by.get(data[at:e])) is not None:
                go(e, [*path, i], w + m.score[i])

    go(0, [], 0.0)
    total = math.log(sum(map(math.exp, out.values())))
    return {k: math.exp(w - total) for k, w in out.items()}


def test_samples_follow_the_path_weights():
    for text in ("these", "on it"):
        n = 20_000
        m, out = sampled([text] * n, tk.mix(np.arange(n, dtype=np.uint64)))
        got = Counter(tuple(x.tolist()) for x in out)
        want = every_path(m, text)
        assert set(got) <= set(want)
        for k, q in want.items():
            assert abs(got[k] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-4


def test_high_alpha_is_the_best_path():
    m, (best,) = sampled(["these"], np.zeros(1, np.uint64), alpha=200.0)
    want = every_path(m, "these")
    assert tuple(best.tolist()) == max(want, key=want.get)


def test_reproducible_in_any_partition(docs, texts, odd, empty):
    a = {(r.doc_id, r.n_pieces, r.ids_crc32, r.decoded_sha256) for r in p.digests(docs).collect()}
    assert a == {tuple(r) for r in p.digests(docs.repartition(7)).collect()}
    assert {d: s for d, _, _, s in a} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
    assert a != {tuple(r) for r in p.digests(docs, seed=1).collect()}
    assert p.digests(empty).collect() == [] and p.digests(odd).count() == odd.count()
    assert all(n == 0 for (d, n, _, _) in a if not texts[d])


def test_chunks_of_any_size():
    texts = ODD * 3
    keys = np.arange(len(texts), dtype=np.uint64)
    _, whole = sampled(texts, keys)
    m = p.piece_model(p.default_path())
    parts = [x for ch in tk.chunks(pa.array(texts), 1) for x in [p.sample_chunk(m, ch, keys[ch.lo : ch.hi], 1.0)[0]]]
    assert all((x == y).all() for x, y in itertools.zip_longest(whole, parts))
