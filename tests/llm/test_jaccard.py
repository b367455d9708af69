import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import brute
from rows import make
from tokenloom.llm import common
from tokenloom.llm import jaccard as j
from tokenloom.llm.components import components


def got(df):
    return {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in df.collect()}


def test_against_brute_force(docs, texts):
    assert got(j.similar(docs)) == brute.jaccard(list(enumerate(texts)))


def test_blocks_and_distributed_components(docs, texts):
    """Every group is split into blocks, and components are found by stars."""
    df = j.join(docs, block=200, one_task=0)
    assert got(df) == brute.jaccard(list(enumerate(texts)))


def test_many_near_copies_and_a_shared_passage(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    base = rng.choices(words, k=200)
    passage = rng.choices(words, k=60)
    texts = []
    for k in range(80):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(0, 14)):
            w[at] = rng.choice(words)
        texts.append(" ".join(w))
        texts.append(" ".join(rng.choices(words, k=60) + passage + rng.choices(words, k=rng.randint(0, 60))))
    texts += texts[:5]
    assert got(j.similar(make(spark, texts))) == brute.jaccard(list(enumerate(texts)))


def test_edges(odd, empty):
    assert j.similar(empty).collect() == []
    rows = j.similar(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.n_similar == 0 for r in rows if r.n_shingles == 0)
    assert any(r.doc_id is None and r.component_id == 0 for r in rows)


@pytest.mark.parametrize("how", [{}, {"block": 200, "one_task": 0}])
def test_other_texts_under_one_id(spark, how):
    rng = random.Random(8)
    base = [rng.choices([f"w{i}" for i in range(3000)], k=90) for _ in range(3)]
    near = lambda i, k: " ".join([*base[i][:-k], *[f"z{k}"] * k])
    texts = [near(0, 1), near(1, 1), near(0, 2), near(1, 2), near(0, 3), near(2, 1), near(2, 2)]
    ids = [5, 5, 7, 3, 9, 20, 20]
    rows = j.join(make(spark, texts, ids), **how).select("doc_id", "n_similar", "component_id").collect()
    assert sorted(map(tuple, rows)) == [(3, 1, 3), (5, 1, 3), (5, 2, 5), (7, 2, 5), (9, 2, 5), (20, 1, 20), (20, 1, 20)]


def test_one_of_each(docs, texts):
    kept = j.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, _, c) in brute.jaccard(list(enumerate(texts))).items() if c == i}
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in want}


def test_one_row_of_repeated_ones_stays(odd):
    rows = j.one_of_each(odd).collect()
    sets = [frozenset(brute.shingles(r.text)) for r in rows]
    assert len(set(sets) - {frozenset()}) == len([x for x in sets if x])
    assert len(rows) < odd.count()


def boilerplate(n, seed):
    """Texts of 60 shared and 100 own words (similarity 0.22), every tenth with a near copy."""
    rng = random.Random(seed)
    shared = " ".join(f"s{i}" for i in range(60))
    out = []
    for i in range(n):
        own = [f"o{seed}x{i}x{k}" for k in range(100)]
        out.append(shared + " " + " ".join(own))
        if i % 10 == 0:
            own[rng.randrange(100)] = "other"
            out.append(shared + " " + " ".join(own))
    return out


@pytest.mark.parametrize("n", [500, 1000])
def test_boilerplate_forms_no_group(spark, n):
    d = j.standing(make(spark, boilerplate(n, n)))
    schema = f"doc_id long, n long, sa long, sb long, bands array<long>, {j.FILE} long, {j.ROW} long"
    sets = j.written(j.placed(d, "doc_id", "text").mapInArrow(j._sets, schema), "sets")
    members, tokens = j.members_of(d, sets, j.classes_of(sets))
    groups = j.groups_of(tokens, 70)
    assert members.count() > n // 2  # the bands let them through
    sizes = [r["count"] for r in groups.groupBy("comp").count().collect()]
    assert sorted(sizes) == [2] * (n // 10)  # pairs to compare: one for each near copy
    assert sorted(r.n_similar for r in j.similar(d).collect()) == [0] * (n - n // 10) + [1] * (n // 5)


def test_beyond_the_broadcast_limit(docs, texts, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert got(j.join(docs, one_task=0)) == brute.jaccard(list(enumerate(texts)))


def test_a_text_longer_than_a_chunk(spark):
    long = " ".join(f"w{i}" for i in range(250_000))
    texts = [long, "a b c d", long + " more", None]
    assert got(j.similar(make(spark, texts))) == {0: (249_998, 1, 0), 1: (2, 0, 1), 2: (249_999, 1, 0), 3: (0, 0, 3)}


def test_bands_at_the_threshold():
    """Pairs of exactly 70 %: all 2,000 meet in a band."""
    rng = np.random.default_rng(11)
    sets, offs = [], [0]
    for _ in range(2000):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        for y in (x[:85], np.concatenate([x[:70], x[85:]])):
            sets.append(np.sort(y))
            offs.append(offs[-1] + len(y))
    k = j.band_keys(np.concatenate(sets), np.array(offs))
    assert (k[0::2] == k[1::2]).any(1).all()
    with pytest.raises(ValueError):
        j.join(None, percent=60)


def test_tree_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(150, 400), replace=False), rng.integers(1 << 62, 1 << 63, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(150)]
    n = np.array([len(s) for s in sets])
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 70 * (n[a] + n[b] - c)}
    side = np.arange(150) % 3 == 0
    for bits in (4096, 64):
        monkeypatch.setattr(j, "MAX_BITS", bits)
        pairs = j.links(sets, n, None, 70)
        assert {tuple(sorted(p)) for p in zip(*(x.tolist() for x in pairs))} == want and len(pairs[0]) == len(want)
        across = j.links(sets, n, side, 70)
        assert {tuple(sorted(p)) for p in zip(*(x.tolist() for x in across))} == {p for p in want if side[p[0]] != side[p[1]]}
    assert want


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    edges = [(i + 1, i) for i in range(10, 40)] + [(100, 200), (300, 200), (5, 5), (7, 100)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    roots = {r.node: r.root for r in components(df, one_task).collect()}
    assert all(roots[i] == 10 for i in range(10, 41)) and all(roots[i] == 7 for i in (7, 100, 200, 300)) and roots.get(5, 5) == 5


def traced(f):
    """MB that ``f`` holds at once."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("universe", [200, 8000])
def test_memory_of_a_large_group(universe):
    """2,500 near copies: each links with all others, and no list of these pairs is held."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 100, dtype=np.uint64)
    other = rng.integers(1 << 62, 1 << 63, universe, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.choice(other, 5, replace=False)])) for _ in range(2500)]
    kind = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()]
    rows = [(1, 0, 0, False, k, len(s), k % 3 + 1, s.tobytes()) for k, s in enumerate(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind)], list("cijsknmt"))
    out = []
    assert traced(lambda: out.extend(j._join_runs(70)(iter([batch])))) < 100
    got = out[0].to_pydict()
    m = np.arange(2500) % 3 + 1
    assert sorted(got["a"]) == list(range(2500)) and len(set(got["b"])) == 1
    assert [x for _, x in sorted(zip(got["a"], got["links"]))] == (m.sum() - m).tolist()


def test_memory_of_connected_keys():
    """Four batches of keys, half of which come again."""
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 1 << 62, 1 << 20)
    node = np.arange(1 << 20)
    batches = [pa.RecordBatch.from_arrays([pa.array(node[k::4]), pa.array(np.where(node[k::4] % 8 < 4, keys[: 1 << 18], keys[k::4]))], ["node", "key"]) for k in range(4)] * 3
    assert traced(lambda: [len(b) for b in j._local_stars(iter(batches))]) < 100


def test_memory_is_given_back_once_a_task_ends(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    assert [*common.returned(lambda batches: (seen.append(b) or b for b in batches))(iter([1, 2]))] == [1, 2]
    assert seen == [1, 2, "back"]
