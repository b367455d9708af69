import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from rows import make
from tokenloom.llm import quality as q


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_counts_against_brute_force(docs, texts):
    got = rows(q.rules(docs))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute.counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def numpy_mcd(x, share=0.5, trim=0.975):
    """Concentration steps from the same two starts, on all rows at once."""
    p = x.shape[1]
    floors = np.diag(np.square(q.FLOOR))
    best = None
    med = np.median(x, 0)
    mad = np.median(np.abs(x - med), 0) * 1.4826
    for m, s in ((med, np.diag(mad**2) + floors), (x.mean(0), np.cov(x.T, bias=True) + floors)):
        last = 1e9
        while True:
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            b = np.floor(np.log2(d + 1e-6) * 32)
            cut = np.sort(b)[int(np.ceil(len(x) * share)) - 1]
            y = x[b <= cut]
            m2, s2 = y.mean(0), np.cov(y.T, bias=True) * q.consistency(share, p) + floors
            det = np.linalg.slogdet(s2)[1]
            if det < last:
                m, s = m2, s2
            if last - det < 1e-3:
                last = min(last, det)
                break
            last = det
        if best is None or last < best[0]:
            best = (last, m, s)
    _, m, s = best
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    y = x[d <= q.chi2_quantile(trim, p)]
    m, s = y.mean(0), np.cov(y.T, bias=True) * q.consistency(trim, p) + floors
    return np.sqrt(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m))


def test_distances_against_numpy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = q.with_stats(d, ["doc_id", "lang", "source"]).where(~q.base_failed()).collect()
    x = np.array([[r[q.STAT][f"x{i}"] for i in range(q.P)] for r in stats]) / q.UNIT
    got = rows(q.rules(d, min_rows=10**6))  # nothing is judged: too few rows for any estimate
    got = rows(q.rules(d.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source"), min_rows=20))
    want = numpy_mcd(x)
    for r, w in zip(stats, want):
        assert got[r.doc_id].distance == pytest.approx(w, rel=1e-6)


def test_junk_goes_and_clean_stays(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = q.rules(d).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(x.quality, x.kept): x["count"] for x in r}
    assert n.get((0, True), 0) == 0 and n.get((1, False), 0) == 0 and n[(0, False)] > 0


def test_each_statistic_alone_rejects(spark):
    """Digits only, repeated lines, and a repeated passage below the base rule's half."""
    rng = random.Random(3)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    clean = d.join(labels, "doc_id").where("lang = 'en'").orderBy("doc_id").limit(60).collect()
    w = list(dict.fromkeys(" ".join(r.text for r in clean).split()))[:600]
    words = rng.sample([x for x in w if x.isalpha() and 4 <= len(x) <= 6], 40)
    planted = {
        "digits": " ".join(map(str, rng.sample(range(10_000, 100_000), 400))),
        "dup_lines": "\n".join(rng.choices(words, k=400)),
        "repeats": " ".join(w[:97] + w[100:300] + w[:97]),
        "prose": " ".join(w[:400]),
    }
    more = spark.createDataFrame([(-1 - i, t, "en", clean[0].source) for i, t in enumerate(planted.values())], d.schema)
    got = rows(q.rules(d.unionByName(more)))
    assert not any(got[-1 - i].base_failed for i in range(4))
    assert {k: got[-1 - i].kept for i, k in enumerate(planted)} == {"digits": False, "dup_lines": False, "repeats": False, "prose": True}


def test_edge_tables(spark, docs, empty, odd, texts):
    assert q.rules(empty).collect() == [] and q.keep_good(empty).collect() == []
    assert q.rules(odd).count() == odd.count()
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in q.rules(docs).where("kept").collect()}
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in ids}
    few = make(spark, texts[:3])
    assert all(r.kept for r in q.rules(few).collect())


def test_chi_squared():
    assert q.chi2_quantile(0.95, 2) == pytest.approx(5.991465, abs=1e-5)
    assert q.chi2_quantile(0.975, 7) == pytest.approx(16.01276, abs=1e-4)
    assert q.consistency(1.0, 3) == 1


def test_a_guard_that_is_reached_raises(spark, docs):
    with pytest.raises(RuntimeError, match="still move"):
        q.fit(q.written(q.with_stats(docs, ["lang", "source"]), "s"), steps=1, tolerance=-1.0, min_rows=5)


def test_long_texts_and_odd_names(spark):
    texts = ["word " * 400_000, "x" * 2_000_000, None, *[f"some plain words of text number {i} " * 12 for i in range(30)]]
    d = make(spark, texts).withColumn("odd`name", F.lit(1))
    rows = {r.doc_id: r for r in q.rules(d).collect()}
    assert (rows[0].n_words, rows[0].base_failed, rows[1].word_chars, rows[2].n_words) == (400_000, True, 2_000_000, 0)
    assert q.keep_good(d).columns == d.columns
