import numpy as np
import pytest

import brute
import corpus_pipeline
from tokenloom.llm import quality, queries, secrets


def test_against_brute_force(spark, sf_dir):
    """Stages in plain Python (verdicts of the rules and spans from their own operators,
    which have brute-force tests of their own)."""
    from tokenizers import Tokenizer

    from tokenloom.llm.tokencache import default_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality.rules(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in kept]
    first = {}
    for i, t in rows:
        first.setdefault(brute.normal(t), i)
    rows = [(i, t) for i, t in rows if first[brute.normal(t)] == i]
    comp = brute.jaccard(rows)
    rows = [(i, t) for i, t in rows if comp[i][2] == i]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(left).collect()}
    lib = Tokenizer.from_file(default_path())
    want = {}
    for i, t in rows:
        done, parts = 0, []
        for _, s, e in sorted((x.split(":") for x in spans[i].split(",") if x), key=lambda x: int(x[1])):
            if int(s) >= done:
                parts += [t[done : int(s)], "[secret]"]
            done = max(done, int(e))
        want[i] = len(lib.encode("".join([*parts, t[done:]]), add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert sum(r.length for r in got) == sum(want.values())
    used = np.bincount([r.sequence_id for r in got], [r.length for r in got])
    assert (used[used > 0] < 2048).sum() <= 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, sf_dir, name):
    from compare import oracle_rows, same_rows

    same_rows(queries.QUERIES[name](spark, sf_dir), *oracle_rows(sf_dir, queries.ORACLES[name]))


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and set(queries.QUERIES) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
