"""Documents with columns whose names clash with the operators' own."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, n string, size string, path string, _stat string"


def make(spark, texts, ids=None):
    rows = [((i if ids is None else ids[i]), t, ("en", "fr", None)[i % 3], "src0" if i % 2 else f"src{i % 5}", None if t is None else len(t), -1, "n", "s", "p", "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
