"""Writers: vocabulary files and measurement tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame

MEASURES = ("input_index", "input_char_len", "output_token_len", "baseline_duration_ms", "duration_ms")


def write_measures(df: DataFrame, path: str) -> None:
    """Per-input measurements as CSV files with a header."""
    df.select(*MEASURES).write.mode("overwrite").csv(path, header=True)


def save_vocabulary(vocab: dict[str, int], folder: str, prefix: str | None = None) -> str:
    """``{prefix-}vocab.json`` in a folder; returns its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "-".join([*([prefix] if prefix else []), "vocab.json"]))
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dict(sorted(vocab.items(), key=lambda x: x[1])), f, ensure_ascii=False)
    return path
