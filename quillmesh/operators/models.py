"""Models from outside as columns: encoders of texts and scorers of pairs, in batches within Arrow streams.

An encoder takes a list of texts and gives a vector for each; a scorer takes lists of queries and documents and gives a
score for each pair. Both are made once per task by a factory, so that a model is loaded where it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODE_BATCH, SCORE_BATCH = 8, 2
MAX_TOKENS = 256


def _in_batches(df: DataFrame, columns: list[str], key: list[str], factory: Callable, size: int, name: str, kind: str) -> DataFrame:
    given = df.select(*key, *columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.select(*key).schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in frames:
            out = []
            for a in range(0, len(pdf), size):
                part = pdf.iloc[a : a + size]
                got = model(*([x or "" for x in part[c]] for c in columns))
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(got)} results")
                out += list(got)
            yield pdf[key].assign(**{name: out})

    return given.mapInPandas(run, f"{schema}, {name} {kind}")


def embed(df: DataFrame, text: str, key: list[str], factory: Callable, batch: int = ENCODE_BATCH, name: str = "v") -> DataFrame:
    """(key, vector of unit length) of every row; a zero vector stays zero."""

    def unit():
        encode = factory()

        def run(texts):
            got = list(encode(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(texts)} texts gave {len(got)} results")
            m = np.asarray(got, float).reshape(len(texts), -1)
            return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).tolist()

        return run

    return _in_batches(df, [text], key, unit, batch, name, "array<double>")


def score(df: DataFrame, query: str, document: str, key: list[str], factory: Callable, batch: int = SCORE_BATCH, name: str = "reranker_score") -> DataFrame:
    """(key, score in [0, 1]) of every pair; a score that isn't finite is 0."""

    def bounded():
        rate = factory()
        return lambda q, d: [float(min(1.0, max(0.0, x))) if np.isfinite(x) else 0.0 for x in rate(q, d)]

    return _in_batches(df, [query, document], key, bounded, batch, name, "double")


def yes_probability(no: float, yes: float) -> float:
    """The share of yes in a softmax over the two answers of a cross-encoder."""
    top = max(no, yes)
    a, b = np.exp(no - top), np.exp(yes - top)
    return float(b / (a + b))


def with_scores(ranked: DataFrame, raw_text: str, factory: Callable) -> DataFrame:
    """The candidates of match() as rerank() takes them, scored by a model that reads both sides as texts."""
    from quillmesh.operators import ranking as R

    pairs = ranked.select("query_id", "company_id", R.reranker_query(F.col(raw_text), F.col("query_text")).alias("_q"), R.reranker_document().alias("_d"))
    return R.from_matches(ranked, score(pairs, "_q", "_d", ["query_id", "company_id"], factory))
