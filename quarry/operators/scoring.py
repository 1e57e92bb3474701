"""Batch scoring with a callable of the user: embeddings of texts, scores of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def embed(texts: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """texts(id long, text) -> id, embedding. model() runs once in each task and gives a function of a list of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(np.asarray(encode(part["text"].fillna("").tolist()), dtype=np.float32))})

    return texts.select("id", "text").mapInPandas(run, "id long, embedding array<float>")


def score_pairs(pairs: DataFrame, model: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], batch: int = 64) -> DataFrame:
    """pairs(query_id long, chunk_id, query, text) -> query_id, chunk_id, score; scores that are not finite become null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model()
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                s = np.asarray(score(list(zip(part["query"].fillna(""), part["text"].fillna("")))), dtype=np.float64)
                yield pd.DataFrame({"query_id": part["query_id"], "chunk_id": part["chunk_id"], "score": pd.Series([float(x) if np.isfinite(x) else None for x in s], index=part.index, dtype="object")})

    return pairs.select("query_id", "chunk_id", "query", "text").mapInPandas(run, "query_id long, chunk_id string, score double")
