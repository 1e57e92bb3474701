"""Exact cosine search for a set of queries, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ranking import top_k

BLOCK_ROWS = 4096


def _rule(size: int, unit: bool = False, tolerance: float = 1e-5) -> Column:
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rule = F.when(F.col("embedding").isNull() | (F.size("embedding") != size), "length").when(odd, "not_finite").when(norm == 0, "zero_norm")
    if unit:
        rule = rule.when(F.abs(F.sqrt(norm) - 1) > tolerance, "not_unit_norm")
    return rule


def violations(vectors: DataFrame, size: int, unit: bool = False, tolerance: float = 1e-5) -> DataFrame:
    """vectors(id, embedding) that can't be searched: wrong length, not finite, zero norm; with unit, also a norm that is
    not one."""
    return vectors.select("id", _rule(size, unit, tolerance).alias("rule_id")).filter("rule_id is not null")


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """The rows that a search takes."""
    return vectors.filter(_rule(size).isNull())


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, skip_self: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """vectors(id, embedding), queries(query_id, embedding) -> query_id, rank, id, score: exact, scores in double rounded to
    9 places and clipped to [-1, 1], ties by id. Every block of queries meets every block of vectors once; a task
    returns its block's k best per query. Rows that violations() names for the longest query's size (null, of another
    length, not finite, zero) take no part on either side. allowed(id), if given, is what may be found."""
    vectors = vectors if allowed is None else vectors.join(allowed.select("id").distinct(), "id", "left_semi")
    size = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    vectors, queries = usable(vectors, size), usable(queries, size)
    total = vectors.count(), queries.count()
    vb, qb = (max(1, -(-n // BLOCK_ROWS)) for n in total)
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")  # noqa: E731 - both sides of a cogroup are dealt by the hash of one type
    v = vectors.select(F.col("id"), "embedding", block("id", vb).alias("vb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    q = queries.select(F.col("query_id"), "embedding", block("query_id", qb).alias("qb")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))))

    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack(column.to_list()).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def best(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        left = left.sort_values("id")
        ids, asked = left["id"].to_numpy(), right["query_id"].to_numpy()
        s = np.clip(np.round(unit(right["embedding"]) @ unit(left["embedding"]).T, 9), -1, 1)
        if skip_self:
            s[asked[:, None] == ids[None]] = -2
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(asked)), top.shape[1])
        out = pd.DataFrame({"query_id": asked[row], "id": ids[top.ravel()], "score": s[row, top.ravel()]})
        return out[out["score"] >= -1]

    pairs = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(best, "query_id long, id long, score double")
    return top_k(pairs, k, ["query_id"], [F.desc("score"), F.col("id")]).select("query_id", "rank", "id", "score")
