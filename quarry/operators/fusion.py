"""Reciprocal-rank fusion and lexical re-ranking of hit tables (query_id, rank, chunk_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ranking import top_k
from quarry.functions.text import bigrams, let, lexical_tokens


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, k: int = 10, constant: int = 60, cap: int = 50) -> DataFrame:
    """Sum of 1 / (constant + rank) over both rankings, each cut at `cap`; ties by chunk_id."""
    d = dense.filter(F.col("rank") <= cap).select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    x = lexical.filter(F.col("rank") <= cap).select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    both = d.join(x, ["query_id", "chunk_id"], "full").withColumn("score", F.round(part("dense_rank") + part("bm25_rank"), 9))
    sources = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("bm25_rank").isNotNull(), "bm25")))
    return top_k(both.withColumn("source_retrievers", sources), k, ["query_id"], [F.desc("score"), F.col("chunk_id")])


def hybrid(dense: DataFrame, lexical: DataFrame, queries: DataFrame, k: int = 10, constant: int = 60, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """(fused hits, query_id with status): both rankings empty is `empty`; one empty is `mismatch`, as both search the same
    chunks under the same filter, and such a query has no fused hits."""
    n = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    seen = queries.select("query_id").join(n(dense, "dense_hits"), "query_id", "left").join(n(lexical, "bm25_hits"), "query_id", "left").na.fill(0, ["dense_hits", "bm25_hits"])
    d, x = F.col("dense_hits") > 0, F.col("bm25_hits") > 0
    status = seen.withColumn("status", F.when(d & x, "ok").when(d | x, "mismatch").otherwise("empty"))
    fused = reciprocal_rank_fusion(dense, lexical, k, constant, cap)
    return fused.join(status.filter("status = 'ok'").select("query_id"), "query_id", "left_semi"), status


def hit_violations(hits: DataFrame) -> DataFrame:
    """Queries whose ranks are not 1 .. n or that list a chunk twice."""
    seen = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("ranks"), F.max("rank").alias("last"), F.min("rank").alias("first"), F.countDistinct("chunk_id").alias("chunks"))
    rules = F.array(F.when((F.col("first") != 1) | (F.col("last") != F.col("n")) | (F.col("ranks") != F.col("n")), "ranks_not_contiguous"), F.when(F.col("chunks") != F.col("n"), "repeated_chunk"))
    return seen.select("query_id", F.explode(F.array_compact(rules)).alias("rule_id"))


def lexical_score(query: Column, text: Column) -> Column:
    """Distinct query tokens that the text contains, shared character pairs, and the share of the query's pairs found."""
    def score(x: Column) -> Column:
        contained = F.size(F.filter(x["words"], lambda w: F.contains(x["low"], w)))
        shared = F.size(F.array_intersect(x["own"], x["other"]))
        recall = F.when(F.size(x["own"]) > 0, F.round(shared / F.size(x["own"]), 9)).otherwise(F.lit(0.0))
        return F.struct(contained.alias("tokens"), shared.alias("pairs"), recall.alias("recall"))

    parts = F.struct(F.array_distinct(lexical_tokens(query)).alias("words"), F.lower(text).alias("low"), bigrams(query).alias("own"), bigrams(text).alias("other"))
    return let(parts, score)


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5, scorer=lexical_score) -> DataFrame:
    """hits re-ordered by a pair scorer (a struct compared field by field, or a number), ties by fusion rank and chunk_id."""
    rows = hits.select("query_id", "chunk_id", F.col("rank").alias("rrf_rank")).join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    rows = rows.select("query_id", "chunk_id", "rrf_rank", scorer(F.col("query"), F.col("text")).alias("reranker_score"))
    return top_k(rows, k, ["query_id"], [F.desc("reranker_score"), F.col("rrf_rank"), F.col("chunk_id")])
