"""Traces of sub-queries: a dataflow of stages in which only what is not resolved yet goes on.

Each query is searched in its own report and its hits are re-ranked; where the hits support a verified fact, that is the
trace. The others are widened to the pages beside their hits, the new chunks are ranked and cut to a budget, and facts are
looked for again in hits and chosen chunks together. Every stage is a table written once; the next one takes from it by
semi and anti joins. Every query has one row at the end, whatever became of it, with the stage that resolved it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import context, facts, fusion, lexical
from quarry.sources.shared import materialize

STRATEGIES = ("plain", "expanded", "budgeted")


def routed_search(index: lexical.Index, queries: DataFrame, k: int = 5, candidates: int = 20, cap: int = 50, dense: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, report_id, text, tokens), each over the index of its own report: both rankings fused, the
    candidates re-ranked, cut to k. -> (hits, query_id with status).

    dense(query_id, rank, chunk_id): the other ranking, inside the reports; without one, how many terms a chunk covers.
    Status is ok, mismatch (one ranking is empty) or no_report (the report has no chunks); only ok has hits."""
    own = materialize(lexical.search_report(index, queries, cap))  # both rankings are read for the status and for the hits
    other = materialize(lexical.coverage(index, queries.select("query_id", "report_id", "tokens"), cap)) if dense is None else dense
    fused, status = fusion.hybrid(other, own, queries, candidates, cap=cap)
    hits = fusion.rerank(materialize(fused), queries, index.chunks, k)  # few rows meet the texts
    told = F.when(F.col("status") == "empty", "no_report").otherwise(F.col("status"))
    return hits, status.select("query_id", told.alias("status"))


def _items(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    places = chunks.select("chunk_id", "report_id", "pdf_page")
    return hits.select("query_id", F.col("rank").alias("context_order"), "chunk_id", F.lit("retrieved").alias("origin")).join(places, "chunk_id")


def _widened(hits: DataFrame, queries: DataFrame, chunks: DataFrame, siblings: bool) -> DataFrame:
    """Candidates of hits(query_id, rank, chunk_id) on the pages beside them (and on their own, if wished), with texts."""
    pool = context.expand(hits, chunks)
    if siblings:
        pool = context.add_siblings(pool, hits, chunks)
    texts = chunks.select("chunk_id", "report_id", "pdf_page", "chunk_index", "text")
    return pool.join(texts, "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")


def trace(hits: DataFrame, status: DataFrame, queries: DataFrame, chunks: DataFrame, registry: DataFrame, evidences: DataFrame, strategy: str = "budgeted", siblings: bool = False, max_items: int = 2, max_chars: int = 1600) -> DataFrame:
    """hits and status of routed_search(); queries(query_id, text, and the keys of facts.resolve); chunks(chunk_id,
    report_id, pdf_page, chunk_index, text); registry and evidences as facts.resolve takes them. -> one row for each query:
    query_id, status (completed or failed), error, hits, stage, fact_ids, evidence_ids, chunk_ids, candidates,
    selected_items, selected_chars.

    plain stops at the hits, expanded reads all neighbours of every query, budgeted those of unresolved queries within the
    budget. Arrays are in context order, then by id; stage is base, expansion or unresolved."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    hits = materialize(hits.select("query_id", "rank", "chunk_id"))
    base_items = materialize(_items(hits, chunks))
    base = materialize(facts.resolve(queries, registry, evidences, base_items))
    found, used, chosen = base.withColumn("stage", F.lit("base")), base_items.select("query_id", "context_order", "chunk_id"), None
    if strategy == "expanded":
        pool = _widened(hits, queries, chunks, siblings)
        n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("anchor_rank", F.abs("page_distance"), "page_distance", "chunk_index", "chunk_id"))
        more = pool.withColumn("o", order).join(n, "query_id").select("query_id", (F.col("n") + F.col("o")).alias("context_order"), "chunk_id", F.lit("adjacent_page").alias("origin"), "report_id", "pdf_page", F.length("text").alias("n_chars"))
        more = materialize(more)
        chosen = more.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count(F.lit(1)).alias("selected_items"), F.sum("n_chars").alias("selected_chars"))
        both = base_items.unionByName(more.drop("n_chars"))
        resolved = facts.resolve(queries, registry, evidences, both)
        found = resolved.withColumn("stage", F.when(F.col("origin") == "retrieved", "base").otherwise("expansion"))
        used = both.select("query_id", "context_order", "chunk_id")
    elif strategy == "budgeted":
        open_hits = hits.join(base.select("query_id").distinct(), "query_id", "left_anti")
        ranked = context.rank_candidates(_widened(open_hits, queries, chunks, siblings))
        decided = materialize(context.budget(ranked.withColumn("n_chars", F.length("text")), max_items, max_chars))
        took = F.col("decision") == "selected"
        chosen = decided.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(took).alias("selected_items"), F.coalesce(F.sum(F.when(took, F.col("n_chars"))), F.lit(0)).alias("selected_chars"))
        read = materialize(context.selected_context(open_hits, decided, chunks).join(chunks.select("chunk_id", "report_id", "pdf_page"), "chunk_id"))
        second = facts.resolve(queries, registry, evidences, read)
        found = found.unionByName(second.withColumn("stage", F.lit("expansion")))
        closed = used.join(open_hits.select("query_id").distinct(), "query_id", "left_anti")
        used = closed.unionByName(read.select("query_id", "context_order", "chunk_id"))
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    pick = lambda rows, c: F.transform(rows, lambda x: x[c])
    supported = found.groupBy("query_id").agg(ordered("context_order", "fact_id", "evidence_id").alias("f"), F.min("stage").alias("stage"))
    contexts = used.groupBy("query_id").agg(ordered("context_order", "chunk_id").alias("c"))
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    out = queries.select("query_id").join(status, "query_id", "left").join(supported, "query_id", "left").join(contexts, "query_id", "left").join(n, "query_id", "left")
    out = out.join(chosen, "query_id", "left") if chosen is not None else out.withColumns({c: F.lit(0) for c in ("candidates", "selected_items", "selected_chars")})
    none, ok = F.array().cast("array<string>"), F.col("status") == "ok"
    return out.select(
        "query_id", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(~F.coalesce(ok, F.lit(False)), F.coalesce("status", F.lit("not_searched"))).alias("error"),
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("stage", F.when(ok, "unresolved")).alias("stage"),
        F.coalesce(pick(F.col("f"), "fact_id"), none).alias("fact_ids"), F.coalesce(F.array_distinct(pick(F.col("f"), "evidence_id")), none).alias("evidence_ids"), F.coalesce(pick(F.col("c"), "chunk_id"), none).alias("chunk_ids"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("candidates", "selected_items", "selected_chars")],
    )


def retrieval_summary(traces: DataFrame, by: list[str]) -> DataFrame:
    """Of traces(query_id, ..., by): how many ended how, what the widening recovered and what it read, by groups and over all.

    Counters of queries and of chosen chunks come from the one row that each query has, so none is counted twice."""
    done = F.col("status") == "completed"
    of = [
        F.count(F.lit(1)).alias("queries"), F.count_if(done).alias("completed"), F.count_if(done & (F.col("stage") != "unresolved")).alias("resolved"),
        F.count_if(F.col("stage") == "base").alias("gate_closed"), F.count_if(done & (F.col("stage") != "base")).alias("gate_open"), F.count_if(F.col("stage") == "expansion").alias("recovered"),
        F.sum("selected_items").alias("selected_items"), F.sum("selected_chars").alias("selected_chars"), F.sum(F.size("chunk_ids")).cast("long").alias("context_chunks"),
    ]
    return traces.groupingSets([[], [F.col(c) for c in by]], *by).agg(*of, F.grouping_id().cast("long").alias("level"))


def failures(traces: DataFrame) -> DataFrame:
    """Queries that did not get a fact, and why."""
    why = F.when(F.col("status") == "failed", F.col("error")).when(F.col("candidates") == 0, "no_candidates").when(F.col("selected_items") == 0, "budget").otherwise("not_in_context")
    return traces.filter("status = 'failed' or stage = 'unresolved'").select("query_id", why.alias("reason"))
