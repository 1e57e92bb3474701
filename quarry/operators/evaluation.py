"""Retrieval metrics, summaries, comparisons of methods and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.context import budget
from quarry.operators.contracts import support_present


def evaluate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases(query_id, gold array of pages), hits(query_id, rank, page) -> first_rank, recall, reciprocal_rank, ndcg; recall and
    ndcg at 1, 3 and 5.

    A gold page counts at its first hit only; the ideal at k has min(k, number of gold pages) hits on top."""
    cuts = (1, 3, 5)
    gold = cases.select("query_id", F.explode(F.array_distinct("gold")).alias("page"))
    first = hits.join(gold, ["query_id", "page"]).groupBy("query_id", "page").agg(F.min("rank").alias("rank"))
    gain = lambda k: F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"_dcg{k}")
    best = first.groupBy("query_id").agg(F.min("rank").alias("first_rank"), *[gain(k) for k in cuts])
    rows = cases.select("query_id", F.size(F.array_distinct("gold")).alias("n_gold")).join(best, "query_id", "left")
    at = lambda k: F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)).alias(f"recall_{k}")

    def ndcg(k: int) -> Column:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), "n_gold")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
        return F.round(F.when(F.col("n_gold") > 0, F.coalesce(f"_dcg{k}", F.lit(0.0)) / ideal).otherwise(0.0), 9).alias(f"ndcg_{k}")

    return rows.select("query_id", "first_rank", *[at(k) for k in cuts], F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 9).alias("reciprocal_rank"), *[ndcg(k) for k in cuts])


def case_plan_violations(cases: DataFrame, plans: DataFrame) -> DataFrame:
    """cases(query_id, question, metric_name, fiscal_year, statement_type, statement_scope, company_id, report_id,
    report_type) against plans with the same fields (original_query for question) and lists -> query_id, rule_id. A plan
    whose lists name pages would tell the search where the gold is: gold_leak."""
    fields = {"question": "original_query", "metric_name": "metric_name", "fiscal_year": "fiscal_year", "statement_type": "statement_type", "statement_scope": "statement_scope"}
    lists = {"company_id": "company_ids", "report_id": "report_ids", "fiscal_year": "fiscal_years", "report_type": "report_types"}
    own = plans.select("query_id", *[F.col(p).alias(f"_{p}") for p in fields.values()], *lists.values(), *[c for c in ("pdf_pages", "page_ids") if c in plans.columns], F.lit(True).alias("planned"))
    both = cases.select("query_id", F.lit(True).alias("asked"), *sorted({*fields, *lists})).join(own, "query_id", "full")
    there = F.col("asked").isNotNull() & F.col("planned").isNotNull()
    rules = [F.when(F.col("planned").isNull(), "no_plan"), F.when(F.col("asked").isNull(), "no_case")]
    rules += [F.when(there & ~F.col(c).eqNullSafe(F.col(f"_{p}")), f"other_{c}") for c, p in fields.items()]
    rules += [F.when(there & ~F.coalesce(F.array_contains(n, F.col(c)), F.lit(False)), f"not_in_{n}") for c, n in lists.items()]
    rules += [F.when(there & (F.coalesce(F.size(c), F.lit(0)) > 0), "gold_leak") for c in ("pdf_pages", "page_ids") if c in plans.columns]
    return both.select("query_id", F.explode(F.array_distinct(F.array_compact(F.array(*rules)))).alias("rule_id"))


def summarize(results: DataFrame, by: list[str]) -> DataFrame:
    """Means per group."""
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), mean("recall_1", "recall_at_1"), mean("recall_3", "recall_at_3"), mean("recall_5", "recall_at_5"), mean("reciprocal_rank", "mrr"), mean("ndcg_5", "ndcg_at_5"))


def totals(results: DataFrame, outer: str, inner: str) -> DataFrame:
    """Hits at 5 per (outer, inner), per outer and over all, in one pass."""
    return results.rollup(outer, inner).agg(F.count(F.lit(1)).alias("cases"), F.sum("recall_5").alias("hits_5"), F.grouping_id().cast("int").alias("level"))


def failures(results: DataFrame, by: list[str], within: int = 5) -> DataFrame:
    """Cases whose gold is not among the first `within`, and where it is: by, query_id, first_rank (null: nowhere)."""
    return results.filter(F.col("first_rank").isNull() | (F.col("first_rank") > within)).select(*by, "query_id", "first_rank")


def latency(times: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and nearest-rank percentiles."""
    return times.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def compare_methods(ranks: DataFrame, methods: list[str]) -> DataFrame:
    """ranks(query_id, method, first_rank or null) -> one column per method, best rank and methods, spread and labels."""
    wide = ranks.groupBy("query_id").pivot("method", methods).agg(F.min("first_rank"))
    best = F.least(*methods) if len(methods) > 1 else F.col(methods[0])
    wide = wide.withColumn("best_rank", best).withColumn("rank_spread", F.greatest(*methods) - F.least(*methods))
    names = F.array_compact(F.array(*[F.when(F.col(m) == F.col("best_rank"), m) for m in methods]))
    labels = [F.when(F.col("best_rank").isNull() | (F.col("best_rank") > 5), "miss_top5"), F.when(F.col("rank_spread") >= 10, "large_disagreement")]
    for m in methods[1:]:
        change = F.col(methods[0]) - F.col(m)
        labels += [F.when(change >= 3, f"{m}_improves"), F.when(change <= -3, f"{m}_degrades"), F.when((F.col(methods[0]) <= 5) & (F.col(m) > 5), f"{m}_drops_top5")]
    return wide.withColumn("best_methods", F.array_join(names, ",")).withColumn("labels", F.array_join(F.array_compact(F.array(*labels)), ","))


def diagnose(cases: DataFrame, retrieved: DataFrame, expanded: DataFrame) -> DataFrame:
    """Why a case has no support: none indexed, found, found only by expansion, or not retrieved."""
    rows = cases.select("query_id", "n_support").join(retrieved.select("query_id", F.lit(1).alias("r")).distinct(), "query_id", "left").join(expanded.select("query_id", F.lit(1).alias("e")).distinct(), "query_id", "left")
    return rows.select("query_id", F.when(F.col("n_support") == 0, "support_missing").when(F.col("r") == 1, "retrieved").when(F.col("e") == 1, "recovered_by_expansion").otherwise("not_retrieved").alias("outcome"))


def group_summary(rows: DataFrame, groups: list[str], outcome: str = "outcome") -> DataFrame:
    """Counts of outcomes over all rows and by each of the groups, in one pass of grouping sets."""
    sets = [[outcome], *[[g, outcome] for g in groups]]
    cols = [F.col(c) for c in (*groups, outcome)]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count(F.lit(1)).alias("cases"), F.grouping_id().cast("int").alias("level"))


def what_if(pool: DataFrame, strategies: dict[str, list[Column]], support: DataFrame, max_items: int = 2, max_chars: int = 1600) -> DataFrame:
    """The same candidates under several orders, ranked and cut to the budget in one pass -> strategy, query_id, items, chars,
    supported (whether a chosen chunk is one of the query's support).

    pool(query_id, chunk_id, n_chars, and what the orders use); strategies: name -> numbers, least first, ties by chunk_id;
    support(query_id, chunk_id). A pool row meets each strategy where it is, so there is one shuffle for all of them."""
    orders = F.array(*[F.struct(F.lit(name).alias("strategy"), F.array(*[c.cast("double") for c in order]).alias("key")) for name, order in strategies.items()])
    rows = pool.select("query_id", "chunk_id", "n_chars", F.explode(orders).alias("o"))
    rows = rows.select(F.struct("o.strategy", "query_id").alias("query_id"), "chunk_id", "n_chars", F.col("o.key").alias("key"))
    ranked = rows.withColumn("selection_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("key", "chunk_id")))
    decided = budget(ranked, max_items, max_chars).select("query_id.strategy", "query_id.query_id", "chunk_id", "n_chars", (F.col("decision") == "selected").alias("took"))
    held = support.select("query_id", "chunk_id", F.lit(True).alias("held")).distinct()
    both = decided.join(held, ["query_id", "chunk_id"], "left")
    took = F.col("took")
    return both.groupBy("strategy", "query_id").agg(F.count_if(took).alias("items"), F.coalesce(F.sum(F.when(took, F.col("n_chars"))), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.bool_or(took & F.col("held")), F.lit(False)).alias("supported"))


def what_if_changes(outcomes: DataFrame, baseline: str) -> DataFrame:
    """what_if() against one of its strategies: queries recovered, regressed, supported by both or neither, by strategy and
    over all of them, with the characters chosen."""
    base = outcomes.filter(F.col("strategy") == baseline).select("query_id", F.col("supported").alias("was"))
    both = outcomes.filter(F.col("strategy") != baseline).join(base, "query_id", "left").withColumn("was", F.coalesce("was", F.lit(False)))
    change = F.when(F.col("supported") & ~F.col("was"), "recovered").when(~F.col("supported") & F.col("was"), "regressed").when(F.col("was"), "both").otherwise("neither")
    rows = both.withColumn("change", change)
    sets = [[F.col("strategy"), F.col("change")], [F.col("strategy")], [F.col("change")]]
    return rows.groupingSets(sets, "strategy", "change").agg(F.count(F.lit(1)).alias("queries"), F.sum("chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


def root_causes(targets: DataFrame, traces: DataFrame, full: DataFrame, selected: DataFrame) -> DataFrame:
    """Why each query did or did not find its fact: targets(query_id, fact_id, evidence_id, chunk_id or null, pdf_page); traces
    (query_id, status, stage, fact_ids); full and selected (query_id, chunk_id, pdf_page): the context with all neighbours,
    and the one that was read. -> query_id, outcome.

    In this order: retrieval_runtime_error; with the fact found base_resolved, expansion_recovered, or
    resolved_without_expected_audit where no stage says so; else fact_resolution_miss (its support was read),
    budget_selection_miss (it was there to be read), same_page_chunk_coverage_gap (another chunk of its page was), and
    retrieval_or_page_window_coverage_gap."""
    there = lambda items, name: support_present(targets, items).select("query_id", F.col("present").alias(name))
    on_page = full.select("query_id", "pdf_page", F.lit(True).alias("_page")).distinct()
    rows = targets.join(traces.select("query_id", "status", "stage", "fact_ids"), "query_id", "left").join(there(full, "_full"), "query_id").join(there(selected, "_read"), "query_id").join(on_page, ["query_id", "pdf_page"], "left")
    hit = F.coalesce(F.array_contains("fact_ids", F.col("fact_id")), F.lit(False))
    outcome = (
        F.when(F.coalesce(F.col("status") == "failed", F.lit(True)), "retrieval_runtime_error").when(hit & (F.col("stage") == "base"), "base_resolved").when(hit & (F.col("stage") == "expansion"), "expansion_recovered")
        .when(hit, "resolved_without_expected_audit").when(F.col("_read"), "fact_resolution_miss").when(F.col("_full"), "budget_selection_miss")
        .when(F.col("chunk_id").isNotNull() & F.col("_page").isNotNull(), "same_page_chunk_coverage_gap").otherwise("retrieval_or_page_window_coverage_gap")
    )
    return rows.select("query_id", outcome.alias("outcome"))


def strategy_comparison(traces: DataFrame, chunks: DataFrame, baseline: str) -> DataFrame:
    """Strategies side by side: traces(strategy, query_id, status, stage, evidence_ids, chunk_ids), chunks(chunk_id, n_chars)
    -> strategy, queries, resolved, resolution_rate, context_chars, evidences; against the baseline: resolved_gain,
    char_growth (share of the baseline's characters read besides) and evidence_ratio (pieces of evidence a baseline's)."""
    read = traces.select("strategy", F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", "n_chars"), "chunk_id").groupBy("strategy").agg(F.sum("n_chars").alias("context_chars"))
    done = (F.col("status") == "completed") & (F.col("stage") != "unresolved")
    own = traces.groupBy("strategy").agg(F.count(F.lit(1)).alias("queries"), F.count_if(done).alias("resolved"), F.sum(F.size("evidence_ids")).cast("long").alias("evidences")).join(read, "strategy", "left").na.fill(0, ["context_chars"])
    base = own.filter(F.col("strategy") == baseline).select(F.col("resolved").alias("_r"), F.col("context_chars").alias("_c"), F.col("evidences").alias("_e"))  # one row
    share = lambda a, b: F.when(F.col(b) > 0, F.round(a / F.col(b), 6))
    return own.join(F.broadcast(base)).select(
        "strategy", "queries", "resolved", share(F.col("resolved"), "queries").alias("resolution_rate"), "context_chars", "evidences", (F.col("resolved") - F.col("_r")).alias("resolved_gain"),
        share(F.col("context_chars") - F.col("_c"), "_c").alias("char_growth"), share(F.col("evidences"), "_e").alias("evidence_ratio"),
    )
