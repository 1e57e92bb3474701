"""Rules that rows of metrics, evidence, steps and answers must keep: each operator gives the rows that break one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.facts import QUERY_KEYS

#: Kinds of evidence, attributions and steps.
TABLE_EVIDENCE = ("financial_statement_cell", "financial_summary_table")
NARRATIVE_EVIDENCE = ("management_statement", "financial_note", "risk_disclosure", "paragraph")
ATTRIBUTIONS = ("report_disclosure", "management_statement")
CALCULATING = ("calculate", "normalize_unit")
DURATION_STATEMENTS = ("income_statement", "cash_flow_statement")


def _broken(rows: DataFrame, keys: list[str], rules: list[Column]) -> DataFrame:
    return rows.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("rule_id"))


def _none(c: str) -> Column:
    """Null or empty list."""
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def metric_violations(metrics: DataFrame) -> DataFrame:
    """metrics(metric_id, statement_type, period_type, metric_origin, formula_id, value_type, default_unit, allowed_scopes,
    confusable_metric_ids, created_at, updated_at) -> metric_id, rule_id."""
    others, text = F.col("confusable_metric_ids"), F.col("value_type") == "text"
    rules = [
        F.when((F.col("statement_type") == "balance_sheet") & (F.col("period_type") != "instant"), "balance_sheet_not_instant"),
        F.when(F.col("statement_type").isin(*DURATION_STATEMENTS) & (F.col("period_type") != "duration"), "statement_not_duration"),
        F.when((F.col("metric_origin") == "reported") & F.col("formula_id").isNotNull(), "reported_with_formula"),
        F.when((F.col("metric_origin") == "derived") & F.col("formula_id").isNull(), "derived_without_formula"),
        F.when(text != (F.col("default_unit") == "text"), "unit_of_other_type"),
        F.when(_none("allowed_scopes"), "no_scope"), F.when(F.size(F.array_distinct("allowed_scopes")) < F.size("allowed_scopes"), "repeated_scope"),
        F.when(F.array_contains("allowed_scopes", "unknown"), "unknown_scope"),
        F.when(F.size(F.array_distinct(others)) < F.size(others), "repeated_confusable"), F.when(F.exists(others, lambda x: ~x.rlike("^[a-z0-9_]+$")), "bad_confusable_id"),
        F.when(F.array_contains(others, F.col("metric_id")), "confusable_with_itself"), F.when(F.col("updated_at") < F.col("created_at"), "updated_before_created"),
    ]
    return _broken(metrics, ["metric_id"], rules)


def evidence_violations(evidences: DataFrame) -> DataFrame:
    """evidences(evidence_id, evidence_type, attribution_type, statement_type, statement_scope, table_name, row_label,
    column_label, cell_value, section_title, validation_status, validated_by, printed_page) -> evidence_id, rule_id."""
    said, by = F.col("evidence_type") == "management_statement", F.col("attribution_type") == "management_statement"
    table = F.col("evidence_type").isin(*TABLE_EVIDENCE)
    verified = F.col("validation_status") == "verified"
    rules = [F.when(~F.coalesce(F.col("attribution_type").isin(*ATTRIBUTIONS), F.lit(False)), "attribution"), F.when(said & ~by, "statement_without_attribution"), F.when(~said & by, "attribution_without_statement"), F.when(F.col("statement_scope") == "unknown", "unknown_scope")]
    rules += [F.when(table & F.col(c).isNull(), f"table_without_{c}") for c in ("statement_type", "statement_scope", "table_name", "row_label", "column_label", "cell_value")]
    rules += [F.when(F.col("evidence_type").isin(*NARRATIVE_EVIDENCE) & F.col("section_title").isNull(), "narrative_without_section"), F.when(verified & F.col("validated_by").isNull(), "verified_by_nobody"), F.when(verified & F.col("printed_page").isNull(), "verified_without_printed_page")]
    return _broken(evidences, ["evidence_id"], rules)


def step_violations(steps: DataFrame) -> DataFrame:
    """steps(case_id, step_id, action, retrieval_query_id, input_refs, depends_on, calculation_id, formula_id, output_ref)."""
    retrieve, calculates = F.col("action") == "retrieve", F.col("action").isin(*CALCULATING)
    fields = F.col("calculation_id").isNotNull() | F.col("formula_id").isNotNull()
    rules = [
        F.when(retrieve & F.col("retrieval_query_id").isNull(), "retrieve_without_query"), F.when(retrieve & ~_none("input_refs"), "retrieve_with_inputs"), F.when(retrieve & ~_none("depends_on"), "retrieve_depends"),
        F.when(~calculates & fields, "calculation_fields"), F.when(~retrieve & F.col("retrieval_query_id").isNotNull(), "query_outside_retrieve"), F.when(~retrieve & _none("input_refs"), "no_inputs"),
        F.when(calculates & F.col("calculation_id").isNull(), "no_calculation"), F.when(calculates & F.col("formula_id").isNull(), "no_formula"),
        F.when(calculates & ~F.col("output_ref").eqNullSafe(F.col("calculation_id")), "output_is_not_the_calculation"),
    ]
    return _broken(steps, ["case_id", "step_id"], rules)


def provenance_violations(queries: DataFrame, traces: DataFrame, facts: DataFrame) -> DataFrame:
    """queries(query_id, QUERY_KEYS), traces(query_id, status, fact_ids, evidence_ids), facts(fact_id, QUERY_KEYS,
    primary_evidence_id, validation_status) -> query_id, fact_id or null, rule_id: queries without a trace and traces
    without a query, unfinished or empty traces, and facts that are unknown, not verified, of another identity or without
    their primary evidence in the trace."""
    both = queries.select("query_id", F.lit(True).alias("asked"), *[F.col(k).alias(f"_{k}") for k in QUERY_KEYS]).join(traces.withColumn("traced", F.lit(True)), "query_id", "full")
    whole = both.select("query_id", F.lit(None).cast("string").alias("fact_id"), F.when(F.col("traced").isNull(), "no_trace").when(F.col("asked").isNull(), "unasked").when(~F.col("status").eqNullSafe(F.lit("completed")), "unfinished").when(_none("fact_ids"), "no_fact").alias("rule_id")).filter("rule_id IS NOT NULL")
    each = both.filter("asked AND traced").select("query_id", "evidence_ids", *[f"_{k}" for k in QUERY_KEYS], F.explode(F.array_distinct("fact_ids")).alias("fact_id"))
    known = each.join(facts.select("fact_id", *QUERY_KEYS, "primary_evidence_id", "validation_status", F.lit(True).alias("known")), "fact_id", "left")
    same = F.lit(True)
    for k in QUERY_KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    there = F.col("known").isNotNull()
    rules = [F.when(~there, "unknown_fact"), F.when(there & ~F.col("validation_status").eqNullSafe(F.lit("verified")), "not_verified"), F.when(there & ~same, "other_identity"), F.when(there & ~F.coalesce(F.array_contains("evidence_ids", F.col("primary_evidence_id")), F.lit(False)), "evidence_not_retrieved")]
    return whole.unionByName(_broken(known, ["query_id", "fact_id"], rules))


def not_alike(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Groups whose rows do not all have one value of a field; null is a value."""
    known = lambda c: F.struct(F.col(c).isNull(), F.col(c))
    seen = rows.groupBy(*by).agg(*[F.max(known(c)).alias(f"_h_{c}") for c in fields], *[F.min(known(c)).alias(f"_l_{c}") for c in fields])
    return _broken(seen, by, [F.when(F.col(f"_h_{c}") != F.col(f"_l_{c}"), f"different_{c}") for c in fields])


def signal_input_violations(pairs: DataFrame, metric: str, statement: str) -> DataFrame:
    """pairs(pair_id, current, previous: structs of a fact) that a year-on-year signal may not use."""
    rules = []
    for side in ("current", "previous"):
        wanted = {"validation_status": "verified", "metric_id": metric, "statement_type": statement, "period_type": "duration", "normalized_unit": "CNY", "currency": "CNY"}
        rules += [F.when(~F.col(f"{side}.{c}").eqNullSafe(F.lit(v)), f"{side}_{c}") for c, v in wanted.items()]
    differ = lambda c: ~F.col(f"current.{c}").eqNullSafe(F.col(f"previous.{c}"))
    rules += [F.when(differ("company_id"), "other_company"), F.when(differ("statement_scope"), "other_scope"), F.when(~(F.col("current.fiscal_year") == F.col("previous.fiscal_year") + 1), "years_not_consecutive")]
    return _broken(pairs, ["pair_id"], rules)


def size_report(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """Rows of each table, its verified rows where it has a state, the least number wished and whether that is met."""
    out = None
    for name, df in sorted(tables.items()):
        verified = F.count_if(F.col("validation_status") == "verified") if "validation_status" in df.columns else F.lit(None).cast("long")
        row = df.agg(F.count(F.lit(1)).alias("rows"), verified.alias("verified")).select(F.lit(name).alias("object"), "rows", "verified", F.lit(least.get(name, 0)).cast("long").alias("least"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("enough", F.col("rows") >= F.col("least"))


def support_present(evidences: DataFrame, items: DataFrame) -> DataFrame:
    """evidences(query_id, evidence_id, chunk_id or null, pdf_page), items(query_id, chunk_id, pdf_page) -> whether the
    context holds the evidence: by its chunk if that is known, else by page."""
    chunks = items.select("query_id", "chunk_id", F.lit(True).alias("_c")).distinct()
    pages = items.select("query_id", "pdf_page", F.lit(True).alias("_p")).distinct()
    both = evidences.join(chunks, ["query_id", "chunk_id"], "left").join(pages, ["query_id", "pdf_page"], "left")
    return both.select("query_id", "evidence_id", F.when(F.col("chunk_id").isNotNull(), F.col("_c").isNotNull()).otherwise(F.col("_p").isNotNull()).alias("present"))
