"""Contracts of tables as tables of rules, checked in shared passes: rules of a row, keys that occur once, references.

A rule of a row is a SQL condition that says when it is broken. A reference leads from keys of a child table (one, or each
of an array) to a parent's key, and may name fields that both must agree in. All references out of a table leave in one pass
over it, as rows of (parent, key, what must agree); all references into a table meet it in one join, whatever tables they
come from. So a table is read once as child and once as parent, however many rules there are. Everything that is broken is
a row of (table, entity_id, rule_id, reference); null keys refer to nothing and break nothing (a rule of the row may forbid
them)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import materialize

FOUND = "table string, entity_id string, rule_id string, reference string"


@dataclass(frozen=True)
class Reference:
    """Keys of `child` (a SQL expression of a string, or with `many` of an array of strings) must be in parent.key.

    agree: a parent's SQL expression -> the child's, equal where the parent is there; nulls are equal to nulls."""

    rule: str
    child: str
    keys: str
    parent: str
    key: str
    agree: dict[str, str] = field(default_factory=dict)
    many: bool = False


def broken_rows(df: DataFrame, table: str, entity: str, rules: dict[str, str]) -> DataFrame:
    """Rows of a table that break rules: {rule_id: SQL condition of a breach}. A condition that is null is no breach."""
    said = F.array(*[F.when(F.expr(c), F.lit(rule)) for rule, c in rules.items()])
    return df.select(F.lit(table).alias("table"), F.expr(entity).cast("string").alias("entity_id"), F.explode(F.array_compact(said)).alias("rule_id"), F.lit(None).cast("string").alias("reference"))


def repeated_keys(df: DataFrame, table: str, key: str) -> DataFrame:
    """Keys that several rows have, or none."""
    n = df.groupBy(F.expr(key).cast("string").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.when(F.col("entity_id").isNull(), "no_key").when(F.col("n") > 1, "repeated_key")
    return n.select(F.lit(table).alias("table"), "entity_id", rule.alias("rule_id"), F.lit(None).cast("string").alias("reference")).filter("rule_id IS NOT NULL")


def outgoing(df: DataFrame, table: str, entity: str, references: list[Reference]) -> DataFrame:
    """All references out of one table: parent, key, entity_id, rule, fields (name -> value as text)."""
    parts = []
    for r in references:
        fields = F.array(*[F.struct(F.lit(p).alias("name"), F.expr(c).cast("string").alias("value")) for p, c in sorted(r.agree.items())]) if r.agree else F.array().cast("array<struct<name:string,value:string>>")
        keys = F.expr(r.keys) if r.many else F.array(F.expr(r.keys).cast("string"))
        parts.append(_told(keys, r, fields))
    none = F.array().cast("array<struct<parent:string,key:string,rule:string,fields:array<struct<name:string,value:string>>>>")
    every = F.concat(*[F.coalesce(p, none) for p in parts])
    return df.select(F.lit(table).alias("table"), F.expr(entity).cast("string").alias("entity_id"), F.inline(every))


def _told(keys, r: Reference, fields):
    return F.transform(F.array_compact(keys), lambda k: F.struct(F.lit(r.parent).alias("parent"), k.cast("string").alias("key"), F.lit(r.rule).alias("rule"), fields.alias("fields")))


def check(tables: dict[str, DataFrame], entities: dict[str, str], rows: dict[str, dict[str, str]] | None = None, references: list[Reference] | None = None, unique: dict[str, str] | None = None) -> DataFrame:
    """Every breach in `tables`: entities names each table's id (SQL), rows its row rules, unique its keys.

    A parent with several rows of a key counts as agreeing if one of them does. References of hot keys meet a parent's few
    attributes; the join is on (key), which Spark splits where one key has most references."""
    found = [broken_rows(tables[t], t, entities[t], rules) for t, rules in (rows or {}).items()] + [repeated_keys(tables[t], t, k) for t, k in (unique or {}).items()]
    by_child: dict[str, list[Reference]] = {}
    for r in references or []:
        by_child.setdefault(r.child, []).append(r)
    if by_child:
        out = materialize(reduce(DataFrame.unionByName, [outgoing(tables[t], t, entities[t], rs) for t, rs in by_child.items()]))
        parents: dict[tuple[str, str], set[str]] = {}
        for r in references:
            parents.setdefault((r.parent, r.key), set()).update(r.agree)
        for (parent, key), agree in parents.items():
            rules = [r.rule for r in references if (r.parent, r.key) == (parent, key)]
            mine = out.filter((F.col("parent") == parent) & F.col("rule").isin(rules))
            attributes = [F.struct(F.lit(a).alias("name"), F.expr(a).cast("string").alias("value")) for a in sorted(agree)]
            held = F.collect_set(F.array(*attributes) if attributes else F.array().cast("array<struct<name:string,value:string>>"))
            there = tables[parent].groupBy(F.expr(key).cast("string").alias("key")).agg(held.alias("held")).filter("key IS NOT NULL")
            both = mine.join(there, "key", "left")
            differs = F.transform(F.filter("fields", lambda f: ~F.exists("held", lambda h: F.exists(h, lambda x: (x["name"] == f["name"]) & x["value"].eqNullSafe(f["value"])))), lambda f: F.concat("rule", F.lit("_other_"), f["name"]))
            said = F.when(F.col("held").isNull(), F.array(F.concat("rule", F.lit("_unknown")))).otherwise(differs)
            found.append(both.select("table", "entity_id", F.explode(said).alias("rule_id"), F.col("key").alias("reference")))
    return reduce(DataFrame.unionByName, found)


def _year(c: str) -> str:
    return f"try_cast(substring_index({c}, '_', -1) AS int)"


#: Contracts of rows: {rule: SQL condition of a breach}. Values of kinds and states are fixed values.
FACT_RULES = {
    "report_without_year": f"{_year('report_id')} IS NULL",
    "report_of_other_company": "substring(report_id, 1, length(report_id) - length(substring_index(report_id, '_', -1)) - 1) <> company_id",
    "year_differs_from_report": f"NOT is_comparative_value AND {_year('report_id')} <> fiscal_year",
    "comparative_after_report": f"is_comparative_value AND {_year('report_id')} < fiscal_year",
    "instant_without_date": "period_type = 'instant' AND as_of_date IS NULL",
    "instant_with_period": "period_type = 'instant' AND (period_start IS NOT NULL OR period_end IS NOT NULL)",
    "duration_without_period": "period_type = 'duration' AND (period_start IS NULL OR period_end IS NULL)",
    "duration_with_date": "period_type = 'duration' AND as_of_date IS NOT NULL",
    "period_reversed": "period_end < period_start",
    "balance_not_instant": "statement_type = 'balance_sheet' AND period_type <> 'instant'",
    "flow_not_duration": "statement_type IN ('income_statement', 'cash_flow_statement') AND period_type <> 'duration'",
    "text_unit": "raw_unit = 'text' OR normalized_unit = 'text'",
    "multiplier_differs": "coalesce(element_at(map('CNY', 1, 'CNY_thousand', 1000, 'CNY_ten_thousand', 10000, 'CNY_million', 1000000, 'CNY_hundred_million', 100000000), raw_unit), 1) <> unit_multiplier",
    "money_not_in_base_unit": "raw_unit IN ('CNY', 'CNY_thousand', 'CNY_ten_thousand', 'CNY_million', 'CNY_hundred_million') AND normalized_unit <> 'CNY'",
    "unit_changed": "raw_unit NOT IN ('CNY', 'CNY_thousand', 'CNY_ten_thousand', 'CNY_million', 'CNY_hundred_million') AND normalized_unit <> raw_unit",
    "value_differs": "normalized_value <> raw_value * unit_multiplier",
    "currency_missing": "normalized_unit IN ('CNY', 'CNY_per_share') AND NOT currency <=> 'CNY'",
    "currency_of_no_money": "normalized_unit NOT IN ('CNY', 'CNY_per_share') AND currency IS NOT NULL",
    "restated_without_comparison": "NOT is_comparative_value AND restatement_status <> 'not_applicable'",
    "comparison_without_state": "is_comparative_value AND restatement_status = 'not_applicable'",
    "verified_unknown_restatement": "is_comparative_value AND validation_status = 'verified' AND restatement_status = 'unknown'",
    "verified_unknown_scope": "validation_status = 'verified' AND statement_scope = 'unknown'",
    "verified_by_nobody": "validation_status = 'verified' AND validated_by IS NULL",
    "verified_without_time": "validation_status = 'verified' AND validated_at IS NULL",
    "updated_before_created": "updated_at < created_at",
    "validated_before_created": "validated_at < created_at",
}
PAGE_RULES = {
    "raw_count_differs": "raw_char_count <> length(raw_text)",
    "normalized_count_differs": "normalized_char_count <> length(normalized_text)",
    "success_with_error": "parse_status = 'success' AND parse_error IS NOT NULL",
    "success_of_unknown_type": "parse_status = 'success' AND content_type = 'unknown'",
    "text_missing": "parse_status = 'success' AND content_type IN ('text', 'mixed') AND normalized_text = ''",
    "text_unexpected": "parse_status = 'success' AND content_type IN ('empty', 'scanned') AND normalized_text <> ''",
    "image_unexpected": "parse_status = 'success' AND content_type = 'empty' AND (image_block_count > 0 OR embedded_image_count > 0 OR max_image_area_ratio > 0)",
    "image_missing": "parse_status = 'success' AND content_type IN ('scanned', 'mixed') AND image_block_count = 0 AND embedded_image_count = 0 AND max_image_area_ratio = 0",
    "error_without_message": "parse_status = 'parse_error' AND coalesce(trim(parse_error), '') = ''",
    "error_with_type": "parse_status = 'parse_error' AND content_type <> 'unknown'",
    "error_with_text": "parse_status = 'parse_error' AND (raw_text <> '' OR normalized_text <> '')",
    "error_with_counts": "parse_status = 'parse_error' AND (raw_char_count <> 0 OR normalized_char_count <> 0 OR text_block_count <> 0 OR image_block_count <> 0 OR embedded_image_count <> 0 OR max_image_area_ratio <> 0)",
}
DOCUMENT_RULES = {
    "id_differs": "document_id <> concat('doc_', report_id, '_', substring(sha256, 1, 24))",
    "filename_differs": "substring_index(source_path, '/', -1) <> source_filename",
    "matched_but_differs": "page_count_status = 'matched' AND NOT pdf_page_count <=> expected_pdf_page_count",
    "mismatched_but_equal": "page_count_status = 'mismatched' AND pdf_page_count <=> expected_pdf_page_count",
    "valid_but_not_matched": "validation_status = 'valid' AND page_count_status <> 'matched'",
    "blocked_but_matched": "validation_status = 'blocked' AND page_count_status = 'matched'",
}
REPORT_RULES = {"id_differs": "report_id <> concat(company_id, '_', fiscal_year)", "updated_before_created": "updated_at < created_at"}
MAPPING_RULES = {
    "half_a_range": "(printed_page_start IS NULL) <> (printed_page_end IS NULL)",
    "pdf_range_reversed": "pdf_page_end < pdf_page_start",
    "printed_range_reversed": "printed_page_end < printed_page_start",
    "verified_without_range": "validation_status = 'verified' AND (printed_page_start IS NULL OR printed_page_end IS NULL)",
    "identity_without_range": "rule_type = 'identity' AND (printed_page_start IS NULL OR printed_page_end IS NULL)",
    "identity_with_offset": "rule_type = 'identity' AND coalesce(offset, 0) <> 0",
    "identity_differs": "rule_type = 'identity' AND (printed_page_start <> pdf_page_start OR printed_page_end <> pdf_page_end)",
    "offset_without_range": "rule_type = 'offset' AND (printed_page_start IS NULL OR printed_page_end IS NULL)",
    "offset_missing": "rule_type = 'offset' AND offset IS NULL",
    "offset_differs": "rule_type = 'offset' AND (pdf_page_start + offset <> printed_page_start OR pdf_page_end + offset <> printed_page_end)",
    "custom_without_notes": "rule_type = 'custom' AND coalesce(trim(notes), '') = ''",
}
#: Contract of a case: question, question_type, difficulty, company_ids, report_ids, fiscal_years, queries, steps, gold_*_ids,
#: answer, validation fields and times.
_ASKED, _GOLD = "array_sort(array_distinct(transform(queries, q -> q.target_fact_id)))", "array_sort(array_distinct(gold_fact_ids))"
_TAKEN = "array_sort(array_distinct(flatten(transform(filter(steps, s -> s.action = 'retrieve'), s -> s.target_fact_ids))))"
CASE_RULES = {
    "not_one_company": "question_type = 'single_company_multi_metric' AND size(company_ids) <> 1",
    "below_two_companies": "question_type = 'cross_company_comparison' AND size(company_ids) < 2",
    "below_three_companies": "question_type = 'multi_company_ranking' AND size(company_ids) < 3",
    "not_hard": "difficulty = 'hard' AND size(gold_fact_ids) < 4 AND size(company_ids) < 3",
    "report_of_no_company": "exists(report_ids, r -> size(filter(array_distinct(company_ids), c -> startswith(r, concat(c, '_')))) <> 1)",
    "company_without_report": "exists(company_ids, c -> NOT exists(report_ids, r -> startswith(r, concat(c, '_'))))",
    "query_facts_differ": f"{_ASKED} <> {_GOLD}",
    "baseline_differs": "exists(queries, q -> NOT q.baseline_query <=> question)",
    "query_of_other_company": "exists(queries, q -> NOT coalesce(array_contains(company_ids, q.company_id), false))",
    "query_of_other_report": "exists(queries, q -> NOT coalesce(array_contains(report_ids, q.report_id), false))",
    "query_of_other_year": "exists(queries, q -> NOT coalesce(array_contains(fiscal_years, q.fiscal_year), false))",
    "plan_facts_differ": f"{_TAKEN} <> {_GOLD}",
    "plan_calculations_differ": "array_sort(array_distinct(filter(transform(steps, s -> s.calculation_id), c -> c IS NOT NULL))) <> array_sort(array_distinct(gold_calculation_ids))",
    "input_not_made": "exists(transform(steps, (s, i) -> size(array_except(s.input_refs, transform(slice(steps, 1, i), p -> p.output_ref))) > 0), b -> b)",
    "dependency_missing": "exists(transform(steps, (s, i) -> exists(slice(steps, 1, i), p -> array_contains(s.input_refs, p.output_ref) AND NOT array_contains(s.depends_on, p.step_id))), b -> b)",
    "answer_of_other_fact": "size(array_except(answer.supporting_fact_ids, gold_fact_ids)) > 0",
    "answer_of_other_evidence": "size(array_except(answer.evidence_ids, gold_evidence_ids)) > 0",
    "answer_of_other_calculation": "size(array_except(answer.supporting_calculation_ids, gold_calculation_ids)) > 0",
    "verified_by_nobody": "validation_status = 'verified' AND validated_by IS NULL",
    "verified_without_time": "validation_status = 'verified' AND validated_at IS NULL",
    "validated_but_not_verified": "validation_status <> 'verified' AND (validated_by IS NOT NULL OR validated_at IS NOT NULL)",
    "updated_before_created": "updated_at < created_at",
}
#: References between the dimensions, with what both sides must agree in.
DIMENSION_REFERENCES = [
    Reference("company", "reports", "company_id", "companies", "company_id"),
    Reference("report", "mappings", "report_id", "reports", "report_id"),
    Reference("metric", "aliases", "metric_id", "metrics", "metric_id"),
    Reference("report", "evidences", "report_id", "reports", "report_id"),
    Reference("company", "facts", "company_id", "companies", "company_id"),
    Reference("report", "facts", "report_id", "reports", "report_id", {"company_id": "company_id"}),
    Reference("metric", "facts", "metric_id", "metrics", "metric_id", {"period_type": "period_type", "default_unit": "normalized_unit"}),
    Reference("primary_evidence", "facts", "primary_evidence_id", "evidences", "evidence_id", {"report_id": "report_id"}),
    Reference("fact", "links", "fact_id", "facts", "fact_id"),
    Reference("evidence", "links", "evidence_id", "evidences", "evidence_id"),
]
DIMENSION_KEYS = {"companies": "company_id", "reports": "report_id", "mappings": "mapping_id", "metrics": "metric_id", "aliases": "alias_id", "evidences": "evidence_id", "facts": "fact_id"}
ENTITIES = DIMENSION_KEYS | {"links": "concat_ws('/', fact_id, evidence_id)"}
ROW_RULES = {"reports": REPORT_RULES, "mappings": MAPPING_RULES, "facts": FACT_RULES}


def dimension_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every breach in those of the dimensions that are given: contracts of rows, repeated keys, references, and scopes that a
    fact's metric does not allow."""
    here = set(tables)
    refs = [r for r in DIMENSION_REFERENCES if {r.child, r.parent} <= here]
    found = check(tables, ENTITIES, {t: r for t, r in ROW_RULES.items() if t in here}, refs, {t: k for t, k in DIMENSION_KEYS.items() if t in here})
    if {"facts", "metrics"} <= here:
        allowed = tables["metrics"].select("metric_id", "allowed_scopes")
        off = tables["facts"].join(allowed, "metric_id").filter(~F.array_contains("allowed_scopes", F.col("statement_scope")))
        found = found.unionByName(off.select(F.lit("facts").alias("table"), F.col("fact_id").alias("entity_id"), F.lit("scope_not_allowed").alias("rule_id"), F.col("metric_id").alias("reference")))
    return found
