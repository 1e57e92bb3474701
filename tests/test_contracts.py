"""Contract rules on small cases."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import contracts, facts, pages


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_metric_rules(spark):
    fields = "metric_id string, statement_type string, period_type string, metric_origin string, formula_id string, value_type string, default_unit string, allowed_scopes array<string>, confusable_metric_ids array<string>, created_at string, updated_at string"
    rows = [
        ("a", "balance_sheet", "instant", "reported", None, "amount", "CNY", ["group"], ["b"], "1", "2"),
        ("b", "balance_sheet", "duration", "reported", "f", "text", "CNY", [], ["b", "b"], "2", "1"),
        ("c", "income_statement", "instant", "derived", None, "amount", "text", ["unknown", "unknown"], ["C!"], "1", "1"),
    ]
    assert found(contracts.metric_violations(spark.createDataFrame(rows, fields))) == sorted(
        [("b", r) for r in ("balance_sheet_not_instant", "reported_with_formula", "unit_of_other_type", "no_scope", "repeated_confusable", "confusable_with_itself", "updated_before_created")]
        + [("c", r) for r in ("statement_not_duration", "derived_without_formula", "unit_of_other_type", "repeated_scope", "unknown_scope", "bad_confusable_id")]
    )


def test_evidence_rules(spark):
    fields = "evidence_id string, evidence_type string, attribution_type string, statement_type string, statement_scope string, table_name string, row_label string, column_label string, cell_value string, section_title string, validation_status string, validated_by string, printed_page int"
    rows = [
        ("a", "financial_statement_cell", "report_disclosure", "s", "group", "t", "r", "c", "1", None, "verified", "x", 3),
        ("b", "management_statement", "report_disclosure", None, None, None, None, None, None, None, "verified", None, None),
        ("c", "financial_summary_table", "other", "s", "unknown", None, "r", "c", "1", None, "pending", None, None),
        ("d", "paragraph", "management_statement", None, None, None, None, None, None, "s", None, None, None),
    ]
    assert found(contracts.evidence_violations(spark.createDataFrame(rows, fields))) == sorted(
        [("b", r) for r in ("statement_without_attribution", "narrative_without_section", "verified_by_nobody", "verified_without_printed_page")]
        + [("c", "attribution"), ("c", "unknown_scope"), ("c", "table_without_table_name"), ("d", "attribution_without_statement")]
    )


def test_step_rules(spark):
    fields = "case_id string, step_id string, action string, retrieval_query_id string, input_refs array<string>, depends_on array<string>, calculation_id string, formula_id string, output_ref string"
    rows = [
        ("k", "1", "retrieve", "q", [], None, None, None, "o"), ("k", "2", "calculate", None, ["1"], ["1"], "c", "f", "c"), ("k", "3", "answer", None, ["c"], ["2"], None, None, "o"),
        ("k", "4", "retrieve", None, ["x"], ["1"], "c", None, "o"), ("k", "5", "normalize_unit", "q", [], [], None, None, "o"), ("k", "6", "compare", None, ["x"], [], None, "f", "o"),
    ]
    assert found(contracts.step_violations(spark.createDataFrame(rows, fields)).drop("case_id")) == sorted(
        [("4", r) for r in ("retrieve_without_query", "retrieve_with_inputs", "retrieve_depends", "calculation_fields")]
        + [("5", r) for r in ("query_outside_retrieve", "no_inputs", "no_calculation", "no_formula", "output_is_not_the_calculation")] + [("6", "calculation_fields")]
    )


def test_provenance_rules(spark):
    keys = "company_id string, report_id string, metric_id string, fiscal_year int, statement_scope string, statement_type string"
    own = ("c", "r", "m", 2024, "group", "note")
    queries = spark.createDataFrame([(q, *own) for q in ("q1", "q2", "q3", "q4")], f"query_id string, {keys}")
    facts = spark.createDataFrame([("f1", *own, "e1", "verified"), ("f2", "d", *own[1:], "e2", "pending")], f"fact_id string, {keys}, primary_evidence_id string, validation_status string")
    traces = spark.createDataFrame([("q1", "completed", ["f1", "f1"], ["e1"]), ("q2", "completed", ["f2", "f9"], []), ("q3", "failed", ["f1"], None), ("q5", "completed", ["f1"], ["e1"])], "query_id string, status string, fact_ids array<string>, evidence_ids array<string>")
    got = sorted((r.query_id, r.fact_id or "", r.rule_id) for r in contracts.provenance_violations(queries, traces, facts).collect())
    assert got == [("q2", "f2", "evidence_not_retrieved"), ("q2", "f2", "not_verified"), ("q2", "f2", "other_identity"), ("q2", "f9", "unknown_fact"), ("q3", "", "unfinished"), ("q3", "f1", "evidence_not_retrieved"), ("q4", "", "no_trace"), ("q5", "", "unasked")]


def test_alike_signal_inputs_and_support(spark):
    rows = spark.createDataFrame([("a", "x", None), ("a", "x", None), ("b", "x", "u"), ("b", None, "u"), ("b", "x", "v")], "k string, f string, g string")
    assert found(contracts.not_alike(rows, ["k"], ["f", "g"])) == [("b", "different_f"), ("b", "different_g")]
    fact = "struct<validation_status:string,metric_id:string,statement_type:string,period_type:string,normalized_unit:string,currency:string,company_id:string,statement_scope:string,fiscal_year:int>"
    good = ("verified", "net_profit", "income_statement", "duration", "CNY", "CNY", "c", "group", 2024)
    before = (*good[:8], 2023)
    pairs = spark.createDataFrame([("p", good, before), ("q", good, (*before[:6], "d", "group", 2022)), ("r", ("pending", *good[1:]), (*before[:5], None, *before[6:]))], f"pair_id string, current {fact}, previous {fact}")
    assert found(contracts.signal_input_violations(pairs, "net_profit", "income_statement")) == [("q", "other_company"), ("q", "years_not_consecutive"), ("r", "current_validation_status"), ("r", "previous_currency")]
    evidence = spark.createDataFrame([("q", "e1", "x", 9), ("q", "e2", "y", 1), ("q", "e3", None, 1), ("q", "e4", None, 2)], "query_id string, evidence_id string, chunk_id string, pdf_page int")
    items = spark.createDataFrame([("q", "x", 1), ("q", "z", 1)], "query_id string, chunk_id string, pdf_page int")
    assert found(contracts.support_present(evidence, items)) == [("q", "e1", True), ("q", "e2", False), ("q", "e3", True), ("q", "e4", False)]


def test_page_selections_and_hashes(spark):
    wanted = spark.createDataFrame([("r", [3, 1, 3]), ("s", [5]), ("t", [1]), ("u", []), ("v", None), ("w", [0, 1])], "report_id string, pdf_pages array<int>")
    reports = spark.createDataFrame([(x, 4) for x in "rsuvw"], "report_id string, pages int")
    good, bad = pages.selections(wanted, reports)
    assert found(good) == [("r", [1, 3])] and found(bad) == [("s", "out_of_range"), ("t", "unknown_report"), ("u", "no_pages"), ("v", "no_pages"), ("w", "out_of_range")]
    blocks = spark.createDataFrame([([(0,), (1,), (0,)],), ([],), (None,)], "b array<struct<type:int>>")
    assert [tuple(r.c) for r in blocks.select(pages.block_counts(F.col("b")).alias("c")).collect()] == [(2, 1), (0, 0), (0, 0)]
    fields = "report_id string, mapping_id string, rule_type string, pdf_page_start int, pdf_page_end int, printed_page_start int, offset int"
    rows = [("r", "a", "identity", 1, 3, None, None), ("r", "b", "offset", 4, 9, None, -3)]
    one, two = (pages.mapping_hash(spark.createDataFrame(x, fields)).first().mapping_sha256 for x in (rows, rows[::-1]))
    other = pages.mapping_hash(spark.createDataFrame([rows[0], (*rows[1][:6], -2)], fields)).first().mapping_sha256
    assert one == two != other


def test_references_and_find(spark):
    aliases, metrics = spark.createDataFrame([("a", "m"), ("b", "x")], "alias_id string, metric_id string"), spark.createDataFrame([("m",)], "metric_id string")
    mappings, reports = spark.createDataFrame([("p", "r"), ("q", "s")], "mapping_id string, report_id string"), spark.createDataFrame([("r",)], "report_id string")
    assert found(facts.reference_violations(aliases, metrics, mappings, reports)) == [("b", "metric_id_unknown"), ("q", "report_id_unknown")]
    table = spark.createDataFrame([("c", "m", 2023), ("c", "m", 2024), ("d", "m", 2024)], "company_id string, metric_id string, fiscal_year int")
    assert found(facts.find(table, company_id="c", fiscal_year=2024, metric_id=None)) == [("c", "m", 2024)] and facts.find(table).count() == 3
    with pytest.raises(ValueError):
        facts.find(table, colour=1)
