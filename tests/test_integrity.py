"""Dimension files, contracts of rows and references: planted breaches of each kind beside good rows."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quarry.operators import integrity
from quarry.sources import dimensions

STAMP = "2024-01-01T00:00:00Z"
GOOD = {
    "companies": {"company_id": "c", "legal_name_cn": "n", "short_name_cn": "n", "stock_code": "000001", "exchange": "x", "industry": "i", "status": "active"},
    "reports": {"report_id": "c_2024", "company_id": "c", "fiscal_year": 2024, "report_type": "annual", "title": "t", "status": "active", "created_at": STAMP, "updated_at": STAMP},
    "mappings": {"mapping_id": "m", "report_id": "c_2024", "rule_type": "offset", "pdf_page_start": 3, "pdf_page_end": 9, "printed_page_start": 1, "printed_page_end": 7, "offset": -2, "validation_status": "verified"},
    "metrics": {"metric_id": "revenue", "display_name_cn": "r", "period_type": "duration", "default_unit": "CNY", "allowed_scopes": ["consolidated"], "status": "active"},
    "aliases": {"alias_id": "a", "metric_id": "revenue", "alias": "sales", "match_type": "exact", "priority": 1},
    "facts": {
        "fact_id": "f", "company_id": "c", "report_id": "c_2024", "metric_id": "revenue", "fiscal_year": 2024, "statement_type": "income_statement", "statement_scope": "consolidated", "period_type": "duration", "period_start": "2024-01-01",
        "period_end": "2024-12-31", "raw_value": "1.2500", "unit_multiplier": "1000", "normalized_value": "1250.0000", "raw_unit": "CNY_thousand", "normalized_unit": "CNY", "currency": "CNY", "is_comparative_value": False,
        "restatement_status": "not_applicable", "primary_evidence_id": "e", "validation_status": "verified", "validated_by": "me", "validated_at": STAMP, "created_at": STAMP, "updated_at": STAMP,
    },
    "links": {"fact_id": "f", "evidence_id": "e", "support_type": "primary"},
    "evidences": {"evidence_id": "e", "report_id": "c_2024", "evidence_type": "table", "attribution_type": "x", "pdf_page": 3, "evidence_text": "t", "source_hash": "h", "validation_status": "verified"},
    "calculations": {"calculation_id": "k", "metric_id": "m", "formula_id": "growth", "result_value": "-12.5", "result_unit": "percent", "input_fact_ids": ["f", "g"], "validation_status": "verified", "created_at": STAMP},
}


def files(tmp_path, extra):
    paths = {}
    for name, good in GOOD.items():
        path = tmp_path / f"{name}.jsonl"
        rows = [good, *extra.get(name, [])]
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps({"schema_version": 1} | r) for r in rows) + "\n\n")
        paths[name] = f"file://{path}"
    return paths


def test_files_are_typed_and_what_is_wrong_is_kept(spark, tmp_path):
    bad = {
        "facts": [GOOD["facts"] | c for c in ({"raw_value": "1,2"}, {"period_start": "soon"}, {"metric_id": None}, {"schema_version": 2}, {"created_at": "never"})] + ["{broken", '{"schema_version": 1}'],
        "metrics": [GOOD["metrics"] | {"allowed_scopes": "consolidated"}], "calculations": [GOOD["calculations"] | {"result_value": "many"}],
    }
    tables, rejected = dimensions.load_all(spark, files(tmp_path, bad))
    (fact,) = tables["facts"].collect()
    assert (str(fact["raw_value"]), fact["period_start"], fact["as_of_date"]) == ("1.2500", date(2024, 1, 1), None)
    (c,) = tables["calculations"].collect()
    assert (str(c["result_value"]), c["input_fact_ids"]) == ("-12.5000", ["f", "g"])
    rules = sorted((r["table"], r["rule_id"]) for r in rejected.collect())
    assert rules == [("calculations", "bad_result_value"), *(("facts", x) for x in ("bad_created_at", "bad_period_start", "bad_raw_value", "broken_json", "missing_fact_id", "missing_metric_id", "schema_version")), ("metrics", "broken_json")]
    assert all(r["line"] and r["file"].endswith(".jsonl") for r in rejected.collect())
    tables.pop("calculations")
    assert integrity.dimension_violations(tables).collect() == []


def test_one_table_of_breaches_over_the_dimensions(spark, tmp_path):
    extra = {
        "reports": [GOOD["reports"] | {"report_id": "z_2023", "company_id": "z", "fiscal_year": 2024}], "mappings": [GOOD["mappings"] | {"mapping_id": "m2", "report_id": "no", "offset": -1}],
        "aliases": [GOOD["aliases"], GOOD["aliases"] | {"alias_id": "b", "metric_id": "no"}], "links": [{"fact_id": "no", "evidence_id": "nor", "support_type": "primary"}],
        "facts": [GOOD["facts"] | {"fact_id": "g", "company_id": "z", "statement_scope": "parent_company", "primary_evidence_id": "nor"}, GOOD["facts"] | {"fact_id": "h", "report_id": "z_2023", "normalized_unit": "percent"}],
    }
    tables, rejected = dimensions.load_all(spark, files(tmp_path, extra))
    assert rejected.count() == 0
    got = sorted(tuple(r) for r in integrity.dimension_violations({k: v for k, v in tables.items() if k != "calculations"}).fillna("").collect())
    assert got == sorted([
        ("aliases", "a", "repeated_key", ""), ("aliases", "b", "metric_unknown", "no"), ("mappings", "m2", "offset_differs", ""), ("mappings", "m2", "report_unknown", "no"), ("reports", "z_2023", "id_differs", ""), ("reports", "z_2023", "company_unknown", "z"),
        ("links", "no/nor", "fact_unknown", "no"), ("links", "no/nor", "evidence_unknown", "nor"), ("facts", "g", "company_unknown", "z"), ("facts", "g", "report_other_company_id", "c_2024"), ("facts", "g", "report_of_other_company", ""),
        ("facts", "g", "primary_evidence_unknown", "nor"), ("facts", "g", "scope_not_allowed", "revenue"), ("facts", "h", "report_of_other_company", ""), ("facts", "h", "year_differs_from_report", ""), ("facts", "h", "report_other_company_id", "z_2023"),
        ("facts", "h", "primary_evidence_other_report_id", "e"), ("facts", "h", "metric_other_default_unit", "revenue"), ("facts", "h", "money_not_in_base_unit", ""), ("facts", "h", "currency_of_no_money", ""),
    ])


@pytest.mark.parametrize(
    "change, rules",
    [
        ({"report_id": "c"}, ["report_of_other_company", "report_without_year"]), ({"fiscal_year": 2023}, ["year_differs_from_report"]), ({"is_comparative_value": True, "fiscal_year": 2025, "restatement_status": "restated"}, ["comparative_after_report"]),
        ({"period_type": "instant"}, ["flow_not_duration", "instant_with_period", "instant_without_date"]), ({"period_end": None}, ["duration_without_period"]), ({"as_of_date": date(2024, 1, 1)}, ["duration_with_date"]),
        ({"period_end": date(2023, 1, 1)}, ["period_reversed"]), ({"statement_type": "balance_sheet"}, ["balance_not_instant"]), ({"raw_unit": "text"}, ["multiplier_differs", "text_unit", "unit_changed"]), ({"unit_multiplier": 100}, ["multiplier_differs", "value_differs"]),
        ({"currency": None}, ["currency_missing"]), ({"restatement_status": "unknown"}, ["restated_without_comparison"]), ({"is_comparative_value": True}, ["comparison_without_state"]), ({"is_comparative_value": True, "restatement_status": "unknown"}, ["verified_unknown_restatement"]),
        ({"statement_scope": "unknown"}, ["verified_unknown_scope"]), ({"validated_by": None}, ["verified_by_nobody"]), ({"validated_at": None}, ["verified_without_time"]), ({"updated_at": "2023-01-01"}, ["updated_before_created"]), ({"validated_at": "2023-01-01"}, ["validated_before_created"]),
        ({"validation_status": "pending", "validated_by": None, "validated_at": None, "statement_scope": "unknown"}, []),
    ],
)
def test_each_rule_of_a_fact(spark, tmp_path, change, rules):
    fact = dimensions.load(spark, files(tmp_path, {})["facts"], "facts")[0]
    for name, value in change.items():
        fact = fact.withColumn(name, F.lit(value).cast(fact.schema[name].dataType))
    assert sorted(r["rule_id"] for r in integrity.broken_rows(fact, "facts", "fact_id", integrity.FACT_RULES).collect()) == rules


def test_rules_of_pages_documents_and_mappings(spark):
    page = "page_id string, parse_status string, parse_error string, content_type string, raw_text string, normalized_text string, raw_char_count int, normalized_char_count int, text_block_count int, image_block_count int, embedded_image_count int, max_image_area_ratio double"
    rows = [
        ("ok", "success", None, "text", "ab", "ab", 2, 2, 1, 0, 0, 0.0), ("error", "parse_error", "E: x", "unknown", "", "", 0, 0, 0, 0, 0, 0.0), ("counts", "success", None, "text", "ab", "a", 1, 2, 1, 0, 0, 0.0), ("blank", "success", "x", "mixed", "", "", 0, 0, 0, 0, 0, 0.0),
        ("scan", "success", None, "scanned", "a", "a", 1, 1, 0, 0, 0, 0.0), ("none", "success", None, "empty", "", "", 0, 0, 0, 1, 0, 0.0), ("what", "success", None, "unknown", "", "", 0, 0, 0, 0, 0, 0.0), ("half", "parse_error", " ", "text", "a", "", 1, 0, 0, 0, 0, 0.5),
    ]
    got = {}
    for r in integrity.broken_rows(spark.createDataFrame(rows, page), "pages", "page_id", integrity.PAGE_RULES).collect():
        got.setdefault(r["entity_id"], []).append(r["rule_id"])
    assert got == {
        "counts": ["raw_count_differs", "normalized_count_differs"], "blank": ["success_with_error", "text_missing", "image_missing"], "scan": ["text_unexpected", "image_missing"], "none": ["image_unexpected"], "what": ["success_of_unknown_type"],
        "half": ["error_without_message", "error_with_type", "error_with_text", "error_with_counts"],
    }
    doc = spark.createDataFrame([("doc_r_" + "a" * 24, "r", "a" * 64, "x/y.pdf", "y.pdf", 3, 3, "matched", "valid"), ("d", "r", "a" * 64, "y", "z", 3, 4, "matched", "blocked"), ("doc_r_" + "a" * 24, "r", "a" * 64, "y", "y", 3, 3, "mismatched", "valid")],
                                "document_id string, report_id string, sha256 string, source_path string, source_filename string, pdf_page_count int, expected_pdf_page_count int, page_count_status string, validation_status string")
    assert sorted(r["rule_id"] for r in integrity.broken_rows(doc, "documents", "document_id", integrity.DOCUMENT_RULES).collect()) == sorted(["id_differs", "filename_differs", "matched_but_differs", "blocked_but_matched", "mismatched_but_equal", "valid_but_not_matched"])


def test_tables_are_read_once_however_many_rules(spark, tmp_path, monkeypatch):
    kinds = spark.createDataFrame([("k1", "red"), ("k2", "blue")], "kind string, colour string")
    items = spark.createDataFrame([("i1", ["k1", "k9", None], "red", "k2"), ("i2", None, "red", "k2")], "item string, kinds array<string>, colour string, main string")
    for name, df in (("kinds", kinds), ("items", items)):
        df.write.parquet(f"file://{tmp_path}/{name}")
    tables = {n: spark.read.parquet(f"file://{tmp_path}/{n}") for n in ("kinds", "items")}
    refs = [integrity.Reference("kind", "items", "kinds", "kinds", "kind", many=True), integrity.Reference("main", "items", "main", "kinds", "kind", {"colour": "colour"}), integrity.Reference("again", "items", "main", "kinds", "kind")]
    passes = []
    real = integrity.materialize
    monkeypatch.setattr(integrity, "materialize", lambda df: passes.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    found = integrity.check(tables, {"items": "item"}, references=refs)
    assert sorted(tuple(r) for r in found.collect()) == [("items", "i1", "kind_unknown", "k9"), ("items", "i1", "main_other_colour", "k2"), ("items", "i2", "main_other_colour", "k2")]
    assert len(passes) == 1 and passes[0].count("FileScan") == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2  # the references, and the parent
