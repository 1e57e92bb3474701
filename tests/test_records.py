"""Records of failing extractors, facts from specifications, what-if orders."""

import sys
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarry.operators import derivation, evaluation, integrity, pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def extractor(value):
    if value == "long":
        raise RuntimeError("x" * 5000)
    if value == "exit":
        return ["no dict"]
    if value is None:
        return {}
    return {"text": f" {value}\r\n", "text_block_count": 2, "image_block_count": 1 if value == "image" else 0, "max_image_area_ratio": 0.7 if value == "full" else 0}


def test_a_failing_row_fails_alone(spark):
    rows = [(1, "good"), (2, "long"), (3, "exit"), (4, None), (5, "image"), (6, "full"), (7, ""), (2, "long")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id int, body string, parse_error string").repartition(1)
    out = pages.extract(df, "body", extractor, ["page_id"])
    got = {r["page_id"]: r for r in out.collect()}
    assert out.count() == 8
    assert {i: (r["parse_status"], r["content_type"]) for i, r in got.items()} == {1: ("success", "text"), 2: ("parse_error", "unknown"), 3: ("parse_error", "unknown"), 4: ("success", "empty"), 5: ("success", "text"), 6: ("success", "mixed"), 7: ("success", "empty")}
    assert len(got[2]["parse_error"]) == 1000 and got[2]["parse_error"].startswith("RuntimeError: xxx") and got[3]["parse_error"].startswith("AttributeError")
    assert (got[1]["raw_char_count"], got[1]["normalized_text"], got[2]["raw_char_count"], got[2]["text_block_count"]) == (7, "good", 0, 0)
    assert integrity.broken_rows(out, "pages", "page_id", integrity.PAGE_RULES).count() == 0
    assert pages.extract(df.limit(0), "body", extractor, ["page_id"]).count() == 0


def test_facts_stand_in_their_chunks(spark):
    chunk = "chunk_id string, company_id string, report_id string, document_id string, pdf_page int, text string"
    chunks = spark.createDataFrame([("a", "c", "r", "d", 1, "revenue 1,200 cost 7"), ("a", "c", "r", "d", 1, "revenue 1,200 cost 7"), ("b", "c", "r", "d", 2, "one"), ("b", "c", "r", "d", 2, "other"), ("e", "c", "r", "d", 3, None)], chunk)
    spec = "chunk_id string, metric_id string, fiscal_year int, statement_type string, statement_scope string, row_label string, column_label string, cell_value string, raw_value decimal(20,2), raw_unit string"
    one = lambda c, m, label, value, unit="CNY_thousand": (c, m, 2024, "note", "group", label, "2024", value, Decimal("1200"), unit)
    specs = spark.createDataFrame([one("a", "m1", "revenue", "1,200"), one("a", "m1", "revenue", "1,200"), one("a", "m1", "cost", "7"), one("a", "m2", "tax", "7"), one("a", "m3", "cost", "8"), one("a", "m4", "cost", None), one("a", "m5", " ", "7"),
                                   one("a", "m6", "cost", "7", "USD"), one("b", "m7", "one", "one"), one("x", "m8", "x", "x"), one("e", "m9", "x", "x"), one(None, "m0", "x", "x")], spec)
    facts, evidences, links, bad = derivation.from_specs(specs, chunks)
    assert sorted((r["metric_id"], r["rule_id"]) for r in bad.collect()) == [
        ("m0", "unknown_chunk"), ("m1", "repeated_fact"), ("m1", "repeated_fact"), ("m2", "row_label_missing"), ("m3", "cell_value_missing"), ("m4", "cell_value_missing"), ("m5", "row_label_missing"), ("m6", "unknown_unit"), ("m7", "conflicting_chunk"),
        ("m8", "unknown_chunk"), ("m9", "row_label_missing"),
    ]
    (fact,), (evidence,), (link,) = facts.collect(), evidences.collect(), links.collect()
    assert (fact["row_label"], fact["normalized_value"], evidence["cell_value"], evidence["pdf_page"]) == ("cost", Decimal("1200000.0000"), "7", 1)
    assert fact["primary_evidence_id"] == evidence["evidence_id"] == link["evidence_id"] and fact["fact_id"] == link["fact_id"]
    again = derivation.from_specs(specs.filter("metric_id = 'm1' and row_label = 'cost'"), chunks)[0].first()
    assert again["fact_id"] == fact["fact_id"] and again["primary_evidence_id"] == fact["primary_evidence_id"]


def test_orders_recover_and_lose(spark):
    pool = spark.createDataFrame([(1, "a", 900, 1), (1, "b", 900, 2), (1, "c", 100, 3), (2, "a", 10, 1), (2, "b", 20, 2), (2, "c", 30, 3), (3, "z", 5000, 1)], "query_id int, chunk_id string, n_chars int, place int")
    support = spark.createDataFrame([(1, "b"), (2, "a"), (3, "z")], "query_id int, chunk_id string")
    out = evaluation.what_if(pool, {"place": [F.col("place")], "back": [-F.col("place")], "size": [F.col("n_chars")]}, support)
    got = {(r["strategy"], r["query_id"]): (r["items"], r["chars"], r["supported"]) for r in out.collect()}
    assert got == {
        ("place", 1): (2, 1000, False), ("back", 1): (2, 1000, True), ("size", 1): (2, 1000, False), ("place", 2): (2, 30, True), ("back", 2): (2, 50, False), ("size", 2): (2, 30, True),
        ("place", 3): (0, 0, False), ("back", 3): (0, 0, False), ("size", 3): (0, 0, False),
    }
    changes = {(r["strategy"], r["change"]): r["queries"] for r in evaluation.what_if_changes(out, "place").collect() if r["level"] == 0}
    assert changes == {("back", "recovered"): 1, ("back", "regressed"): 1, ("back", "neither"): 1, ("size", "both"): 1, ("size", "neither"): 2}
