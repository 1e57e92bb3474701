"""Gate, packets, step tables, scoring jobs and dataset helpers on inline cases."""

from decimal import Decimal

import numpy as np
import pytest

from quarry.operators import context, evaluation, evidence, facts, questions, scoring
from quarry.sources import datasets


def test_gate_and_packets(spark):
    q = spark.createDataFrame([(1, "revenue", "income_statement", 2024), (2, "revenue", "balance_sheet", 2024), (3, "revenue", "income_statement", 2024)], "query_id int, metric_name string, statement_type string, fiscal_year int")
    items = spark.createDataFrame([(1, "E1", "合并 利润表\nRevenue 2024: 1,234.5"), (1, "E2", "revenue 1,234.5"), (2, "E1", "Balance sheet revenue 2024")], "query_id int, citation string, text string")
    ready = evidence.assess(q, items)
    assert {r.query_id: (r.status, r.supporting) for r in ready.collect()} == {1: ("ready", ["E1"]), 2: ("insufficient", []), 3: ("no_hits", [])}
    packets = evidence.answer_packets(ready, items)
    answers = spark.createDataFrame([(1, "1,234.5 [E1]")], "query_id int, answer string")
    got = {r.query_id: (r.status, r.citations) for r in evidence.final_results(packets, answers).collect()}
    assert got == {1: ("answered", ["E1"]), 2: ("refused", None), 3: ("refused", None)}


def test_steps(spark):
    schema = "case_id string, pos int, step_id string, action string, fact_id string, depends array<string>"
    rows = [("a", 0, "s1", "retrieve", "f1", []), ("a", 1, "s2", "answer", None, ["s1"]), ("b", 0, "s1", "retrieve", "none", []), ("b", 1, "s1", "retrieve", "f1", ["s9"])]
    steps = spark.createDataFrame(rows, schema)
    assert sorted((r.case_id, r.rule_id) for r in questions.topology_violations(steps).collect()) == [("b", "depends_on_later_step"), ("b", "last_step_is_no_answer"), ("b", "repeated_step")]
    run = lambda rows: spark.createDataFrame(rows, "case_id string, case_status string")
    change = {r.change: r.cases for r in questions.compare_runs(run([("a", "failed"), ("b", "completed"), ("c", "failed")]), run([("a", "completed"), ("b", "failed"), ("d", "failed")])).collect()}
    assert change == {"recovered": 1, "regressed": 1, "removed": 1, "added": 1}
    gold = spark.createDataFrame([("a", "x", ["1", "2"]), ("b", "y", ["1"])], "case_id string, answer string, fact_ids array<string>")
    assert tuple(questions.exact_matches(gold.filter("case_id = 'a'"), gold).first()) == (2, 1, 1)


CASE = "case_id string, queries array<struct<query_id string, target_fact_id string, gold_pdf_pages array<int>, year int>>, steps array<struct<step_id string, action string, target_fact_ids array<string>, input_refs array<string>, depends_on array<string>, output_ref string, calculation_id string, formula_id string>>"


def cases(spark):
    q = lambda *pairs: [(i, f, [1], 2024) for i, f in pairs]
    get = lambda i, f: (i, "retrieve", [f], ["dropped"], ["dropped"], f, None, None)
    calc = lambda i, refs, formula, out: (i, "calculate", [], refs, [], out, f"calc_{i}", formula)
    pas = lambda i, refs, out: (i, "synthesize", [], refs, [], out, None, None)
    rows = [
        ("good", q(("q1", "f1"), ("q2", "f2")), [get("s1", "f1"), get("s2", "f2"), calc("s3", ["f1", "f2"], "growth", "up"), pas("s4", ["up", "f2"], "both"), pas("s5", ["both"], "answer")]),
        ("twice", q(("q0", "f1"), ("q1", "f1")), [get("s1", "f1")]),
        ("zero", q(("q1", "f1"), ("q3", "f3")), [get("s1", "f1"), get("s2", "f3"), calc("s3", ["f1", "f3"], "current_ratio_formula", "r"), pas("s4", ["r"], "answer")]),
        ("nested", q(("q1", "f1"), ("q2", "f2")), [get("s1", "f1"), get("s2", "f2"), calc("s3", ["f1", "f2"], "growth", "g"), calc("s4", ["g", "f1"], "expense_ratio", "x")]),
        ("later", q(("q1", "f1")), [pas("s1", ["f1", "no"], "a"), get("s2", "f1")]),
        ("failed", q(("q4", "f4"), ("q5", "f5")), [get("s1", "f4"), get("s2", "f5")]),
        ("empty", q(("q5", "f5")), [get("s1", "f5")]),
        ("unknown", q(), [get("s1", "f1")]),
        ("none", None, []),
    ]
    return spark.createDataFrame(rows, CASE)


def test_plans_name_queries_instead_of_facts(spark):
    seen = questions.sub_queries(cases(spark))
    assert seen.columns == ["case_id", "pos", "query_id", "year"] and seen.count() == 12
    steps = {(r["case_id"], r["step_id"]): r for r in questions.plan_steps(questions.plans(cases(spark))).collect()}
    s1, s3, s4 = (steps["good", s] for s in ("s1", "s3", "s4"))
    assert (s1["query_id"], s1["input_refs"], s1["depends_on"], s1["output_ref"]) == ("q1", [], [], "retrieval_result_q1")
    assert s3["input_refs"] == ["retrieval_result_q1", "retrieval_result_q2"] and s4["input_refs"] == ["up", "retrieval_result_q2"]
    assert steps["twice", "s1"]["query_id"] == "q1" and steps["unknown", "s1"]["query_id"] is None
    bad = sorted(map(tuple, questions.reference_violations(questions.plans(cases(spark))).fillna("").collect()))
    assert bad == [("later", "s1", "no", "unknown_reference"), ("later", "s1", "retrieval_result_q1", "later_reference"), ("unknown", "s1", "", "no_query")]
    repeated = spark.createDataFrame([("c", None, [("s1", "answer", [], [], [], "x", None, None), ("s2", "answer", [], ["x"], [], "x", None, None)])], CASE)
    assert [r["rule_id"] for r in questions.reference_violations(questions.plans(repeated)).collect()] == ["repeated_output"]


def test_cases_stop_at_the_step_that_fails(spark):
    traces = spark.createDataFrame([("q1", "completed", None, ["f1", "other"]), ("q2", "completed", None, ["f2"]), ("q3", "completed", None, ["f3"]), ("q4", "failed", "timeout", []), ("q5", "completed", None, [])], "query_id string, status string, error string, fact_ids array<string>")
    D = "fact_id string, company_id string, fiscal_year int, normalized_value decimal(20,2), verified boolean"
    registry = spark.createDataFrame([("f1", "c", 2024, Decimal(120), True), ("f2", "c", 2023, Decimal(100), True), ("f3", "c", 2024, Decimal(0), True)], D)
    log = questions.run_cases(questions.plans(cases(spark)), traces, registry)
    rows = {(r["case_id"], r["step_id"]): r for r in log.collect()}
    assert rows["good", "s3"]["result_value"] == Decimal("20.0000") and rows["good", "s4"]["ids"] == ["calc_s3", "f2"]
    got = {r["case_id"]: (r["case_status"], r["failed_at"], r["failure_stage"], r["message"], r["not_run"], r["answer_ids"]) for r in questions.case_results(log).collect()}
    assert got == {
        "good": ("completed", None, None, None, 0, ["calc_s3", "f2"]), "twice": ("completed", None, None, None, 0, ["f1"]), "zero": ("failed", 2, "calculation", "guard_failed", 1, None),
        "nested": ("failed", 3, "calculation", "input_is_no_fact", 0, None), "later": ("failed", 0, "planning", "unknown_reference", 1, None), "failed": ("failed", 0, "retrieval", "timeout", 1, None),
        "empty": ("failed", 0, "retrieval", "no_fact", 0, None), "unknown": ("failed", 0, "planning", "no_query", 0, None),
    }
    asked = {r["case_id"]: (r["planned_queries"], r["executed_queries"], r["resolved_queries"], r["calculated"]) for r in questions.case_results(log).collect()}
    assert asked["good"] == (2, 2, 2, 1) and asked["failed"] == (2, 1, 0, 0) and asked["later"] == (1, 0, 0, 0)


@pytest.mark.parametrize(
    "change, status",
    [
        ({}, "done"), ({"company_id": "d"}, "other_context"), ({"report_id": "r2"}, "other_context"), ({"fiscal_year": 2023}, "other_context"), ({"statement_scope": "parent"}, "other_context"), ({"period_type": "instant"}, "other_context"),
        ({"period_end": "2024-06-30"}, "other_context"), ({"as_of_date": "2024-12-31"}, "other_context"), ({"currency": "USD"}, "other_currency"), ({"normalized_unit": None}, "other_currency"), ({"verified": False}, "input_not_verified"),
        ({"verified": None}, "input_not_verified"), ({"normalized_value": None}, "input_missing"), ({"normalized_value": Decimal(0), "formula": "cash_flow_to_net_profit"}, "guard_failed"),
        ({"fiscal_year": 2023, "report_id": "r2", "period_end": "2023-12-31", "formula": "growth"}, "done"), ({"fiscal_year": 2022, "formula": "growth"}, "other_context"), ({"fiscal_year": 2023, "statement_scope": "x", "formula": "growth"}, "other_context"),
        ({"fiscal_year": None, "formula": "growth"}, "other_context"), ({"formula": "nothing"}, "unknown_formula"), ({"formula": "expense_ratio"}, "input_count"),
    ],
)
def test_inputs_of_a_calculation_agree_in_context(spark, change, status):
    base = {"company_id": "c", "report_id": "r", "fiscal_year": 2024, "statement_scope": "group", "period_type": "duration", "period_start": "2024-01-01", "period_end": "2024-12-31", "as_of_date": None, "normalized_unit": "CNY", "currency": "CNY", "normalized_value": Decimal(50), "verified": True}
    formula = change.get("formula", "gross_profit_margin_formula")
    other = base | {k: v for k, v in change.items() if k != "formula"}
    schema = ", ".join(f"{k} {'int' if k == 'fiscal_year' else 'boolean' if k == 'verified' else 'decimal(20,2)' if k == 'normalized_value' else 'string'}" for k in base)
    known = spark.createDataFrame([("a", *base.values()), ("b", *other.values())], f"fact_id string, {schema}")
    asked = spark.createDataFrame([("x", formula, ["a", "b"])], "calculation_id string, formula_id string, input_fact_ids array<string>")
    (r,) = facts.calculate(asked, known).collect()
    assert r["status"] == status and (r["result_value"] is not None) == (status == "done")


def test_rates_of_two_runs_and_failures(spark):
    run = lambda *rows: spark.createDataFrame(rows, "case_status string, planned_queries int, resolved_queries int")
    got = questions.run_deltas(run(("completed", 2, 2), ("failed", 2, 0)), run(("completed", 2, 2), ("completed", 2, 1), ("failed", 1, 1))).first()
    assert tuple(got) == (2, 0.5, 0.5, 3, 0.666667, 0.8, 0.166667, 0.3)
    assert questions.run_deltas(run(("failed", 0, 0)), run(("failed", 0, 0))).first()["resolution_change"] is None
    ranks = spark.createDataFrame([("m", 1, 5), ("m", 2, 6), ("m", 3, None)], "method string, query_id int, first_rank int")
    assert [tuple(r) for r in evaluation.failures(ranks, ["method"]).collect()] == [("m", 2, 6), ("m", 3, None)]


def test_summaries_and_context(spark):
    rows = spark.createDataFrame([("x", "hit"), ("x", "miss"), ("y", "hit")], "kind string, outcome string")
    got = {(r.kind, r.outcome, r.level): r.cases for r in evaluation.group_summary(rows, ["kind"]).collect()}
    assert got == {(None, "hit", 2): 2, (None, "miss", 2): 1, ("x", "hit", 0): 1, ("x", "miss", 0): 1, ("y", "hit", 0): 1}
    hits = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "query_id int, rank int, chunk_id string")
    assert [r.query_id for r in context.unresolved_only(hits, hits.filter("query_id = 1")).collect()] == [2]
    said = spark.createDataFrame([(1, 1, "b", "selected"), (1, 2, "c", "char_budget")], "query_id int, selection_rank int, chunk_id string, decision string")
    chunks = spark.createDataFrame([("a", "xx"), ("b", "yyy")], "chunk_id string, text string")
    assert [(r.context_order, r.chunk_id, r.chars_so_far) for r in context.selected_context(hits.filter("query_id = 1"), said, chunks).collect()] == [(1, "a", 2), (2, "b", 5)]


def test_scoring_jobs(spark):
    texts = spark.createDataFrame([(i, "x" * i if i else None) for i in range(130)], "id long, text string")
    got = {r.id: r.embedding for r in scoring.embed(texts, lambda: lambda batch: np.array([[len(t), 1.0] for t in batch]), 50).collect()}
    assert got[7] == [7.0, 1.0] and got[0] == [0.0, 1.0] and len(got) == 130
    pairs = spark.createDataFrame([(1, "a", "q", "tt"), (1, "b", "q", None)], "query_id long, chunk_id string, query string, text string")
    assert {r.chunk_id: r.score for r in scoring.score_pairs(pairs, lambda: lambda p: np.array([len(t) or np.nan for _, t in p])).collect()} == {"a": 2.0, "b": None}


def test_dataset_helpers(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    whole, twice = datasets.merge_cases([a, a.filter("k = 'k1'")], "k")
    assert whole.count() == 3 and [r.k for r in twice.collect()] == ["k1"]
    grown, clash = datasets.append_missing(a, spark.createDataFrame([("k2", 9), ("k3", 3)], "k string, v int"), "k")
    assert sorted(r.k for r in grown.collect()) == ["k1", "k2", "k3"] and [tuple(r) for r in clash.collect()] == [("k2", 9)]
    r = spark.createDataFrame([("a",), ("b",)], "report_id string")
    m = spark.createDataFrame([("a",), ("a",)], "report_id string")
    assert sorted(tuple(x) for x in datasets.route_violations(r, m).collect()) == [("a", "several_indexes"), ("b", "no_index")]
    assert len(spark.range(1).select(datasets.dataset_id("x", a=1, b="c")).first()[0]) == 26
