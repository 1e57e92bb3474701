"""Traces of sub-queries: which stage resolves what."""

import pytest

from quarry.operators import facts, lexical, traces

CHUNKS = [(f"r{r}_p{p}_{i}", f"r{r}", p, i, f"page {p} of report {r} speaks of topic{p} part{i} " + "filler " * (80 if p == 4 else 5)) for r in (1, 2) for p in range(1, 7) for i in (0, 1)]
KEYS = ("company_id", "report_id", "metric_id", "fiscal_year", "statement_scope", "statement_type")


def keyed(query, report):
    return ("c", report, f"m{query}", 2024, "group", "note")


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, report_id string, pdf_page int, chunk_index int, text string")
    index = lexical.stored(spark, str(tmp_path_factory.mktemp("index") / "i"), lambda: chunks, lambda c: c.selectExpr("*", "split(lower(text), ' ') AS tokens"))
    asked = [("q1", "r1", "topic2 part0"), ("q2", "r1", "topic2 part0"), ("q3", "r2", "topic5 part1"), ("q4", "r9", "topic1"), ("q5", "r1", "nothing"), ("q6", "r2", "topic3 part0")]
    queries = spark.createDataFrame([(q, t, t.split(), *keyed(q, r)) for q, r, t in asked], f"query_id string, text string, tokens array<string>, company_id string, report_id string, metric_id string, fiscal_year int, statement_scope string, statement_type string")
    # q1 lies in its hit, q2 beside it, q3 beside it but in a chunk too long for a budget of 100, q6 in a fact that is not verified
    held = [("q1", "r1", "r1_p2_0", None, "verified"), ("q2", "r1", None, 3, "verified"), ("q3", "r2", "r2_p4_0", None, "verified"), ("q5", "r1", None, 1, "verified"), ("q6", "r2", "r2_p3_0", None, "pending")]
    registry = spark.createDataFrame([(f"fact_{q}", *keyed(q, r), f"ev_{q}", ok) for q, r, _, _, ok in held], "fact_id string, company_id string, report_id string, metric_id string, fiscal_year int, statement_scope string, statement_type string, primary_evidence_id string, validation_status string")
    evidences = spark.createDataFrame([(f"ev_{q}", r, c, p, "verified") for q, r, c, p, _ in held], "evidence_id string, report_id string, chunk_id string, pdf_page int, validation_status string")
    hits, status = traces.routed_search(index, queries, k=1)
    assert set(facts.QUERY_KEYS) <= set(queries.columns)
    return hits.cache(), status.cache(), queries, index.chunks.drop("chunk_no"), registry, evidences


def told(world, strategy, **kw):
    return {r["query_id"]: r for r in traces.trace(*world, strategy, **kw).collect()}


def test_stages_of_each_strategy(world):
    plain, wide, budgeted = (told(world, s, **({"max_chars": 300} if s == "budgeted" else {})) for s in traces.STRATEGIES)
    stages = lambda t: [t[f"q{i}"]["stage"] for i in range(1, 7)]
    assert stages(plain) == ["base", "unresolved", "unresolved", None, None, "unresolved"]
    assert stages(wide) == ["base", "expansion", "expansion", None, None, "unresolved"]
    assert stages(budgeted) == ["base", "expansion", "unresolved", None, None, "unresolved"]
    assert [(plain[q]["status"], plain[q]["error"]) for q in ("q1", "q4", "q5")] == [("completed", None), ("failed", "no_report"), ("failed", "mismatch")]
    assert budgeted["q1"]["chunk_ids"] == ["r1_p2_0"] and budgeted["q1"]["candidates"] == 0 and wide["q1"]["candidates"] == 4
    assert budgeted["q2"]["fact_ids"] == ["fact_q2"] and budgeted["q2"]["selected_items"] == 2 and len(budgeted["q2"]["chunk_ids"]) == 3
    assert all(r["selected_chars"] <= 300 for r in budgeted.values())


def test_gate_leaves_resolved_queries_out_of_the_widening(world):
    both = traces.trace(*world, "budgeted", siblings=True).collect()
    assert {r["query_id"]: r["candidates"] for r in both} == {"q1": 0, "q2": 5, "q3": 5, "q4": 0, "q5": 0, "q6": 5}
    with pytest.raises(ValueError):
        traces.trace(*world, "none")


def test_summary_and_failures(spark, world):
    rows = traces.trace(*world, "budgeted", max_chars=300)
    total = [r for r in traces.retrieval_summary(rows.selectExpr("*", "'b' AS strategy"), ["strategy"]).collect() if r["strategy"] is None]
    (t,) = total
    assert (t["queries"], t["completed"], t["resolved"], t["gate_closed"], t["gate_open"], t["recovered"], t["level"]) == (6, 4, 2, 1, 3, 1, 1)
    assert t["context_chunks"] == sum(len(r["chunk_ids"]) for r in rows.collect())
    assert {r["query_id"]: r["reason"] for r in traces.failures(rows).collect()} == {"q3": "not_in_context", "q4": "no_report", "q5": "mismatch", "q6": "not_in_context"}


def test_nothing_asked(world):
    hits, status, queries, *rest = world
    assert traces.trace(hits.limit(0), status.limit(0), queries.limit(0), *rest).count() == 0
    (r,) = traces.trace(hits.limit(0), status.limit(0), queries.limit(1), *rest).collect()
    assert (r["status"], r["error"], r["chunk_ids"]) == ("failed", "not_searched", [])
