"""Source gate, report snapshots, case contracts, root causes and strategies on inline cases."""

import hashlib
import json

import pytest

from quarry.operators import context, evaluation, integrity, pages, vectors
from quarry.sources import datasets

CASE = (
    "case_id string, question string, question_type string, difficulty string, company_ids array<string>, report_ids array<string>, fiscal_years array<int>, queries array<struct<query_id string, target_fact_id string, baseline_query string, company_id string, report_id string, fiscal_year int>>, "
    "steps array<struct<step_id string, action string, target_fact_ids array<string>, input_refs array<string>, depends_on array<string>, output_ref string, calculation_id string>>, gold_fact_ids array<string>, gold_evidence_ids array<string>, gold_calculation_ids array<string>, "
    "answer struct<supporting_fact_ids array<string>, evidence_ids array<string>, supporting_calculation_ids array<string>>, validation_status string, validated_by string, validated_at string, created_at string, updated_at string"
)
GOOD = {
    "case_id": "k", "question": "q", "question_type": "single_company_multi_metric", "difficulty": "easy", "company_ids": ["a"], "report_ids": ["a_2024"], "fiscal_years": [2024], "queries": [("q1", "f1", "q", "a", "a_2024", 2024)],
    "steps": [("s1", "retrieve", ["f1"], [], [], "f1", None), ("s2", "calculate", [], ["f1"], ["s1"], "r", "c1")], "gold_fact_ids": ["f1"], "gold_evidence_ids": ["e1"], "gold_calculation_ids": ["c1"], "answer": (["f1"], ["e1"], ["c1"]),
    "validation_status": "verified", "validated_by": "me", "validated_at": "2024-01-02", "created_at": "2024-01-01", "updated_at": "2024-01-01",
}


@pytest.mark.parametrize("batch", [0])
def test_each_rule_of_a_case(spark, batch):
    s1, s2 = GOOD["steps"]
    changes = [
        ({}, []), ({"company_ids": ["a", "b"], "report_ids": ["a_2024", "b_2024"]}, ["not_one_company"]), ({"question_type": "cross_company_comparison"}, ["below_two_companies"]), ({"question_type": "multi_company_ranking"}, ["below_three_companies"]),
        ({"difficulty": "hard"}, ["not_hard"]), ({"report_ids": ["a_2024", "z_2024"]}, ["report_of_no_company"]), ({"report_ids": []}, ["company_without_report", "query_of_other_report"]), ({"gold_fact_ids": ["f1", "f2"]}, ["plan_facts_differ", "query_facts_differ"]),
        ({"question": "other"}, ["baseline_differs"]), ({"fiscal_years": [2023]}, ["query_of_other_year"]), ({"queries": [("q1", "f1", "q", None, "a_2024", 2024)]}, ["query_of_other_company"]), ({"gold_calculation_ids": []}, ["answer_of_other_calculation", "plan_calculations_differ"]),
        ({"steps": [s2, s1]}, ["input_not_made"]), ({"steps": [s1, (*s2[:4], [], *s2[5:])]}, ["dependency_missing"]), ({"answer": (["f9"], ["e9"], [])}, ["answer_of_other_evidence", "answer_of_other_fact"]), ({"validated_by": None}, ["verified_by_nobody"]),
        ({"validated_at": None}, ["verified_without_time"]), ({"validation_status": "pending"}, ["validated_but_not_verified"]), ({"updated_at": "2023-12-31"}, ["updated_before_created"]),
    ]
    rows = [tuple((GOOD | {"case_id": str(i)} | c).values()) for i, (c, _) in enumerate(changes)]
    got = {}
    for r in integrity.broken_rows(spark.createDataFrame(rows, CASE), "cases", "case_id", integrity.CASE_RULES).collect():
        got.setdefault(int(r["entity_id"]), []).append(r["rule_id"])
    assert {i: sorted(r) for i, r in got.items()} == {i: r for i, (_, r) in enumerate(changes) if r}


def test_source_gate(spark):
    reports = spark.createDataFrame([(r, "d", 2) for r in "abcde"] + [("f", None, None)], "report_id string, active_document_id string, expected_pdf_page_count int")
    manifests = spark.createDataFrame([("a", "d", 2, 2, True), ("b", "x", 2, 2, True), ("c", "d", 3, 2, False), ("d", "d", 2, 2, True), ("e", "d", 2, 2, None), ("f", "z", 1, 1, True), ("g", "d", 0, 0, True)],
                                      "report_id string, document_id string, total_pdf_pages int, page_record_count int, quality_gate_passed boolean")
    page = lambda r, i, n, doc="d", status="success": (r, doc, i, n, status)
    rows = [page("a", "1", 1), page("a", "2", 2), page("b", "1", 1), page("b", "2", 2), page("c", "1", 1), page("c", "2", 3), page("d", "1", 1), page("d", "1", 2, status="parse_error"), page("f", "1", 1, "z")]
    got = {}
    for r in pages.source_violations(reports, manifests, spark.createDataFrame(rows, "report_id string, document_id string, page_id string, pdf_page int, parse_status string")).collect():
        got.setdefault(r["report_id"], []).append(r["rule_id"])
    assert got == {"b": ["not_the_active_document", "page_of_other_document"], "c": ["page_count", "quality_gate", "coverage"], "d": ["repeated_page_id", "parse_error"], "e": ["quality_gate", "record_count", "coverage"], "g": ["unknown_report"]}


def test_snapshot_is_the_hash_of_canonical_json(spark):
    r = {"company_id": "c", "fiscal_year": 2024, "report_id": "c_2024", "report_type": "annual", "title": None}
    for title in ("年报 \"x\"/y", None):
        r["title"] = title
        df = spark.createDataFrame([(*r.values(), "more")], "company_id string, fiscal_year long, report_id string, report_type string, title string, notes string")
        text = json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert datasets.report_snapshot(df).first()["snapshot_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_eight_root_causes(spark):
    targets = spark.createDataFrame([(i, f"f{i}", f"e{i}", None if i == 7 else f"c{i}", i) for i in range(1, 9)], "query_id int, fact_id string, evidence_id string, chunk_id string, pdf_page int")
    traces = spark.createDataFrame([(1, "failed", None, []), (2, "completed", "base", ["f2"]), (3, "completed", "expansion", ["f3"]), (4, "completed", None, ["f4"]), *((i, "completed", "unresolved", ["no"]) for i in range(5, 9))], "query_id int, status string, stage string, fact_ids array<string>")
    read = spark.createDataFrame([(5, "c5", 5)], "query_id int, chunk_id string, pdf_page int")
    full = read.union(spark.createDataFrame([(6, "c6", 6), (7, "x", 70), (8, "other", 8)], read.schema))
    got = {r["query_id"]: r["outcome"] for r in evaluation.root_causes(targets, traces, full, read).collect()}
    assert [got[i] for i in range(1, 9)] == ["retrieval_runtime_error", "base_resolved", "expansion_recovered", "resolved_without_expected_audit", "fact_resolution_miss", "budget_selection_miss", "retrieval_or_page_window_coverage_gap", "same_page_chunk_coverage_gap"]
    assert evaluation.root_causes(targets, traces.filter("query_id > 9"), full, read).filter("outcome = 'retrieval_runtime_error'").count() == 8


def test_strategies_against_a_baseline(spark):
    rows = [("plain", 1, "completed", "base", ["e"], ["a"]), ("plain", 2, "completed", "unresolved", [], ["b"]), ("wide", 1, "completed", "base", ["e"], ["a", "b"]), ("wide", 2, "completed", "expansion", ["e", "g"], ["b", "c"]), ("none", 1, "failed", None, [], [])]
    traces = spark.createDataFrame(rows, "strategy string, query_id int, status string, stage string, evidence_ids array<string>, chunk_ids array<string>")
    chunks = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "chunk_id string, n_chars int")
    got = {r["strategy"]: tuple(r)[1:] for r in evaluation.strategy_comparison(traces, chunks, "plain").collect()}
    assert got == {"plain": (2, 1, 0.5, 30, 1, 0, 0.0, 1.0), "wide": (2, 2, 1.0, 80, 3, 1, 1.666667, 3.0), "none": (1, 0, 0.0, 0, 0, -1, -1.0, 0.0)}


def test_documents_of_files(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    for name in ("a.pdf", "x/b.pdf", "x/stray.pdf"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    files = datasets.register_files(spark, f"file://{tmp_path}/in", "*.pdf")
    at = {r["path"].rsplit("/", 1)[-1]: r["path"] for r in files.collect()}
    reports = spark.createDataFrame([("r1", at["a.pdf"], 3), ("r2", at["b.pdf"], 3), ("r3", "file:/none.pdf", 1), ("r4", at["a.pdf"], None)], "report_id string, source_path string, expected_pdf_page_count int")
    counts = spark.createDataFrame([(at["a.pdf"], 3), (at["b.pdf"], 4)], "path string, pdf_page_count int")
    made = datasets.register_documents(files, reports, counts)
    got = {r["report_id"]: (r["page_count_status"], r["validation_status"], r["source_filename"]) for r in made.collect()}
    assert got == {"r1": ("matched", "valid", "a.pdf"), "r2": ("mismatched", "blocked", "b.pdf"), "r3": ("not_checked", "blocked", "none.pdf"), "r4": ("not_checked", "blocked", "a.pdf")}
    assert {r["document_id"] for r in made.filter("report_id = 'r1'").collect()} == {f"doc_r1_{hashlib.sha256(b'a.pdf').hexdigest()[:24]}"}
    assert integrity.broken_rows(made, "documents", "report_id", integrity.DOCUMENT_RULES).count() == 0


def test_manifests_exports_and_merges(spark, tmp_path):
    for name, text in (("a", '{"report_id": "r1",\n "n": 2}'), ("b/c", '{"report_id": "r2"}')):
        (tmp_path / "root" / name).mkdir(parents=True)
        (tmp_path / "root" / name / "manifest.json").write_text(text)
    found = datasets.find_manifests(spark, f"file://{tmp_path}/root", "report_id string, n int").collect()
    assert sorted((r["folder"].rsplit("/root/", 1)[1], r["report_id"], r["n"]) for r in found) == [("a", "r1", 2), ("b/c", "r2", None)]
    own = spark.createDataFrame([("r1", 2, "two"), ("r1", 1, "one"), ("r2", 1, None)], "report_id string, pdf_page int, text string")
    assert datasets.export_pages(own.select("report_id", "pdf_page"), own, f"file://{tmp_path}/out") == 3
    text = "".join(f.read_text() for f in sorted((tmp_path / "out" / "report_id=r1").glob("*.txt")))
    assert text == "===== r1 page 1 =====\none\n===== r1 page 2 =====\ntwo\n"
    with pytest.raises(ValueError, match="1 pages are missing"):
        datasets.export_pages(spark.createDataFrame([("r1", 9)], "report_id string, pdf_page int"), own, f"file://{tmp_path}/none")
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    more = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    assert datasets.append_all_or_none(dim, more(("c", 3)), "k").count() == 3 and datasets.append_all_or_none(dim, more(("a", 1)), "k").count() == 2
    for bad in (more(("a", 1), ("c", 3)), more(("a", 9))):
        with pytest.raises(ValueError):
            datasets.append_all_or_none(dim, bad, "k")
    chunks = spark.createDataFrame([("d", "r", "c", "x", "k1", "text"), ("e", "r", "c", "x", "k1", "text")], "dataset_id string, report_id string, company_id string, document_id string, chunk_id string, text string")
    sums = datasets.checksum(chunks, list(datasets.CHUNK_FIELDS), ["dataset_id"]).selectExpr("dataset_id", "checksum")
    manifests = sums.selectExpr("dataset_id", "'r' AS report_id", "'c' AS company_id", "'x' AS document_id", "1 AS chunk_count", "4 AS char_total", "if(dataset_id = 'd', checksum, 'other') AS checksum")
    assert [tuple(r) for r in datasets.chunk_manifest_violations(chunks, manifests).collect()] == [("e", "checksum")]


def test_hints_duplicates_ranges_and_allowed(spark):
    rows = [(1, "cost of sales", "sales were good", 1, 1, 0, "a", ["net profit"]), (1, "cost of sales", "the Net-Profit grew", 2, 1, 1, "b", ["net profit"]), (1, "cost of sales", "nothing", 3, 1, 2, "c", None)]
    df = spark.createDataFrame(rows, "query_id int, query string, text string, anchor_rank int, page_distance int, chunk_index int, chunk_id string, hints array<string>")
    ranks = lambda d: [r["chunk_id"] for r in context.rank_candidates(d).orderBy("selection_rank").collect()]
    assert ranks(df) == ["b", "a", "c"] and ranks(df.drop("hints")) == ["a", "b", "c"]
    tied = df.selectExpr("1 AS query_id", "'z' AS query", "chunk_id || text AS text", "1 AS anchor_rank", "chunk_id")
    assert ranks(tied) == ["c", "a", "b"]  # the shortest first
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "c")], "query_id int, rank int, chunk_id string")
    chunks = spark.createDataFrame([(c, "r", 1, c * 30) for c in "abc"], "chunk_id string, report_id string, pdf_page int, text string")
    blocks = context.evidence_blocks(hits, chunks, max_hits=2)
    assert [(r["rank"], r["citation"], r["chunk_id"]) for r in blocks.orderBy("rank").collect()] == [(1, "E1", "a"), (3, "E2", "b")]
    assert tuple(context.evidence_counts(hits, blocks).first())[:4] == (1, 1, 2, 1)
    resolved = spark.createDataFrame([("r", p, "unmapped" if p in (1, 2, 5) else "mapped") for p in range(1, 7)], "report_id string, pdf_page int, mapping_status string")
    assert sorted(tuple(r) for r in pages.unmapped_ranges(resolved).collect()) == [("r", 1, 2), ("r", 5, 5)]
    parsed = spark.createDataFrame([("r", 1, "p", "1"), ("r", 2, "p", "2")], "report_id string, pdf_page int, parser_name string, parser_version string")
    assert [r["rule_id"] for r in pages.completeness_violations(parsed, spark.createDataFrame([("r", 2)], "report_id string, pages int")).collect()] == ["several_parsers"]
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, embedding array<float>")
    found = vectors.cosine_top_k(v, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>"), 2, allowed=spark.createDataFrame([(3,), (4,), (9,)], "id long"))
    assert [r["id"] for r in found.orderBy("rank").collect()] == [3, 4]
