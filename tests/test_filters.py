"""Filters, plans, sections and context pools on small cases, against plain Python."""

import random

from pyspark.sql import functions as F

from quarry.operators import chunking, context, filters, fusion


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_filters_match_plain_python(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.choice([1999, 2000, 2001, None]), rng.choice(["x", "y"]), i % 7) for i in range(60)]
    table = spark.createDataFrame(rows, "page_id long, report_id string, fiscal_year int, report_type string, pdf_page int")
    lists = [("q0", [], None, [], []), ("q1", ["a", "a"], [2000], [], []), ("q2", [], [], ["x"], [1, 2]), ("q3", ["z"], [], [], []), ("q4", ["b", "c"], [2000, 2001], ["y"], [3])]
    asked = spark.createDataFrame(lists, "query_id string, report_ids array<string>, fiscal_years array<int>, report_types array<string>, pdf_pages array<int>")
    wanted = sorted((q, r[0]) for q, a, b, c, d in lists for r in rows if all(not x or v in x for x, v in ((a, r[1]), (b, r[2]), (c, r[3]), (d, r[4]))))
    assert found(filters.eligible(asked, table).select("query_id", "page_id")) == wanted
    assert filters.eligible(asked.limit(0), table).collect() == [] and filters.eligible(asked, table.limit(0)).collect() == []
    assert found(filters.where(table, report_ids=["a"], fiscal_years=[2000], page_ids=[]).select("page_id")) == [(i,) for q, i in wanted if q == "q1"]
    bad = spark.createDataFrame([("a", [""], [1999, 2000], [0]), ("b", ["r"], [2000], [1]), ("c", None, None, [2, None])], "query_id string, report_ids array<string>, fiscal_years array<int>, pdf_pages array<int>")
    assert found(filters.violations(bad)) == [("a", "bad_fiscal_years"), ("a", "bad_pdf_pages"), ("a", "bad_report_ids"), ("c", "bad_pdf_pages")]
    assert [r.pdf_pages for r in filters.normalize(spark.createDataFrame([("a", [3, 1, 3]), ("b", None)], "query_id string, pdf_pages array<int>")).orderBy("query_id").collect()] == [[1, 3], []]


def test_plans_and_agreement(spark):
    fields = "query_id string, metric_name string, fiscal_year int, company_id string, report_id string, report_type string, statement_type string, statement_scope string"
    rows = [("q1", " 营业收入 ", 2024, "c", "r", "annual", "income_statement", "consolidated"), ("q2", " ", 2024, "c", "r", "annual", "note", "group"), ("q3", "x", 2024, "c", "r", "annual", "other", "group"), ("q4", "x", 2024, "c", "r", "annual", "note", None)]
    plans, bad = filters.query_plans(spark.createDataFrame(rows, fields))
    assert [(r.semantic_query, r.report_ids, r.fiscal_years) for r in plans.collect()] == [("合并利润表 2024年度 营业收入 金额", ["r"], [2024])]
    assert found(bad) == [("q2", "no_metric_name"), ("q3", "statement_type"), ("q4", "statement_scope")]
    reports = spark.createDataFrame([("r", "c", 2023, "d1"), ("s", "e", 2024, None)], "report_id string, company_id string, fiscal_year int, active_document_id string")
    asked = spark.createDataFrame([("q1", "r", ["r"], [2024]), ("q2", "s", [], []), ("q3", "t", ["t"], []), ("q4", "s", ["r"], [2024])], "query_id string, report_id string, report_ids array<string>, fiscal_years array<int>")
    assert found(filters.plan_violations(asked, reports)) == [("q1", "other_fiscal_year"), ("q3", "unknown_report"), ("q4", "other_report_id")]
    hits = spark.createDataFrame([("q", "r", "d0"), ("q", "r", "d1"), ("q", "s", "d9"), ("p", "r", None)], "query_id string, report_id string, document_id string")
    assert sorted((r.query_id, r.document_id or "") for r in filters.outdated(hits, reports).collect()) == [("p", ""), ("q", "d0")]
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z"), (3, "w", "w")], "k int, f string, g string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", "w")], "k int, f string, g string")
    assert found(filters.disagreements(a, b, ["k"], ["f", "g"])) == [(2, "other_g"), (3, "only_left"), (4, "only_right")]


def sections_by_hand(pages, carry):
    out, state = [], {}
    for page, lines in pages:
        state = state if carry else {}
        place = 0
        for line in lines:
            level = {"第": 1, "一": 2, "（": 3}.get(line[:1])
            if level:
                state = {k: v for k, v in state.items() if k < level} | {level: (line, page)}
            held = [state[k] for k in sorted(state)]
            out.append((page, place, [t for t, _ in held], held[-1][1] if held else None, bool(held) and held[-1][1] != page))
            place += len(line) + 1
    return sorted(out)


def test_sections_carry_over_pages_and_ranges(spark, monkeypatch):
    rng = random.Random(2)
    kinds = ["第一节 A{}", "一、B{}", "（一）C{}", "text {}"]
    made = [(p, [rng.choices(kinds, [1, 2, 3, 8])[0].format(rng.randrange(100)) for _ in range(rng.randrange(5))]) for p in range(1, 40)]
    df = spark.createDataFrame([("r", p, "\n".join(lines)) for p, lines in made], "report_id string, pdf_page int, text string")
    places = [("r", p, sum(len(x) + 1 for x in lines[:i])) for p, lines in made for i in range(len(lines))]
    at = spark.createDataFrame(places, "report_id string, pdf_page int, start_char int")
    for size in (1000, 7):
        monkeypatch.setattr(chunking, "RANGE", size)
        for carry in (True, False):
            got = chunking.sections_at(at, chunking.headings(df), carry).drop("report_id")
            assert sorted(tuple(r) for r in got.collect()) == sections_by_hand(made, carry)


def test_section_chunks_cut_at_headings(spark):
    text = "intro\n\n第一节 总则\nbody\n\n一、范围\nmore text"
    df = spark.createDataFrame([(1, "r", 1, text), (2, "r", 2, "tail"), (3, "q", 1, "")], "doc_id long, report_id string, pdf_page int, text string")
    got = [(r.doc_id, r.chunk_index, text[r.start_char : r.end_char] if r.doc_id == 1 else "tail", r.section_path, r.section_page, r.section_inherited) for r in chunking.section_chunks(df).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, 0, "intro\n\n", [], None, False), (1, 1, "第一节 总则\nbody\n\n", ["第一节 总则"], 1, False), (1, 2, "一、范围\nmore text", ["第一节 总则", "一、范围"], 1, False), (2, 0, "tail", ["第一节 总则", "一、范围"], 1, True)]
    for strategy in ("fixed_length", "paragraph", "section_paragraph"):
        out = chunking.build_chunks(df, strategy)
        assert out.columns[:5] == ["doc_id", "chunk_index", "start_char", "end_char", "text"]
        assert {r.doc_id for r in out.collect()} == {1, 2} and all(len(r.text) == r.end_char - r.start_char for r in out.collect())


def test_hybrid_status(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, score double")
    dense, lexical = hits([("a", 1, "x", 1.0), ("b", 1, "x", 1.0)]), hits([("a", 1, "y", 1.0)])
    fused, status = fusion.hybrid(dense, lexical, spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string"))
    assert found(status) == [("a", 1, 1, "ok"), ("b", 1, 0, "mismatch"), ("c", 0, 0, "empty")]
    assert [(r.query_id, r.chunk_id) for r in fused.orderBy("rank").collect()] == [("a", "x"), ("a", "y")]


def test_metric_hints_and_siblings(spark):
    metrics = spark.createDataFrame([("m", " 营业收入 "), ("n", "Net profit")], "metric_id string, display_name string")
    aliases = spark.createDataFrame([("m", "收入"), ("m", "营业收入"), ("m", " ")], "metric_id string, alias string")
    assert found(context.metric_hints(metrics, aliases)) == [("m", ["营业收入", "收入"]), ("n", ["Net profit"])]

    def pairs(x):
        x = "".join(c.lower() for c in x if c.isalnum() and not c.isdigit())
        return {x[i : i + 2] for i in range(len(x) - 1)}

    cases = [([], "any"), (["营业收入", "收入总额"], "本年 营业 收入 12"), (["Net profit", "7"], "the net-profit of 2024"), (["Net profit"], "netp profi"), (["x"], ""), (["营业收入", "", "12"], "营业 3 12")]
    df = spark.createDataFrame(cases, "hints array<string>, text string")
    for r in df.select("hints", "text", context.metric_score(F.col("hints"), F.col("text")).alias("s")).collect():
        plain = lambda x: "".join(c.lower() for c in x if c.isalnum())
        exact = int(any(plain(h) and plain(h) in plain(r.text) for h in r.hints))
        shared = [(len(pairs(h) & pairs(r.text)), len(pairs(h))) for h in r.hints]
        assert tuple(r.s) == (exact, max((a for a, _ in shared), default=0), round(max((a / b for a, b in shared if b), default=0.0), 9))
    chunks = spark.createDataFrame([(c, "r", p) for c, p in (("a", 1), ("b", 1), ("c", 1), ("d", 2))], "chunk_id string, report_id string, pdf_page int")
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "d")], "query_id string, rank int, chunk_id string")
    pool = spark.createDataFrame([("q", "c", "d", 2, -1)], "query_id string, chunk_id string, anchor_chunk_id string, anchor_rank int, page_distance int")
    assert found(context.add_siblings(pool, hits, chunks)) == [("q", "b", "a", 1, 0, "same_page"), ("q", "c", "d", 2, -1, "adjacent_page")]
