"""Operators on small inline cases."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.ranking import numbered
from quarry.operators import chunking, context, evaluation, facts, fusion, lexical, pages, vectors
from quarry.plans import retrieval
from quarry.sources import datasets


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def plain_tokens(text):
    """Search tokens by the definition: compatibility composition, lower case, runs."""
    out = []
    for run in re.findall("[a-z0-9]+|[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in T.CJK) + "]+", unicodedata.normalize("NFKC", text).lower()):
        out += [run] if run.isascii() or len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def test_tokens_of_every_compatibility_character_and_of_marks(spark):
    rng, every = random.Random(0), [*T.COMPATIBLE]
    marks = [m for m in map(chr, range(0x300, 0x370))] + list("\u3099\uff9e\u20dd\u0591\u1dc4")
    pieces = ["a", "K", "é", "ß", "한", "ｱ", "营业", "\U00020001", " ", "\n", "ſ", "x", "9"]
    texts = ["".join(f"ab{c}" for c in every[i : i + 50]) for i in range(0, len(every), 50)]
    texts += ["".join(rng.choice([rng.choice(pieces), rng.choice("aeinosyzAEN") + rng.choice(marks), rng.choice(marks), rng.choice(every)]) for _ in range(10)) for _ in range(1500)]
    texts = [t.replace("İ", "") for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [(r.t, r.w) for r in df.select("t", T.tokens(F.col("t")).alias("w")).collect() if r.w != plain_tokens(r.t)] == []
    assert "Python" not in df.select(T.tokens(F.col("t")))._jdf.queryExecution().executedPlan().toString()


def test_text_functions(spark):
    assert one(spark, T.normalize_page_text(F.lit("　a \t\r\nb\r\r\r\rc\x00 \n"))) == "a\nb\n\nc"
    assert one(spark, T.tokens(F.lit("营业收入 ＡＢ1 é x，利"))) == ["营业", "业收", "收入", "ab1", "x", "利"]
    assert one(spark, T.lexical_tokens(F.lit("A net_profit 2024 利润 x"))) == ["net_profit", "利润"]
    assert one(spark, T.bigrams(F.lit("a1b😀c"))) == ["ab", "bc"] and one(spark, T.bigrams(F.lit("a"))) == []
    assert one(spark, T.values(F.lit("1,234.50 (2,000) 12 2024 3.5% 12345,6 +1,234 ( 9.5 )"))) == ["1,234.50", "(2,000)", "2024", "3.5%", "12345", "+1,234", "( 9.5 )"]
    assert one(spark, T.citations(F.lit("see [E1] and [E12][E0]"))) == ["E1", "E12"]
    assert one(spark, T.near_value(F.lit("Revenue (2024): 1,234"), F.lit("revenue"), F.lit(2024)))
    assert not one(spark, T.near_value(F.lit("Revenue 2024"), F.lit("revenue"), F.lit(2024)))
    cells = {"1,234": 1234.0, "(5)": -5.0, "（１２．５）": -12.5, "-": None, "n/a": None, "": None}
    for cell, number in cells.items():
        found = one(spark, T.clean_number(F.lit(cell)))
        assert (found if found is None else float(found)) == number
    assert one(spark, T.grouped(F.lit("1234567.5000").cast("decimal(20,4)"), F.lit(" yuan"))) == "1,234,567.5 yuan"
    assert unicodedata.normalize("NFKC", "Ａ") == "A"


def test_numbering_matches_a_window(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"k{i % 3}") for i in range(0, 5000, 3)], "id long, k string")
    seen = {}
    got = {r.id: r.n for r in numbered(df, "k", "id", "n", 100).collect()}
    for i, k in sorted((r.id, r.k) for r in df.collect()):
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]


def test_fixed_chunks_end_at_the_text_end(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 799, 800, 801, 1480, 1481)], "doc_id long, text string")
    spans = {}
    for r in chunking.fixed_chunks(df).collect():
        spans.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    assert spans == {1: [(0, 1)], 799: [(0, 799)], 800: [(0, 800)], 801: [(0, 800), (680, 801)], 1480: [(0, 800), (680, 1480)], 1481: [(0, 800), (680, 1480), (1360, 1481)]}


def test_paragraphs_and_packing(spark):
    df = spark.createDataFrame([(1, "a\nb\n\n\ncc\n\n" + "z" * 900)], "doc_id long, text string")
    assert [(r.paragraph_index, r.start_char, r.end_char, r.paragraph[:3]) for r in chunking.paragraph_spans(df).collect()] == [(0, 0, 3, "a\nb"), (1, 6, 8, "cc"), (2, 10, 910, "zzz")]
    assert chunking.pack([(0, 10), (12, 30), (32, 50)], 30, 1) == [(0, 1), (1, 1), (2, 2)]
    got = [(r.start_char, r.end_char) for r in chunking.paragraph_chunks(df).collect()]
    assert got[0] == (0, 8) and got[-1][1] == 910 and all(e - s <= 800 for s, e in got)


def test_sections(spark):
    text = "第一节 总则\nbody text.\n一、范围\n（一）细则\n第2节 财务\n（一）收入"
    df = spark.createDataFrame([("r", 1, text), ("r", 2, "二、利润\nx.")], "report_id string, pdf_page int, text string")
    paths = [r.section_path for r in chunking.section_paths(chunking.headings(df)).orderBy("pdf_page", "line").collect()]
    assert paths == [["第一节 总则"], ["第一节 总则", "一、范围"], ["第一节 总则", "一、范围", "（一）细则"], ["第2节 财务"], ["第2节 财务", "（一）收入"], ["第2节 财务", "二、利润"]]


def test_chunk_and_page_checks(spark):
    page = spark.createDataFrame([(1, "abc"), (2, "def")], "doc_id long, text string")
    chunk = spark.createDataFrame([("c1", 1, 0, 0, 2, "ab"), ("c2", 1, 2, 1, 3, "xx")], "chunk_id string, doc_id long, chunk_index int, start_char int, end_char int, text string")
    assert sorted(tuple(r) for r in chunking.chunk_violations(chunk, page).collect()) == [("1", "index_gap"), ("2", "page_without_chunk"), ("c2", "text_differs")]
    seg = spark.createDataFrame([("r", "a", 1, 5), ("r", "b", 5, 9), ("r", "c", 8, 7)], "report_id string, mapping_id string, pdf_page_start int, pdf_page_end int")
    rules = sorted((r.mapping_id, r.rule_id) for r in pages.segment_violations(seg, spark.createDataFrame([("r", 8)], "report_id string, pages int")).collect())
    assert rules == [("b", "overlap"), ("b", "past_last_page"), ("c", "empty_range"), ("c", "overlap")]
    p = spark.createDataFrame([("r", 1), ("r", 3), ("q", 1), ("q", 1)], "report_id string, pdf_page int")
    n = spark.createDataFrame([("r", 3), ("q", 1), ("z", 2)], "report_id string, pages int")
    assert sorted(tuple(r) for r in pages.completeness_violations(p, n).collect()) == [("q", "repeated_page"), ("r", "missing_page"), ("z", "no_pages")]


def test_bm25_formula_ties_and_zero_scores(spark, tmp_path):
    docs = {"a": "x y".split(), "b": "x x z".split(), "c": "z".split(), "d": "x y".split()}
    chunks = spark.createDataFrame([(c, "r", w) for c, w in docs.items()], "chunk_id string, report_id string, tokens array<string>")
    queries = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["none"])], "query_id int, tokens array<string>")
    index = lexical.stored(spark, f"{tmp_path}/index", lambda: chunks, lambda c: c)
    assert lexical.index_violations(index, chunks).count() == 0 and lexical.index_violations(index, chunks.filter("chunk_id <> 'c'")).count() == 3
    odd = spark.createDataFrame([("a", ["x"]), ("a", ["y"]), ("b", [])], "chunk_id string, tokens array<string>")
    assert sorted(tuple(r) for r in lexical.input_violations(odd).collect()) == [("a", "repeated_chunk"), ("b", "no_token")] and lexical.input_violations(odd.limit(0)).count() == 1
    got = {}
    for r in lexical.search(index, queries, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.score)

    def score(d):
        out = 0
        for t in ("x", "y"):
            df, tf = sum(t in v for v in docs.values()), docs[d].count(t)
            out += math.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / 2.0))
        return round(out, 9)

    assert [got[1][k][0] for k in (1, 2, 3, 4)] == ["a", "d", "b", "c"] and all(abs(s - score(c)) < 1e-9 for c, s in got[1].values())
    assert [got[2][k] for k in (1, 2, 3, 4)] == [(c, 0.0) for c in "abcd"]
    only = lexical.search(index, queries, 2, chunks.filter("chunk_id in ('b', 'c')")).filter("query_id = 1").orderBy("rank").collect()
    assert [(r.chunk_id, abs(r.score - score(r.chunk_id)) < 1e-9) for r in only] == [("b", True), ("c", True)]


def index_of(spark, path, rows):
    return lexical.stored(spark, str(path), lambda: spark.createDataFrame(rows, "chunk_id string, report_id string, tokens array<string>"), lambda c: c)


WORDS = [(f"c{i:03d}", f"r{i % 5}" if i % 11 else None, [f"w{(i * j) % 17}" for j in range(1, 2 + i % 7)]) for i in range(120)]


@pytest.mark.parametrize("lost", lexical.TABLES)
def test_index_recovers_what_was_not_written(spark, tmp_path, lost):
    """A job lost while a table was written leaves a folder without its mark: that table, and what is made from it, come anew."""
    asked = spark.createDataFrame([(1, "r2", ["w1", "w2"]), (2, "r9", ["w3"]), (3, "r1", ["none"])], "query_id int, report_id string, tokens array<string>")

    def all_of(index):
        whole = [tuple(r) for r in lexical.search(index, asked, 6).collect()]
        return sorted(whole), sorted(tuple(r) for r in lexical.search_report(index, asked, 6).collect()), index.stats.collect()

    before = all_of(index_of(spark, tmp_path / "index", WORDS))
    (tmp_path / "index" / lost / "_SUCCESS").unlink()
    for part in (tmp_path / "index" / lost).rglob("*.parquet"):
        part.unlink()
        break
    assert all_of(index_of(spark, tmp_path / "index", WORDS)) == before
    never = lexical.stored(spark, str(tmp_path / "index"), lambda: 1 / 0, lambda c: 1 / 0)  # nothing is made twice
    assert all_of(never) == before


def test_search_by_report_equals_filtered_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "FOLDER_CHUNKS", 10)
    index = index_of(spark, tmp_path / "index", WORDS)
    rows = [(q, f"r{q % 6}", [f"w{q % 17}", f"w{(3 * q) % 17}", "w1"]) for q in range(12)]
    asked = spark.createDataFrame(rows, "query_id int, report_id string, tokens array<string>")
    routed = sorted(tuple(r) for r in lexical.search_report(index, asked, 4, own_statistics=False).collect())
    want = []
    for q, report, words in rows:
        one = spark.createDataFrame([(q, words)], "query_id int, tokens array<string>")
        want += [tuple(r) for r in lexical.search(index, one, 4, index.chunks.filter(index.chunks.report_id == report)).collect()]
    assert routed == sorted(want) and not [r for r in routed if r[0] % 6 == 5]
    own = index_of(spark, tmp_path / "own", [r for r in WORDS if r[1] == "r3"])
    alone = spark.createDataFrame([r for r in rows if r[1] == "r3"], asked.schema)
    ours = sorted(tuple(r) for r in lexical.search_report(index, asked.filter("report_id = 'r3'"), 4).collect())
    assert ours == sorted(tuple(r) for r in lexical.search(own, alone, 4).collect())


def test_search_reads_the_folders_it_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "FOLDER_CHUNKS", 10)
    index = index_of(spark, tmp_path / "index", WORDS)
    sizes = index.stats.first()
    assert (sizes["report_folders"], sizes["term_folders"]) == (4, 3)
    one = spark.createDataFrame([(1, "r2", ["w1"])], "query_id int, report_id string, tokens array<string>")
    terms = one.select("query_id", "report_id", F.explode("tokens").alias("term"))
    found = lexical.asked_postings(index, terms)
    files = {r["f"] for r in found.select(F.input_file_name().alias("f")).collect()}
    assert len(files) == 1 and found.count() == index.postings.filter("report_id = 'r2' and term = 'w1'").count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("term_folder") and plan.count("report_folder") and "PartitionFilters" in plan
    whole = lexical.summed(index, terms.drop("report_id"), F.count(F.lit(1)))
    text = whole._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("RepartitionByExpression") < text.index("LeftSemi")  # deals out what the term filter leaves


def test_vectors_that_cannot_be_searched_take_no_part(spark):
    bad = [(90, None), (91, [1.0]), (92, [0.0, 0.0]), (93, [float("nan"), 1.0]), (94, [None, 1.0]), (95, [])]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), *bad], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (7, None), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.id) for r in vectors.cosine_top_k(v, q, 3).orderBy("query_id", "rank").collect()] == [(1, 1, 3), (1, 2, 2)]
    assert {r.id for r in vectors.violations(v, 2).collect()} == {i for i, _ in bad}
    assert vectors.cosine_top_k(v, q.filter("query_id = 7"), 3).count() == 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    rows = [(i, [float(math.cos(i)), float(math.sin(i))]) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    for r in vectors.cosine_top_k(v, q, 3).filter("rank = 1").collect():
        best = max((j for j in range(40) if j != r.query_id), key=lambda j: math.cos(j - r.query_id))
        assert r.id == best
    bad = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, None), (5, [1.0, 0.0])], "id long, embedding array<float>")
    assert {r.id: r.rule_id for r in vectors.violations(bad, 2).collect()} == {1: "zero_norm", 2: "length", 3: "not_finite", 4: "length"}


def test_vector_blocks_meet_in_every_partition(spark, monkeypatch):
    """Block keys of both sides have one type: else their hashes differ and blocks miss each other wherever a key has a
    partition of its own."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 5)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.filter("id % 6 = 0").withColumnRenamed("id", "query_id")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, x in own.items():
            spark.conf.set(k, x)
        got = {(r.query_id, r["rank"]): r.id for r in vectors.cosine_top_k(v, q, 5).collect()}
    finally:
        for k, x in was.items():
            spark.conf.set(k, x)
    want = {(i, n): j for i, a in rows if i % 6 == 0 for n, j in enumerate(sorted((j for j, _ in rows if j != i), key=lambda j: (-round(cosine(a, rows[j][1]), 9), j))[:5], 1)}
    assert got == want


def test_fusion_and_rerank(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, rank int, chunk_id string")
    out = fusion.reciprocal_rank_fusion(hits([(1, 1, "a"), (1, 2, "b")]), hits([(1, 1, "b"), (1, 2, "c")]), 3).collect()
    assert [(r.chunk_id, r.score) for r in out] == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 62, 9))]
    assert [r.rule_id for r in fusion.hit_violations(hits([(1, 1, "a"), (1, 3, "a")])).orderBy("rule_id").collect()] == ["ranks_not_contiguous", "repeated_chunk"]
    q, c = spark.createDataFrame([(1, "net profit")], "query_id int, text string"), spark.createDataFrame([("a", "nothing"), ("b", "the net profit")], "chunk_id string, text string")
    assert [r.chunk_id for r in fusion.rerank(hits([(1, 1, "a"), (1, 2, "b")]), q, c).collect()] == ["b", "a"]


def test_budget_skips_and_evidence_stops(spark):
    rows = [(1, k, f"c{k}", n) for k, n in enumerate([1000, 900, 500, 100, 50], 1)]
    got = context.budget(spark.createDataFrame(rows, "query_id int, selection_rank int, chunk_id string, n_chars int")).orderBy("selection_rank").collect()
    assert [r.decision for r in got] == ["selected", "char_budget", "selected", "item_budget", "item_budget"]
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "b")], "query_id int, rank int, chunk_id string")
    chunks = spark.createDataFrame([("a", "r", 1, "x" * 60), ("b", "r", 2, "y" * 300), ("c", "r", 3, "z")], "chunk_id string, report_id string, pdf_page int, text string")
    got = context.evidence_blocks(hits, chunks, max_chars=100).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "a"), (2, "b")] and got[1].block.endswith("…") and got[1].chars == 100
    answers = spark.createDataFrame([(1, "ok [E1]", ["E1"], ["E1"]), (2, "no", ["E1"], ["E1"]), (3, "[E2]", ["E1"], ["E1"])], "query_id int, answer string, declared array<string>, allowed array<string>")
    assert sorted((r.query_id, r.rule_id) for r in context.citation_violations(answers).collect()) == [(2, "differs_from_declared"), (2, "no_citation"), (3, "differs_from_declared"), (3, "not_allowed")]


def test_context_budget_decides_every_candidate(spark, monkeypatch):
    hits = spark.createDataFrame([("q", 1, "hit")], "query_id string, rank int, chunk_id string")
    rows = [("hit", "r", 5, 0, "a b")] + [(f"c{i:03}", "r", 6, i, "a b") for i in range(250)]
    chunks = spark.createDataFrame(rows, "chunk_id string, report_id string, pdf_page int, chunk_index int, text string")
    monkeypatch.setattr(retrieval, "bm25", lambda *_: hits)
    monkeypatch.setattr(retrieval, "chunks_of", lambda *_: chunks)
    monkeypatch.setattr(retrieval, "questions", lambda *_: spark.createDataFrame([("q", "a b")], "query_id string, text string"))
    out = {r.selection_rank: r.decision for r in retrieval.x6_context_budget(spark, "").collect()}
    assert out == {k: "selected" if k <= 2 else "item_budget" for k in range(1, 251)}


def test_expand_keeps_the_nearest_anchor(spark):
    chunks = spark.createDataFrame([(f"c{p}", "r", p, 0) for p in range(1, 7)], "chunk_id string, report_id string, pdf_page int, chunk_index int")
    hits = spark.createDataFrame([(1, 1, "c4"), (1, 2, "c2")], "query_id int, rank int, chunk_id string")
    got = [(r.context_order, r.chunk_id, r.anchor_chunk_id, r.duplicates) for r in context.expand(hits, chunks).orderBy("context_order").collect()]
    assert got == [(3, "c3", "c4", 1), (4, "c5", "c4", 0), (5, "c1", "c2", 0)]


def test_ratios_round_half_up(spark):
    d = lambda x: F.lit(x).cast("decimal(20,2)")
    assert str(one(spark, facts.ratio(d("1"), d("8"), F.lit(True)))) == "0.1250"
    assert str(one(spark, facts.ratio(d("-1.00"), d("80000.00"), F.lit(True)))) == "0.0000"
    assert str(one(spark, facts.growth_percent(d("90"), d("80")))) == "12.5000"
    assert one(spark, facts.growth_percent(d("90"), d("-80"))) is None and one(spark, facts.ratio(d("1"), d("0"), F.lit(True))) is None
    assert str(one(spark, facts.normalize_unit(F.lit("1.5"), F.lit("CNY_ten_thousand")))) == "15000.0000" and one(spark, facts.normalize_unit(F.lit("1"), F.lit("shell"))) is None


def test_metrics(spark):
    cases = spark.createDataFrame([(1, [5, 9]), (2, [1]), (3, [7])], "query_id int, gold array<int>")
    hits = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (1, 3, 5), (1, 4, 9), (2, 1, 8), (3, 6, 7)], "query_id int, rank int, page int")
    got = {r.query_id: r for r in evaluation.evaluate(cases, hits).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert abs(got[1].ndcg_5 - (1 / math.log2(3) + 1 / math.log2(5)) / ideal) < 1e-8 and got[1].reciprocal_rank == 0.5
    assert (got[2].first_rank, got[2].ndcg_5) == (None, 0) and (got[3].first_rank, got[3].recall_5, got[3].ndcg_5) == (6, 0, 0)
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 12), (2, "a", None), (2, "b", 7)], "query_id int, method string, first_rank int")
    labels = {r.query_id: r.labels for r in evaluation.compare_methods(ranks, ["a", "b"]).collect()}
    assert labels == {1: "large_disagreement,b_degrades,b_drops_top5", 2: "miss_top5"}


def test_datasets(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    c = {r.k: r.checksum for r in datasets.checksum(df, ["k", "v"], ["k"]).collect()}
    assert c == {r.k: r.checksum for r in datasets.checksum(df.orderBy(F.desc("v")), ["k", "v"], ["k"]).collect()}
    changed = datasets.checksum(df.withColumn("v", F.coalesce("v", F.lit(0))), ["k", "v"], ["k"])
    assert [tuple(r) for r in datasets.manifest_violations(datasets.checksum(df, ["k", "v"], ["k"]), changed, "k").collect()] == [("a", "checksum")]
    path = str(tmp_path / "d")
    assert datasets.write_once(df, path) and not datasets.write_once(df.orderBy(F.desc("v")), path)
    with pytest.raises(ValueError):
        datasets.write_once(df.limit(1), path)
    (tmp_path / "half").mkdir()
    assert datasets.write_once(df, str(tmp_path / "half"))
    assert spark.read.parquet(path).count() == 3 and [r.k for r in datasets.repeated_keys(df, ["k"]).collect()] == ["a"]
    assert datasets.register_files(spark, path, "*.parquet").filter("length(sha256) = 64").count() >= 1


def test_case_files(spark, tmp_path):
    file = tmp_path / "cases.jsonl"
    file.write_text('{"case_id": "a", "steps": [{"n": 1}]}\n\n{"case_id": "b"}\n{"case_id": \n{"case_id": "a"}\n{"x": 1}\n', encoding="utf-8")
    lines = datasets.case_lines(spark, str(file), "case_id string, steps array<struct<n:int>>")
    assert [(r.line, r.case.case_id) for r in lines.filter("case IS NOT NULL").orderBy("line").collect()] == [(1, "a"), (3, "b"), (5, "a"), (6, None)]
    got = sorted((r.line, r.rule_id, r.first_line) for r in datasets.case_violations(lines).collect())
    assert got == [(2, "blank_line", None), (4, "broken_record", None), (5, "repeated_key", 1), (6, "no_key", None)]
    cases = spark.createDataFrame([("r", "a"), ("s", "b"), ("r", "c")], "report_id string, case_id string")
    datasets.write_by_report(cases, str(tmp_path / "split"))
    assert [r.case_id for r in spark.read.json(str(tmp_path / "split" / "report_id=r")).orderBy("case_id").collect()] == ["a", "c"]


def test_chunk_manifests(spark):
    rows = [("d", "r", "c", "x", "1", "ab"), ("d", "r", "c", "y", "1", "c"), ("e", "r", "c", "x", "2", "abc"), ("f", "r", "c", "x", "3", "")]
    chunks = spark.createDataFrame(rows, "dataset_id string, report_id string, company_id string, document_id string, chunk_id string, text string")
    listed = [("d", "r", "c", "x", 2, 4), ("e", "r", "c", "x", 1, 3), ("g", "r", "c", "x", 1, 3)]
    manifests = spark.createDataFrame(listed, "dataset_id string, report_id string, company_id string, document_id string, chunk_count int, char_total int")
    got = sorted(tuple(r) for r in datasets.chunk_manifest_violations(chunks, manifests).collect())
    assert got == [("d", "char_total"), ("d", "other_document_id"), ("d", "repeated_chunk_id"), ("f", "no_manifest"), ("g", "no_chunks")]


def test_cases_against_plans(spark):
    fields = "query_id string, question string, metric_name string, fiscal_year int, statement_type string, statement_scope string, company_id string, report_id string, report_type string"
    cases = spark.createDataFrame([(q, "how much", "m", 2024, "note", "group", "c", "r", "annual") for q in "abc"], fields)
    planned = "query_id string, original_query string, metric_name string, fiscal_year int, statement_type string, statement_scope string, company_ids array<string>, report_ids array<string>, fiscal_years array<int>, report_types array<string>, pdf_pages array<int>, page_ids array<string>"
    rows = [("a", "how much", "m", 2024, "note", "group", ["c"], ["r"], [2024], ["annual"], [], None), ("b", "what", "m", 2023, "note", "group", ["c"], [], [2023], ["annual"], [3], ["p"]), ("d", "", "", 1, "", "", [], [], [], [], [], [])]
    got = sorted(tuple(r) for r in evaluation.case_plan_violations(cases, spark.createDataFrame(rows, planned)).collect())
    assert got == sorted([("b", r) for r in ("other_question", "other_fiscal_year", "not_in_report_ids", "not_in_fiscal_years", "gold_leak")] + [("c", "no_plan"), ("d", "no_case")])
