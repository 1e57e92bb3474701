"""What keeps queries from growing faster than their input: nothing costly is made twice or below a join."""

import duckdb
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import lexical
from quarry.plans import finance, retrieval

DATA = "/root/testdata/sf0.001"


def test_facts_are_read_once(spark):
    plan = finance.l2_case_plans(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey#" not in plan and " Join Inner" not in plan


def test_postings_make_tokens_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, "...")], "chunk_no long, text string").write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c")).withColumn("tokens", T.ascii_tokens(F.col("text")))
    out = lexical.postings(chunks, "chunk_no")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 3, "a", 2), (1, 3, "b", 1)]


def test_possessive_run_says_what_the_search_says(spark):
    c = F.chr(F.col("id"))
    odd = spark.range(1, 256).select(F.concat(F.lit("x\n"), c).alias("t")).union(spark.createDataFrame([("",), ("\u0131",), ("\u012f",), ("\u4e2d",), ("a\uff21",)], "t string"))
    assert odd.filter(F.col("t").rlike(T.NONE_COMPATIBLE) == F.col("t").rlike(T.MAYBE_COMPATIBLE)).count() == 0


def test_index_check_names_each_kind_of_difference(spark, tmp_path):
    texts = [("c1", "r", "a b a"), ("c2", "r", "b c"), ("c3", "r", "...")]
    split = lambda df: df.withColumn("tokens", T.ascii_tokens(F.col("text")))
    index = lexical.stored(spark, str(tmp_path / "i"), lambda: spark.createDataFrame(texts, "chunk_id string, report_id string, text string"), split)
    assert lexical.index_violations(index, split(index.chunks.drop("chunk_no"))).count() == 0
    now = split(spark.createDataFrame([("c1", "a b"), ("c3", "c d"), ("c4", "e")], "chunk_id string, text string"))
    got = {tuple(r) for r in lexical.index_violations(index, now).collect()}
    assert got == {
        ("chunks", "c2", 1, None), ("chunks", "c4", None, 1), ("postings", "c1/a", 2, 1), ("postings", "c2/b", 1, None), ("postings", "c2/c", 1, None), ("postings", "c3/c", None, 1), ("postings", "c3/d", None, 1),
        ("postings", "c4/e", None, 1), ("terms", "b", 2, 1), ("terms", "d", None, 1), ("terms", "e", None, 1),
    }


def folder_of(spark, path, texts, questions=((1, "a"),)):
    """A data folder of documents(doc_id, text, lang, source) and benchmark."""
    spark.createDataFrame([(i, t, "fr" if i % 3 else "en", f"s{i % 2}", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(questions), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def same_as_sql(spark, path, *names):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    for name in names:
        df, r = retrieval.QUERIES[name](spark, path), c.sql(retrieval.ORACLES[name])
        at = [r.columns.index(x) for x in df.columns]
        close = lambda x: round(x, 6) if isinstance(x, float) else x
        assert sorted(repr([close(x) for x in row]) for row in df.collect()) == sorted(repr([close(row[i]) for i in at]) for row in r.fetchall()), name


def test_chunks_without_a_token_stay_so_in_every_50th_document(spark, tmp_path):
    path = folder_of(spark, tmp_path, [(i, "\u00e9 \u00e8" if i % 50 == 0 else "a b") for i in range(0, 210, 10)])
    same_as_sql(spark, path, "b2_input_violations")
    assert {r["report_id"]: r["chunks"] for r in retrieval.b2_input_violations(spark, path).collect()} == {"s0": 9}


def test_chunks_make_a_pages_text_once(spark, tmp_path):
    path = folder_of(spark, tmp_path, [(1, "a\r\nb"), (2, ""), (3, None)])
    made = retrieval.texts(spark.read.parquet(f"{path}/documents.parquet"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 5 and "Filter" in plan  # of one normalisation
    assert [tuple(r) for r in made.collect()] == [("000000000001_00000", "a\nb")]
