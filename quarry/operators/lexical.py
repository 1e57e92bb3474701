"""BM25 over token arrays: an index of written tables, and exact scores for a set of queries.

Postings lie in folders by report and by term (a hash of each), sorted by term inside a file. A search reads the folders
of the terms, and of the reports, that it asks for, keeps the postings of those terms, and only then deals them by chunk,
so that the terms of a query meet and sum up where the chunk is."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ranking import top_k
from quarry.sources.shared import delete, is_written, materialize

K1, B, BROADCAST_ROWS = 1.2, 0.75, 1_000_000
#: Chunks for each folder of postings, and the most folders by report and by term.
FOLDER_CHUNKS, REPORT_FOLDERS, TERM_FOLDERS = 8_000, 64, 1024
#: A posting with more repeats is compared by itself.
MOST_TF = 1_000_000
TABLES = ("chunks", "postings", "terms", "report_terms", "report_stats", "stats")


@dataclass(frozen=True)
class Index:
    """chunks(chunk_no, chunk_id, report_id, ...), postings(report_folder, term_folder, report_id, chunk_no, dl, term, tf),
    terms(term, df), report_terms(report_id, term, df), report_stats(report_id, n, avg_dl), stats(n, avg_dl,
    report_folders, term_folders; one row).

    Chunk numbers follow the order of chunk ids, so that scores and ties need no text keys."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    report_terms: DataFrame
    report_stats: DataFrame
    stats: DataFrame


def postings(chunks: DataFrame, *keys: str) -> DataFrame:
    """chunks(keys, tokens) -> keys, dl, term, tf: counted where the chunk is, which the first key says. Tokens are made once:
    below an inner explode, filters on them would make them again."""
    dealt = chunks.select(*keys, "tokens").repartition(keys[0])
    return dealt.select(*keys, F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).filter("term is not null").groupBy(*keys, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def folder(key: str, folders: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders) if isinstance(folders, int) else folders).cast("int")


def folders_for(chunks: int) -> tuple[int, int]:
    """Folders by report and by term: as many in all as the number of chunks asks for."""
    wanted = max(1, math.ceil(chunks / FOLDER_CHUNKS))
    reports = min(REPORT_FOLDERS, math.ceil(math.sqrt(wanted)))
    return reports, min(TERM_FOLDERS, math.ceil(wanted / reports))


def stored(spark: SparkSession, path: str, make, tokenise) -> Index:
    """The index at a path. A table that is not there whole is written again, and every table that is made from it; the
    others stay. make() gives the table of chunks (chunk_id, report_id, text, ...)."""
    fresh: set[str] = set()

    def table(name: str, make_it, *needs: str, folders: tuple[str, ...] = ()) -> DataFrame:
        if fresh & set(needs) or not is_written(spark, f"{path}/{name}"):
            make_it().write.mode("overwrite").partitionBy(*folders).parquet(f"{path}/{name}")
            fresh.add(name)
        return spark.read.parquet(f"{path}/{name}")

    def numbered() -> DataFrame:
        """Written before it is sorted: a sort runs what it sorts twice, once for a sample."""
        make().write.mode("overwrite").parquet(f"{path}/unsorted")
        return spark.read.parquet(f"{path}/unsorted").orderBy("chunk_id").withColumn("chunk_no", F.monotonically_increasing_id())

    chunks = table("chunks", numbered)
    delete(spark, f"{path}/unsorted")
    reports, terms = folders_for(chunks.count())
    by = ("report_folder", "term_folder")

    def dealt() -> DataFrame:
        rows = postings(tokenise(chunks), "chunk_no", "report_id").withColumns({by[0]: folder("report_id", reports), by[1]: folder("term", terms)})
        return rows.hint("rebalance", *map(F.col, by)).sortWithinPartitions(*by, "term", "chunk_no")  # folders of hot reports are split

    posted = table("postings", dealt, "chunks", folders=by)
    needs = ("chunks", "postings")
    per_report = table("report_terms", lambda: posted.groupBy("report_id", "term").agg(F.count(F.lit(1)).alias("df")), *needs)
    all_terms = table("terms", lambda: per_report.groupBy("term").agg(F.sum("df").alias("df")), "report_terms", *needs)
    lengths = lambda: posted.groupBy("report_id").agg(F.sum("tf").alias("total"))
    counts = lambda: chunks.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))
    own = F.coalesce("total", F.lit(0))
    per_report_stats = table("report_stats", lambda: counts().join(lengths().withColumnRenamed("report_id", "_r"), F.col("report_id").eqNullSafe(F.col("_r")), "left").select("report_id", "n", own.alias("total"), (own / F.col("n")).alias("avg_dl")), *needs)
    whole = per_report_stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    stats = table("stats", lambda: whole.select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avg_dl"), F.lit(reports).alias("report_folders"), F.lit(terms).alias("term_folders")), "report_stats", *needs)
    return Index(chunks, posted, all_terms, per_report, per_report_stats, stats)


def input_violations(chunks: DataFrame) -> DataFrame:
    """Chunks that can't be indexed: a repeated id, no token; an empty table is one row with a null id."""
    n = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("tokens")).alias("least"))
    rules = F.array(F.when(F.col("n") > 1, "repeated_chunk"), F.when(F.coalesce("least", F.lit(0)) <= 0, "no_token"))
    bad = n.select("chunk_id", F.explode(F.array_compact(rules)).alias("rule_id"))
    none = chunks.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("chunk_id"), F.lit("no_chunks").alias("rule_id"))
    return bad.unionByName(none)


def _suspects(index: Index, chunks: DataFrame) -> DataFrame:
    """chunk_id, chunk_nos: chunks whose postings, written out as sorted words, are not the sorted tokens of their text, and
    (without an id of a chunk) postings of no chunk. A chunk's words meet in one row."""
    sane = F.when(F.col("tf").between(1, MOST_TF), F.struct("term", "tf"))
    own = index.postings.groupBy("chunk_no").agg(F.collect_list(sane).alias("p"), F.count_if(sane.isNull()).alias("odd"))
    own = own.join(index.chunks.select("chunk_no", "chunk_id"), "chunk_no", "left")
    words = F.flatten(F.transform("p", lambda x: F.array_repeat(x["term"], x["tf"].cast("int"))))
    stored = own.select(F.coalesce("chunk_id", F.concat(F.lit("\0"), F.col("chunk_no").cast("string"))).alias("chunk_id"), "chunk_no", "odd", words.alias("was"), F.lit(None).cast("array<string>").alias("now"))
    given = chunks.select("chunk_id", F.lit(None).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("odd"), F.lit(None).cast("array<string>").alias("was"), F.col("tokens").alias("now"))
    every = lambda c: F.sort_array(F.flatten(F.collect_list(c)))
    both = stored.unionByName(given).groupBy("chunk_id").agg(F.collect_set("chunk_no").alias("chunk_nos"), F.sum("odd").alias("odd"), every("was").alias("was"), every("now").alias("now"))
    return both.filter((F.col("odd") > 0) | ~F.col("was").eqNullSafe(F.col("now"))).select("chunk_id", "chunk_nos")


def index_violations(index: Index, chunks: DataFrame) -> DataFrame:
    """Where a stored index differs from its texts, chunks(chunk_id, tokens): table, term, what is stored and what should be.

    Chunks are compared whole; postings are compared one by one where a chunk differs. How many chunks should hold a term
    are those stored, less those of chunks that differ, plus those of these chunks' texts."""
    chunks, out = materialize(chunks.select("chunk_id", "tokens")), None
    suspects = materialize(_suspects(index, chunks))
    odd = index.postings.join(suspects.select(F.explode("chunk_nos").alias("chunk_no")), "chunk_no", "left_semi")
    named = odd.join(index.chunks.select("chunk_no", "chunk_id"), "chunk_no")
    fresh = materialize(postings(chunks.join(suspects.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id"))
    n = lambda df, sign: df.groupBy("term").agg((F.count(F.lit(1)) * sign).alias("n"))
    held = n(index.postings, 1).unionByName(n(odd, -1)).unionByName(n(fresh, 1)).groupBy("term").agg(F.sum("n").alias("v")).filter("v <> 0")
    pairs = (
        ("chunks", ["chunk_id"], index.chunks.withColumn("v", F.lit(1)), chunks.withColumn("v", F.lit(1))),
        ("postings", ["chunk_id", "term"], named.withColumn("v", F.col("tf")), fresh.withColumn("v", F.col("tf"))),
        ("terms", ["term"], index.terms.withColumn("v", F.col("df")), held),
    )
    for name, key, was, now in pairs:
        both = was.select(*key, F.col("v").cast("long").alias("stored")).join(now.select(*key, F.col("v").cast("long").alias("expected")), key, "full")
        bad = both.filter(~F.col("stored").eqNullSafe(F.col("expected"))).select(F.lit(name).alias("table"), F.concat_ws("/", *key).alias("entity_id"), "stored", "expected")
        out = bad if out is None else out.unionByName(bad)
    return out


def asked_postings(index: Index, terms: DataFrame) -> DataFrame:
    """Postings of the terms asked: terms(query_id, term, ...), with report_id where each query has its report. Only the
    folders that hold them are read; terms are broadcast up to BROADCAST_ROWS of them."""
    routed = "report_id" in terms.columns
    keys = ["report_id", "term"] if routed else ["term"]
    sizes = index.stats.select("report_folders", "term_folders").first()
    asked = terms.select(*keys).distinct()
    of = [F.count(F.lit(1)).alias("n"), F.collect_set(folder("term", sizes["term_folders"])).alias("terms")]
    said = asked.agg(*of, *([F.collect_set(folder("report_id", sizes["report_folders"])).alias("reports")] if routed else [])).first()  # no more numbers than folders
    own = index.postings.filter(F.col("term_folder").isin(said["terms"]))
    if routed:
        own = own.filter(F.col("report_folder").isin(said["reports"]))
    return own.join(F.broadcast(asked) if said["n"] <= BROADCAST_ROWS else asked, keys, "left_semi")


def summed(index: Index, terms: DataFrame, score: Column, allowed: DataFrame | None = None) -> DataFrame:
    """terms(query_id, term, ...) -> query_id, chunk_no, score: `score` over the postings of each query's terms. Survivors
    of the term filter are dealt by chunk once; queries meet them there."""
    own = asked_postings(index, terms)
    if allowed is not None:
        own = own.join(allowed, "chunk_no", "left_semi")
    small = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = ["report_id", "term"] if "report_id" in terms.columns else ["term"]
    found = own.repartition("chunk_no").join(F.broadcast(terms) if small else terms, keys)
    return found.groupBy("query_id", "chunk_no").agg(score.alias("score"))


def weighted(terms: DataFrame) -> DataFrame:
    """terms(..., df, n, avg_dl) with idf."""
    return terms.withColumn("idf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("df", "n")


def bm25() -> Column:
    return F.round(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))), 9)


def _best(index: Index, scored: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The k best; a query with less than k scored chunks is filled up with the first chunks it may have, at score zero."""
    order = [F.desc("score"), F.col("chunk_no")]
    rows = scored.unionByName(first.withColumn("score", F.lit(0.0)))
    best = top_k(rows, 3 * k, ["query_id"], order).groupBy("query_id", "chunk_no").agg(F.max("score").alias("score"))
    return with_ids(index, top_k(best, k, ["query_id"], order)).select("query_id", "rank", "chunk_id", "score")


def search(index: Index, queries: DataFrame, k: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """queries(query_id, tokens) -> query_id, rank, chunk_id, score.

    Unique query terms; scores rounded to 9 places before ranking; ties by chunk_id. allowed(chunk_id), if given, restricts
    what is ranked, not the statistics. Queries with less than k scored chunks are filled up with chunks of score zero in
    chunk_id order."""
    terms = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term")).join(index.terms, "term")
    terms = weighted(terms.join(F.broadcast(index.stats.select("n", "avg_dl"))))
    pool = index.chunks.select("chunk_no")
    if allowed is not None:
        pool = index.chunks.join(allowed.select("chunk_id"), "chunk_id", "left_semi").select("chunk_no")
    # 2k chunks hold k that a query with less than k scored chunks has not scored
    first = queries.select("query_id").distinct().join(F.broadcast(pool.orderBy("chunk_no").limit(2 * k)))
    return _best(index, summed(index, terms, bm25(), None if allowed is None else pool), first, k)


def search_report(index: Index, queries: DataFrame, k: int = 5, own_statistics: bool = True) -> DataFrame:
    """queries(query_id, report_id, tokens) ranked over the chunks of their own report, with that report's statistics or with
    those of the whole index; else as search(). Only folders of the reports asked are read. A report without chunks gives no
    rows."""
    asked = queries.select("query_id", "report_id", F.explode(F.array_distinct("tokens")).alias("term"))
    if own_statistics:
        terms = asked.join(index.report_terms, ["report_id", "term"]).join(index.report_stats.select("report_id", "n", "avg_dl"), "report_id")
    else:
        terms = asked.join(index.terms, "term").join(F.broadcast(index.stats.select("n", "avg_dl")))
    places = index.chunks.select("report_id", "chunk_no").join(queries.select("report_id").distinct(), "report_id", "left_semi")
    first = queries.select("query_id", "report_id").join(top_k(places, 2 * k, ["report_id"], [F.col("chunk_no")], "_o").drop("_o"), "report_id")
    return _best(index, summed(index, weighted(terms), bm25()), first.select("query_id", "chunk_no"), k)


def coverage(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """A second ranking: how many distinct terms of a query a chunk holds. queries(query_id, tokens[, report_id]); with a
    report, its chunks alone."""
    keys = ["query_id", *(["report_id"] if "report_id" in queries.columns else [])]
    terms = queries.select(*keys, F.explode(F.array_distinct("tokens")).alias("term"))
    n = summed(index, terms, F.count(F.lit(1)))
    return with_ids(index, top_k(n, k, ["query_id"], [F.desc("score"), F.col("chunk_no")])).select("query_id", "chunk_id", "score", "rank")


def with_ids(index: Index, ranked: DataFrame) -> DataFrame:
    return ranked.join(index.chunks.select("chunk_no", "chunk_id"), "chunk_no")
