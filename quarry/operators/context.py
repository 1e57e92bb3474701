"""Context of hits: neighbouring pages, candidate ranking, item and character budgets, evidence blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import bigrams, citations
from quarry.operators.fusion import lexical_score
from quarry.sources.shared import materialize


def expand(hits: DataFrame, chunks: DataFrame, distances: tuple[int, ...] = (-1, 1)) -> DataFrame:
    """Chunks on pages next to a hit's page: query_id, context_order (after the hits), chunk_id, anchor_chunk_id, anchor_rank, page_distance.

    hits(query_id, rank, chunk_id); chunks(chunk_id, report_id, pdf_page, chunk_index). Of several anchors the nearest, then
    best ranked, then lowest distance counts; order by anchor rank, distance, chunk index, chunk id."""
    pages = chunks.select("chunk_id", "report_id", "pdf_page", "chunk_index")
    anchors = hits.join(pages, "chunk_id").select("query_id", F.col("rank").alias("anchor_rank"), F.col("chunk_id").alias("anchor_chunk_id"), "report_id", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.col("pdf_page") + d).alias("page")) for d in distances])).alias("x"))
    anchors = anchors.select("*", F.col("x.d").alias("page_distance"), F.col("x.page").alias("pdf_page")).drop("x")
    pool = anchors.join(pages, ["report_id", "pdf_page"]).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    near = F.struct(F.abs("page_distance").alias("a"), "anchor_rank", "page_distance", "anchor_chunk_id")
    kept = pool.groupBy("query_id", "chunk_id", "chunk_index").agg(F.min(near).alias("n"), F.count(F.lit(1)).alias("seen"))
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("n.anchor_rank", "n.a", "n.page_distance", "chunk_index", "chunk_id"))
    rows = kept.select("*", order.alias("o")).join(n, "query_id")
    return rows.select("query_id", (F.col("hits") + F.col("o")).alias("context_order"), "chunk_id", "n.anchor_chunk_id", "n.anchor_rank", "n.page_distance", (F.col("seen") - 1).alias("duplicates"))


def around(hits: DataFrame, chunks: DataFrame, distances: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """The chunks on the pages of hits(chunk_id) and beside them: all that expand() and add_siblings() can find. The pages are
    written first, so that few of them go to the chunks by broadcast."""
    own = hits.select("chunk_id").distinct().join(chunks.select("chunk_id", "report_id", "pdf_page"), "chunk_id")
    pages = own.select("report_id", F.explode(F.array(*[F.col("pdf_page") + d for d in distances])).alias("pdf_page")).distinct()
    return chunks.join(materialize(pages), ["report_id", "pdf_page"], "left_semi").select(*chunks.columns)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """candidates(query_id, query, text, anchor_rank, chunk_id[, hints]) plus lexical scores and selection_rank: most of the
    query's tokens, then pairs shared, then the share of its pairs, the better anchor, the shorter text, chunk_id. With hints
    (array of texts that name the metric) the metric's score comes first, and pairs before tokens."""
    s = candidates.withColumn("s", lexical_score(F.col("query"), F.col("text")))
    tokens, pairs, last = [F.desc("s.tokens")], [F.desc("s.pairs"), F.desc("s.recall")], [F.col("anchor_rank"), F.length("text"), F.col("chunk_id")]
    order = [*tokens, *pairs, *last]
    if "hints" in candidates.columns:
        s = s.withColumn("m", metric_score(F.col("hints"), F.col("text")))
        order = [F.desc("m.exact"), F.desc("m.recall"), F.desc("m.overlap"), *pairs, *tokens, *last]
    return s.withColumn("selection_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def metric_hints(metrics: DataFrame, aliases: DataFrame) -> DataFrame:
    """metrics(metric_id, display_name), aliases(metric_id, alias) -> hints: the name, then the aliases in order, trimmed,
    each once, blanks left out."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    own = aliases.groupBy("metric_id").agg(F.array_sort(F.collect_set(bare("alias"))).alias("_a"))
    every = F.concat(F.array(bare("display_name")), F.coalesce("_a", F.array().cast("array<string>")))
    return metrics.join(own, "metric_id", "left").select("metric_id", F.array_distinct(F.filter(every, lambda x: x != "")).alias("hints"))


def metric_score(hints: Column, text: Column) -> Column:
    """Whether a hint is in the text (letters and digits only, no case), the most character pairs that a hint shares with
    it, and the greatest share of a hint's pairs found. No hints score nothing."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")

    def score(x: Column) -> Column:
        exact = F.exists(hints, lambda h: (plain(h) != "") & F.contains(x["plain"], plain(h)))
        both = F.transform(hints, lambda h: F.struct(F.size(F.array_intersect(bigrams(h), x["pairs"])).alias("n"), F.size(bigrams(h)).alias("of")))
        share = F.array_max(F.transform(both, lambda b: F.when(b["of"] > 0, F.round(b["n"] / b["of"], 9)).otherwise(F.lit(0.0))))
        return F.struct(F.coalesce(exact, F.lit(False)).cast("int").alias("exact"), F.coalesce(F.array_max(both["n"]), F.lit(0)).alias("overlap"), F.coalesce(share, F.lit(0.0)).alias("recall"))

    return F.get(F.transform(F.array(F.struct(plain(text).alias("plain"), bigrams(text).alias("pairs"))), score), 0)


def add_siblings(pool: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """pool(query_id, chunk_id, anchor_chunk_id, anchor_rank, page_distance) plus the other chunks of the hits' own pages at
    distance 0. A chunk that is in the pool keeps its place there; of several anchors the best ranked counts; hits stay out."""
    places = chunks.select("chunk_id", "report_id", "pdf_page")
    anchors = hits.join(places, "chunk_id").select("query_id", F.col("rank").alias("anchor_rank"), F.col("chunk_id").alias("anchor_chunk_id"), "report_id", "pdf_page")
    near = anchors.join(places, ["report_id", "pdf_page"]).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    best = near.groupBy("query_id", "chunk_id").agg(F.min(F.struct("anchor_rank", "anchor_chunk_id")).alias("n"))
    new = best.join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    new = new.select("query_id", "chunk_id", "n.anchor_chunk_id", "n.anchor_rank", F.lit(0).alias("page_distance"), F.lit("same_page").alias("origin"))
    return pool.select("query_id", "chunk_id", "anchor_chunk_id", "anchor_rank", "page_distance", F.lit("adjacent_page").alias("origin")).unionByName(new)


def budget(candidates: DataFrame, max_items: int = 2, max_chars: int = 1600) -> DataFrame:
    """Greedy choice in selection_rank order: a candidate that does not fit is skipped, later ones may still fit; after
    max_items the rest are item_budget. candidates(query_id, selection_rank, chunk_id, n_chars), any number per query.

    Nothing is collected: what fits changes only when something is taken, so the next one taken is the least later candidate that fits."""
    w = Window.partitionBy("query_id")
    rows = candidates.select("query_id", F.struct("selection_rank", "chunk_id", F.col("n_chars").cast("int").alias("n_chars")).alias("c"))
    rows = rows.withColumn("last", F.lit(None).cast(rows.schema["c"].dataType)).withColumn("left", F.lit(max_chars).cast("long"))
    rows = rows.withColumn("full", F.lit(max_items <= 0)).withColumn("taken", F.lit(False))
    for k in range(1, max_items + 1):
        fits = (F.col("c.n_chars") <= F.col("left")) & (F.col("last").isNull() | (F.col("c") > F.col("last")))
        rows = rows.withColumn("next", F.min(F.when(fits, F.col("c"))).over(w))
        rows = rows.select("query_id", "c", F.coalesce("next", "last").alias("last"), (F.col("left") - F.coalesce(F.col("next.n_chars"), F.lit(0))).alias("left"),
                           F.lit(k == max_items) & F.col("next").isNotNull(), F.col("taken") | F.coalesce(F.col("c") == F.col("next"), F.lit(False))).toDF("query_id", "c", "last", "left", "full", "taken")
    after = F.col("full") & (F.col("last").isNull() | (F.col("c") > F.col("last")))
    said = F.when(F.col("taken"), "selected").when(after, "item_budget").otherwise("char_budget")
    return rows.select("query_id", "c.selection_rank", "c.chunk_id", "c.n_chars", said.alias("decision"))


def evidence_blocks(hits: DataFrame, chunks: DataFrame, max_hits: int = 5, max_chars: int = 4000) -> DataFrame:
    """Cited blocks of the best hits, each chunk at its best rank alone: header and text, blocks two characters apart, stop at the first overflow of the
    budget; a first block that alone is too long is truncated with an ellipsis. -> query_id, rank, citation, chunk_id, block, chars."""
    w = Window.partitionBy("query_id").orderBy("rank")
    once = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_hits)
    rows = once.join(chunks.select("chunk_id", "report_id", "pdf_page", "text"), "chunk_id").withColumn("citation", F.concat(F.lit("E"), "n"))
    block = F.concat(F.lit("["), "citation", F.lit("] "), "report_id", F.lit(" p."), F.col("pdf_page").cast("string"), F.lit("\n"), "text")
    rows = rows.withColumn("block", block)
    cut = (F.col("n") == 1) & (F.length("block") > max_chars)
    rows = rows.withColumn("block", F.when(cut, F.concat(F.substring("block", 1, max_chars - 1), F.lit("…"))).otherwise(F.col("block")))
    so_far = F.sum(F.length("block") + F.when(F.col("n") > 1, 2).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far)
    over = F.max(F.when(F.col("so_far") > max_chars, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("over", over).filter("over = 0").select("query_id", "rank", "citation", "chunk_id", "block", F.length("block").alias("chars"))


def evidence_counts(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of each query's hits: how many repeat a chunk, how many chunks got a block and how many were left out."""
    seen = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("chunk_id").alias("chunks"))
    made = blocks.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("chars").alias("chars"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return seen.join(made, "query_id", "left").select("query_id", (F.col("hits") - F.col("chunks")).alias("duplicates"), n("blocks").alias("blocks"), (F.col("chunks") - n("blocks")).alias("omitted"), n("chars").alias("chars"))


def citation_violations(answers: DataFrame) -> DataFrame:
    """answers(query_id, answer, declared, allowed): inline citations must be the declared ones, allowed, and at least one."""
    inline = F.array_sort(F.array_distinct(citations(F.col("answer"))))
    rules = F.array(F.when(F.size(inline) == 0, "no_citation"), F.when(F.size(F.array_except(inline, "allowed")) > 0, "not_allowed"), F.when(inline != F.array_sort(F.array_distinct("declared")), "differs_from_declared"))
    return answers.select("query_id", F.explode(F.array_compact(rules)).alias("rule_id"))


def unresolved_only(hits: DataFrame, resolved: DataFrame) -> DataFrame:
    """Hits of queries whose base hits did not resolve a fact: only these are widened."""
    return hits.join(resolved.select("query_id").distinct(), "query_id", "left_anti")


def selected_context(hits: DataFrame, decisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Base hits and chosen candidates, renumbered, with running character totals."""
    base = hits.select("query_id", F.lit(0).alias("g"), F.col("rank").alias("o"), "chunk_id", F.lit("retrieved").alias("origin"))
    more = decisions.filter("decision = 'selected'").select("query_id", F.lit(1).alias("g"), F.col("selection_rank").alias("o"), "chunk_id", F.lit("adjacent_page").alias("origin"))
    rows = base.unionByName(more).join(chunks.select("chunk_id", F.length("text").alias("chars")), "chunk_id")
    w = Window.partitionBy("query_id").orderBy("g", "o", "chunk_id")
    return rows.select("query_id", F.row_number().over(w).alias("context_order"), "chunk_id", "origin", "chars", F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("chars_so_far"))
