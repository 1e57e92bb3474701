"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document is contaminated by a benchmark item if a window of as many words as the item has (or the whole
document, if shorter) is alike: weighted Jaccard similarity of 5-word shingles, weighted by their counts, of 0.8
or more, and SimHash fingerprints (64 bits over the same shingles) within `radius` bits. Items of less than 5
words take one shingle of all their words.

Windows are fingerprinted where they can matter: one that shares no shingle with the item has similarity zero, so
all windows come from shared shingles. The shared count only grows, as a window moves right, when a shared
shingle enters it, so the windows that end with a shared shingle hold the best one; of a run of shared
shingles that follow one another as in the item, the last suffices. Two fingerprints within radius r agree in
one of r + 1 blocks of bits; candidates must share such a block before their distance and exact similarity
are computed. Everything is built-in expressions.

Words are runs of letters and digits of the lower-cased text. Null and empty texts hold no words: such items match
nothing, such documents are clean. Repeated items match alike, repeated documents count once for their id; rows
with a null doc_id stay in the table. Empty tables give no matches. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import let, read

SHINGLE, SIMILARITY, RADIUS, BROADCAST_ROWS = 5, 0.8, 20, 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hash_at(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(k)])


def _shingles(words: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: _hash_at(words, i, k))


def fingerprint(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes (repeats count)."""
    ones = lambda b: F.size(F.filter(hashes, lambda h: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)) == 1))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * ones(b) > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def blocks(fp: Column, radius: int) -> Column:
    """radius + 1 blocks of bits, each as its place and its value in one number."""
    n, out = radius + 1, []
    for b in range(n):
        low, high = 64 * b // n, 64 * (b + 1) // n
        value = F.call_function("shiftrightunsigned", fp, F.lit(low)).bitwiseAND(F.lit((1 << (high - low)) - 1))
        out.append(F.lit(b << 32).cast("long") + value)
    return F.array(*out)


def counted(hashes: Column) -> Column:
    """Each hash with its how-manieth occurrence, so that set operations count repeats."""
    return let(F.sort_array(hashes), lambda s: F.transform(s, lambda h, i: F.struct(h.alias("h"), (i - F.array_position(s, h).cast("int")).alias("n"))))


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, item_id, similarity, hamming: the best window of each pair."""
    items = items.select("item_id", F.explode(F.array(words_of(F.col("text")))).alias("w")).filter(F.size("w") > 0)
    texts = docs.select("doc_id", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    sizes = [r["k"] for r in items.select(F.least(F.size("w"), F.lit(SHINGLE)).alias("k")).distinct().collect()]  # at most five numbers
    found = None
    for k in sorted(sizes):
        own = items.filter(F.least(F.size("w"), F.lit(SHINGLE)) == k).select("item_id", F.size("w").alias("n"), "w", _shingles(F.col("w"), k).alias("hs"))
        own = own.select("*", (F.size(F.array_distinct("hs")) < F.size("hs")).alias("repeats"))
        keys = own.select("item_id", "n", "w", "repeats", F.posexplode("hs").alias("q", "h"))
        # the word that would carry on a run; unknown where the item repeats a shingle, so that no window is left out
        keys = keys.select("h", "item_id", "n", F.when(~F.col("repeats"), F.get("w", F.col("q") + k)).alias("next")).distinct()
        small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        spots = texts.filter(F.size("w") >= k).select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("p")).withColumn("h", _hash_at(F.col("w"), F.col("p"), k))
        hits = spots.join(F.broadcast(keys) if small else keys, "h")
        runs_on = F.coalesce(F.get("w", F.col("p") + k) == F.col("next"), F.lit(False))
        start = F.greatest(F.col("p") + k - F.col("n"), F.lit(0))
        cut = hits.filter(~runs_on).select("doc_id", "item_id", F.slice("w", start + 1, F.col("n")).alias("window"))
        # fingerprints and blocks of items once, of windows where a shared shingle put one
        marked = own.select("item_id", F.explode(F.array(F.struct("hs", fingerprint(F.col("hs")).alias("fp"), counted(F.col("hs")).alias("c")))).alias("i"))
        marked = marked.select("item_id", "i.fp", "i.c", blocks(F.col("i.fp"), radius).alias("b"))
        seen = cut.select("doc_id", "item_id", F.explode(F.array(let(_shingles(F.col("window"), k), lambda hs: F.struct(fingerprint(hs).alias("fp"), counted(hs).alias("c"))))).alias("x"))
        pairs = seen.join(F.broadcast(marked) if small else marked, "item_id").filter(F.arrays_overlap(blocks(F.col("x.fp"), radius), "b"))
        pairs = pairs.select("doc_id", "item_id", F.bit_count(F.col("x.fp").bitwiseXOR(F.col("fp"))).alias("hamming"), F.size(F.array_intersect("x.c", "c")).alias("both"), F.size("x.c").alias("a"), F.size("c").alias("z"))
        pairs = pairs.filter(F.col("hamming") <= radius).select("doc_id", "item_id", (F.col("both") / (F.col("a") + F.col("z") - F.col("both"))).alias("similarity"), "hamming").filter(F.col("similarity") >= similarity)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        nothing = F.lit(None).cast(items.schema["item_id"].dataType)
        return docs.select("doc_id", nothing.alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("hamming")).filter(F.lit(False))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min("hamming").alias("hamming"))


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with the columns of docs."""
    bad = matches(docs.select("doc_id", "text"), items, similarity, radius).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
