"""Sharding by bytes: global prefix sums from partition totals, cut at equal byte targets into contiguous shards.

Rows are put in one global order: by bucket, then group, then a spread of each group, then doc_id. Totals per
(group, spread) cell are summed before the shuffle; cells get running sums inside their bucket on top of the
totals of the buckets before it; rows get running sums inside their cell. No step needs all rows, or all rows
of a hot group, in one task. A shard is a range of that order. Rows of a group of less than `slack` of a
shard's target stay together (the group's middle decides); a larger group is cut where its rows' middles fall.

Null texts have size 1 and no checksum; all null texts form one group. Rows repeated in full take slots of
their own, in any order among themselves. Empty tables give no rows; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read

SHARDS, SLACK, BUCKETS, SPREAD = 16, 0.01, 1024, 64


def text_size(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 1


def shard_by_bytes(rows: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """rows(_bucket int, _group long, _spread int, doc_id, size, ...) -> the same plus shard and slot.

    _bucket must not decrease along the wished order and should hold about equal row counts; _group orders
    inside a bucket; _spread deals out the rows of one group."""
    cells = rows.groupBy("_bucket", "_group", "_spread").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    totals = cells.groupBy("_bucket").agg(F.sum("_bytes").alias("_b"), F.sum("_rows").alias("_r"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    totals = totals.select("_bucket", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_r0"), F.sum("_b").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_bucket").orderBy("_group", "_spread").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("_bucket", "_group")
    cells = cells.select("*", F.coalesce(F.sum("_bytes").over(inside), F.lit(0)).alias("_b1"), F.coalesce(F.sum("_rows").over(inside), F.lit(0)).alias("_r1"))
    cells = cells.select("*", F.min("_b1").over(group).alias("_g0"), F.sum("_bytes").over(group).alias("_g"))
    cells = cells.join(totals, "_bucket").select("_bucket", "_group", "_spread", (F.col("_b0") + F.col("_b1")).alias("_b2"), (F.col("_r0") + F.col("_r1")).alias("_r2"), (F.col("_b0") + F.col("_g0")).alias("_g1"), "_g", "_all")
    keys = ["_bucket", "_group", "_spread"]
    cell = Window.partitionBy(*keys).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("*", F.coalesce(F.sum("size").over(cell), F.lit(0)).alias("_b3"), (F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id")) - 1).alias("_r3"))
    placed = placed.join(cells, keys)
    target = F.col("_all") / shards
    middle = F.when(F.col("_g") <= slack * target, F.col("_g1") + F.col("_g") / 2).otherwise(F.col("_b2") + F.col("_b3") + F.col("size") / 2)
    shard = F.least(F.floor(middle / target), F.lit(shards - 1)).cast("int")
    out = placed.select(*[c for c in rows.columns if c not in keys], shard.alias("shard"), (F.col("_r2") + F.col("_r3")).alias("_rank"))
    out = materialize(out)
    first = out.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row per shard
    return out.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def by_text(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in the order of a hash of the text, so that equal texts lie together."""
    h = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), h.alias("_group"))
    return rows.withColumn("_bucket", F.shiftright("_group", 64 - 10).cast("int")).withColumn("_spread", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(by_text(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def by_mix(docs: DataFrame) -> DataFrame:
    """Mixed documents in the order of their slots (a slot is one block of one source)."""
    last = docs.agg(F.coalesce(F.max("mix_slot"), F.lit(0)).alias("_last"))  # one row
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "source", "mix_slot", F.col("mix_slot").cast("long").alias("_group"), F.col("mix_rank").cast("int").alias("_spread"))
    return rows.join(F.broadcast(last)).withColumn("_bucket", F.floor(F.col("_group") * BUCKETS / (F.col("_last") + 1)).cast("int")).drop("_last")
