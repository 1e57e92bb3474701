"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks of equal length. Block k of a source with weight w (its share
of the slots, weights summing to 1) is released at slot floor((k - 1) / w) and due by slot ceil(k / w); the
earliest deadline first among released blocks takes each slot, which keeps every source within less than one
block of w * t after t slots. Weights are whole parts of a period, so the schedule of one period repeats; it
is worked out once per phase from the weights alone. When a source has no block left, a new phase starts with
the weights of the others scaled up: no document is dropped or repeated.

A source's documents are numbered in the order of a hash of doc_id, by running sums over buckets of that hash,
so a hot source is spread over many tasks. Null sources form a source of their own (null). Ties and repeated
rows take places of their own; empty tables give no rows. Further columns are kept; columns that the mix adds
(mix_slot, mix_block, mix_phase, mix_rank) replace columns of the same names.

The schedule is made on the driver for a bounded number of lines: a source each up to OWN sources. Where there are
more, the OWN largest (and all that targets name) keep lines of their own, and the others share one line for each
class of size (powers of two) and eighth of their hash, which weighs what its members weigh together. A shared line is
scheduled like a source, within less than one block; inside it blocks stand in the order of their members' own times
((k + 1/2) / weight, in sixteenths), numbered by running sums on the cluster.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import partitions, read

BLOCK, PERIOD, TEMPERATURE = 8, 1000, 0.5
#: Sources with a line of their own where there are more, lines for a class of size, parts of a unit of time.
OWN, LINES, TICKS = 256, 8, 16


def pattern(parts: dict[str, int]) -> dict[str, list[int]]:
    """Earliest deadline first over one period: parts[s] slots of sum(parts) for each source, in order."""
    period, out = sum(parts.values()), {s: [] for s in parts}
    releases = [[] for _ in range(period)]
    for s, q in parts.items():
        for k in range(q):
            releases[k * period // q].append((-(-(k + 1) * period // q), s))
    ready: list[tuple[int, str]] = []
    for slot in range(period):
        for job in releases[slot]:
            heapq.heappush(ready, job)
        out[heapq.heappop(ready)[1]].append(slot)
    return out


def parts_of(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole parts of a period by largest remainder, one part at least."""
    period = max(period, 2 * len(weights))
    spare, total = period - len(weights), sum(weights.values())
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: int(x) + 1 for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def phases(blocks: dict[str, int], parts: dict[str, int]) -> list[tuple[str, int, int, int, int, int, list[int]]]:
    """(source, phase, first block, end block, first slot, period, pattern) for each source and phase it takes part in."""
    done, start, out, n = dict.fromkeys(blocks, 0), 0, [], 0
    active = {s: parts[s] for s in sorted(blocks) if blocks[s] > 0}
    while active:
        slots, period = pattern(active), sum(active.values())
        ends = {s: (left // q) * period + slots[s][left % q] for s, q in active.items() for left in [blocks[s] - done[s] - 1]}
        length = min(ends.values()) + 1
        for s, q in active.items():
            took = length // period * q + sum(x < length % period for x in slots[s])
            out.append((s, n, done[s], done[s] + took, start, period, slots[s]))
            done[s] += took
        start, n = start + length, n + 1
        active = {s: q for s, q in active.items() if done[s] < blocks[s]}
    return out


def _shared(sources: DataFrame, own: list[str], targets: dict[str, float] | None, block: int, temperature: float) -> DataFrame:
    """sources(_source, n) without lines of their own -> _source, _line, _blocks, _weight."""
    rest = sources.filter(~F.col("_source").isin(own))
    weight = F.pow("n", F.lit(temperature)) if targets is None else F.lit(float(min(targets.values())))
    line = F.format_string("*%d_%d", F.floor(F.log2("n")), F.pmod(F.xxhash64("_source"), F.lit(LINES)))
    return rest.select("_source", line.alias("_line"), F.ceil(F.col("n") / block).alias("_blocks"), weight.alias("_weight"))


def _numbered(shared: DataFrame) -> DataFrame:
    """The blocks of sources that share a line: _source, mix_block, _line, _k (place in the line)."""
    blocks = shared.select("_source", "_line", "_weight", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("mix_block"), F.xxhash64("_source").alias("_s"))
    cell = ["_line", "_tick", "_part"]
    blocks = blocks.withColumn("_tick", F.floor((F.col("mix_block") + 0.5) / F.col("_weight") * TICKS)).withColumn("_part", F.shiftright("_s", 58))
    counts = blocks.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_line").orderBy("_tick", "_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("_s", "_source", "mix_block")) - 1
    return blocks.withColumn("_i", inside).join(counts, cell).select("_source", "mix_block", "_line", (F.col("_first") + F.col("_i")).alias("_k"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, temperature: float = TEMPERATURE) -> DataFrame:
    """docs(doc_id, source, ...) plus mix_block (in its source), mix_phase, mix_slot (global) and mix_rank (in its block).

    targets: weight of each source; a source not named gets the smallest named weight. By default a source
    weighs its document count to the power `temperature`, which lifts small sources."""
    spark = docs.sparkSession
    added = ("mix_block", "mix_phase", "mix_slot", "mix_rank")
    keys = ["_source", "_bucket"]
    h = F.xxhash64("doc_id")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), h.alias("_h"))
    rows = rows.withColumn("_bucket", F.pmod("_h", F.lit(4 * partitions(spark))).cast("int"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sources = counts.groupBy("_source").agg(F.sum("_n").alias("n"))
    largest = sources.orderBy(F.desc("n"), "_source").limit(OWN + 1).collect()
    if len(largest) > OWN:  # those with lines of their own: as many as OWN, and those that targets name
        named = sources.filter(F.substring("_source", 2, 1 << 30).isin(list(targets))).collect() if targets else []
        largest = list({r["_source"]: r for r in (*largest[:OWN], *named)}.values())
        shared = _shared(sources, [r["_source"] for r in largest], targets, block, temperature)
        lines = shared.groupBy("_line").agg(F.sum("_blocks").alias("n"), F.sum("_weight").alias("w")).collect()  # LINES for a class
    else:
        shared, lines = None, []
    sizes = {r["_source"]: r["n"] for r in largest}
    if targets is None:
        weights = {s: n**temperature for s, n in sizes.items()}
    else:
        weights = {s: float(targets.get(s[1:], min(targets.values()))) for s in sizes}
    blocks = {s: -(-n // block) for s, n in sizes.items()} | {r["_line"]: r["n"] for r in lines}
    weights |= {r["_line"]: float(r["w"]) for r in lines}
    plan = phases(blocks, parts_of(weights, period)) if blocks else []
    by_source: dict[str, list] = {}
    for s, *rest in plan:
        by_source.setdefault(s, []).append(tuple(rest))
    schema = "_line string, _plan array<struct<phase:int,first:long,last:long,start:long,period:long,slots:array<int>>>"
    plans = spark.createDataFrame(list(by_source.items()), schema)
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if shared is None:
        offsets = offsets.join(plans.withColumnRenamed("_line", "_source"), "_source")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id")) - 1
    rows = rows.withColumn("_place", place).join(offsets, keys).withColumn("_place", F.col("_place") + F.col("_before"))
    rows = rows.withColumn("mix_block", F.floor(F.col("_place") / block)).withColumn("_k", F.col("mix_block"))
    if shared is not None:
        own = rows.join(F.broadcast(plans.withColumnRenamed("_line", "_source")), "_source")
        others = rows.drop("_k").join(_numbered(shared), ["_source", "mix_block"]).join(F.broadcast(plans), "_line").drop("_line")
        rows = own.unionByName(others)
    rows = rows.withColumn("_p", F.get(F.filter("_plan", lambda p: (F.col("_k") >= p["first"]) & (F.col("_k") < p["last"])), F.lit(0)))
    k, q = F.col("_k") - F.col("_p.first"), F.size("_p.slots")
    slot = F.col("_p.start") + F.floor(k / q) * F.col("_p.period") + F.get(F.col("_p.slots"), F.pmod(k, q).cast("int"))
    rows = rows.select("*", F.col("_p.phase").alias("mix_phase"), slot.alias("mix_slot"), F.pmod("_place", F.lit(block)).cast("int").alias("mix_rank"))
    return rows.drop("_source", "_h", "_bucket", "_place", "_before", "_plan", "_p", "_k")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table's mixing order under the default weights: one row per document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_phase", F.col("mix_block").cast("long").alias("mix_block"), F.col("mix_slot").cast("long").alias("mix_slot"), "mix_rank")
