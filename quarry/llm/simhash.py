"""SimHash near-duplicates by vantage-point trees over fingerprints.

A fingerprint has 64 bits per lane; a bit is 1 if it is set in over half of the hashes of a text's shingles (with
repeats). Two fingerprints link if they differ in `radius` bits or less, and groups are connected components. Where a
similarity is asked for (the pipeline), such links are candidates, and the sets of shingles decide.

Search: distinct fingerprints only. A small vantage-point tree, fitted on a sample (`SAMPLE` fingerprints of least
hash, or 16 for each leaf if that is more), splits the space into leaves by Hamming distance; its split values only
steer where work goes, so results don't depend on the sample. A fingerprint goes to its own leaf and, for each
other leaf that the triangle bound cannot rule out, to the shard of that pair of leaves. The tree is as deep as leaves
of `LEAF` fingerprints ask for; a leaf that ties make larger is dealt into blocks, and each pair of blocks meets in a
task of its own. A task joins one pair exactly, with vantage-point pruning of its own, and gives back a spanning
star of what it linked instead of all pairs. Rows of equal fingerprints (exact copies) are never joined with each other.

Null and empty texts have fingerprint zero and link like any other. Words are `[^\\x20\\x09-\\x0D]+` after
lower-casing A-Z. Repeated rows get the same fingerprint and group. Rows with a null id get a fingerprint
and a group whose id is the smallest id that is not null, if any. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, partitions, read
from quarry.llm.components import components

SEED = 42
SAMPLE, LEAF, BRUTE = 8192, 1 << 17, 1 << 20
#: Sets of shingles that one task compares with each other: in cells of a group, then those left over with the others.
CELL, PIVOTS, FAR = 256, 16, 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = (np.arange(8) * 256).astype(np.intp)


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Further bits of a hash for the lanes after the first: its state moved on and mixed."""
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """A hash of each shingle, in text order and with repeats; a text of fewer words has one of all its words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()[shingle - 1 :] or ends.tolist()[-1:]
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(ends))


def fingerprint(text: bytes, shingle: int, lanes: int = 1, distinct: bool = False) -> tuple[list[int], int, int]:
    """Unsigned fingerprint of each lane, the number of shingles and a hash of them; with distinct, of the set of shingles."""
    first = shingle_hashes(text, shingle)
    if distinct:
        first = np.unique(first)
    n, out = len(first), []
    mark = xxhash.xxh64_intdigest(first.tobytes(), SEED)
    if not n:
        return [0] * lanes, 0, mark
    for lane in range(lanes):
        h = _remix(first, lane) if lane else first
        counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
        out.append(int(np.packbits((2 * counts.ravel() > n), bitorder="little").view("<u8")[0]))
    return out, n, mark


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """docs(doc_id long, text) -> doc_id, text_hash, n_shingles, shingles_hash, f0 .. (longs that hold the unsigned bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py() or b"", shingle, lanes, distinct) for t in b.column(1).cast(pa.binary())]
            bits = np.array([f for f, _, _ in found], dtype=np.uint64).reshape(-1, lanes).view(np.int64)
            marks = np.array([m for _, _, m in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([n for _, n, _ in found], pa.int64()), pa.array(marks), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(lanes)]], ["doc_id", "text_hash", "n_shingles", "shingles_hash", *[f"f{k}" for k in range(lanes)]])

    schema = "doc_id long, text_hash long, n_shingles long, shingles_hash long, " + ", ".join(f"f{k} long" for k in range(lanes))
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of two arrays of shape (.., lanes)."""
    d = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16)
    for lane in range(1, x.shape[-1]):
        d += np.bitwise_count(x[..., lane] ^ y[..., lane])
    return d


class Join:
    """All pairs within a radius among points of one task, gathered as a spanning forest."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int, ratio: float):
        self.p, self.low, self.high, self.r, self.ratio = points, low, high, radius, ratio
        self.root = np.arange(len(points))

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def brute(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every pair of a and b, in blocks; with a size ratio only the sizes that may match."""
        if self.ratio > 0:
            a, b = a[np.argsort(self.low[a], kind="stable")], b[np.argsort(self.low[b], kind="stable")]
            top = np.maximum.accumulate(self.high[b])
        for k in range(0, len(a), 256):
            part, other = a[k : k + 256], b
            if self.ratio > 0:
                lo = np.searchsorted(top, self.low[part[0]] * self.ratio)
                hi = np.searchsorted(self.low[b], self.high[part].max() / self.ratio, side="right")
                other = b[lo:hi]
            for m in range(0, len(other), 4096):
                some = other[m : m + 4096]
                i, j = np.nonzero(_apart(self.p[part][:, None], self.p[some][None]) <= self.r)
                i, j = part[i], some[j]
                if self.ratio > 0:
                    fit = (self.low[i] * self.ratio <= self.high[j]) & (self.low[j] * self.ratio <= self.high[i])
                    i, j = i[fit], j[fit]
                self.tie(i, j)

    def inside(self, a: np.ndarray) -> None:
        """Pairs within a."""
        if len(a) * len(a) <= BRUTE:
            return self.brute(a, a)
        d = _apart(self.p[a], self.p[a[len(a) // 2]]).astype(np.int64)
        mu = int(np.median(d))
        near = d <= mu
        edge_in, edge_out = near & (d > mu - self.r), ~near & (d <= mu + self.r)
        if near.all() or edge_in.sum() * edge_out.sum() > 0.8 * near.sum() * (~near).sum() and edge_out.sum() > 0.9 * len(a) / 2:
            return self.brute(a, a)
        self.inside(a[near])
        self.inside(a[~near])
        return self.across(a[edge_in], a[edge_out])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of one of a and one of b."""
        if len(a) * len(b) <= BRUTE:
            return self.brute(a, b)
        if len(a) < len(b):
            a, b = b, a
        v = self.p[a[len(a) // 2]]
        da, db = _apart(self.p[a], v).astype(np.int64), _apart(self.p[b], v).astype(np.int64)
        mu = int(np.median(da))
        near = da <= mu
        b_in, b_out = db <= mu + self.r, db > mu - self.r
        if near.all() or near.sum() * b_in.sum() + (~near).sum() * b_out.sum() > 0.9 * len(a) * len(b):
            return self.brute(a, b)
        self.across(a[near], b[b_in])
        return self.across(a[~near], b[b_out])


class Tree:
    """A vantage-point tree of a given depth over a sample; it knows the leaf of a point and the leaves within a radius."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.nodes = depth, {}
        self._grow(sample, 0, 1)

    def _grow(self, x: np.ndarray, level: int, at: int) -> None:
        if level == self.depth:
            return
        v = x[len(x) // 2] if len(x) else None
        d = _apart(x, v).astype(np.int64) if len(x) else np.zeros(0, np.int64)
        mu = int(np.median(d)) if len(x) else 0
        self.nodes[at] = (v, mu)
        self._grow(x[d <= mu], level + 1, 2 * at)
        self._grow(x[d > mu], level + 1, 2 * at + 1)

    def leaves(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, is_home) for each leaf that may hold a point within the radius."""
        found: list[tuple[np.ndarray, int, np.ndarray]] = []

        def walk(at: int, rows: np.ndarray, home: np.ndarray, level: int) -> None:
            if not len(rows):
                return
            if level == self.depth:
                found.append((rows, at - (1 << self.depth), home))
                return
            v, mu = self.nodes[at]
            d = _apart(x[rows], v).astype(np.int64) if v is not None else np.zeros(len(rows), np.int64)
            left, right = d <= mu + radius, d > mu - radius
            walk(2 * at, rows[left], home[left] & (d[left] <= mu), level + 1)
            walk(2 * at + 1, rows[right], home[right] & (d[right] > mu), level + 1)

        walk(1, np.arange(len(x)), np.ones(len(x), bool), 0)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate([r for r, _, _ in found]), np.concatenate([np.full(len(r), leaf) for r, leaf, _ in found]), np.concatenate([h for _, _, h in found])


def links(points: DataFrame, radius: int, lanes: int = 1, ratio: float = 0.0) -> DataFrame:
    """points(node long, low long, high long, f0 ..) with distinct fingerprints -> (u, v): links that span each group.

    ratio: sizes (a range low .. high for each point) must be within it of each other; 0 sets no limit."""
    spark, lane = points.sparkSession, [f"f{k}" for k in range(lanes)]
    n, count = partitions(spark), points.count()
    depth = max(1, int(np.ceil(np.log2(2 * np.sqrt(n)))), int(np.ceil(np.log2(max(1, count / LEAF)))))
    shards = 1 << depth
    sample = points.select(*lane).orderBy(F.xxhash64(*lane)).limit(max(SAMPLE, 16 * shards)).collect()
    sample = np.array(sample, dtype=np.int64).reshape(-1, lanes).view(np.uint64)
    tree = Tree(sample, depth)
    row, leaf, home = tree.leaves(sample, 0)
    shares = np.bincount(leaf[home], minlength=shards) / max(1, len(sample))
    parts = np.maximum(1, np.ceil(shares * count / (2 * LEAF))).astype(np.int64)  # blocks of each leaf

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.ascontiguousarray(f[lane].to_numpy(np.int64)).view(np.uint64)
            row, leaf, home = tree.leaves(x, radius)
            own = np.zeros(len(f), np.int64)
            own[row[home]] = leaf[home]
            block = (f["node"].to_numpy(np.int64).view(np.uint64) % parts[own].astype(np.uint64)).astype(np.int64)
            # one row for each block of the other leaf
            copies = parts[leaf]
            other = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, leaf = np.repeat(row, copies), np.repeat(leaf, copies)
            mine, at = own[row], block[row]
            second = (mine > leaf) | ((mine == leaf) & (at > other))
            out = f.iloc[row].copy()
            out["pair"] = np.minimum(mine, leaf) * shards + np.maximum(mine, leaf)
            out["cell"] = np.where(second, other << 31 | at, at << 31 | other)
            out["second"] = second
            yield out

    def meet(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.ascontiguousarray(f[lane].to_numpy(np.int64)).view(np.uint64)
        join = Join(x, f["low"].to_numpy(np.float64), f["high"].to_numpy(np.float64), radius, ratio)
        if key[0] // shards == key[0] % shards and key[1] >> 31 == key[1] & (1 << 31) - 1:
            join.inside(np.arange(len(f)))
        else:
            second = f["second"].to_numpy(bool)
            join.across(np.flatnonzero(~second), np.flatnonzero(second))
        tied = np.flatnonzero(join.root != np.arange(len(f)))
        node = f["node"].to_numpy(np.int64)
        return pd.DataFrame({"u": node[tied], "v": node[join.root[tied]]})

    fields = "node long, low long, high long, " + ", ".join(f"{c} long" for c in lane)
    dealt = points.select("node", "low", "high", *lane).mapInPandas(deal, f"{fields}, pair long, cell long, second boolean")
    return dealt.repartition(n, "pair", "cell").groupBy("pair", "cell").applyInPandas(meet, "u long, v long")


def tie_sets(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, similarity: float) -> np.ndarray:
    """Labels of sets (distinct hashes) after every set of left was compared with all sets: sets whose Jaccard similarity
    is reached share the least label. Pairs that share a label already need no comparison."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark, label = np.zeros(len(values), bool), label.copy()
    for a in left:
        if (label == label[0]).all():
            break
        own = ids[starts[a] : starts[a] + sizes[a]]
        mark[own] = True
        both = np.add.reduceat(mark[ids], starts, dtype=np.int64)
        mark[own] = False
        near = np.unique(label[both / (sizes + sizes[a] - both) >= similarity])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]
    return label


def verified(docs: DataFrame, points: DataFrame, groups: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): links that span the texts whose sets of shingles are alike, of the candidate groups(node, root).

    docs(doc_id long, text); points(node, first): a document of each different set. A group is dealt into cells of about
    CELL sets; each cell compares all its pairs, and about PIVOTS sets of the group sit in every cell, so that most of
    what belongs together is tied at a cost linear in the group. If a large group is then still in parts, every set outside
    its largest part meets every other set of the group in a task of its cells: no pair of different parts is left out."""
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    members = groups.select("node", "root").unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    large = members.groupBy("root").agg(F.count(F.lit(1)).alias("g")).filter(F.col("g") > CELL)  # at most a CELL-th of the nodes
    named = members.join(points.select("node", F.col("first").alias("doc_id")), "node").join(F.broadcast(large), "root", "left")

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or b"", shingle)) for t in b.column(3).cast(pa.binary())]
            # a doc_id that stands for several texts brings them all: only the one that the node is of counts
            mine = [len(s) > 0 and np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)) == np.int64(k).view(np.uint64) for s, k in zip(sets, b.column(0).to_pylist())]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "root", "g", "shingles"])
            yield out.filter(pa.array(mine, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(texts.join(named, "doc_id").select("node", "root", "g", "text").mapInArrow(shingle_sets, "node long, root long, g long, shingles binary"))

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        """One cell: rows with second (all, if there is none) against all rows; part is what a set is tied to already."""
        sets = [np.frombuffer(x, np.uint64) for x in f["shingles"]]
        node = f["node"].to_numpy(np.int64)
        _, first, part = np.unique(f["part"].to_numpy(np.int64), return_index=True, return_inverse=True)
        start = first[part]
        label = tie_sets(sets, start, np.flatnonzero(f["second"].to_numpy(bool)), similarity)
        tied = np.flatnonzero(label != start)
        return pd.DataFrame({"u": node[tied], "v": node[label[tied]]})

    def meet_all(f: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([meet(part) for _, part in f.groupby(["root", "cell", "other"])], ignore_index=True)

    def links_of(dealt: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("root", "cell", "other"), F.lit(n))
        dealt = dealt.select("node", "root", "shingles", "part", "second", "cell", "other", bucket.alias("bucket"))
        return materialize(dealt.groupBy("bucket").applyInPandas(meet_all, "u long, v long"))

    place = lambda count, seed: F.pmod(F.xxhash64("node", F.lit(seed)), count)
    every = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    cells = F.coalesce(F.ceil(F.col("g") / CELL), F.lit(1)).cast("long")
    pivot = (cells > 1) & (place(cells * (CELL // PIVOTS), 1) == 0)
    near = rows.withColumn("cell", F.explode(F.when(pivot, every(cells)).otherwise(F.array(place(cells, 2)))))
    found = links_of(near.select("*", F.lit(0).alias("other"), F.col("node").alias("part"), F.lit(True).alias("second")))
    if large.isEmpty():
        return found
    parts = rows.filter("g is not null").join(components(found).withColumnRenamed("root", "part"), ["node"], "left").withColumn("part", F.coalesce("part", "node"))
    parts = materialize(parts)
    counts = parts.groupBy("root", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("root").agg(F.max_by("part", F.struct("c", "part")).alias("main"), (F.sum("c") - F.max("c")).alias("r"))
    split = parts.join(F.broadcast(counts.filter("r > 0")), "root")
    far, rest = F.ceil(F.col("g") / FAR).cast("long"), F.ceil(F.col("r") / FAR).cast("long")
    ones = split.select("*", place(far, 3).alias("cell"), F.explode(every(rest)).alias("other"), F.lit(False).alias("second"))
    others = split.filter("part <> main").select("*", F.explode(every(far)).alias("cell"), place(rest, 4).alias("other"), F.lit(True).alias("second"))
    return found.unionByName(links_of(ones.unionByName(others)))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, lanes: int = 1, ratio: float = 0.0, similarity: float = 0.0) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, n_shingles, f0 .., root (of the group), component_id (the smallest doc_id
    reachable), one row per row.

    With a similarity, fingerprints are of sets of shingles and give candidates only: of those, texts link whose sets have
    that Jaccard similarity or more. Rows of equal sets are one point."""
    distinct = similarity > 0
    lane = [f"f{k}" for k in range(lanes)]
    node = F.col("shingles_hash") if distinct else F.col("f0") if lanes == 1 else F.xxhash64(*lane)
    marks = materialize(fingerprints(docs, shingle, lanes, distinct)).withColumn("node", node)
    points = materialize(marks.groupBy("node", *lane).agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")))
    groups = components(links(points, radius, lanes, ratio))
    if distinct:
        groups = components(verified(docs, points, groups, shingle, similarity))
    rooted = points.select("node", "first").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("node", "root", "component_id")
    return marks.join(named, "node").select("doc_id", "text_hash", "n_shingles", *lane, "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 110, lanes: int = 8, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest doc_id stays (of the smallest
    hash, if that id has several texts), one of rows that repeat it. Rows with a null doc_id stay, uncompared.

    Texts link if their sets of shingles overlap by similarity (Jaccard) or more, which is computed. Candidates are texts
    whose fingerprints differ in `radius` bits or less and whose numbers of distinct shingles are within similarity, which
    bounds the overlap of sets. Sets 0.8 alike have vectors at 27 degrees or less and so differ in 15 percent of the bits
    on average: 78 of 512, with a standard deviation of 8; a radius of 110 is four of those away."""
    known = docs.filter("doc_id is not null")
    groups = near_duplicates(known.select("doc_id", "text"), shingle, radius, lanes, similarity, similarity)
    # rows are told apart by id and text: an id may stand for texts of different groups
    stay = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select(F.col("s.doc_id").alias("_stay_id"), F.col("s.text_hash").alias("_stay_text"))
    text_hash = F.xxhash64("text")
    kept = known.join(stay, (F.col("doc_id") == F.col("_stay_id")) & (text_hash == F.col("_stay_text")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", text_hash).orderBy(F.lit(0)))
    kept = kept.withColumn("_nth", nth).filter("_nth = 1").select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
