"""Spelling variants: words one letter apart, found with a bit-sliced index of positions.

Words are counted by built-in functions. Two words that differ by one inserted, deleted or replaced letter share the
first half of the shorter or what follows it: with L letters in the shorter word and the first L // 2 of them as its
head, an edit behind the head leaves the head whole, an edit inside it leaves the last L - L // 2 letters whole. So each
word is dealt to four shards, by head and by tail, as the shorter word and (with one letter more) as the longer one, and
every near pair meets in one of them. A pair that shares both is counted by its head alone.

In a shard the index holds a bit set over the shard's words for every (position, letter): which words have that letter
there. For all words of a length at once, four bit sets are carried from letter to letter, 64 words in a step: words
that agree so far (zero errors), and words that are one replacement, one letter more or one letter less away; the last
two read the index one position further on or back. Small shards are put together to bundles of one index (pairs of
different shards in it are left out); a shard of more than its share of letters is cut into blocks, and each block is
the index for every block's queries, so a task holds two blocks however common a head is. Only near pairs leave the bit
sets, and only their sums leave the task: per word the number of near words and the best of them.

A word's form is its near word of most occurrences (ties: the least in code-point order) if it has at least twice its
own. Forms are followed to their end by doubling: occurrences double with each step, so there are few rounds.

Null texts have no words, a null doc_id is the empty string. Repeated documents count again. Words may be of any
length. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, delete, partitions, read, write_out

NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO, TYPOS = 5, 3, 2, 97
#: Words and letters of an index: blocks of a large shard, and bundles of small ones.
BLOCK_WORDS, BLOCK_LETTERS = 2048, 1 << 16
#: Words dealt to a task, for which it holds four rows each, or more where a shard is large.
TASK_WORDS = 16_384
POINTS = 0x110000
NEAR = "word string, n_near long, best_n long, best string"


def with_typo(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % TYPOS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """docs(doc_id, text) -> word, n."""
    runs = docs.select("doc_id", F.explode(F.split(ascii_lower(F.col("text")), NOT_LETTERS)).alias("run")).filter("run <> ''")
    words = runs.select(with_typo(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def shards(words: DataFrame, block_words: int = BLOCK_WORDS, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """words(word, n) -> shard, half, size (L), query, indexed, word, n. A word is in up to four shards; in a shard of
    several blocks it is a query in each and indexed in each that its own block is the index of."""
    m = F.length("word")
    kinds = F.array(*[F.struct(F.lit(half).alias("half"), (m - longer).alias("size")) for half in (0, 1) for longer in (0, 1)])
    placed = words.filter(m > 0).select("word", "n", F.explode(kinds).alias("k")).select("word", "n", "k.*")
    head = F.floor(F.col("size") / 2).cast("int")
    part = F.when(F.col("half") == 0, F.substring(F.col("word"), F.lit(1), head)).otherwise(F.substring(F.col("word"), F.length("word") - F.col("size") + head + 1, F.col("size")))
    placed = placed.withColumn("shard", F.xxhash64("half", "size", part))
    share = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.lit(block_letters) / (F.col("size") + 1))))
    sizes = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.max(share)).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = placed.join(sizes, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(own.alias("i"), b.alias("j"), F.lit(True).alias("indexed"), (b == own).alias("query")))
    asking = F.filter(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("i"), own.alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("query"))), lambda x: x["i"] != own)
    places = dealt.select("shard", "half", "size", "word", "n", F.explode(F.concat(others, asking)).alias("p"))
    return places.select(F.when((F.col("p.i") == 0) & (F.col("p.j") == 0), F.col("shard")).otherwise(F.xxhash64("shard", "p.i", "p.j")).alias("shard"), "half", "size", "p.query", "p.indexed", "word", "n")


def near_sets(queries: list[np.ndarray], indexed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(query, indexed) numbers of all pairs that differ by exactly one letter; words as arrays of letters."""
    lengths = np.array([len(w) for w in indexed])
    width, deepest = -(-len(indexed) // 64), int(lengths.max())
    who = np.repeat(np.arange(len(indexed)), lengths)
    where = np.arange(len(who)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = np.concatenate(indexed).astype(np.int64)
    keys, slot = np.unique(where * POINTS + letters, return_inverse=True)
    sets = np.zeros((len(keys) + 1, width), np.uint64)  # the last one is empty
    np.bitwise_or.at(sets, (slot, who // 64), np.uint64(1) << (who % 64).astype(np.uint64))

    def having(condition: np.ndarray) -> np.ndarray:
        padded = np.zeros(width * 64, bool)
        padded[: len(condition)] = condition
        return np.packbits(padded.reshape(width, 64), axis=1, bitorder="little").view(np.uint64).reshape(width)

    def at(position: int, column: np.ndarray) -> np.ndarray:
        """For each query: the words that have its letter at a position."""
        if not 0 <= position < deepest:
            return sets[np.full(len(column), len(keys))]
        k = position * POINTS + column
        found = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return sets[np.where(keys[found] == k, found, len(keys))]

    by_length: dict[int, list[int]] = {}
    for q, w in enumerate(queries):
        by_length.setdefault(len(w), []).append(q)
    out_q, out_i = [], []
    for m, members in by_length.items():
        block = np.stack([queries[q] for q in members]).astype(np.int64)
        same = np.broadcast_to(having(lengths >= 0), (len(members), width)).copy()
        more = np.broadcast_to(having(lengths >= 1), same.shape).copy()  # one letter inserted so far
        other, less = np.zeros_like(same), np.zeros_like(same)  # one replaced, one deleted
        for j in range(m):
            letter = block[:, j]
            here = at(j, letter)
            other = (other & here) | (same & ~here & having(lengths > j))
            less = (less & at(j - 1, letter)) | same
            same &= here
            more = (more & at(j + 1, letter)) | (same & having(lengths > j + 1))
            if not (same.any() or other.any() or less.any() or more.any()):
                break
        found = (other & having(lengths == m)) | (more & having(lengths == m + 1)) | (less & having(lengths == m - 1))
        row, word = np.nonzero(found)
        bits = np.unpackbits(found[row, word].reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        out_q.append(np.asarray(members)[row[hit]])
        out_i.append(word[hit] * 64 + bit)
    return np.concatenate(out_q), np.concatenate(out_i)


def _bundle(rows: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
    """rows(shard, half, size, query, indexed, word, n) of whole shards -> word, n_near, best_n, best."""
    asks, held = [r for r in rows if r[3]], [r for r in rows if r[4]]
    if not asks or not held:
        return
    spelled = {r[5]: np.frombuffer(r[5].encode("utf-32-le"), np.uint32) for r in rows}
    q, i = near_sets([spelled[r[5]] for r in asks], [spelled[r[5]] for r in held])
    best: dict[str, tuple[int, int, str]] = {}
    for a, b in zip(q.tolist(), i.tolist()):
        (*shard, _, _, word, _), (*other, _, _, near, n) = asks[a], held[b]
        _, half, size = shard
        if shard != other or min(len(word), len(near)) != size:
            continue  # of another shard, or both the longer word: met where their own length is the size
        if (word[: size // 2] == near[: size // 2]) != (half == 0):
            continue  # met by the head
        count, top, least = best.get(word, (0, 0, ""))
        best[word] = (count + 1, *((n, near) if n > top or (n == top and near < least) else (top, least)))
    yield from ((word, *told) for word, told in best.items())


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """words(word, n) -> word, n_near, best_n, best, for words that have a near word."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            found = list(_bundle(rows))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(schema)], schema=schema)

        held, open_, letters = [], [], 0  # rows of whole shards, rows of the shard being read
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("shard", "half", "size", "query", "indexed", "word", "n"))):
                if open_ and open_[-1][0] != row[0]:
                    if len(held) + len(open_) >= block_words or letters >= block_letters:
                        yield table(held + open_)
                        held, letters = [], 0
                    else:
                        held += open_
                    open_ = []
                open_.append(row)
                letters += len(row[5])
        yield table(held + open_)

    tasks = max(partitions(words.sparkSession), -(-words.count() // TASK_WORDS))
    dealt = shards(words, block_words, block_letters).repartition(tasks, "shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(run, NEAR)
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    sums = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("_b"))
    return sums.select("word", "n_near", (-F.col("_b.n")).alias("best_n"), F.col("_b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) without cycles, form not null -> word, root: the end of each chain."""
    now, path = write_out(forms.select("word", F.col("form").alias("root")))
    while True:
        ends = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new, fresh = write_out(now.join(ends, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        delete(forms.sparkSession, path)
        now, path = new.select("word", "root"), fresh
        if not new.filter("_moved").limit(1).count():
            return now


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """docs(doc_id, text) -> word, form, root, n, n_near, form_n."""
    words, _ = write_out(vocabulary(docs, min_length, min_count))
    led = F.col("best_n") >= ratio * F.col("n")
    known, _ = write_out(words.join(near_words(words), "word", "left").select(
        "word", F.when(led, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("best_n")).alias("form_n")))
    ends = roots(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the whole documents with their forms."""
    return variants(read(spark, sf_dir, "documents"))
