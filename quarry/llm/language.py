"""Language identification: a bidirectional gated recurrent network over bytes.

A text is read as segments: its words, lower-cased in A-Z, each at most SEGMENT bytes (longer words go on in
further segments). Two gated recurrent layers run over the bytes of a segment, forwards and backwards, and a
softmax labels every byte position; a document's probability of a language pools the log probabilities of all its
positions. The network is trained in numpy by backpropagation through time on a bounded sample of
labelled rows (TRAIN_ROWS different texts of each language, those of least hash, each up to TRAIN_CHARS characters); prediction covers
whole texts, and labels a segment that repeats within a batch of rows once.

lang_pred is `und` with score 0 for null texts and texts without a letter, and for all texts if no row can be
learned from. Ties go to the language that sorts first. Rows with null lang are not learned from; a null doc_id
counts as not held out. Repeated rows are predicted alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read

SEGMENT, HIDDEN, EMBED = 16, 12, 8
TRAIN_ROWS, TRAIN_CHARS, STEPS, BATCH, RATE = 400, 4000, 500, 512, 0.02
CACHE, PART = 400_000, 4096
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters and both passes. Directions share nothing; padding bytes (0) are masked."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.languages = languages
        self.w = {"embed": 0.5 * rng.standard_normal((256, EMBED)).astype(np.float32), "out": draw(2 * HIDDEN, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": draw(EMBED, 3 * HIDDEN), f"h{d}": draw(HIDDEN, 2 * HIDDEN), f"c{d}": draw(HIDDEN, HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, d: str, x: np.ndarray, keep: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States of one direction; x: (steps, rows) bytes."""
        w, h = self.w, np.zeros((x.shape[1], HIDDEN), np.float32)
        inputs = w["embed"] @ w[f"x{d}"] + w[f"b{d}"]
        states, trail = np.empty((*x.shape, HIDDEN), np.float32), []
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a = inputs[x[t]]
            gates = _sigmoid(a[:, : 2 * HIDDEN] + h @ w[f"h{d}"])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + (r * h) @ w[f"c{d}"])
            new = np.where(keep[t][:, None], h + z * (c - h), h)
            trail.append((t, h, z, r, c))
            h = states[t] = new
        return states, trail

    def _states(self, d: str, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """The states of _run alone, for prediction: the same recurrence in place, the gates' halving in the weights."""
        w, gates, h = self.w, 2 * HIDDEN, np.zeros((x.shape[1], HIDDEN), np.float32)
        inputs = w["embed"] @ w[f"x{d}"] + w[f"b{d}"]
        inputs[:, :gates] *= 0.5
        half = 0.5 * w[f"h{d}"]
        states = np.empty((*x.shape, HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a = inputs[x[t]]
            g = h @ half
            g += a[:, :gates]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            c = (g[:, HIDDEN:] * h) @ w[f"c{d}"]
            c += a[:, gates:]
            np.tanh(c, out=c)
            c -= h
            c *= g[:, :HIDDEN]
            if not keep[t].all():
                c *= keep[t][:, None]
            h = np.add(h, c, out=states[t])
        return states

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, rows, languages) for bytes of shape (steps, rows)."""
        keep = x > 0
        s = self._states("f", x, keep) @ self.w["out"][:HIDDEN]
        s += self._states("b", x, keep) @ self.w["out"][HIDDEN:]
        s += self.w["bias"]
        s -= s.max(axis=2, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=2, keepdims=True))
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions and its gradients, by backpropagation through time."""
        w, keep = self.w, x > 0
        runs = {d: self._run(d, x, keep) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        s = both @ w["out"] + w["bias"]
        s -= s.max(axis=2, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=2, keepdims=True)
        n = keep.sum()
        rows = np.arange(x.shape[1])
        loss = -float((np.log(p[:, rows, y] + 1e-9) * keep).sum() / n)
        p[:, rows, y] -= 1
        p *= keep[:, :, None] / n
        g = {"out": np.tensordot(both, p, ((0, 1), (0, 1))), "bias": p.sum((0, 1)), "embed": np.zeros_like(w["embed"])}
        back = p @ w["out"].T
        for k, d in enumerate("fb"):
            g |= {f"{v}{d}": np.zeros_like(w[f"{v}{d}"]) for v in "xhcb"}
            carried = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, c in reversed(runs[d][1]):
                m = keep[t][:, None]
                dh = carried + back[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dn = dh * m
                dc = dn * z * (1 - c * c)
                dz = dn * (c - h) * z * (1 - z)
                drh = dc @ w[f"c{d}"].T
                dr = drh * h * r * (1 - r)
                dg = np.concatenate([dz, dr], axis=1)
                da = np.concatenate([dg, dc], axis=1)
                carried = dh * ~m + dn * (1 - z) + drh * r + dg @ w[f"h{d}"].T
                g[f"c{d}"] += (r * h).T @ dc
                g[f"h{d}"] += h.T @ dg
                g[f"b{d}"] += da.sum(0)
                e = w["embed"][x[t]]
                g[f"x{d}"] += e.T @ da
                np.add.at(g["embed"], x[t], da @ w[f"x{d}"].T)
        return loss, g


def segments(text: str) -> list[bytes]:
    words = text.encode("utf-8", "replace").lower().split()
    if not words or max(map(len, words)) <= SEGMENT:
        return words
    out = []
    for w in words:
        out.append(w[:SEGMENT])
        if len(w) > SEGMENT:
            out += [w[k : k + SEGMENT] for k in range(SEGMENT, len(w), SEGMENT)]
    return out


def _grid(words: list[bytes]) -> np.ndarray:
    """(steps, rows) of bytes, padded with 0 (a zero byte in a text reads as 1)."""
    joined = b"".join(w.replace(b"\0", b"\1").ljust(SEGMENT, b"\0") for w in words)
    return np.frombuffer(joined, np.uint8).reshape(-1, SEGMENT).T


def train(texts: list[str], langs: list[str], seed: int = 1) -> Network:
    """Adam on batches of distinct segments, drawn by how often each language uses them."""
    names = sorted(set(langs))
    net, rng = Network(names, seed), np.random.default_rng(seed)
    pools = []
    for name in names:
        counts = Counter(s for t, lang in zip(texts, langs) if lang == name for s in segments(t[:TRAIN_CHARS]))
        found = sorted(counts)
        total = np.cumsum([counts[s] for s in found], dtype=np.float64) if found else np.zeros(0)
        if found:
            pools.append((names.index(name), _grid(found), total / total[-1]))
    if not pools:
        return net
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, STEPS + 1):
        xs, ys = [], []
        for label, grid, total in pools:
            pick = np.searchsorted(total, rng.random(max(8, BATCH // len(pools))))
            xs.append(grid[:, np.minimum(pick, len(total) - 1)])
            ys.append(np.full(len(pick), label))
        _, g = net.gradients(np.concatenate(xs, axis=1), np.concatenate(ys))
        rate = RATE * (1 - step / (STEPS + 1))
        for k, v in g.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Labeller:
    """Pools position labels of documents; remembers the sums of a bounded number of segments."""

    def __init__(self, net: Network):
        self.net, self.place, self.sums = net, {}, np.zeros((0, len(net.languages)))

    def _learn(self, words: list[bytes]) -> None:
        if len(self.place) + len(words) > CACHE:
            self.place, self.sums = {}, self.sums[:0]
        added = [self.sums]
        words = sorted(words, key=len)  # like lengths together: no steps are run over padding
        for k in range(0, len(words), PART):
            part = words[k : k + PART]
            x = _grid(part)[: len(part[-1])]
            added.append((self.net.log_probabilities(x) * (x > 0)[:, :, None]).sum(axis=0, dtype=np.float64))
        self.place |= {w: i for i, w in enumerate(words, len(self.place))}
        self.sums = np.concatenate(added)

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        if not self.net.languages:
            return [("und", 0.0)] * len(texts)
        for k in range(0, len(texts), 256):
            part = texts[k : k + 256]
            words = [segments(t) if t and LETTER.search(t) else [] for t in part]
            every = set().union(*words)
            missing = every.difference(self.place)
            if len(self.place) + len(missing) > CACHE:
                self.place, self.sums = {}, self.sums[:0]
                missing = every
            self._learn(sorted(missing))
            for w in words:
                if not w:
                    out.append(("und", 0.0))
                    continue
                s = self.sums[[self.place[x] for x in w]].sum(axis=0) / max(1, sum(map(len, w)) ** 0.5)
                p = np.exp(s - s.max())
                best = int(np.argmax(p))
                out.append((self.net.languages[best], float(p[best] / p.sum())))
        return out


def fit(rows: DataFrame, per_language: int = TRAIN_ROWS) -> Network:
    """rows(text, lang): a network from at most per_language rows of each language."""
    known = rows.filter("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("_h"), F.substring("text", 1, TRAIN_CHARS).alias("text"))
    # hashes below a bound that leaves about three times the wished texts, so that few rows meet for the ranking; copies
    # have one hash, so the bound is of the number of different texts
    different = known.select("lang", "_h").distinct()
    sizes = different.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))  # a row per language
    place = F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53))
    few = known.join(F.broadcast(sizes), "lang").filter(place * F.col("_n") <= 3 * per_language).groupBy("lang", "_h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    sample = few.withColumn("_r", rank).filter(F.col("_r") <= per_language).select("lang", "text").collect()
    sample.sort()
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def predict(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs plus lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net)
        for b in batches:
            found = labeller.label(b.column(b.schema.get_field_index("_text")).to_pylist())
            kept = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*[n for n in b.schema.names if n != "_text"], "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score", text)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields], "lang_pred string", "score double"])
    return docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(text).alias("_text")).mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text", "lang")
    net = fit(docs.filter("not held_out").select("text", "lang"))
    return predict(docs.drop("lang"), net)
