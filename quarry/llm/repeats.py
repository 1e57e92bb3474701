"""Removal of byte strings that an earlier document holds, by difference-cover suffix sorting in shards.

A byte goes if a string of `WINDOW` bytes that covers it also starts in a document with a smaller doc_id. One suffix
array over all text would move every byte many times over, so the suffixes are first dealt out by content:

1. In each window of 50 bytes the 20-byte string of least hash is its anchor, so equal windows have equal
   anchors. Windows in a row with one anchor form a segment. Segments go, as hashes with the least and largest
   doc_id of their batch, to the shard of their anchor. A segment that a smaller doc_id holds in full is covered.
2. An anchor that stands in one segment only is settled. For the others each different segment's bytes go once, from
   the smallest doc_id that holds it, to the anchor's shard; there the difference-cover algorithm sorts the suffixes
   of all segments of the shard, neighbours in that order are compared over 50 bytes, and each class of equal
   windows learns its smallest doc_id. Anchors with more than HOT different segments would crowd one shard:
   their windows are dealt out one by one, by a hash of the window.
3. Answers return to the group of documents that asked, and documents are cut.

Batches keep one row for each segment, however often it repeats, so copies and common passages don't pile up. Hashes
are 80 bits where segments of all documents meet and 64 bits inside a group of documents.

Null texts are empty. Documents shorter than a window stay whole. Rows of the same doc_id don't cover one another;
a null doc_id counts as larger than all others. Long texts are scanned in slices. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, partitions, read
from quarry.llm.suffixes import suffix_order

WINDOW, ANCHOR, SLICE, HOT, PARTS = 50, 20, 1 << 17, 256, 16
LAST = np.iinfo(np.int64).max
_U = np.uint64
LOW = _U((1 << 40) - 1)
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15


def _powers(n: int, step: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, step, _U)]), dtype=_U)


class Hashes:
    """Hashes of all substrings of one buffer, from prefix sums."""

    up, down = _powers(0, 1), _powers(0, 1)

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        if len(Hashes.up) <= n:
            Hashes.up, Hashes.down = _powers(2 * n, _STEP), _powers(2 * n, pow(_STEP, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[buffer] * Hashes.up[:n], dtype=_U)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._mixed((self.sums[end] - self.sums[start]) * Hashes.down[start])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of one width, in order."""
        x = self.sums[width:] - self.sums[:-width]
        x *= Hashes.down[: len(x)]
        return self._mixed(x)

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(32)
        return x


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value of each window of `width` values; values count without their last bits."""
    bits = _U(len(h).bit_length())
    value, span = (h >> bits << bits) | np.arange(len(h), dtype=_U), 1
    while span < width:
        step = min(span, width - span)
        value = np.minimum(value[: len(value) - step], value[step:])
        span += step
    return (value & ((_U(1) << bits) - _U(1))).view(np.int64)


class Scan:
    """Segments of the texts of one slice: doc (index), start and end (in the text), anchor, name; windows by name."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        """pieces: (document's index, offset of the piece in its text, bytes)."""
        self.buffer = np.frombuffer(b"".join(x for _, _, x in pieces), np.uint8)
        sizes = np.array([len(x) for _, _, x in pieces])
        ends = np.cumsum(sizes)
        n = len(self.buffer)
        self.hashes = Hashes(self.buffer)
        empty = np.zeros(0, np.int64)
        self.doc = self.start = self.end = self.at = empty
        self.anchor = self.name = self.own = np.zeros(0, _U)
        if n < WINDOW:
            return
        anchors = self.hashes.every(ANCHOR)
        place = _least(anchors, WINDOW - ANCHOR + 1)
        # runs of one anchor, cut where pieces begin and before the windows that pass a piece's end
        edges = np.union1d(np.flatnonzero(place[1:] != place[:-1]) + 1, np.append(0, (ends - sizes)[ends - sizes < len(place)]))
        own = np.searchsorted(ends, edges, side="right")
        last = np.minimum(np.append(edges[1:], len(place)) - 1, ends[own] - WINDOW)
        whole = last >= edges
        start, last, own = edges[whole], last[whole], own[whole]
        if not len(start):
            return
        self.at, self.to = start, last + WINDOW
        self.anchor = anchors[place[start]]
        # as much of a segment as questions carry: 40 bits of its anchor's hash and 40 of its own
        self.anchor &= LOW
        self.own = self.hashes.of(start, self.to) & LOW
        self.name = (self.anchor << _U(24)) ^ self.own
        shift = np.array([offset for _, offset, _ in pieces]) - (ends - sizes)
        self.doc = np.array([d for d, _, _ in pieces])[own]
        self.start, self.end = start + shift[own], self.to + shift[own]

    def windows(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of k, hash) of each window of the segments k."""
        counts = self.to[k] - self.at[k] - WINDOW + 1
        row = np.repeat(np.arange(len(k)), counts)
        at = self.at[k][row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        return row, self.hashes.of(at, at + WINDOW)


def slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces of about SLICE bytes; longer texts are split so that each window lies in one piece."""
    group, size = [], 0
    for d, t in enumerate(texts):
        for k in range(0, max(1, len(t) - WINDOW + 1), SLICE):
            piece = t[k : k + SLICE + WINDOW - 1]
            if group and size + len(piece) > SLICE:
                yield group
                group, size = [], 0
            group.append((d, k, piece))
            size += len(piece)
    if group:
        yield group


def _pack(x: np.ndarray) -> bytes:
    """Numbers of 0 or more as 4 bytes each if they fit, else 8."""
    return x.astype("<u4").tobytes() if not len(x) or x.max() < 1 << 32 else x.astype("<i8").tobytes()


def _unpack(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, "<u4" if len(b) == 4 * n else "<i8").astype(np.int64)


def _wide(b: bytes, n: int) -> np.ndarray:
    """Numbers of 5 bytes each."""
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(n, 5)
    return out.view(_U).ravel()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First places of runs of equal keys in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


ASK = "key long, base long, n long, groups binary, counts binary, anchors binary, names binary, least binary, spread binary"
TELL = "grp long, kind int, doc_id long, body binary, names binary, mins binary, flags binary"
CUT = "kind int, grp long, key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, body binary, names binary, mins binary, sizes binary, part long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SETTLED, WAITING, SEGMENTS, WINDOWS = 0, 1, 2, 3  # kinds of rows of CUT
CONTESTED, OWNER, CROWDED = 1, 2, 4  # flags of TELL


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([LAST if x is None else x for x in column.to_pylist()], dtype=np.int64)


def _ask(keys: list[int]):
    schema, shards = _schema(ASK), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, grp, text) -> the segments that each group of documents asks each shard about."""
        for b in (b.slice(k, 4000) for b in batches for k in range(0, b.num_rows, 4000)):
            ids, grp = _ids(b.column(0)), b.column(1).to_numpy()
            found = [(s.doc, s.anchor, s.own) for s in map(Scan, slices([x.as_py() or b"" for x in b.column(2).cast(pa.binary())]))]
            if not found:
                continue
            doc, anchor, name = (np.concatenate(x) for x in zip(*found))
            shard = ((anchor >> _U(8)) % _U(shards)).astype(np.int64)
            groups, g = np.unique(grp, return_inverse=True)
            cell = shard * len(groups) + g[doc]
            # equal segments of a cell side by side: a few that share the key's bits and stand apart are told twice, no more
            bits = _U(64 - (shards * len(groups)).bit_length())
            order = np.argsort((cell.astype(_U) << bits) | (((anchor << _U(24)) ^ name) * _U(_STEP) >> (_U(64) - bits)))
            cell, name, anchor, doc = cell[order], name[order], anchor[order], ids[doc[order]]
            first = _runs(cell, anchor, name)
            if not len(first):
                continue
            least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
            cell, name = cell[first], name[first]
            short = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5] for x in (anchor[first], name)]
            home = cell // len(groups)
            rows, cuts = [], np.append(_runs(home), len(cell))
            for a, z in zip(cuts[:-1], cuts[1:]):
                base, each = int(least[a:z].min()), _runs(cell[a:z])
                asking = groups[cell[a:z][each] % len(groups)].astype("<i8").tobytes()
                counts = np.diff(np.append(each, z - a)).astype("<i4").tobytes()
                rows.append((keys[home[a]], base, int(z - a), asking, counts, short[0][a:z].tobytes(), short[1][a:z].tobytes(), _pack(least[a:z] - base), _pack(most[a:z] - least[a:z])))
            for k in range(0, len(rows), 5000):
                yield _table(schema, rows[k : k + 5000])

    return run


def _judge():
    schema = _schema(TELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The questions to some shards -> for each group the names it must know of, their least doc_id, and flags."""
        parts = []
        for b in batches:
            for _, base, n, groups, counts, anchors, names, least, spread in zip(*[c.to_pylist() for c in b.columns]):
                low = _unpack(least, n) + base
                asking = np.repeat(np.frombuffer(groups, "<i8"), np.frombuffer(counts, "<i4"))
                parts.append((_wide(anchors, n), _wide(names, n), low, low + _unpack(spread, n), asking))
        if not parts:
            return
        anchor, name, low, high, grp = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((low, name, anchor))
        anchor, name, low, high, grp = anchor[order], name[order], low[order], high[order], grp[order]
        first = _runs(anchor, name)
        sizes = np.diff(np.append(first, len(name)))
        least = low[first]
        by_anchor = _runs(anchor[first])
        kinds = np.diff(np.append(by_anchor, len(first)))
        kinds = np.repeat(np.repeat(kinds, kinds), sizes)
        smallest = np.repeat(least, sizes)
        name = (anchor << _U(24)) ^ name
        own = np.zeros(len(name), bool)
        own[first] = True
        contested = kinds > 1
        flags = contested * CONTESTED + (own & contested) * OWNER + (kinds > HOT) * CROWDED
        told = np.flatnonzero((smallest < high) | (own & contested))
        told = told[np.lexsort((name[told], grp[told]))]
        cuts = np.append(_runs(grp[told]), len(told))
        rows = [(int(grp[told[a]]), 0, None, None, name[told[a:z]].tobytes(), smallest[told[a:z]].tobytes(), flags[told[a:z]].astype(np.uint8).tobytes()) for a, z in zip(cuts[:-1], cuts[1:])]
        if rows:
            yield _table(schema, rows)

    return run


class Answers:
    """What a group of documents has been told: least doc_id and flags by name."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes | None]]):
        self.name = np.frombuffer(b"".join(x for x, _, _ in rows), _U)
        self.least = np.frombuffer(b"".join(x for _, x, _ in rows), np.int64)
        self.flags = np.frombuffer(b"".join(x or b"" for _, _, x in rows), np.uint8)
        order = np.argsort(self.name, kind="stable")
        self.name, self.least = self.name[order], self.least[order]
        self.flags = self.flags[order] if len(self.flags) else np.zeros(len(order), np.uint8)
        first = _runs(self.name)
        if len(first):
            self.least, self.flags = np.minimum.reduceat(self.least, first), np.bitwise_or.reduceat(self.flags, first)
        self.name = self.name[first]

    def of(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least doc_id, or LAST; flags, or 0)."""
        if not len(self.name):
            return np.full(len(names), LAST), np.zeros(len(names), np.uint8)
        k = np.minimum(np.searchsorted(self.name, names), len(self.name) - 1)
        hit = self.name[k] == names
        return np.where(hit, self.least[k], LAST), np.where(hit, self.flags[k], 0)


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and kept_sha256 of a text without the given ranges."""
    if not len(starts):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Answers, list[int | None], list[bytes], list[tuple]]]:
    """Answers of the groups of one task, which come first, then batches of documents (doc_id, group, body, rest)."""
    rows, answers = [], None
    for b in batches:
        grp, kind, ids, body, names, mins, flags = (b.column(i) for i in range(7))
        told = kind.to_numpy() == 0
        docs = []
        for i in range(len(told)):
            if told[i]:
                rows.append((names[i].as_py(), mins[i].as_py(), flags[i].as_py()))
            else:
                docs.append((ids[i].as_py(), grp[i].as_py(), body[i].as_py() or b"", names[i].as_py(), mins[i].as_py()))
        if docs:
            answers = answers or Answers(rows)
            yield answers, docs


def _settle(keys: list[int]):
    schema, shards = _schema(CUT), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers and documents -> settled documents, documents that wait, and the segments whose windows must be compared."""
        sent: set[int] = set()
        expand = zstandard.ZstdDecompressor()
        for answers, docs in _grouped(batches):
            ids = np.array([LAST if d[0] is None else d[0] for d in docs], dtype=np.int64)
            grp = np.array([d[1] for d in docs], dtype=np.int64)
            texts = [expand.decompress(d[2]) for d in docs]
            covered: list[tuple] = []
            waiting: list[tuple] = []
            asked: list[tuple] = []
            for s in map(Scan, slices(texts)):
                least, flags = answers.of(s.name)
                full = least < ids[s.doc]
                covered.append((s.doc[full], s.start[full], s.end[full]))
                open_ = np.flatnonzero(~full & ((flags & CONTESTED) > 0))
                waiting.append((s.doc[open_], s.start[open_], s.end[open_]))
                fresh = [k for k in open_[(flags[open_] & OWNER) > 0].tolist() if int(s.name[k]) not in sent]
                _, once = np.unique(s.name[fresh], return_index=True)
                fresh = np.array(fresh, dtype=np.int64)[once]
                sent.update(s.name[fresh].tolist())
                crowd = (flags[fresh] & CROWDED) > 0
                few, many = fresh[~crowd], fresh[crowd]
                shard = ((s.anchor[few] >> _U(8)) % _U(shards * PARTS)).astype(np.int64)
                for k in range(len(few)):
                    i = few[k]
                    asked.append((SEGMENTS, int(shard[k]), int(grp[s.doc[i]]), int(ids[s.doc[i]]), s.buffer[s.at[i] : s.to[i]].tobytes()))
                row, names = s.windows(many)
                home = ((names >> _U(40)) % _U(shards)).astype(np.int64)
                owner = s.doc[many][row]
                order = np.lexsort((grp[owner], home))
                row, names, home, owner = row[order], names[order], home[order], owner[order]
                cuts = np.append(_runs(home, grp[owner]), len(home))
                for a, z in zip(cuts[:-1], cuts[1:]):
                    if z > a:
                        asked.append((WINDOWS, int(home[a]), int(grp[owner[a]]), names[a:z].tobytes(), ids[owner[a:z]].tobytes()))
            out = []
            cover, wait = (tuple(np.concatenate(x) for x in zip(*rows)) for rows in (covered, waiting))
            cover, wait = (tuple(x[np.argsort(rows[0], kind="stable")] for x in rows) for rows in (cover, wait))
            edges = [np.searchsorted(rows[0], np.arange(len(docs) + 1)) for rows in (cover, wait)]
            for d, text in enumerate(texts):
                a, z = edges[0][d], edges[0][d + 1]
                b, y = edges[1][d], edges[1][d + 1]
                if b == y:
                    out.append((SETTLED, None, None, docs[d][0], *cut(text, cover[1][a:z], cover[2][a:z]), None, None, None, None, None))
                else:
                    known = np.concatenate([cover[1][a:z], cover[2][a:z]]).astype("<i8").tobytes()
                    ask = np.concatenate([wait[1][b:y], wait[2][b:y]]).astype("<i8").tobytes()
                    out.append((WAITING, int(grp[d]), None, docs[d][0], len(text), None, None, None, docs[d][2], known, ask, None, None))
            joined: dict[tuple[int, int], list[tuple]] = {}
            for row in asked:
                if row[0] == SEGMENTS:
                    joined.setdefault(row[1:3], []).append(row[3:])
                else:
                    out.append((WINDOWS, row[2], keys[row[1]], None, None, None, None, None, None, row[3], row[4], None, None))
            for (shard, g), rows in joined.items():
                sizes = np.array([len(x) for _, x in rows], dtype="<i4").tobytes()
                out.append((SEGMENTS, g, keys[shard % shards], None, None, None, None, None, b"".join(x for _, x in rows), None, np.array([d for d, _ in rows], dtype="<i8").tobytes(), sizes, shard))
            for k in range(0, len(out), 2000):
                yield _table(schema, out[k : k + 2000])

    return run


def equal_windows(body: bytes, sizes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the segments in body that a smaller doc_id's segment also holds: segment, place in body, smallest doc_id."""
    buffer = np.frombuffer(body, np.uint8)
    ends = np.cumsum(sizes)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.arange(len(buffer)) + WINDOW <= ends[segment]
    order = suffix_order(buffer.astype(np.int64) + 1, WINDOW)
    order = order[valid[order]]
    same = np.ones(max(0, len(order) - 1), bool)
    wide = np.lib.stride_tricks.sliding_window_view(np.append(buffer, np.zeros(7, np.uint8)), 8)
    eight = np.ascontiguousarray(wide).view(_U).ravel()
    for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        part = eight[order + k]
        same &= part[1:] == part[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    if not len(first):
        return first, first, first
    docs = least[segment[order]]
    smallest = np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(order))))
    hit = smallest < docs
    return segment[order[hit]], order[hit], smallest[hit]


def _compare():
    schema = _schema(TELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments and single windows of some shards -> for each group the windows that a smaller doc_id holds."""
        parts: dict[int, list[tuple]] = {}
        singles = []
        for b in batches:
            for g, body, names, mins, size, part in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if size is not None:
                    parts.setdefault(part, []).append((body, np.frombuffer(size, "<i4").astype(np.int64), np.frombuffer(mins, "<i8"), g))
                else:
                    singles.append((np.frombuffer(names, _U), np.frombuffer(mins, "<i8"), np.full(len(mins) // 8, g)))
        found = []
        for part in sorted(parts):  # a part holds all segments of its anchors
            bodies, sizes, least, groups = zip(*parts.pop(part))
            of = np.repeat(groups, [len(x) for x in sizes])
            body = b"".join(bodies)
            segment, at, smallest = equal_windows(body, np.concatenate(sizes), np.concatenate(least))
            found.append((Hashes(np.frombuffer(body, np.uint8)).of(at, at + WINDOW), smallest, of[segment]))
        if singles:
            name, low, g = (np.concatenate(x) for x in zip(*singles))
            order = np.argsort(name, kind="stable")
            name, low, g = name[order], low[order], g[order]
            first = _runs(name)
            smallest = np.repeat(np.minimum.reduceat(low, first), np.diff(np.append(first, len(name))))
            hit = smallest < low
            found.append((name[hit], smallest[hit], g[hit]))
        if not found:
            return
        name, smallest, g = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(g, kind="stable")
        name, smallest, g = name[order], smallest[order], g[order]
        cuts = np.append(_runs(g), len(g))
        rows = [(int(g[a]), 0, None, None, name[a:z].tobytes(), smallest[a:z].tobytes(), None) for a, z in zip(cuts[:-1], cuts[1:]) if z > a]
        if rows:
            yield _table(schema, rows)

    return run


def _finish():
    schema = _schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers about windows and the documents that wait for them -> results."""
        expand = zstandard.ZstdDecompressor()
        for answers, docs in _grouped(batches):
            out = []
            for doc_id, _, body, known, ask in docs:
                text = expand.decompress(body)
                starts, ends = np.frombuffer(known, "<i8").reshape(2, -1)
                a, z = np.frombuffer(ask, "<i8").reshape(2, -1)
                counts = z - a - WINDOW + 1
                at = np.repeat(a, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                lo = int(a.min())
                least, _ = answers.of(Hashes(np.frombuffer(text, np.uint8)[lo : int(z.max())]).of(at - lo, at - lo + WINDOW))
                at = at[least < (LAST if doc_id is None else doc_id)]
                out.append((doc_id, *cut(text, np.concatenate([starts, at]), np.concatenate([ends, at + WINDOW]))))
            yield _table(schema, out)

    return run


def _keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers, one that Spark's hash puts into each of n partitions, so that shards fill tasks evenly."""
    tried = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    found = {r["p"]: r["id"] for r in tried.collect()}  # n rows
    return [found.get(p, 64 * n + p) for p in range(n)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id long, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    n = partitions(spark)
    keys = _keys(spark, n)
    group = F.get(F.lit(keys), F.pmod(F.hash("doc_id"), F.lit(n)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.cast("long").alias("grp"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    told = materialize(rows.mapInArrow(_ask(keys), ASK).repartition(n, "key").mapInArrow(_judge(), TELL))
    none = F.lit(None).cast("binary")

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield b.set_column(2, "body", pa.array([by.compress(x.as_py()) for x in b.column(2)], pa.binary()))

    def with_answers(answers: DataFrame, docs: DataFrame, run, schema: str) -> DataFrame:
        both = answers.unionByName(docs.select("grp", F.lit(1).alias("kind"), "doc_id", "body", "names", "mins", none.alias("flags")))
        return both.repartition(n, "grp").sortWithinPartitions("kind").mapInArrow(run, schema)

    first = materialize(with_answers(told, rows.mapInArrow(press, "doc_id long, grp long, body binary").select("*", none.alias("names"), none.alias("mins")), _settle(keys), CUT))
    open_ = first.filter(F.col("kind").isin(SEGMENTS, WINDOWS)).select("grp", "body", "names", "mins", "sizes", "part", "key")
    told = open_.repartition(n, "key").mapInArrow(_compare(), TELL)
    rest = with_answers(told, first.filter(F.col("kind") == WAITING), _finish(), RESULT)
    return first.filter(F.col("kind") == SETTLED).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(rest)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
