"""Suffix order by the difference-cover algorithm, in numpy, for the text of one task."""

from __future__ import annotations

import numpy as np


def suffix_order(t: np.ndarray, need: int, stride: int = 1, cover: int = 1) -> np.ndarray:
    """Positions of t (names of 1 or more) in the order of their suffixes; suffixes that agree in the first `need`
    bytes may stand in any order among themselves. Names stand for `cover` bytes each, `stride` bytes apart.

    Triples, or longer tuples where a number holds them, at positions 1 and 2 modulo 3 are sorted and named; as names
    may overlap, a tuple takes names as far apart as they cover. The names are ordered by recursion until they are
    unique or cover `need` bytes; the positions 0 modulo 3 follow from the order of their successors, and the two
    orders are merged."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), dtype=np.int64)
    bits, step = int(t.max()).bit_length(), max(1, cover // stride)
    width = max(3, 63 // bits)
    p = np.concatenate([t.astype(np.int64), np.zeros(width * step + 3, np.int64)])
    ones = len(range(1, n + (n % 3 == 1), 3))  # with a spare position if the last tuple has one name
    twos = len(range(2, n, 3))

    def at(k: int) -> np.ndarray:
        """The names k places after the sampled positions."""
        return np.concatenate([p[1 + k :: 3][:ones], p[2 + k :: 3][:twos]])

    names, order = _names([at(k * step) for k in range(width)], bits)
    covered = (width - 1) * step * stride + cover
    if names[order[-1]] < len(order) and covered < need:
        order = suffix_order(names, need, 3 * stride, covered)
    first = order < ones
    order = np.where(first, 3 * order + 1, 3 * (order - ones) + 2)
    rank = np.zeros(n + 4, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    if n % 3 == 1:
        real = order < n
        order, first = order[real], first[real]
    deep = (ones + twos).bit_length() + 1
    by_next = (p[:n:3] << deep) + rank[1 : n + 1 : 3]
    zero = np.argsort(by_next)
    one, two = order[first], order[~first]
    before = np.searchsorted((p[one] << deep) + rank[one + 1], by_next[zero])
    zero *= 3
    if 2 * bits + deep < 64:
        pairs = [(((p[x] << bits) + p[x + 1]) << deep) + rank[x + 2] for x in (two, zero)]
    else:
        mixed = np.concatenate([two, zero])
        pairs = np.split((_names([p[mixed], p[mixed + 1]], bits)[0] << deep) + rank[mixed + 2], [len(two)])
    before += np.searchsorted(*pairs)
    out = np.empty(n, np.int64)
    # names that cover `need` bytes leave ties in any order, which the two counts may see differently
    place = np.maximum.accumulate(before) + np.arange(len(zero))
    rest = np.ones(n, bool)
    rest[place] = False
    out[place], out[rest] = zero, order
    return out


def _names(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks from 1 of tuples of names of at most `bits` bits, equal for equal tuples, and the order of the tuples."""
    key, held = columns[0], bits
    for c in columns[1:]:
        if held + bits > 63:
            key = _ranks(key)[0]
            held = int(key.max()).bit_length()
        key, held = (key << bits) + c, held + bits
    return _ranks(key)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    return rank, order
