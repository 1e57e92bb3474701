"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import spelling
from quarry.llm.common import read

DOCS = "doc_id long, text string"


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def counted(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain(counts):
    near, forms, out = {w: [] for w in counts}, {}, []
    signs = {}
    for w in counts:  # two near words share one of the strings with a letter left out
        for s in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            signs.setdefault(s, []).append(w)
    for group in signs.values():
        for a in group:
            near[a] += [b for b in group if b not in near[a] and one_apart(a, b)]
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * counts[w] else None
    for w, form in forms.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, form, root, counts[w], len(near[w]), counts[form] if form else None))
    return sorted(out)


def run(spark, docs, **kw):
    return sorted(map(tuple, spelling.variants(spark.createDataFrame(docs, DOCS), **kw).collect()))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_on_the_table(spark, scale):
    docs = [tuple(r) for r in read(spark, f"/root/testdata/{scale}", "documents").select("doc_id", "text").collect()]
    ours = sorted(map(tuple, spelling.op13_spelling_variants(spark, f"/root/testdata/{scale}").collect()))
    assert ours == plain(counted(docs))
    assert any(form for _, form, *_ in ours)


def test_bit_sets_against_all_pairs():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(500)})
    letters = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    q, i = spelling.near_sets(letters[::2], letters)
    assert sorted(zip((2 * q).tolist(), i.tolist())) == [(a, b) for a in range(0, len(words), 2) for b in range(len(words)) if one_apart(words[a], words[b])]


@pytest.mark.parametrize("block_words, block_letters", [(3, 1 << 16), (50, 40), (2048, 1 << 16)])
def test_blocks_of_large_shards(spark, block_words, block_letters):
    rng = random.Random(2)
    counts = {"prefix" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))): rng.randint(1, 40) for _ in range(200)}
    counts |= {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) + "suffix": rng.randint(1, 40) for _ in range(200)}
    counts |= {"a": 3, "b": 9, "é" * 3000: 4, "é" * 2999 + "e": 9, "é" * 3001: 20}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    ours = sorted(map(tuple, spelling.near_words(df, block_words, block_letters).collect()))
    hand = []
    for w in counts:
        others = [v for v in counts if one_apart(w, v)]
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            hand.append((w, len(others), counts[best], best))
    assert ours == sorted(hand)


def test_chains_ties_nulls_and_repeats(spark):
    text = " ".join(["Étage"] * 3 + ["étage"] * 3 + ["étages"] * 6 + ["étagesx"] * 12 + ["étagesxy"] * 30 + ["stage"] * 6 + ["ÉTAGE"] * 3 + ["abc"] * 9 + ["rare1rare", "a×b÷c"])
    docs = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "12 ,;\n"), (5, "z" * 500_000)]
    assert run(spark, docs) == plain(counted(docs))
    assert run(spark, []) == []
    wide = spark.createDataFrame([(1, text, "w", 7, "r")], f"{DOCS}, word string, n long, root string")
    assert sorted(map(tuple, spelling.variants(wide).collect())) == plain(counted([(1, text)]))


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w37"}
