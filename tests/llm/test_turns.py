"""Conversation repair against every sequence of edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quarry.llm import turns
from quarry.llm.common import read

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Every audit no dearer than deleting all: inserts up to two in a place, each row kept, reroled either way or deleted."""
    best = (2 * len(rows), "D" * len(rows), [])
    gaps = [g for n in range(3) for g in itertools.product("ua", repeat=n)]

    def go(i, cost, audit, made):
        nonlocal best
        for gap in gaps:
            c, a, m = cost + 5 * len(gap), audit + "I" * len(gap), [*made, *((r, f"{NAMES[r]}:") for r in gap)]
            if c > best[0]:
                continue
            if i == len(rows):
                if SHAPE.fullmatch("".join(r for r, _ in m)) and (c, a) <= best[:2]:
                    best = (c, a, m)
                continue
            _, role, text = rows[i]
            go(i + 1, c + 2, a + "D", m)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                go(i + 1, c + more, a + "K", [*m, (role[:1] or "?", f"{role}:{text}")])
                for r, name in NAMES.items():
                    go(i + 1, c + 1 + more, a + "R", [*m, (r, f"{name}:{text}")])

    go(0, 0, "", [])
    return best[0], best[1], "\n".join(line for _, line in best[2])


def spelled(rows, faults):
    """The same by states with whole audits, for longer conversations."""
    live = {"": (0, "", [])}
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def better(out, state, way):
        if state not in out or way[:2] < out[state][:2]:
            out[state] = way

    def filled(at):
        out = []
        for state, (cost, audit, made) in at.items():
            out.append((state, cost, audit, made))
            for _ in range(2):
                role = "a" if state == "u" else "u"
                state, cost, audit, made = role, cost + 5, audit + "I", [*made, f"{NAMES[role]}:"]
                out.append((state, cost, audit, made))
        return out

    for (_, role, text), fault in zip(rows, faults):
        out = {}
        for state, cost, audit, made in filled(live):
            better(out, state, (cost + 2, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if role[:1] in after[state]:
                    better(out, role[:1], (cost + more, audit + "K", [*made, f"{role}:{text}"]))
                for r in set(after[state]) & set(NAMES):
                    better(out, r, (cost + 1 + more, audit + "R", [*made, f"{NAMES[r]}:{text}"]))
        live = out
    cost, audit, made = min((c, a, m) for s, c, a, m in filled(live) if s in ("", "a"))
    return cost, audit, "\n".join(made)


def whole(conv, rows, solve):
    """The contract's row for damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, known = fault_of(rows), [r[0] for r in rows if r[0] is not None]
    cost, audit, text = solve(rows, faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept, h = out.setdefault(conv, []), zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        if h:
            kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def test_every_short_conversation(spark):
    rng, rows, hand = random.Random(3), [], []
    roles, texts = ["user", "assistant", "system", "tool", "", "u"], ["a.", "b?", "c!  \n", "cut", "cut,", "", " \t", "é."]
    for conv in range(400):
        mine = [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 5))]
        rows += [(conv, *r) for r in mine]
        hand += [whole(conv, mine, cheapest)]
        assert hand[-1] == whole(conv, mine, spelled)
    ours = turns.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, ours)) == hand


@pytest.mark.parametrize("spill", [64, 1 << 20])
def test_giant_conversation_beside_small_ones(spark, spill):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "user", "assistant"]), f"{rng.randint(0, 400)}{rng.choice('.. ')}") for t in range(3000)]
    rows += [(c, 0, "user", "alone.") for c in range(20)] + [(None, None, None, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        ours = {r["conv_id"]: tuple(r) for r in turns.repair(spark.createDataFrame(rows, SCHEMA), spill_bytes=spill).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    big = [r[1:] for r in rows if r[0] == 7]
    assert ours[7] == whole(7, big, spelled)
    assert ours[None] == whole(None, [(None, " ", " ")], spelled) and len(ours) == 21


def test_query_on_the_table(spark):
    rows = read(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()
    hand = [whole(conv, mine, spelled) for conv, mine in damaged(rows).items()]
    assert sorted(map(tuple, turns.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect())) == sorted(hand)


def test_conversation_without_rows_nulls_repeats_and_extra_columns(spark):
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (None, 3, None, "y."), (None, 3, None, "y."), (500, None, "user", None), (501, 1, "user", "é" * 200_000 + "."), (501, 2, "assistant", "ok.")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{SCHEMA}, fault string, cost long")
    ours = {r["conv_id"]: tuple(r) for r in turns.repair(turns.damage(df)).collect()}
    assert ours[gone] == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert ours == {c: whole(c, mine, spelled) for c, mine in damaged(rows).items()}
    assert turns.repair(turns.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_one_shuffle(spark):
    plan = turns.op12_conversation_repair(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
