"""Conversation structure repair: the cheapest edits that make turns alternate, found in one pass over sorted rows.

Rows are dealt by conversation and sorted by turn; a task reads them as a stream and carries a conversation's state
across Arrow batches. The state is one cost for each state of the automaton of `(s?(ua)+)?` (nothing yet, after the
system turn, after a user, after an assistant), with a running SHA-256 of the repaired text and a rank beside it. What a
row can do is a fixed table of moves by its role and fault; each move is up to two inserts and then keep, rerole or
delete. The audits of two states are never each other's beginnings (each has one letter for each row read and ends in
that letter), so their ASCII order is settled where they part: ranks alone carry it, and of two moves of equal cost the
lower (rank, letters) wins. The moves taken are one byte for each state and row. They are held in memory up to
SPILL_BYTES for a conversation and beyond that in an unnamed file of the task's own, which nothing else reads and which
goes with the task; a lost task is run again from its input. They are read backwards once to give the audit. Memory of a
task is a batch, SPILL_BYTES and the audit itself, however long a conversation is.

Repeats are found before, by a window over (conversation, role and text) inside the same partitions: no second shuffle.
Order in a conversation is turn (nulls first), then role, then text, so rows of one turn have a defined order and the
copies of a row stand together. Null conversation ids are one conversation. Null role or text are one space; a role's
initial is its first character; roles other than system, user and assistant by initial, the empty one too, must be reroled or deleted.
Texts may be empty or long. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read

SPILL_BYTES, BATCH_ROWS = 4 << 20, 2000
START, SYSTEM, USER, ASSISTANT = range(4)
#: What each state accepts, and the state after it.
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {"u": b"user", "a": b"assistant"}
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)
KEEP, REROLE, DELETE, INSERT, STUMP = 0, 1, 2, 5, 5
OPS = "DKR"
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TYPES = {"long": pa.int64(), "string": pa.string()}


def _inserts(state: int) -> list[tuple[int, list[str]]]:
    """(state, roles) after no, one and two inserts."""
    out = [(state, [])]
    for _ in range(2):
        at, made = out[-1]
        role = next(r for r in STEPS[at] if r in NAMES)
        out.append((STEPS[at][role], [*made, role]))
    return out


def moves(initial: str, fault: int) -> list[tuple[int, str, int, int, list[str], str]]:
    """(from, letters, to, cost, inserted roles, role of the row: k kept, u or a reroled, d deleted), the best of each (from, to)."""
    best: dict[tuple[int, int], tuple] = {}
    stump = STUMP if fault == TRUNCATED else 0
    for start in STEPS:
        for state, made in _inserts(start):
            ways = [(state, DELETE, "D", "d")]
            if fault in (TRUNCATED, SOUND):
                if initial in STEPS[state]:
                    ways.append((STEPS[state][initial], KEEP + stump, "K", "k"))
                ways += [(to, REROLE + stump, "R", r) for r, to in STEPS[state].items() if r in NAMES]
            for to, cost, letter, role in ways:
                way = (INSERT * len(made) + cost, "I" * len(made) + letter, made, role)
                if (start, to) not in best or way[:2] < best[start, to][:2]:
                    best[start, to] = way
    return [(start, letters, to, cost, made, role) for (start, to), (cost, letters, made, role) in sorted(best.items())]


MOVES = {(i, fault): moves(i, fault) for i in ("s", "u", "a", "") for fault in (BLANK, DUPLICATE, TRUNCATED, SOUND)}
ENDS = {START: (0, []), ASSISTANT: (0, []), USER: (1, ["a"]), SYSTEM: (2, ["u", "a"])}


class Repair:
    """State of one conversation. A backpointer's byte holds the state before (2 bits), the inserts (2) and the letter (2)."""

    def __init__(self, conv_id: int | None, spill_bytes: int = SPILL_BYTES):
        self.conv_id, self.counts, self.illegal, self._rows = conv_id, [0, 0, 0, 0], 0, 0
        self._lo = self._hi = self._turn = self._before = None
        self._turns = 0
        self._live = {START: (0, 0, hashlib.sha256())}  # state: cost, rank, digest of the repaired text
        self._back = tempfile.SpooledTemporaryFile(max_size=spill_bytes)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self._lo = turn if self._lo is None else self._lo
            self._hi = turn
            self._turns += turn != self._turn
            self._turn = turn
        initial = role[:1]
        self.illegal += self._before is not None and self._before + initial not in ("su", "ua", "au")
        self._before = initial
        self.counts[fault] += 1
        self._rows += 1
        best: dict[int, tuple] = {}
        for start, letters, to, cost, made, kind in MOVES[initial if initial in ("s", "u", "a") else "", fault]:
            if start in self._live:
                was = self._live[start]
                way = (was[0] + cost, was[1], letters, start, made, kind)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        order = sorted(best, key=lambda s: best[s][1:3])
        body = b":" + text.encode("utf-8", "replace")
        pointers, live = bytearray(4), {}
        for rank, to in enumerate(order):
            cost, _, letters, start, made, kind = best[to]
            pointers[to] = start | len(made) << 2 | OPS.index(letters[-1]) << 4
            lines = [NAMES[r] + b":" for r in made]
            if kind != "d":
                lines.append((role.encode("utf-8", "replace") if kind == "k" else NAMES[kind]) + body)
            live[to] = (cost, rank, self._extended(start, lines))
        self._live = live
        self._back.write(pointers)

    def _extended(self, state: int, lines: list[bytes]):
        made = self._live[state][2].copy()
        for i, line in enumerate(lines):
            made.update(line if state == START and i == 0 else b"\n" + line)
        return made

    def _audit(self, state: int) -> str:
        letters, block = [], 4 * 65536
        end = self._back.tell()
        while end > 0:
            start = max(0, end - block)
            self._back.seek(start)
            data = self._back.read(end - start)
            for at in range(len(data) - 4, -1, -4):
                p = data[at + state]
                letters.append(OPS[p >> 4 & 3])
                letters.append("I" * (p >> 2 & 3))
                state = p & 3
            letters = ["".join(letters)]
            end = start
        return "".join(letters)[::-1]

    def result(self) -> tuple:
        def total(state: int) -> tuple[int, int]:
            return self._live[state][0] + INSERT * ENDS[state][0], self._live[state][1]

        state = min(self._live, key=total)
        n, roles = ENDS[state]
        made = self._extended(state, [NAMES[r] + b":" for r in roles])
        audit = self._audit(state) + "I" * n
        self._back.close()
        gaps = 0 if self._lo is None else self._hi - self._lo + 1 - self._turns
        blank, duplicate, truncated, _ = self.counts
        return self.conv_id, gaps, blank, duplicate, truncated, self.illegal, total(state)[0], audit, made.hexdigest()


def repair(rows: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """rows(conv_id, turn, role, text[, gone]) -> one row for each conversation: its faults, cheapest edits and their digest.

    gone: a row that only says that its conversation exists."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    base = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    base = base.repartition("conv_id")  # the window below and the stream both keep to it
    same = Window.partitionBy("conv_id", "gone", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).orderBy("turn")
    said = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(said == "", BLANK).when(F.row_number().over(same) > 1, DUPLICATE).when(~F.substring(said, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    marked = base.select("*", fault.alias("fault")).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in OUT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            for conv, turn, role, text, off, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault"))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.result())
                    now = Repair(conv, spill_bytes)
                if not off:
                    now.add(turn, role, text, fault)
            if len(done) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return marked.mapInArrow(run, OUT)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of their place: dropped (gone), emptied, without stops, repeated, or said by the user."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_h", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("_h") < 2, F.lit("")).when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_h") == 0).alias("gone"), F.explode(copies).alias("_c")).drop("_c")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage, each with its faults, audit and the digest of its repaired turns."""
    return repair(damage(read(spark, sf_dir, "conversations")))
