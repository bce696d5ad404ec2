"""Repair of conversation structure: the cheapest edits that make roles alternate, by Four-Russians block tables.

A repaired conversation is empty or reads (s)(ua)+ in role initials. Four states say where in that pattern an edit sequence
stands: at the start, after a system row, after a user row, after an assistant row. The costs of the four states after a
row, less the least of them, form a normalised vector. Costs more than ``FAR`` above the least can never be made good, so
there are few vectors, and for each vector and each block of ``BLOCK`` rows the next vector and what was subtracted are
computed beforehand. A conversation is then read block by block with one lookup each. Afterwards blocks are expanded from
the last to the first: the states on cheapest paths are marked, and at each of them the least letter that stays on one.
Walking those marks from the start gives the ASCII-least of all cheapest edit sequences.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import WHITE_CHARS, map_arrow, shuffle_width, written

# Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
NEVER = 1 << 20
FAR = 2 * INSERT  # two inserts lead from any state to one that ends as cheaply as any other
BLOCK = 4
SYMBOLS = 9  # rows to delete; then s, u, a, other, each whole or truncated
HELD = 200_000  # expanded blocks that a task remembers

# A row's code is 4 * fault + role: faults none, blank, duplicate, truncated; roles s, u, a, other.
SYMBOL_OF = [1 + 2 * r for r in range(4)] + [0] * 8 + [2 + 2 * r for r in range(4)]
LEGAL = {(0, 1), (1, 2), (2, 1)}
INSERTS = [(START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)]

Vector = tuple[int, int, int, int]


@cache
def row_moves(symbol: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, from, to, cost) of the edits of a row, least letter first."""
    moves = [("D", s, s, DELETE) for s in range(4)]
    if symbol:
        role, more = (symbol - 1) // 2, LEFT_TRUNCATED if symbol % 2 == 0 else 0
        to = {0: [(START, SYSTEM)], 1: [i for i in INSERTS if i[1] == USER], 2: [(USER, ASSISTANT)], 3: []}[role]
        moves += [("K", a, b, more) for a, b in to] + [("R", a, b, REROLE + more) for a, b in INSERTS]
    return tuple(moves)


def with_inserts(costs: list[int]) -> Vector:
    for _ in range(2):
        for a, b in INSERTS:
            costs[b] = min(costs[b], costs[a] + INSERT)
    return tuple(costs)


def after_row(costs: Vector, symbol: int) -> Vector:
    out = [NEVER] * 4
    for _, a, b, c in row_moves(symbol):
        out[b] = min(out[b], costs[a] + c)
    return with_inserts(out)


def normalised(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(c - least if c - least <= FAR else NEVER for c in costs), least


FIRST: Vector = normalised(with_inserts([0, NEVER, NEVER, NEVER]))[0]


@cache
def tables() -> tuple[list[Vector], list[array], list[array]]:
    """All normalised vectors; per vector the next one and the amount subtracted, of a single row and of a block."""
    vectors, number = [FIRST], {FIRST: 0}
    step, cost = [], []
    at = 0
    while at < len(vectors):
        for symbol in range(SYMBOLS):
            to, least = normalised(after_row(vectors[at], symbol))
            if to not in number:
                number[to] = len(vectors)
                vectors.append(to)
            step.append(number[to])
            cost.append(least)
        at += 1
    one, paid = np.array(step).reshape(-1, SYMBOLS), np.array(cost).reshape(-1, SYMBOLS)
    many, total = one, paid
    for _ in range(BLOCK - 1):  # a block's code gains a digit for each further row
        total = (total[:, :, None] + paid[many]).reshape(len(vectors), -1)
        many = one[many].reshape(len(vectors), -1)
    flat = lambda x: array("i", x.astype(np.int32).tobytes())
    return vectors, [flat(one), flat(many)], [flat(paid), flat(total)]


Marks = tuple[tuple[str, int] | None, ...]


def _inserting(costs: Vector, marks: list) -> Marks:
    """Marks of a place completed by inserts that lead to marked states."""
    for _ in range(2):
        for a, b in INSERTS:
            if marks[b] and costs[a] < NEVER and costs[a] + INSERT == costs[b] and (marks[a] is None or marks[a][0] > "I"):
                marks[a] = ("I", b)
    return tuple(marks)


def _expanded(costs: Vector, symbols: tuple[int, ...], alive: tuple[bool, ...]) -> list[Marks]:
    """The marks before each row of a block, given the states that are on cheapest paths after it."""
    before = [costs]
    for symbol in symbols:
        before.append(after_row(before[-1], symbol))
    out = []
    for i in range(len(symbols) - 1, -1, -1):
        marks: list = [None] * 4
        for letter, a, b, c in row_moves(symbols[i]):
            if alive[b] and before[i][a] < NEVER and before[i][a] + c == before[i + 1][b] and marks[a] is None:
                marks[a] = (letter, b)
        out.append(_inserting(before[i], marks))
        alive = tuple(m is not None for m in out[-1])
    return out[::-1]


class Repairer:
    """Cheapest edits of rows given as symbols; remembers expanded blocks."""

    def __init__(self) -> None:
        self.vectors, (self.one, self.many), (self.paid, self.total) = tables()
        self.memory: dict = {}

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """(cost, audit): the least cost, and the ASCII-least letters K, R, D, I of edits of that cost."""
        n, width = len(symbols), SYMBOLS**BLOCK
        whole = n - n % BLOCK
        codes = np.frombuffer(symbols, np.uint8, whole).astype(np.int64).reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        at, cost, starts = 0, 0, array("i")
        for code in codes.tolist():
            starts.append(at)
            cost += self.total[at * width + code]
            at = self.many[at * width + code]
        starts.append(at)
        for symbol in symbols[whole:]:
            cost += self.paid[at * SYMBOLS + symbol]
            at = self.one[at * SYMBOLS + symbol]
        last = self.vectors[at]
        least = min(last[s] for s in ACCEPTED)
        marks = _inserting(last, [("", s) if s in ACCEPTED and last[s] == least else None for s in range(4)])
        placed: list[list[Marks]] = [[marks]]
        for block in range(len(starts) - 1, -1, -1):
            key = (starts[block], symbols[block * BLOCK : (block + 1) * BLOCK], tuple(m is not None for m in marks))
            if key not in self.memory:
                if len(self.memory) > HELD:
                    self.memory.clear()
                self.memory[key] = _expanded(self.vectors[key[0]], tuple(key[1]), key[2])
            if self.memory[key]:
                placed.append(self.memory[key])
                marks = placed[-1][0]
        audit, state = [], START
        while placed:
            for marks in placed.pop():
                letter, state = marks[state]
                while letter == "I":
                    audit.append(letter)
                    letter, state = marks[state]
                audit.append(letter)
        return cost + least, "".join(audit)


def _role(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def plain(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest): null roles and texts as one space, and a digest that tells role and text."""
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return filled.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation in ``rows``.

    ``rows`` has conv_id, turn, role, text, and is read once. Rows are ordered by turn, nulls first; rows of the same turn
    by digest of role and text, so repeated rows are adjacent. Null conv_id is a conversation of its own. The order is cut
    into ranges over all conversations, so a long one is spread over many tasks; what meets in one task is one letter per
    row, as many as the audit has. An empty table has no conversations.
    """
    spark = rows.sparkSession
    width = shuffle_width(spark)
    body = F.btrim("text", F.lit(WHITE_CHARS))
    fault = F.when(body == "", 1).when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    light = plain(rows).select("conv_id", "turn", "digest", _role(F.col("role")).alias("role"), fault.alias("fault"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ranged = light.repartitionByRange(width, *order).sortWithinPartitions(*order)
    # the upper bits of `at` are the range, and it ascends with the order
    placed = written(ranged.select("conv_id", "turn", "digest", "role", "fault", F.monotonically_increasing_id().alias("at")), "turns")
    repeats = placed.filter("fault <> 1").groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    r = repeats.select(F.col("conv_id").alias("r_conv"), F.col("digest").alias("r_digest"), "first")
    marked = placed.join(r, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("digest") == F.col("r_digest")), "left")
    code = F.when((F.col("fault") != 1) & (F.col("at") > F.col("first")), 2).otherwise(F.col("fault")) * 4 + F.col("role")
    letter = F.lower(F.hex(code.cast("bigint")))
    ranges = marked.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("at", letter.alias("code")))).alias("codes"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"),
    )
    parts = ranges.select("conv_id", F.struct("part", F.array_join("codes.code", "").alias("codes"), "low", "high", "turns").alias("part"))
    gathered = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    kind = dict(rows.dtypes)["conv_id"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer()
        for batch in batches:
            out = [judged(parts, repairer) for parts in batch.column("parts").to_pylist()]
            names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            kinds = [pa.int64()] * 6 + [pa.string()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", *names])

    return map_arrow(gathered, solve, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def judged(parts: list[dict], repairer: Repairer) -> tuple:
    """Counts, cost and audit of one conversation from its ranges in order."""
    turns, low, high = 0, None, None
    for p in parts:
        if p["low"] is not None:
            turns += p["turns"] - (p["low"] == high)
            low, high = p["low"] if low is None else low, p["high"]
    codes = np.frombuffer(bytes.fromhex("".join("0" + c for p in parts for c in p["codes"])), np.uint8)
    faults = np.bincount(codes >> 2, minlength=4)
    roles = codes & 3
    pair = roles[:-1] * 4 + roles[1:]
    illegal = len(pair) - int(np.isin(pair, [a * 4 + b for a, b in LEGAL]).sum())
    cost, audit = repairer.solve(np.array(SYMBOL_OF, np.uint8)[codes].tobytes())
    gaps = 0 if low is None else high - low + 1 - turns
    return (gaps, *(int(faults[k]) for k in (1, 2, 3)), illegal, cost, audit)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text) of the repaired conversations; ``found`` is what ``audits`` gave for the same ``rows``.

    Rows stream through tasks in order, each conversation behind its audit, and leave a task conversation by conversation
    with ``nth`` ascending; no conversation's texts are held together. Conversations whose rows all go have no row.
    """
    kind = dict(rows.dtypes)["conv_id"]
    texts = plain(rows).withColumn("audit", F.lit(None).cast("string"))
    letters = found.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in texts.dtypes if c not in ("conv_id", "audit")], "audit")
    mixed = letters.unionByName(texts).withColumn("row", F.col("audit").isNull())
    order = ["conv_id", "row", F.col("turn").asc_nulls_first(), "digest"]
    dealt = mixed.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "audit")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = nth = at = 0
        audit, conv = "", None
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal state, nth
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            out.append((conv, nth, role, text))
            nth += 1

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("assistant" if state == USER else "user", "")
                at += 1

        for batch in batches:
            for new, role, text, letters in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit"))):
                if letters is not None:
                    inserted()
                    conv, audit, state, nth, at = new, letters, START, 0, 0
                    continue
                inserted()
                if audit[at] == "K":
                    put(role, text)
                elif audit[at] == "R":
                    put("assistant" if state == USER else "user", text)
                at += 1
            if out:
                yield columns(out, batch.column("conv_id").type)
                out.clear()
        inserted()
        if out:
            yield columns(out, batch.column("conv_id").type)

    def columns(out: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        kinds = [conv_type, pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["conv_id", "nth", "role", "text"])

    return map_arrow(dealt, edit, f"conv_id {kind}, nth bigint, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines; ``rows`` come as ``repaired`` leaves them, a conversation in a row."""
    kind = dict(rows.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv = None, None
        for batch in batches:
            done = []
            for new, nth, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "nth", "role", "text"))):
                if nth == 0:
                    if state:
                        done.append((conv, state.hexdigest()))
                    conv, state = new, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if done:
                yield pairs(done, batch.column("conv_id").type)
        if state:
            yield pairs([(conv, state.hexdigest())], batch.column("conv_id").type)

    def pairs(done: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], conv_type), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])

    return map_arrow(rows, digest, f"conv_id {kind}, repaired_sha256 string")
