"""Conversation repair against plain recursion and plain rules, over short, long, repeated and missing rows."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from textweave.llm import convrepair
from textweave.llm.convrepair import DELETE, INSERT, LEFT_TRUNCATED, REROLE, SYMBOL_OF, Repairer
from textweave.llm.queries import damaged, op11

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # what may follow; "" is the start


def cheapest(rows):
    """(cost, audit) of rows (initial, must go, truncated) by recursion; more than two inserts in a row never pay."""

    @cache
    def rest(i, last, inserted=0):
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        add = lambda letter, cost, tail: ways.append((cost + tail[0], letter + tail[1]))
        if i < len(rows):
            initial, must, truncated = rows[i]
            more = LEFT_TRUNCATED if truncated else 0
            add("D", DELETE, rest(i + 1, last))
            if not must and initial in NEXT[last]:
                add("K", more, rest(i + 1, initial))
            for to in NEXT[last] if not must else ():
                if to != "s":
                    add("R", REROLE + more, rest(i + 1, to))
        for to in NEXT[last] if inserted < 2 else ():
            if to != "s":
                add("I", INSERT, rest(i, to, inserted + 1))
        return min(ways, default=(10**9, ""))

    return rest(0, "")


def symbol(initial, must, truncated):
    role = "sua".find(initial) if initial else -1
    fault = 1 if must else 3 if truncated else 0
    return SYMBOL_OF[4 * fault + (role if role >= 0 else 3)]


def by_force(rows):
    """(cost, audit) by listing every edit sequence with at most three inserts in a row."""
    best = (10**9, "")
    options = []
    for initial, must, truncated in rows:
        more = LEFT_TRUNCATED if truncated else 0
        options.append([("D", "", DELETE)] + ([] if must else [("K", initial, more), ("R", "u", REROLE + more), ("R", "a", REROLE + more)]))
    fills = ["".join(x) for k in range(3) for x in itertools.product("ua", repeat=k)]
    for picks in itertools.product(*options):
        for ins in itertools.product(fills, repeat=len(rows) + 1):
            roles = "".join(f + p[1] for f, p in zip(ins, picks + (("", "", 0),))) if picks else ins[0]
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "".join("I" * len(f) + p[0] for f, p in zip(ins, picks + (("", "", 0),)))
                best = min(best, (sum(p[2] for p in picks) + INSERT * sum(map(len, ins)), audit))
    return best


KINDS = [(i, m, t) for i in "suax" for m, t in ((False, False), (True, False), (False, True))]


def test_tables_are_small_and_blocks_repeat_rows():
    vectors, (one, many), (paid, total) = convrepair.tables()
    assert len(vectors) < 200 and vectors[0] == convrepair.FIRST
    rng = random.Random(2)
    for _ in range(500):
        at = start = rng.randrange(len(vectors))
        code = cost = 0
        for s in rng.choices(range(convrepair.SYMBOLS), k=convrepair.BLOCK):
            cost += paid[at * convrepair.SYMBOLS + s]
            at, code = one[at * convrepair.SYMBOLS + s], code * convrepair.SYMBOLS + s
        place = start * convrepair.SYMBOLS**convrepair.BLOCK + code
        assert (many[place], total[place]) == (at, cost)


def test_every_short_conversation():
    repairer = Repairer()
    for n in range(3):
        for rows in itertools.product(KINDS, repeat=n):
            want = by_force(rows)
            assert repairer.solve(bytes(symbol(*r) for r in rows)) == want, rows


def test_longer_conversations_by_recursion():
    repairer, rng = Repairer(), random.Random(4)
    for _ in range(1500):
        rows = tuple(rng.choices(KINDS, k=rng.randint(3, 7)))
        assert repairer.solve(bytes(symbol(*r) for r in rows)) == cheapest(rows), rows


def test_blocks_agree_with_single_rows(monkeypatch):
    """A long conversation gives the same by lookups of any block length; memory is emptied on the way."""
    rng = random.Random(6)
    symbols = bytes(rng.choices(range(convrepair.SYMBOLS), k=20_003))
    want = Repairer().solve(symbols)
    for block, held in ((1, 3), (3, 50)):
        monkeypatch.setattr(convrepair, "BLOCK", block)
        monkeypatch.setattr(convrepair, "HELD", held)
        convrepair.tables.cache_clear()
        assert Repairer().solve(symbols) == want
    convrepair.tables.cache_clear()


def plain(rows, key):
    """All columns of one conversation by plain rules."""
    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for turn, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
        seen.add((role, text))
    first = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = Repairer().solve(bytes(symbol(i, f in (1, 2), f == 3) for i, f in zip(first, faults)))
    out, last, left = [], "", iter(rows)
    for letter in audit:
        turn, role, text = next(left) if letter != "I" else (None, None, "")
        if letter == "D":
            continue
        role = role if letter == "K" else "assistant" if last == "u" else "user"
        out.append(f"{role}:{text}")
        last = role[0]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        yield from [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())


def expected(rows):
    talks = {conv: [] for conv, *_ in rows}
    for conv, *row in damage(rows):
        talks[conv].append(tuple(row))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {conv: plain(r, order) if r else empty for conv, r in talks.items()}


def found(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def awkward():
    rng = random.Random(8)
    texts = ["Fine.", "Cut", " ", "", None, "Is it?\n", "Größe!", "x. y", " ", "a.\x0b"]
    roles = ["user", "assistant", "system", None, "", "User", "tool", "s", "assistant"]
    rows = [(c, rng.choice([None, t, t, t, t + 3]), rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(None, t, "user", "Who?") for t in range(5)] + [(1000, None, None, None)]
    rows += [(1001, t // 2, ["user", "assistant"][t % 2], rng.choice(texts)) for t in range(3000)]  # long
    rows += [(1002, 4, "user", "The same.")] * 2000  # one row, many times
    return rows + [(1003, 1, "user", "word " * 100_000 + "."), (1003, 2, "assistant", "word " * 100_000)]


def test_query_on_awkward_rows(spark, tmp_path):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("codes", F.lit("own")).withColumn("at", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(op11(spark, str(tmp_path))) == expected(rows)


def test_a_long_conversation_is_spread(spark):
    rows = [(7, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = convrepair.audits(df).collect()
    assert [(r.audit, r.cost, r.gaps, r.illegal) for r in seen] == [("K" * 4000, 0, 0, 0)]
    out = convrepair.repaired(df, convrepair.audits(df)).orderBy("nth").collect()
    assert [(r.role, r.text) for r in out] == [(r, t) for _, _, r, t in rows]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11(spark, str(tmp_path)).count() == 0


def test_query_equals_plain_rules(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11(spark, small)) == expected(rows)
    assert damaged(spark.read.parquet(f"{small}/conversations.parquet")).count() == len(list(damage(rows)))
