"""Conversation structure repair by a run-length dynamic program.

Rows of a conversation become symbols: the role's initial and the row's fault. Equal symbols in a
row are one run. A symbol moves a repaired conversation between four states, and the cheapest ways
form a matrix over (min, +); a run of n rows is its n-th power, applied through powers of two that
are kept. Going back over the runs gives the least cost left in each state; going forward, each row
takes the first edit in ASCII order that loses nothing.

Equal rows of one turn are counted, not kept apart, before any shuffle. Rows are dealt by ranges of
(conversation, turn, role, text), so a long conversation spreads over tasks, each of which sends its
runs. A conversation meets in one row only as its runs and its audit, a byte for each row, which is
what the result holds. Texts then pass by once, in order, into the digest; none is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The contract's costs and marks.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK, AGAIN, CUT, FINE = "b", "d", "t", "k"

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
#: The state after a turn of some role; a role that cannot stand there has none.
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after a turn that may be given either role.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows whose choices are unrolled together.
STRETCH = 4096


def _inserts() -> list[list[int]]:
    """Least cost of inserted turns from one state to another."""
    out = [[INF] * 4 for _ in range(4)]
    for s in range(4):
        t, cost = s, 0
        while cost < out[s][t]:
            out[s][t] = cost
            t, cost = NEXT[t], cost + INSERT
    return out


def times(a, b):
    return tuple(tuple(min(INF, min(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def onto(m, v):
    return tuple(min(INF, min(m[i][k] + v[k] for k in range(4))) for i in range(4))


INSERTS = _inserts()
#: Cost left behind the last row: inserted turns up to an end that is allowed.
ENDS = tuple(min(INSERTS[s][NOTHING], INSERTS[s][ASSISTANT]) for s in range(4))


def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of one row, in ASCII order; a row that must go can only be deleted."""
    out = [("D", DELETE, state)]
    role, fault = symbol
    if fault in (FINE, CUT):
        extra = TRUNCATED * (fault == CUT)
        if state in AFTER.get(role, {}):
            out.append(("K", extra, AFTER[role][state]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


@lru_cache(maxsize=None)
def power(symbol: str, k: int):
    """The transition of 2**k rows of one symbol; 16 symbols and at most 63 powers."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    one = [[INF] * 4 for _ in range(4)]
    for s in range(4):
        for _, cost, t in edits(symbol, s):
            one[s][t] = min(one[s][t], cost)
    return times(INSERTS, one)


def advance(symbol: str, n: int, left: tuple[int, ...]) -> tuple[int, ...]:
    """Cost left before ``n`` rows of a symbol, from the cost left behind them."""
    k = 0
    while n:
        if n & 1:
            left = onto(power(symbol, k), left)
        n >>= 1
        k += 1
    return left


def merge_runs(pieces) -> list[tuple[str, int]]:
    """Runs of several pieces on end."""
    runs: list[tuple[str, int]] = []
    for symbols, counts in pieces:
        for j, n in enumerate(counts):
            s = symbols[2 * j : 2 * j + 2]
            if runs and runs[-1][0] == s:
                runs[-1] = (s, runs[-1][1] + int(n))
            else:
                runs.append((s, int(n)))
    return runs


def repair(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """Least cost, and the edits' initials, the ASCII-least of the cheapest."""
    left = [ENDS]
    for symbol, n in reversed(runs):
        left.append(advance(symbol, n, left[-1]))
    left.reverse()
    out, state = [], NOTHING
    for r, (symbol, n) in enumerate(runs):
        for done in range(0, n, STRETCH):
            m = min(STRETCH, n - done)
            costs = [advance(symbol, n - done - m, left[r + 1])]
            for _ in range(m):
                costs.append(onto(power(symbol, 0), costs[-1]))
            for j in range(m, 0, -1):
                here, behind = costs[j], costs[j - 1]
                while True:
                    options = [(e, t) for e, c, t in edits(symbol, state) if c + behind[t] == here[state]]
                    if options and options[0][0] == "D":
                        break
                    if INSERT + here[NEXT[state]] != here[state]:
                        break
                    out.append("I")
                    state = NEXT[state]
                out.append(options[0][0])
                state = options[0][1]
    while ENDS[state]:
        out.append("I")
        state = NEXT[state]
    return left[0][NOTHING], "".join(out)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, equal ones of a turn counted.

    A null counts as one space in the checksum's text, in roles and in texts.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with their fault and whether role and text stood earlier in the conversation.

    The first place of a role and text is found by a grouped minimum and joined back on its
    turn too, so a text that stands at every turn is no hot key of the join.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    rows = rows.withColumn("h", F.sha2("text", 256))
    first = rows.groupBy("conv_id", "role", "h").agg(F.min(F.struct("turn")).alias("t")).select(
        F.col("conv_id").alias("c1"), F.col("role").alias("r1"), F.col("h").alias("h1"), F.col("t.turn").alias("t1"), F.lit(True).alias("is_first"))
    on = _same(F.col("conv_id"), F.col("c1")) & (F.col("role") == F.col("r1")) & (F.col("h") == F.col("h1")) & _same(F.col("turn"), F.col("t1"))
    fault = F.when(last == "", BLANK).when(F.col("is_first").isNull(), AGAIN).when(last.isin(".", "!", "?"), FINE).otherwise(CUT)
    return rows.join(first, on, "left").select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def _key(c: str) -> Column:
    """The id as text, a null apart from all others."""
    return F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(c).cast("string")))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of the rows of each conversation, in pieces; rows come in order."""
    part, seq, key, symbols, counts, out = TaskContext.get().partitionId(), 0, None, [], [], []

    def close():
        nonlocal seq
        if symbols:
            out.append((key, part, seq, "".join(symbols), list(counts)))
            seq += 1
            symbols.clear()
            counts.clear()

    def add(symbol: str, n: int):
        if symbols and symbols[-1] == symbol:
            counts[-1] += n
        elif n:
            symbols.append(symbol)
            counts.append(n)

    columns = ["key", "part", "seq", "symbols", "counts"]
    for b in batches:
        for k, role, fault, n in zip(b["key"], b["role"], b["fault"], b["n"]):
            if k != key or len(symbols) > 100_000:
                close()
                key = k
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            add(initial + fault, 1)
            # copies of a row stand right behind it
            add(initial + (BLANK if fault == BLANK else AGAIN), int(n) - 1)
        if out:
            yield pd.DataFrame(out, columns=columns)
            out = []
    close()
    if out:
        yield pd.DataFrame(out, columns=columns)


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    legal = {"su", "ua", "au"}
    for b in batches:
        out = []
        for key, pieces in zip(b["key"], b["pieces"]):
            runs = merge_runs((p["symbols"], p["counts"]) for p in pieces)
            n = {f: sum(c for s, c in runs if s[1] == f) for f in (BLANK, AGAIN, CUT)}
            illegal = sum(c - 1 for _, c in runs) + sum(x[0] + y[0] not in legal for (x, _), (y, _) in zip(runs, runs[1:]))
            cost, audit = repair(runs)
            out.append((key, n[BLANK], n[AGAIN], n[CUT], illegal, cost, audit))
        yield pd.DataFrame(out, columns=["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


class Rewriter:
    """The repaired conversation, line by line, as its rows pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.empty = audit, 0, NOTHING, True
        self.sha = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        self.empty = False

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._line(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[role[0]][self.state]
            self._line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._line(ROLE[self.state], text)

    def digest(self) -> str:
        self.inserts()
        if self.at != len(self.audit):
            raise ValueError("rows and audit of a conversation differ")
        return self.sha.hexdigest()


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A digest for each audit row, from the rows of its conversation, which come behind it in order."""
    now, key = None, None
    for b in batches:
        out = []
        for k, audit, role, text, n in zip(b["key"], b["audit"], b["role"], b["text"], b["n"]):
            if isinstance(audit, str):
                if now:
                    out.append((key, now.digest()))
                now, key = Rewriter(audit), k
            else:
                for _ in range(int(n)):
                    now.row(role, text)
        if out:
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
    if now:
        yield pd.DataFrame([(key, now.digest())], columns=["key", "repaired_sha256"])


def repair_conversations(rows: DataFrame, original: DataFrame) -> DataFrame:
    """One row for each conv_id of ``original``: gaps, faults, cost, audit and digest of the repaired conversation.

    ``rows`` (conv_id, turn, role, text, n) are distinct rows with how often each stands there;
    they are taken by turn (nulls first), role and text. Rows without a conversation id are one
    conversation. A role whose initial is none of s, u, a cannot be kept as it is. Conversations
    without rows give zeros, an empty audit and the digest of nothing; an empty table gives an
    empty result. Other columns of ``original`` are ignored.
    """
    kind = original.schema["conv_id"].dataType
    marked = faults(rows).withColumn("key", _key("conv_id")).drop("conv_id").withColumn("start", F.substring("text", 1, 64))
    ordered = materialize(marked.repartitionByRange("key", "turn", "role", "start").sortWithinPartitions("key", "turn", "role", "text").select(
        "key", "turn", "role", "text", "n", "fault", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "turns")

    every = original.select(_key("conv_id").alias("key")).distinct()
    none = every.select("key", F.lit(-1).alias("part"), F.lit(0).alias("seq"), F.lit("").alias("symbols"), F.array().cast("array<long>").alias("counts"))
    pieces = _pieces(ordered).unionAll(none)
    whole = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "symbols", "counts"))).alias("pieces"))
    solved = materialize(whole.mapInPandas(
        _solve, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "audits")

    turns = ordered.filter("turn IS NOT NULL").groupBy("key", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))

    stream = solved.select("key", F.lit(-1).cast("long").alias("place"), "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n")).unionAll(
        ordered.select("key", "place", F.lit(None).cast("string").alias("audit"), "role", "text", "n"))
    digests = stream.repartition("key").sortWithinPartitions("key", "place").mapInPandas(_digests, "key string, repaired_sha256 string")

    conv_id = F.when(F.col("key") != "0", F.substring("key", 2, 1 << 30).cast(kind)).alias("conv_id")
    return solved.join(digests, "key").join(gaps, "key", "left").select(
        conv_id, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _pieces(ordered: DataFrame) -> DataFrame:
    """Runs of the written rows; dealt once more by the ranges they were written in, without texts."""
    light = ordered.select("key", "role", "fault", "n", "part", "place")
    return light.repartitionByRange("place").sortWithinPartitions("place").mapInPandas(
        _runs, "key string, part int, seq int, symbols string, counts array<long>")
