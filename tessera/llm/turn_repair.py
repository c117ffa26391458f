"""Repair of damaged conversations by shortest paths.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.  Its
repairs are the paths through a graph whose nodes are (rows passed, state of
that pattern) and whose arcs are edits: Keep for 0, Delete for 4, Rerole for 3,
Insert for 3, and 3 more for a truncated row that isn't deleted.  Blank and
duplicate rows can only be deleted.  Costs are small whole numbers, so the
distances to the end come from Dial's bucket queue; the audit is the walk from
the start that takes the ASCII-least letter among the tight arcs, those on some
shortest path.  A letter leads to one node only, so the walk is the least audit.

Long conversations are cut into slices of at most ``SLICE`` rows:

1. Equal rows (same turn, role and text) are counted, by partial aggregation;
   all but the first are duplicates, whose deletions follow its letter.
2. Rows are dealt by ranges of (conv_id, turn, role, text) and sorted, so a
   conversation of very many turns lies in several tasks.
3. Where a conversation has several slices, each gives the distances between its
   ends (4 x 4), and these fold from the last slice to the first.
4. Each slice then finds its own distances, and its walk from each state.
5. One pass in order chains the walks and writes the repaired text into its hash.
   A hash is serial, so this pass has one task a conversation; it holds a batch
   of rows and one slice's letters, and the audit, which is a result.

Defined cases: a null conv_id is a conversation of its own; other nulls are one
space, so null texts are blank and null roles have no legal initial; null turns
come first; rows of one turn go by role, then text, after damage; repeated rows
are duplicates; an empty role has no legal initial and can't be kept; an initial
is the first character as it stands, "U" isn't "u"; very long texts are read
whole; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clustered, groups, shuffle_parts, stored

SLICE = 13  # bits: slices of 8192 rows at most
FAR_ROWS = 1_000_000  # keys that may be broadcast; beyond, the join shuffles
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after an output of that initial (0 s, 1 u, 2 a, 3 other), or None; and the role that each state can be given.
NEXT = [[AFTER_S, AFTER_U, None, None], [None, AFTER_U, None, None], [None, None, AFTER_A, None], [None, AFTER_U, None, None]]
NEED = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
BEFORE = [[q for q in range(4) if NEED[q] == r] for r in range(4)]
KEEPS = [[[q for q in range(4) if NEXT[q][c] == r] for r in range(4)] for c in range(4)]
NONE, BLANK, DUPLICATE, CUT = range(4)
FAR = 1 << 60
END = (0, FAR, FAR, 0)
RING = 32  # buckets: above the spread of distances at a slice's end plus the dearest arc


def dial(initial: list[int], fault: list[int], after: tuple[int, ...]) -> list[list[int]]:
    """Distances from every node to the end, by a bucket queue over the reversed arcs.

    ``initial`` and ``fault`` are those of the rows in order; ``after`` are the
    distances from the states behind the last row (``FAR`` where there is none).
    """
    n, least = len(initial), min(after)
    dist = [[FAR] * 4 for _ in range(n + 1)]
    ring: list[list[tuple[int, int]]] = [[] for _ in range(RING)]
    waiting = 0
    for q, d in enumerate(after):
        if d < FAR:
            dist[n][q] = d - least
            ring[(d - least) % RING].append((n, q))
            waiting += 1
    now = 0
    while waiting:
        bucket = ring[now % RING]
        while bucket:
            i, q = bucket.pop()
            waiting -= 1
            if dist[i][q] != now:
                continue
            arcs = [(i, p, INSERT) for p in BEFORE[q]]
            if i:
                arcs.append((i - 1, q, DELETE))
                f = fault[i - 1]
                if f not in (BLANK, DUPLICATE):
                    more = TRUNCATED if f == CUT else 0
                    arcs += [(i - 1, p, more) for p in KEEPS[initial[i - 1]][q]]
                    arcs += [(i - 1, p, REROLE + more) for p in BEFORE[q]]
            for j, p, cost in arcs:
                d = now + cost
                if d < dist[j][p]:
                    dist[j][p] = d
                    ring[d % RING].append((j, p))
                    waiting += 1
        now += 1
    return dist


def walk(dist: list[list[int]], initial: list[int], fault: list[int], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least letters of a shortest path from ``state``, and the state they lead to; only the last slice inserts behind its rows."""
    n, i, letters = len(initial), 0, []
    while i < n or last and dist[i][state]:
        here = dist[i][state]
        more = TRUNCATED if i < n and fault[i] == CUT else 0
        free = i < n and fault[i] not in (BLANK, DUPLICATE)
        kept = NEXT[state][initial[i]] if free else None
        if i < n and dist[i + 1][state] + DELETE == here:
            letters.append("D")
            i += 1
        elif dist[i][NEED[state]] + INSERT == here:
            letters.append("I")
            state = NEED[state]
        elif kept is not None and dist[i + 1][kept] + more == here:
            letters.append("K")
            i, state = i + 1, kept
        elif free and dist[i + 1][NEED[state]] + REROLE + more == here:
            letters.append("R")
            i, state = i + 1, NEED[state]
        else:
            raise AssertionError("no tight arc")
    return "".join(letters), state


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (none, conv, turn, role, text, copies) after damage; ``none`` marks a null conv_id."""
    conv, turn = F.col(id_col).cast("long"), F.col(turn_col).cast("long")
    rows = conversations.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(as_) for c, as_ in ((role_col, "role"), (text_col, "text"))))
    named = F.concat(F.when(F.col("none"), " ").otherwise(F.col("conv").cast("string")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.col("hit")
    return rows.withColumn("hit", F.crc32(F.encode(named, "UTF-8")) % 20).where(hit != 0).select(
        "none", "conv", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), F.when(hit == 3, 2).otherwise(1).alias("copies"))


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FAR_ROWS else df


def faults(rows: DataFrame) -> DataFrame:
    """One row per different (conversation, turn, role, text): m (how many), initial and fault of the first."""
    one = rows.groupBy("none", "conv", "turn", "role", "text").agg(F.sum("copies").alias("m")).withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = stored(one.groupBy("none", "conv", "role", "sha").agg(F.min(when).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns"), "turns-again")
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("first").isNotNull() & (when > F.col("first")), DUPLICATE)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(NONE))
    code = F.substring("role", 1, 1)
    return one.join(_near(again), ["none", "conv", "role", "sha"], "left").select(
        "none", "conv", "turn", "role", "text", "m", F.when(code == "s", 0).when(code == "u", 1).when(code == "a", 2).otherwise(3).alias("initial"), fault.alias("fault"))


def in_order(rows: DataFrame, bits: int = SLICE) -> DataFrame:
    """The rows with ``at``, ascending in each conversation's order, and the slice that each belongs to."""
    begins = F.substring("text", 1, 64)
    dealt = rows.withColumn("begins", begins).repartitionByRange(shuffle_parts(rows.sparkSession), "none", "conv", "turn", "role", "begins")
    return stored(dealt.drop("begins").sortWithinPartitions("none", "conv", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
                  .withColumn("slice", F.shiftright("at", bits)), "turns-in-order")


def _codes(group: pa.Table) -> tuple[list[int], list[int]]:
    return group["initial"].to_pylist(), group["fault"].to_pylist()


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distances between the states at both ends of each slice: ``costs``, 4 x 4."""
    for g in groups(batches, ["none", "conv", "slice"]):
        initial, fault = _codes(g)
        ends = [dial(initial, fault, tuple(0 if q == r else FAR for q in range(4)))[0] for r in range(4)]
        costs = [[ends[r][q] for r in range(4)] for q in range(4)]
        yield pa.RecordBatch.from_arrays([g["none"].combine_chunks()[:1], g["conv"].combine_chunks()[:1], g["slice"].combine_chunks()[:1], pa.array([sum(costs, [])], pa.list_(pa.int64()))],
                                         names=["none", "conv", "slice", "costs"])


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From slices in descending order: the distances ``after`` each slice, null after the last of a conversation."""
    conv, after = None, None
    for b in batches:
        out = []
        for none, c, costs in zip(b.column("none").to_pylist(), b.column("conv").to_pylist(), b.column("costs").to_pylist(), strict=True):
            if (none, c) != conv:
                conv, after = (none, c), None
            out.append(after)
            ahead = after or [6, 6, 3, 0]  # from each state to the end by insertions; the start is an end as well
            if after is None:
                ahead[START] = 0
            after = [min(costs[4 * q + r] + ahead[r] for r in range(4)) for q in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("none"), b.column("conv"), b.column("slice"), pa.array(out, pa.list_(pa.int64()))], names=["none", "conv", "slice", "after"])


def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's letters from each state, and the states they lead to."""
    for g in groups(batches, ["none", "conv", "slice"]):
        initial, fault = _codes(g)
        after, alone = g["after"][0].as_py(), not g["several"][0].as_py()
        dist = dial(initial, fault, tuple(after) if after else END)
        found = [walk(dist, initial, fault, q, after is None) if dist[0][q] < FAR else ("", q) for q in range(1 if alone else 4)]
        yield pa.RecordBatch.from_arrays(
            [g["none"].combine_chunks()[:1], g["conv"].combine_chunks()[:1], g["at"].combine_chunks()[:1], pa.array([[x for x, _ in found]], pa.list_(pa.string())),
             pa.array([[q for _, q in found]], pa.list_(pa.int32()))], names=["none", "conv", "at", "letters", "leads"])


class _Conversation:
    """What the last pass holds of one conversation: counts, the state, the audit and the hash of the repaired text."""

    def __init__(self, none: bool, conv: int):
        self.name = None if none else conv
        self.low = self.high = self.prior = self.role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.state = 0
        self.audit: list[str] = []
        self.sha, self.lines = hashlib.sha256(), 0
        self.letters, self.leads, self.place = "", START, 0

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def insertions(self) -> None:
        while self.letters[self.place: self.place + 1] == "I":
            self.state = NEED[self.state]
            self.line(ROLE[self.state], "")
            self.audit.append("I")
            self.cost += INSERT
            self.place += 1

    def begin(self, letters: list[str], leads: list[int]) -> None:
        self.close()
        self.letters, self.leads, self.place = letters[self.state], leads[self.state], 0

    def close(self) -> None:
        self.insertions()
        if self.place != len(self.letters) or self.letters and self.state != self.leads:
            raise AssertionError("the walk and the rows differ")

    def row(self, turn: int | None, role: str, text: str, m: int, initial: int, fault: int) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        here = "sua?"[initial]
        if self.prior is not None and self.prior + here not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += m - 1
        self.prior = here
        if fault == BLANK:
            self.blank += m
        else:
            self.duplicate += m - 1 + (fault == DUPLICATE)
            self.truncated += fault == CUT
        self.insertions()
        letter = self.letters[self.place]
        self.place += 1
        self.audit.append(letter + "D" * (m - 1))
        self.cost += DELETE * (m - 1)
        if letter == "D":
            self.cost += DELETE
            return
        self.cost += (REROLE if letter == "R" else 0) + (TRUNCATED if fault == CUT else 0)
        self.state = NEXT[self.state][initial] if letter == "K" else NEED[self.state]
        self.line(role if letter == "K" else ROLE[self.state], text)

    def result(self) -> tuple:
        self.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


OUT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From markers (kind 0), slices (1) and rows (2) of conversations in order: one row per conversation."""
    now, key, done = None, None, []
    for b in batches:
        for none, conv, kind, turn, role, text, m, initial, fault, letters, leads in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (none, conv) != key:
                if now:
                    done.append(now.result())
                now, key = _Conversation(none, conv), (none, conv)
            if kind == 1:
                now.begin(letters, leads)
            elif kind == 2:
                now.row(turn, role, text, m, initial, fault)
        if len(done) >= 1000:
            yield _rows(done)
            done = []
    if now:
        done.append(now.result())
    yield _rows(done)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True) if done else [[]] * len(OUT), OUT, strict=True)], schema=OUT)


def repair(conversations: DataFrame, bits: int = SLICE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per original conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    key, place = ["none", "conv"], ["none", "conv", "slice"]
    rows = in_order(faults(damaged(conversations, id_col, turn_col, role_col, text_col)), bits)
    spans = rows.groupBy(*key).agg(F.min("slice").alias("a"), F.max("slice").alias("b")).where("a < b").select(*key, F.lit(True).alias("several"))
    spans = stored(spans, "turns-several")
    codes = rows.select(*place, "at", "initial", "fault").join(_near(spans), key, "left").withColumn("several", F.coalesce("several", F.lit(False)))
    parts = shuffle_parts(rows.sparkSession)
    costs = clustered(codes.where("several"), place, [*place, "at"]).mapInArrow(across, "none boolean, conv long, slice long, costs array<long>")
    after = stored(costs.repartition(parts, *key).sortWithinPartitions(*key, F.desc("slice")).mapInArrow(fold, "none boolean, conv long, slice long, after array<long>"), "turns-after")
    found = (clustered(codes.join(_near(after), place, "left"), place, [*place, "at"])
             .mapInArrow(walks, "none boolean, conv long, at long, letters array<string>, leads array<int>"))

    conv = F.col(id_col).cast("long")
    markers = conversations.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv")).distinct()
    every = (markers.withColumns({"at": F.lit(-1).cast("long"), "kind": F.lit(0)})
             .unionByName(found.withColumn("kind", F.lit(1)), allowMissingColumns=True)
             .unionByName(rows.drop("slice").withColumn("kind", F.lit(2)), allowMissingColumns=True))
    columns = ["none", "conv", "kind", "turn", "role", "text", "m", "initial", "fault", "letters", "leads"]
    return every.repartition(parts, *key).sortWithinPartitions(*key, "at", "kind").select(*columns).mapInArrow(chain, DDL)
