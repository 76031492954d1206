"""Operator 12: conversations whose turns are damaged, repaired by the cheapest edits.

A conversation is well formed where the initials of its roles read ``(s?(ua)+)?``: perhaps
a system turn, then user and assistant in turns. The edits are Keep, Rerole, Delete and
Insert; together with the grammar's state they make a lattice of nodes (turn index, state)
that is never built: Dijkstra's search goes over it with the key (cost, audit) and stops at
the first accepting end node that it pops, so the audit is the ASCII-least of the cheapest.

``damaged`` and ``faults`` are Spark expressions and joins; whole texts are shuffled once,
by conversation, and sorted there. A task reads one conversation after another, in segments
of at most ``SEGMENT`` turns: a segment's search starts from the four states that the one
before it ended in, and the hash of the repaired text runs along. A conversation of any
length so takes the memory of one segment, and of one byte a turn for its audit. One task
reads it whole, as the digest of its text in order asks.

Defined cases: null role, text or key parts are one space; a null conv_id is a conversation
like any other; turns are ordered with nulls first, ties by role and text after damage;
repeated rows are turns of their own (and duplicates); roles other than user, assistant and
system count by their initial, an empty role has none and is never kept; empty texts are blank; very long ones
are read whole; a conversation of which nothing is left has zeros, an empty audit and the
empty string's digest; an empty table gives no rows. Only conv_id, turn, role and text are
read, so other columns may have any names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlathe.llm.bytetext import tidy
from twinlathe.llm.storage import Scratch

#: Turns that one search goes over; more are searched in segments.
SEGMENT = 512

RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
CUT_COST = 1
#: Grammar states: nothing yet, after system, after user, after assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
#: Role that a rerole or an insertion gives in a state, and the state after it.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"

Node = tuple[int, str, int]  # cost, audit, entry state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, and how many copies of the row are left."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    there = F.col("kind") != 0
    return rows.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(there, text).alias("text"), F.when(F.col("kind") == 3, 2).otherwise(there.cast("int")).alias("copies"),
    )


def _place() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with seen: whether an earlier turn of the conversation has the role and the text.
    (Repeats within one turn lie next to each other once sorted.) Role and text are told apart
    by 128 bits; what is met at one turn only, nearly everything, leaves in the aggregate."""
    hashes = {"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")}
    hashed = rows.withColumns(hashes)
    said = hashed.where((F.col("copies") > 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    first = said.groupBy("conv_id", "h1", "h2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first < last")
    repeats = scratch.small(scratch.cut(first.select(F.col("conv_id").alias("r_conv"), F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first"), "repeats"))
    same = F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))
    return hashed.join(repeats, same, "left").select("conv_id", "turn", "role", "text", "copies", F.coalesce(_place() > F.col("first"), F.lit(False)).alias("seen"))


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    #: Blank or a duplicate: only deletion is left.
    gone: bool
    cut: bool


def search(turns: list[Turn], entries: dict[int, tuple[int, str]], last: bool = True) -> dict[int, Node]:
    """Cheapest (cost, audit, entry state) by end state, from ``entries`` (cost, audit) by state:
    the first accepting end node if these are the last turns, else every end node."""
    heap = [(cost, audit, 0, state, state) for state, (cost, audit) in entries.items()]
    heapq.heapify(heap)
    closed, ends = set(), {}
    while heap:
        cost, audit, at, state, entry = heapq.heappop(heap)
        if (at, state) in closed:
            continue
        closed.add((at, state))
        over = at == len(turns)
        if over and (not last or state in ACCEPTING):
            ends[state] = (cost, audit, entry)
            if last:
                return ends
            continue
        after = NEXT[state][1]
        moves = [(INSERT, at, after, 0)]
        if not over:
            turn = turns[at]
            moves.append((DELETE, at + 1, state, 0))
            if not turn.gone:
                moves.append((REROLE, at + 1, after, turn.cut))
                if (kept := STEPS.get((state, turn.role[:1]))) is not None:
                    moves.append((KEEP, at + 1, kept, turn.cut))
        for edit, to, becomes, cut in moves:
            if (to, becomes) not in closed:
                heapq.heappush(heap, (cost + COST[edit] + CUT_COST * cut, audit + edit, to, becomes, entry))
    return ends


def applied(turns: list[Turn], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns after the edits of ``audit``, from a state on."""
    rest = iter(turns)
    for edit in audit:
        if edit == DELETE:
            next(rest)
        elif edit == KEEP:
            turn = next(rest)
            state = STEPS[state, turn.role[:1]]
            yield turn.role, turn.text
        else:
            role, state = NEXT[state]
            yield role, next(rest).text if edit == REROLE else ""


@dataclass
class _Way:
    """The cheapest edits that end in one state, and the text they make."""

    cost: int = 0
    audit: str = ""  # its end, where the ways differ
    digest: object = field(default_factory=hashlib.sha256)
    empty: bool = True

    def along(self, turns: list[Turn], state: int, cost: int, audit: str) -> _Way:
        digest, empty = self.digest.copy(), self.empty
        for role, text in applied(turns, audit[len(self.audit) :], state):
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        return _Way(cost, audit, digest, empty)


class Conversation:
    """One conversation, fed turn by turn in order."""

    def __init__(self, segment: int = SEGMENT):
        self.segment, self.turns, self.ways, self.settled = segment, [], {0: _Way()}, []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.latest = self.before = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            if turn != self.latest:
                self.distinct += 1
            self.first = turn if self.first is None else self.first
            self.latest = turn
        said = text.rstrip(WHITE)
        blank = not said
        duplicate = not blank and (seen or self.before == (turn, role, text))
        cut = not blank and not duplicate and said[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in LEGAL
        self.before = (turn, role, text)
        if len(self.turns) == self.segment:
            self._settle()
        self.turns.append(Turn(role, text, blank or duplicate, cut))

    def _advance(self, last: bool) -> dict[int, _Way]:
        ends = search(self.turns, {s: (w.cost, w.audit) for s, w in self.ways.items()}, last)
        return {s: self.ways[entry].along(self.turns, entry, cost, audit) for s, (cost, audit, entry) in ends.items()}

    def _settle(self) -> None:
        self.ways, self.turns = self._advance(last=False), []
        common = commonprefix([w.audit for w in self.ways.values()])
        self.settled.append(common)
        for w in self.ways.values():
            w.audit = w.audit[len(common) :]

    def result(self) -> tuple:
        (way,) = self._advance(last=True).values()
        gaps = 0 if self.first is None else self.latest - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, way.cost, "".join(self.settled) + way.audit, way.digest.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


@tidy
def _repair(schema: pa.Schema, segment: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, one row for each conversation out."""
    out: list[tuple] = []
    for conv_id, rows in groupby(_rows(batches), itemgetter(0)):
        conversation = Conversation(segment)
        for _, turn, role, text, copies, seen in rows:
            for _ in range(copies):
                conversation.add(turn, role, text, seen)
        out.append((conv_id, *conversation.result()))
        if len(out) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repair(rows: DataFrame, scratch: Scratch, segment: int = SEGMENT) -> DataFrame:
    """Faults, cost, audit and the digest of the repaired text of each conversation of ``rows``
    (conv_id, turn, role, text, copies: how often the row stands there)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = rows.withColumn("turn", F.col("turn").cast("long"))
    marked = faults(rows, scratch).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {RESULT_DDL}"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)
    return marked.mapInArrow(functools.partial(_repair, schema, segment), ddl)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), Scratch(spark, "repair"))


def _struct(cost: str, audit: str, said: str) -> str:
    return f"{{'cost': ({cost})::BIGINT, 'audit': {audit}, 'said': {said}}}"


def _edit(way: str, edit: str, cost: str, role: str | None = None, text: str = "''") -> str:
    said = f"{way}.said" if role is None else f"{way}.said || CASE WHEN {way}.said = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}"
    return _struct(f"{way}.cost + {cost}", f"{way}.audit || '{edit}'", said)


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _sql() -> str:
    """The lattice as a fold over a conversation's turns: the four states' best ways, layer by
    layer (insertions within a layer, then the turn's edits). ``acc`` holds them in a struct."""
    ins = lambda way, role: _edit(way, "I", "2", f"'{role}'")
    twice = lambda way: _struct(f"{way}.cost + 4", f"{way}.audit || 'II'", f"{way}.said || CASE WHEN {way}.said = '' THEN '' ELSE chr(10) END || 'user:' || chr(10) || 'assistant:'")
    closed = (
        "{'w0': acc.w0, 'w1': acc.w1, "
        f"'w2': {_least('acc.w2', ins('acc.w0', 'user'), ins('acc.w1', 'user'), ins('acc.w3', 'user'))}, "
        f"'w3': {_least('acc.w3', ins('acc.w2', 'assistant'), twice('acc.w0'), twice('acc.w1'))}}}"
    )
    far = "(CASE WHEN r.gone OR r.initial <> '{}' THEN 1000000000 ELSE r.cut END)"
    keep = lambda way, i: _edit(way, "K", far.format(i), "r.role", "r.text")
    rerole = lambda way, role: _edit(way, "R", "(CASE WHEN r.gone THEN 1000000000 ELSE 2 + r.cut END)", f"'{role}'", "r.text")
    gone = lambda way: _edit(way, "D", "3")
    users = [x for w in ("j.w0", "j.w1", "j.w3") for x in (keep(w, "u"), rerole(w, "user"))]
    step = (
        f"{{'w0': {gone('j.w0')}, 'w1': {_least(gone('j.w1'), keep('j.w0', 's'))}, "
        f"'w2': {_least(gone('j.w2'), *users)}, 'w3': {_least(gone('j.w3'), keep('j.w2', 'a'), rerole('j.w2', 'assistant'))}}}"
    )
    none = _struct("1000000000", "''", "''")
    start = f"{{'w0': {_struct('0', chr(39) * 2, chr(39) * 2)}, 'w1': {none}, 'w2': {none}, 'w3': {none}}}"
    return rf"""
WITH table_ AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT) AS bytes FROM conversations),
kinds AS (SELECT k.*, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM keyed k, table_),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged),
judged AS (
  SELECT *, said = '' AS blank, said <> '' AND again AS duplicate, said <> '' AND NOT again AND right(said, 1) NOT IN ('.', '!', '?') AS truncated,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS two FROM placed),
told AS (
  SELECT conv_id, list({{'role': role, 'initial': left(role, 1), 'text': text, 'gone': blank OR duplicate, 'cut': truncated::BIGINT}} ORDER BY n) AS turns,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
         count_if(two NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
folded AS (
  SELECT *, list_reduce(turns, lambda acc, r: list_transform([{closed}], lambda j: {step})[1], {start}) AS acc FROM told),
ended AS (SELECT *, list_transform([{closed}], lambda j: {_least('j.w0', 'j.w3')})[1] AS way FROM folded),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(way.said, '')) AS repaired_sha256
FROM every e LEFT JOIN ended d ON e.conv_id IS NOT DISTINCT FROM d.conv_id"""


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE_SQL = {"op12_conversation_repair": _sql()}
