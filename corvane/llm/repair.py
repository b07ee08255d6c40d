"""Repair of conversations by A* on the lattice of edits.

A conversation's rows, in order, are kept, given the role of user or assistant, or deleted, and rows without text may be
inserted, so that the initials of the roles become (s?(ua)+)?. A state is (rows consumed, state of that pattern). The
heuristic is a suffix sum: each row that must go, and each truncated one, costs at least a deletion. It is consistent, and
states leave the queue by (cost plus heuristic, audit), so the first way out is the cheapest and, of these, has the least
audit: two ways into one state at one cost never have audits of which one begins the other, for an insertion always costs.

Spark deals rows by conversation, sorts them and marks repeated ones; a task reads its rows in order, a conversation at a
time. Of a long one it searches SEGMENT rows from each state of the pattern to each, and joins the segments' best ways; it
holds a byte a row and the audit, while texts beyond SPOOL characters wait in the shared folder. One conversation is one
task's, since its hash runs over all its rows in order.

Nulls in role and text are one space; null turns come first and have no part in gaps; a null conversation is one of its own.
Rows of one turn follow by role, then text. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import os.path
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm import shared

SEGMENT = 512
SPOOL = 1 << 24
#: Costs of the edits.
REROLE, DELETE, TRUNCATED, INSERT = 1, 2, 5, 5
#: From a state of the pattern by an initial to the next; a repaired conversation ends in 0 or 3.
_NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
_ROLE = {"u": "user", "a": "assistant"}
_INITIALS, _FAULTS = "suax", ("", "blank", "duplicate", "truncated")
_SPACES = " \t\n\x0b\x0c\r"


def _code(initial: str, fault: str) -> int:
    return _INITIALS.find(initial if initial and initial in "sua" else "x") * 4 + _FAULTS.index(fault)


@functools.lru_cache(1 << 14)
def ways(codes: bytes, start: int = 0, ends: tuple[int, ...] = _ENDS, first: bool = True) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best way through all rows from a state of the pattern: to each of ends that can be reached, or only the first of them to be reached."""
    n = len(codes)
    rest = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        rest[k] = rest[k + 1] + (DELETE if codes[k] % 4 else 0)
    queue, closed, found = [(rest[0], "", 0, start)], set(), {}
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in closed:
            continue
        closed.add((at, state))
        if at == n and state in ends:
            found[state] = (cost, audit)
            if first or len(found) == len(ends):
                break
        spent, to = cost - rest[at], _NEXT[state]
        for initial in "ua":
            if initial in to:
                heapq.heappush(queue, (spent + INSERT + rest[at], audit + "I", at, to[initial]))
        if at < n:
            fault, left = codes[at] % 4, rest[at + 1]
            heapq.heappush(queue, (spent + DELETE + left, audit + "D", at + 1, state))
            if fault in (0, 3):
                charge = spent + left + (TRUNCATED if fault else 0)
                own = _INITIALS[codes[at] // 4]
                if own in to:
                    heapq.heappush(queue, (charge, audit + "K", at + 1, to[own]))
                for initial in "ua":
                    if initial in to:
                        heapq.heappush(queue, (charge + REROLE, audit + "R", at + 1, to[initial]))
    return found


def cheapest(codes: bytes, segment: int = SEGMENT) -> tuple[int, str]:
    """(cost, audit) of the best repair."""
    if len(codes) <= segment:
        return next(iter(ways(codes).values()))
    best, settled = {0: (0, "")}, []
    for at in range(0, len(codes), segment):
        part, grown = codes[at : at + segment], {}
        for state, (cost, audit) in best.items():
            for to, (more, edits) in ways(part, state, (0, 1, 2, 3), False).items():
                way = (cost + more, audit + edits)
                grown[to] = min(grown.get(to, way), way)
        common = os.path.commonprefix([audit for _, audit in grown.values()])
        settled.append(common)
        best = {state: (cost, audit[len(common) :]) for state, (cost, audit) in grown.items()}
    cost, audit = min(best[state] for state in _ENDS if state in best)
    return cost, "".join(settled) + audit


class _Texts:
    """Roles and texts of a conversation in order; beyond a number of characters they wait in files of the shared folder."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.held, self.size, self.files = folder, limit, [], 0, []

    def add(self, role: str, text: str) -> None:
        self.held.append((role, text))
        self.size += len(role) + len(text) + 16
        if self.size > self.limit:
            name = f"rows-{uuid.uuid4().hex}"
            table = pa.table({"role": [r for r, _ in self.held], "text": [t for _, t in self.held]})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            shared.write_file(self.folder, name, [sink.getvalue()])
            self.files.append(name)
            self.held, self.size = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        for name in self.files:
            with shared.open_file(self.folder, name) as f:
                for batch in pa.ipc.open_stream(f):
                    yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        yield from self.held

    def drop(self) -> None:
        for name in self.files:
            files, path = shared.file_system(self.folder)
            files.delete_file(f"{path}/{name}")


class _Conversation:
    def __init__(self, name, folder: str, spool: int):
        self.name, self.texts, self.codes = name, _Texts(folder, spool), bytearray()
        self.counts = dict.fromkeys(_FAULTS, 0)
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.counts[fault] += 1
        self.codes.append(_code(initial, fault))
        self.texts.add(role, text)

    def repaired(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of each row of the repaired conversation."""
        state, rows = 0, iter(self.texts)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            initial = role[:1] if edit == "K" else "a" if "a" in _NEXT[state] else "u"
            yield edit, role if edit == "K" else _ROLE[initial], text
            state = _NEXT[state][initial]


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, role string, text string"


def _ordered(rows: DataFrame, lost: Column | None, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows by conversation in order, with their fault; a lost row only keeps its conversation's name."""
    x = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))).alias("lost"))
    body = F.rtrim("text", F.lit(_SPACES))
    # the same dealing serves the window, which only sorts anew
    x = x.repartition("conv").withColumn("again", F.row_number().over(Window.partitionBy("conv", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1)
    fault = F.when(body == "", "blank").when(F.col("again"), "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return x.withColumn("fault", fault).drop("again").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "duplicate")


def _run(rows: DataFrame, lost: Column | None, names: tuple[str, str, str, str], answer, shape: str, spool: int) -> DataFrame:
    x = _ordered(rows, lost, *names)
    folder = shared.new_folder(rows.sparkSession, "turns")
    kind, conv = x.schema["conv"].dataType.simpleString(), to_arrow_type(x.schema["conv"].dataType)

    fields = [f.split() for f in shape.split(", ")]

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for name, turn, role, text, gone, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "lost", "fault")), strict=True):
                if now is None or name != now.name:
                    if now is not None:
                        yield from answer(now)
                    now = _Conversation(name, folder, spool)
                if not gone:
                    now.add(turn, role, text, fault)
        if now is not None:
            yield from answer(now)

    @shared.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = answers(batches)
        types = [conv, *(pa.int64() if t == "long" else pa.string() for _, t in fields)]
        while some := list(itertools.islice(rows, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], [names[0], *(n for n, _ in fields)])

    return x.mapInArrow(run, f"{shared.quoted(names[0])} {kind}, {shape}")


def report(rows: DataFrame, lost: Column | None = None, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), spool: int = SPOOL) -> DataFrame:
    """A row for each conversation: its faults, the cost and audit of its repair, and the digest of the repaired `role:text` lines.

    Where lost holds a row counts as not there, but its conversation is answered.
    """

    def answer(of: _Conversation) -> Iterator[tuple]:
        cost, audit = cheapest(bytes(of.codes))
        digest, between = hashlib.sha256(), b""
        for _, role, text in of.repaired(audit):
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
        of.texts.drop()
        gaps = of.last - of.first + 1 - of.turns if of.turns else 0
        yield of.name, gaps, of.counts["blank"], of.counts["duplicate"], of.counts["truncated"], of.illegal, cost, audit, digest.hexdigest()

    return _run(rows, lost, names, answer, REPORT, spool)


def repaired(rows: DataFrame, lost: Column | None = None, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), spool: int = SPOOL) -> DataFrame:
    """The repaired conversations: a row for each of their rows, with its place from 0 and the edit that gave it (K, R or I)."""

    def answer(of: _Conversation) -> Iterator[tuple]:
        _, audit = cheapest(bytes(of.codes))
        for place, (edit, role, text) in enumerate(of.repaired(audit)):
            yield of.name, place, edit, role, text
        of.texts.drop()

    return _run(rows, lost, names, answer, TURNS, spool)


def damaged(rows: DataFrame) -> DataFrame:
    """`conversations` with known faults, by crc32 of `conv_id:turn`, modulo 20: 0 loses a row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes its role user."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.encode(F.concat(whole("conv_id"), F.lit(":"), whole("turn")), "UTF-8")) % 20
    x = rows.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"), by.alias("by"))
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    x = x.select("conv_id", "turn", F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("by") == 0).alias("lost"), "by")
    return x.withColumn("copy", F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("by", "copy")
