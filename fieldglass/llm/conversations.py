"""Conversation structure repair: the cheapest edits that make every conversation a sound exchange, streamed in turn order.

A row is faulty if it is blank (nothing but blank and 0x09-0x0D), else if it repeats the role and text of an earlier row, else
if it is truncated (its last solid character ends no sentence). A sound conversation has the role initials
``(s?(ua)+)?``. Keep costs 0, Rerole (to user or assistant) 2, Delete 3 (blank and repeated rows must go), Insert (an empty
user or assistant row, anywhere) 2; a truncated row that stays adds 1. Of equally cheap repairs the one whose edits'
initials come first in ASCII is taken.

Rows are dealt by conversation and sorted by turn within partitions, last turn first; the stream carries the least
costs to go from the row on, one for each state of the pattern, across Arrow batches. Each row leaves one byte with the four
states' best edits. At a conversation's first row the edits are read forward from these bytes. What a conversation
holds beyond ``HELD`` bytes (bytes of edits with the texts) is written to the shared folder and read back from the end on.

Scale: one shuffle of the texts. Whether a row repeats one of an earlier turn is known beforehand from an aggregate over hashes
by conversation, whose (few) results are joined; within a turn equal rows are neighbours. A task's memory is bounded also for a
conversation with a third of all rows. Its output is a row a conversation (``audit_conversations``) or a row a repaired row
(``repair_conversations``).

Defined cases: nulls in conv_id, turn, role and text: null turns come first; a null role or text stands for one blank; rows of
a null conv_id are one conversation. Rows of a turn go by role, then text. Roles that don't begin with s, u or a can't be
kept. A conversation without rows has empty results. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import pickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import Scratch, arrow, shuffle_width, table
from fieldglass.llm.files import read_file, write_file

#: Bytes of one conversation that a task holds.
HELD = 8 << 20
SOLID = r"[^\x20\x09-\x0D]"
#: States: 0 nothing so far, 1 after s, 2 after u, 3 after a. What an initial leads to, and what a row by choice does.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = (2, 2, 3, 2)
DELETE, INSERT, KEEP, REROLE = range(4)
LETTER = "DIKR"
#: Costs to go behind the last row: insertions that complete the pattern.
END = (0, 4, 2, 0)
END_EDIT = (None, INSERT, INSERT, None)


def costs_before(costs: tuple, initial: str, gone: bool, truncated: bool) -> tuple[tuple, int]:
    """(costs to go from the row on, a byte of the states' best edits) from the costs behind the row."""
    cost, edit = [], []
    for s in range(4):
        best = (costs[s] + 3, DELETE)
        if not gone:
            kept = AFTER[s].get(initial)
            if kept is not None:
                best = min(best, (costs[kept] + truncated, KEEP))
            best = min(best, (costs[TURN[s]] + 2 + truncated, REROLE))
        cost.append(best[0])
        edit.append(best[1])
    plain = list(cost)
    for _ in range(2):  # an insertion ahead of the row, from the last state to the first one
        for s in (3, 2, 1, 0):
            if (cost[TURN[s]] + 2, INSERT) < (cost[s], edit[s]):
                cost[s], edit[s] = cost[TURN[s]] + 2, INSERT
        if cost == plain:
            break
    return tuple(cost), edit[0] | edit[1] << 2 | edit[2] << 4 | edit[3] << 6


class _Conversation:
    """The rows of one conversation, last one first, with the state of the dynamic program."""

    def __init__(self, folder: str, held: int):
        self.folder, self.held, self.rows, self.size, self.files = folder, held, [], 0, []
        self.costs = END
        self.count = {"rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = None
        self.turns = 0
        self.next = None  # initial of the row behind

    def add(self, turn, role: str, text: str, times: int, blank: bool, again: bool, truncated: bool) -> None:
        """``times`` copies of a row, of which all but the first repeat it; ``again``: the first one does as well."""
        if turn is not None and turn != self.low:
            self.low, self.turns = turn, self.turns + 1
            self.high = turn if self.high is None else self.high
        initial = role[:1]
        for k in range(times, 0, -1):
            repeats = not blank and (again or k > 1)
            cut = not blank and not repeats and truncated
            self.costs, edits = costs_before(self.costs, initial, blank or repeats, cut)
            c = self.count
            c["rows"] += 1
            c["blank"] += blank
            c["duplicate"] += repeats
            c["truncated"] += cut
            if self.next is not None and initial + self.next not in ("su", "ua", "au"):
                c["illegal"] += 1
            self.next = initial
            self.rows.append((edits, role, text))
            self.size += len(role) + len(text) + 120
        if self.size > self.held:
            self.files.append(write_file(self.folder, "turns", [pickle.dumps(self.rows, 5)]))
            self.rows, self.size = [], 0

    def _forward(self):
        yield from reversed(self.rows)
        for path in reversed(self.files):
            yield from reversed(pickle.loads(read_file(self.folder, path)))

    def repaired(self):
        """(edit's initial, role, text) in order; role and text are None where a row is deleted."""
        s = 0
        for edits, role, text in self._forward():
            while (e := edits >> 2 * s & 3) == INSERT:
                s = TURN[s]
                yield "I", "user" if s == 2 else "assistant", ""
            if e == DELETE:
                yield "D", None, None
                continue
            s = AFTER[s][role[:1]] if e == KEEP else TURN[s]
            yield LETTER[e], role if e == KEEP else "user" if s == 2 else "assistant", text
        while END_EDIT[s] is not None:
            s = TURN[s]
            yield "I", "user" if s == 2 else "assistant", ""

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


AUDIT = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, position long, edit string, role string, text string"


def _conversations(folder: str, most: int, batches):
    """Each conversation of a stream sorted by it. Rows of one turn are neighbours, so equal ones among them are as well."""
    now, key, held = None, None, None

    def flush():
        if held is not None:
            now.add(*held)

    for b in batches:
        for conv, turn, role, text, times, blank, again, truncated in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or conv != key:
                if now is not None:
                    flush()
                    yield key, now
                now, key, held = _Conversation(folder, most), conv, None
            if not times:
                continue
            if held is not None and held[:3] == (turn, role, text):
                held = (*held[:3], held[3] + times, *held[4:])
            else:
                flush()
                held = (turn, role, text, times, blank, again, truncated)
    if now is not None:
        flush()
        yield key, now


def _audits(folder: str, held: int):
    def run(batches):
        import pyarrow as pa

        names = [c.split(" ")[0] for c in AUDIT.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in AUDIT.split(", ")]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names)

        rows, size = [], 0
        for key, c in _conversations(folder, held, batches):
            digest, edits, first = hashlib.sha256(), [], True
            for edit, role, text in c.repaired():
                edits.append(edit)
                if role is not None:
                    digest.update((("" if first else "\n") + f"{role}:{text}").encode())
                    first = False
            n = c.count
            rows.append((key, n["rows"], c.gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], c.costs[0], "".join(edits), digest.hexdigest()))
            size += len(edits) + 200
            if size > 1 << 20:
                yield made(rows)
                rows, size = [], 0
        yield made(rows)

    return run


def _rows(folder: str, held: int):
    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], ["conv_id", "position", "edit", "role", "text"])

        rows, size = [], 0
        for key, c in _conversations(folder, held, batches):
            position = 0
            for edit, role, text in c.repaired():
                if role is None:
                    continue
                rows.append((key, position, edit, role, text))
                position, size = position + 1, size + len(text) + 60
                if size > 4 << 20:
                    yield made(rows)
                    rows, size = [], 0
        yield made(rows)

    return run


def _stream(rows: DataFrame, times: str | None, scratch: Scratch) -> DataFrame:
    """Rows by conversation, last turn first, with their faults. ``times``: a column that says how often a row stands there."""
    blank_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank_or("role").alias("role"), blank_or("text").alias("text"), (F.col(times).cast("int") if times else F.lit(1)).alias("times"))
    r = r.withColumn("blank", ~F.col("text").rlike(SOLID))
    end = F.expr(r"right(trim(trailing ' \t\n\u000b\u000c\r' from text), 1)")
    r = r.withColumn("truncated", ~F.col("blank") & ~end.isin(".", "!", "?")).withColumn("h", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "text", "role"))
    # of rows that recur in other turns the first turn, as (is not null, turn)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = r.where("times > 0 and not blank").groupBy(F.col("conv_id").alias("c"), F.col("h").alias("a"), F.col("h2").alias("a2")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    again = scratch.put(again, "again")  # written, so that its measured size decides the join ahead of any shuffle of texts
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("a")) & (F.col("h2") == F.col("a2"))
    r = r.join(again, same, "left").select("conv_id", "turn", "role", "text", "times", "blank", (F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))).alias("again"), "truncated")
    order = ["conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()]
    return r.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions(*order)


def audit_conversations(rows: DataFrame, times: str | None = None, held: int = HELD) -> DataFrame:
    """A row for each conv_id of the rows (conv_id, turn, role, text): n_rows, gaps (turns missing between the least and the
    largest), rows by first fault (blank, duplicate, truncated), illegal (neighbours whose roles can't follow each
    other), cost, audit (the edits' initials in order) and the digest of the repaired ``role:text`` lines."""
    scratch = Scratch(rows.sparkSession, "turns")
    return _stream(rows, times, scratch).transform(arrow, _audits(scratch.path("files"), held), AUDIT)


def repair_conversations(rows: DataFrame, times: str | None = None, held: int = HELD) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), edit (I, K or R), role, text."""
    scratch = Scratch(rows.sparkSession, "turns")
    return _stream(rows, times, scratch).transform(arrow, _rows(scratch.path("files"), held), REPAIRED)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with planted faults by crc32 of ``conv_id:turn`` modulo 20, and ``times``: 0 where a row is dropped, 2 where it
    stands twice."""
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    r = rows.select("conv_id", "turn", word("role").alias("role"), text.alias("text"), fault.alias("fault"))
    return r.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("times"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(damaged(table(spark, sf_dir, "conversations")), times="times").drop("n_rows")
