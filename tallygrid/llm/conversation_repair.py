"""Repair of damaged conversations, also of one that holds a large part of all rows.

1. Equal rows of a turn are counted natively, and the first turn of every (conversation,
   role, text digest) is an aggregate, joined back; so duplicates need no window over a
   conversation.  Texts do not travel here, only their digests.
2. The slim rows are dealt by ranges of (conversation, turn, role, digest).  A long
   conversation lies in many ranges; it is cut into blocks of ``BLOCK`` rows, and each block is
   solved by branch-and-bound (``edit_search``), between all states of the role grammar if it
   is a part, from start to end if it is a whole conversation.
3. Blocks and texts meet by conversation and are read in order: the blocks are chained to one
   audit, which is then followed over the texts.  A task holds one audit, a letter a row, and
   one Arrow batch, never a conversation's texts.

The rows of one conversation leave in order because their text is one sequence; that pass
alone is not split.

Defined cases: a NULL role or text counts as one space; NULL turns come first; rows of one turn
are ordered by role and the MD5 of the text, so repeated rows are neighbours; rows with a NULL
conversation id form one conversation; a conversation of which only deletions are left has an
empty text; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edit_search import (
    BLANK,
    DUPLICATE,
    FINE,
    SPOKEN,
    START,
    KEPT,
    TRUNCATED,
    USER,
    Chain,
    ways,
)

BLOCK = 1024
# Rows gathered before a batch is handed on, and bytes of their texts.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_BLOCK = (
    "struct<part:int,seq:int,n:bigint,head:string,tail:string,low:bigint,high:bigint,turns:bigint,"
    "blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,"
    "ways:array<struct<entry:int,leave:int,cost:bigint,audit:string>>>"
)


def _slim(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: copies, fault of the text, and whether the first."""
    bare = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(bare == "", BLANK)
        .when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    )
    each = (
        rows.select("conv_id", "turn", "role", "digest", fault.alias("fault"))
        .groupBy("conv_id", "turn", "role", "digest")
        .agg(F.count("*").alias("copies"), F.first("fault").alias("fault"))
    )
    firsts = each.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct("turn")).alias("first"))
    a, b = each.alias("a"), firsts.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "role", "digest")]
    return a.join(b, same[0] & same[1] & same[2]).select(
        *[f"a.{c}" for c in each.columns],
        F.struct("a.turn").eqNullSafe(F.col("b.first")).alias("first"),
    )


class _Part:
    """The rows of a block of one conversation."""

    def __init__(self):
        self.rows: list[tuple[str, int]] = []
        self.low = self.high = None
        self.turns = 0

    def add(self, initial: str, fault: int, turn: int | None) -> None:
        self.rows.append((initial, fault))
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn

    def packed(self, part: int, seq: int, whole: bool) -> dict:
        initials, faults = zip(*self.rows, strict=True)
        return {
            "part": part, "seq": seq, "n": len(initials), "head": initials[0],
            "tail": initials[-1], "low": self.low, "high": self.high, "turns": self.turns,
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE),
            "truncated": faults.count(TRUNCATED),
            "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])),
            "ways": [dict(zip(("entry", "leave", "cost", "audit"), w, strict=True))
                     for w in ways(self.rows, whole)],
        }


def _blocks(slim: DataFrame, block: int) -> DataFrame:
    """``(conv_id, block)``: blocks of neighbouring rows, numbered in their order."""
    order = ["conv_id", "turn", "role", "digest"]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "copies", "first")
    schema = T.StructType([slim.schema["conv_id"]]).add("block", _parsed(_BLOCK))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        types = _arrow(schema)
        ids: list = []
        packed: list[dict] = []
        held, seq, key, opened = _Part(), 0, None, 0

        def close(whole: bool) -> None:
            nonlocal held, seq
            if held.rows:
                ids.append(key)
                packed.append(held.packed(part, seq, whole))
                held, seq = _Part(), seq + 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, types[0]), pa.array(packed, types[1])], names=schema.names)
            ids.clear()
            packed.clear()
            return batch

        for batch in batches:
            for conv, turn, initial, fault, copies, first in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if not opened or conv != key:
                    # the first conversation of a task may have begun in the task before
                    close(opened > 1 and seq == 0)
                    key, seq, opened = conv, 0, opened + 1
                for copy in range(copies):
                    again = fault != BLANK and (copy or not first)
                    held.add(initial, DUPLICATE if again else fault, turn)
                    if len(held.rows) >= block:
                        close(False)
            if len(ids) >= OUT_ROWS:
                yield out()
        close(False)  # and the last may go on in the next
        yield out()

    return dealt.mapInArrow(work, schema)


def _parsed(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


class _Report:
    """Counts and the audit of one conversation, from its blocks."""

    def __init__(self):
        self.chain = Chain()
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.tail = None
        self.turns = 0

    def add(self, b: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[name] += b[name]
        if self.tail is not None:
            self.counts["illegal"] += (self.tail, b["head"]) not in LEGAL
        self.tail = b["tail"]
        if b["low"] is not None:
            self.turns += b["turns"] - (b["low"] == self.high)
            self.low = b["low"] if self.low is None else self.low
            self.high = b["high"]
        self.chain.add([(w["entry"], w["leave"], w["cost"], w["audit"]) for w in b["ways"]])

    def close(self) -> tuple[list[int], str]:
        if self.low is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        self.counts["cost"], audit = self.chain.best()
        return [self.counts[c] for c in COUNTS], audit


class _Follower:
    """Follows an audit over the rows of a conversation and says what becomes of each."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[str]:
        """Roles of the turns to insert here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = SPOKEN[self.state]
            yield "user" if self.state == USER else "assistant"

    def row(self, role: str) -> tuple[str, str | None]:
        """The edit of the next row and its role afterwards, None where it is deleted."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return edit, None
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            return edit, role
        self.state = SPOKEN[self.state]
        return edit, "user" if self.state == USER else "assistant"


def repair(
    rows: DataFrame,
    ids: DataFrame | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """For each conversation a report row, then its repaired turns, in order.

    The report (``position`` NULL) has the counts ``COUNTS``, and ``audit``: initials of Keep,
    Rerole, Delete and Insert.  A turn has ``position`` from 0, ``edit``, ``turn`` (NULL if
    inserted), ``role`` and ``text``.  Conversations come out whole and in order within a
    partition.  ``ids`` may add conversations of which no row is left.
    """
    clean = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.md5("text")))
    blocks = _blocks(_slim(clean), block)
    named = clean.select("conv_id") if ids is None else ids.select(F.col(conv_id).alias("conv_id"))
    empty = {"block": _BLOCK, "turn": "bigint", "role": "string", "digest": "binary",
             "text": "string"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        return df.select("conv_id", F.lit(kind).alias("kind"), *(
            F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)
            for c, t in empty.items()))

    met = (
        shaped(named.distinct(), 0).unionByName(shaped(blocks, 1)).unionByName(shaped(clean, 2))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", "block.part", "block.seq", "turn", "role", "digest")
        .select("conv_id", "kind", "block", "turn", "role", "text")
    )
    schema = T.StructType([met.schema["conv_id"]])
    for name in COUNTS:
        schema.add(name, T.LongType())
    for name, kind in (("audit", T.StringType()), ("position", T.LongType()),
                       ("edit", T.StringType()), ("turn", T.LongType()),
                       ("role", T.StringType()), ("text", T.StringType())):
        schema.add(name, kind)
    return met.mapInArrow(_followed(schema), schema)


def _followed(schema: T.StructType) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _arrow(schema)
        out: list[tuple] = []
        size = 0
        report: _Report | None = None
        follower: _Follower | None = None
        key, position, begun = None, 0, False

        def turn_row(edit: str, turn: int | None, role: str, text: str) -> None:
            nonlocal position, size
            out.append((key, *(None,) * (len(COUNTS) + 1), position, edit, turn, role, text))
            position, size = position + 1, size + len(text)

        def tell() -> None:
            nonlocal report, follower
            if report is not None:
                counts, audit = report.close()
                out.append((key, *counts, audit, *(None,) * 5))
                report, follower = None, _Follower(audit)

        def insert() -> None:
            for role in follower.inserted():
                turn_row("I", None, role, "")

        def close() -> None:
            if begun:
                tell()
                insert()

        def batch_of() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=schema.names)

        for batch in batches:
            for conv, kind, block, turn, role, text in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if not begun or conv != key:
                    close()
                    key, position, begun, report = conv, 0, True, _Report()
                if kind == 1:
                    report.add(block)
                elif kind == 2:
                    tell()
                    insert()
                    edit, spoken = follower.row(role)
                    if spoken is not None:
                        turn_row(edit, turn, spoken, text)
                if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                    yield batch_of()
        close()
        yield batch_of()

    return work


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the stated damage: by ``crc32(conv_id:turn) % 20`` a row is 0 dropped,
    1 emptied, 2 stripped of its sentence ends, 3 repeated, 4 given the role of a user."""
    said = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" "))
                              for c in ("conv_id", "turn")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                    (F.crc32(said) % 20).alias("_kind"))
        .filter("_kind <> 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_kind") == 1, "")
            .when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
            .alias("_copy"),
        )
        .drop("_copy")
    )
