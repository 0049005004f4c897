"""Conversations brought into the order (system? (user assistant)+)? by the cheapest edits.

Rows of a conversation go by turn (nulls first), then role and text. A row's first fault
counts: blank (white space alone), duplicate (role and text seen earlier), truncated (does not
end in `.`, `!` or `?`). Blank and duplicate rows are deleted; otherwise a row is kept, gets
the role user or assistant, or is deleted, and empty rows are put in. `audit_paths` finds the
cheapest edits; ties go to the audit that is first in ASCII order.

Conversations are streamed: Spark sorts the rows, a task holds one Arrow batch and the audits
of one conversation (a byte per row, and the edits not yet common to all candidates).
A second pass over the sorted rows applies the audits. Duplicates are found by an aggregate of
(conv_id, role, text's digest), so no task keeps the texts of a conversation.

Null roles and texts are one space. Null conv_ids form one conversation. Repeated rows are
duplicates. An empty table has no conversations. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.audit_paths import BLANK, DUPLICATE, FINE, ROLES, TRUNCATED, Cheapest, Rewriter
from larder.llm.staging import staged

LEGAL = ("su", "ua", "au")
# White space of the word rule.
_SPACE = r"\x20\x09-\x0D"
_ORDER = ("conv_id", "turn", "role", "text")


def cleaned(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: nulls in role and text are one space."""
    blank = F.lit(" ")
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of `cleaned`, a quarter of them damaged by the crc32 of conv_id:turn modulo 20.

    0 drops a row, 1 empties its text, 2 takes its `.`, `!` and `?` away, 3 repeats it, 4 makes it
    the user's. A null in the key is one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(part("conv_id"), F.lit(":"), part("turn"))
    rows = turns.withColumn("damage", F.crc32(key) % 20).filter("damage != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _fault(repeated: Column) -> Column:
    """The row's fault; a repeat at the turn of the first one is told by its neighbour in order."""
    return (
        F.when(~F.col("text").rlike(f"[^{_SPACE}]"), BLANK)
        .when(repeated, DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*+\z"), TRUNCATED)
        .otherwise(FINE)
    )


def signed(rows: DataFrame) -> DataFrame:
    """The rows with their fault.

    A text said at several turns is a duplicate behind the first of them. The list of such texts
    is joined; where it is long, Spark shuffles it and splits its skewed keys.
    """
    digest = F.sha2("text", 256)
    said = rows.groupBy("conv_id", "role", digest.alias("digest")).agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.max(F.col("turn").isNull()).alias("unnumbered")
    )
    # Null turns come first.
    often = said.filter("least < most OR unnumbered AND most IS NOT NULL").select(
        F.col("conv_id").alias("of"), F.col("role").alias("by"), "digest", F.when(~F.col("unnumbered"), F.col("least")).alias("first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (digest == F.col("digest"))
    later = F.col("of_key").isNotNull() & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("turn") > F.col("first")))
    joined = rows.join(often.withColumn("of_key", F.lit(True)), same, "left")
    return joined.select(*_ORDER, _fault(later).alias("fault"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation in one partition, one after another, in the order of its rows."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "text")


class _Judged:
    """One conversation's counts and cheapest audit, row by row."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.counts = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, FINE: 0}
        self.illegal, self.turns, self.least, self.last, self.row = 0, 0, None, None, None
        self.paths = Cheapest()

    def push(self, turn: int | None, role: str, text: str, fault: int) -> None:
        row = (turn, role, text)
        if fault in (FINE, TRUNCATED) and row == self.row:
            fault = DUPLICATE
        if self.row is not None and self.row[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last = turn
        self.row = row
        self.counts[fault] += 1
        self.paths.push(fault * 4 + max(0, ROLES.find(role[:1] or "?")))

    def result(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        cost, audit = self.paths.result()
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, cost, audit)


_JUDGED = pa.schema([
    *((c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
])
_JUDGED_COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _JUDGED)], schema=_JUDGED)
        out.clear()
        return made

    now: _Judged | None = None
    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.append(now.result())
                now = _Judged(conv_id)
            now.push(turn, role, text, fault)
        if out:
            yield batch_of()
    if now is not None:
        out.append(now.result())
        yield batch_of()


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row per conversation of `cleaned` rows."""
    return _in_order(signed(rows)).select(*_ORDER, "fault").mapInArrow(_judge, _JUDGED_COLUMNS)


def _rewritten(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows in order, each conversation led by its audit in the place of a text."""
    none = F.lit(None)
    heads = judged.select("conv_id", F.lit(0).alias("is_row"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    body = rows.select("conv_id", F.lit(1).alias("is_row"), "turn", "role", "text")
    return _in_order(heads.union(body), "is_row").select("conv_id", "is_row", "role", "text")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str | None]]:
    """(conv_id, role, text) of repaired rows; (conv_id, None, None) ends a conversation."""
    conv_id, rewriter = None, None
    for batch in batches:
        for key, is_row, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if is_row:
                for new in rewriter.row(role, text):
                    yield key, *new
                continue
            if rewriter is not None:
                for new in rewriter.inserted():
                    yield conv_id, *new
                yield conv_id, None, None
            conv_id, rewriter = key, Rewriter(text)
    if rewriter is not None:
        for new in rewriter.inserted():
            yield conv_id, *new
        yield conv_id, None, None


# Repaired rows of a batch, and the code points of text beyond which it is closed.
_ROWS, _CHARS = 5_000, 8_000_000


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out, size, place = [], 0, 0
    for conv_id, role, text in _rewrite(batches):
        if role is None:
            place = 0
            continue
        out.append((conv_id, place, role, text))
        place, size = place + 1, size + len(text)
        if len(out) >= _ROWS or size >= _CHARS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the rows of the repaired conversations."""
    rows = cleaned(turns)
    return _rewritten(rows, audits(rows)).mapInArrow(_listed, "conv_id long, place long, role string, text string")


def _digests_of(out: list[tuple[int | None, str]]) -> pa.RecordBatch:
    ids, hashes = zip(*out)
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["of", "repaired_sha256"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int | None, str]] = []
    digest, first = hashlib.sha256(), True
    for conv_id, role, text in _rewrite(batches):
        if role is None:
            out.append((conv_id, digest.hexdigest()))
            digest, first = hashlib.sha256(), True
            if len(out) >= _ROWS:
                yield _digests_of(out)
                out = []
            continue
        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False
    if out:
        yield _digests_of(out)


def digests(turns: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row per conv_id of the table.

    With damage, the rows are damaged first; conversations left without rows have zeros, an empty
    audit and the digest of nothing.
    """
    all_rows = cleaned(turns)
    rows = damaged(all_rows) if damage else all_rows
    judged = staged(audits(rows), "audits")
    hashes = _rewritten(rows, judged).mapInArrow(_hashed, "of long, repaired_sha256 string")
    ids = all_rows.select(F.col("conv_id").alias("id")).distinct()
    found = ids.join(judged, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
