"""Conversation structure repair: a fold over each conversation's turns that carries the cheapest edits for four states.

Rows are looked at in order of turn (null first); rows of one turn in order of role, then of the text's MD5. A row's first
fault counts: blank, duplicate (its role and text stood earlier), truncated (its last visible character ends no sentence).
Edits make the role initials read `(s?(ua)+)?`: keep (0), rerole to user or assistant (2), delete (3, the only choice for
blank and duplicate rows), insert an empty user or assistant turn (2); a truncated row that stays adds 1. Among the
cheapest the audit (initials D, I, K, R in order) that is least in ASCII is taken.

How it holds: the fold sees no text, only flags from windows, and works on runs of at most FOLD rows. A run is folded from
each state it may begin in, which makes it a 4 x 4 table of (cost, audit); a second fold chains the tables of a
conversation, so a long conversation is spread over BLOCK turns a window and FOLD rows a list. Two paths of equal cost
over the same rows never are prefixes of each other (a longer audit holds an insertion more, which costs), so the least
of two audits stays the least whatever is appended. Repeated rows are counted before they travel; all but the first are
deleted. The repaired texts are put together in one pass over rows sorted by conversation, streamed and never collected.

Defined results: null role and text are one space, so such rows are blank; null turns come first and count in no gap; the
null conversation is one conversation. Rows of no conversation fail nothing: an empty table gives no rows. Extra columns
are ignored. A conversation's audit is one value, so a conversation may have as many turns as a string has characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import arrow
from tarn.llm.interactions import BLANKS

#: Turns whose rows share a window; a conversation of more is several.
BLOCK = 1024
#: Rows in one list of the first fold.
FOLD = 256
#: States: nothing yet, after a first system turn, after a user turn, after an assistant turn.
STATES = range(4)
_CELL = "struct<cost:bigint,audit:string>"
_STATE = f"struct<{','.join(f's{s}:{_CELL}' for s in STATES)}>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) after the damage that crc32(conv_id:turn) % 20 chooses."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    return conversations.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), kind.alias("kind")).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns for conversations as they are."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def faults(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text) with its place and faults; texts are left behind as digests.

    blank, truncated: of the text. live: neither blank nor a repetition. dead: copies that must go. illegal: neighbours
    within the block whose initials may not follow each other. fresh: first of its turn. All from windows over blocks.
    """
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = (
        rows.select("conv_id", "turn", "role", _digest().alias("digest"), (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies")
        .groupBy("conv_id", "turn", "role", "digest", "blank", "truncated")
        .agg(F.sum("copies").cast("long").alias("copies"))
        .withColumn("block", F.floor(F.col("turn") / BLOCK))
    )
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("copies") == 0, F.col("turn").asc_nulls_first())
    here = Window.partitionBy("conv_id", "block").orderBy(F.col("copies") == 0, *order)
    initial = F.substring("role", 1, 1)
    there = F.col("copies") > 0
    before = F.lag("initial").over(here)
    pair = before.isNotNull() & ~F.concat(before, F.col("initial")).isin("su", "ua", "au")
    return (
        light.withColumn("live", there & ~F.col("blank") & (F.row_number().over(same) == 1))
        .withColumn("initial", initial)
        .withColumn("place", F.row_number().over(here))
        .withColumn("illegal", F.when(there, F.col("copies") - 1 + pair.cast("long")).otherwise(0))
        .withColumn("fresh", there & F.col("turn").isNotNull() & F.coalesce(F.lag("turn").over(here) != F.col("turn"), F.lit(True)))
        .withColumn("dead", F.col("copies") - F.col("live").cast("long"))
    )


def _reach(state: Column, into: int, row: Column) -> Column:
    """The cheapest way into a state over one row (live, dead, initial, truncated) from a struct of four cells."""
    tail = F.repeat(F.lit("D"), row["dead"].cast("int"))
    rest = 3 * row["dead"]

    def way(source: int, cost: Column, edits: Column, when: Column | None = None) -> Column:
        cell = state[f"s{source}"]
        ok = cell.isNotNull() if when is None else cell.isNotNull() & when
        return F.when(ok, F.struct((cell["cost"] + cost + rest).alias("cost"), F.concat(cell["audit"], edits, tail).alias("audit")))

    ways = [way(into, F.when(row["live"], 3).otherwise(0), F.when(row["live"], "D").otherwise(""))]
    open_end = row["truncated"].cast("long")
    if into == 1:
        ways.append(way(0, open_end, F.lit("K"), row["live"] & (row["initial"] == "s")))
    if into >= 2:
        own = row["initial"] == ("u" if into == 2 else "a")
        cost, letter = open_end + F.when(own, 0).otherwise(2), F.when(own, "K").otherwise("R")
        for source, inserted in ({0: "", 1: "", 2: "I", 3: ""} if into == 2 else {0: "I", 1: "I", 2: "", 3: "I"}).items():
            ways.append(way(source, cost + 2 * len(inserted), F.concat(F.lit(inserted), letter), row["live"]))
    return F.least(*ways) if len(ways) > 1 else ways[0]


def _start(state: int) -> Column:
    cells = [F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")).alias(f"s{s}") if s == state else F.lit(None).cast(_CELL).alias(f"s{s}") for s in STATES]
    return F.struct(*cells).cast(_STATE)


def _folded(rows: Column, state: int) -> Column:
    """aggregate() over the sorted rows of a run, from one state."""
    return F.aggregate(rows, _start(state), lambda acc, row: F.struct(*[_reach(acc, s, row).alias(f"s{s}") for s in STATES]).cast(_STATE))


def _chained(tables: Column) -> Column:
    """aggregate() over the tables of a conversation's runs: the (least, append) product, from the empty state."""

    def step(acc: Column, table: Column) -> Column:
        out = []
        for s in STATES:
            ways = []
            for via in STATES:
                cell, more = acc[f"s{via}"], table[f"f{via}"][f"s{s}"]
                ways.append(F.when(cell.isNotNull() & more.isNotNull(), F.struct((cell["cost"] + more["cost"]).alias("cost"), F.concat(cell["audit"], more["audit"]).alias("audit"))))
            out.append(F.least(*ways).alias(f"s{s}"))
        return F.struct(*out).cast(_STATE)

    return F.aggregate(tables, _start(0), step)


def _ended(state: Column) -> Column:
    """The cheapest cell with which a conversation may end, the pair that it lacks inserted."""
    close = lambda s, more: F.when(state[f"s{s}"].isNotNull(), F.struct((state[f"s{s}"]["cost"] + 2 * len(more)).alias("cost"), F.concat(state[f"s{s}"]["audit"], F.lit(more)).alias("audit")))
    return F.least(close(0, ""), close(1, "II"), close(2, "I"), close(3, ""))


def summary(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation of rows, dropped ones included."""
    there = F.col("copies") > 0
    item = F.struct("place", "live", "dead", "initial", "truncated")
    count = lambda c: F.coalesce(F.sum(F.when(there, c)), F.lit(0))
    ends = lambda f: f(F.when(there, F.struct("place", "initial")))["initial"]
    runs = (
        faults(rows)
        .groupBy("conv_id", "block", F.floor((F.col("place") - 1) / FOLD).alias("run"))
        .agg(
            F.array_sort(F.collect_list(F.when(there, item))).alias("rows"),
            *[f(F.when(there, F.col("turn"))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))],
            F.count(F.when(F.col("fresh"), 1)).alias("turns"),
            count(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            count(F.when(F.col("blank"), 0).otherwise(F.col("dead"))).alias("duplicate"),
            F.count(F.when(F.col("live") & F.col("truncated"), 1)).alias("truncated"),
            F.sum("illegal").alias("illegal"),
            ends(F.min).alias("opens"),
            ends(F.max).alias("closes"),
        )
    )
    # a block's first run alone may begin a conversation with nothing before it; the others are folded from every state
    first = F.col("run") == 0
    later = Window.partitionBy("conv_id").orderBy(F.col("opens").isNull(), F.col("block").asc_nulls_first(), "run")
    lone = F.col("nth") == 1
    seam = F.lag("closes").over(later)
    folded = (
        runs.withColumn("nth", F.row_number().over(later))
        .withColumn("seam", (first & seam.isNotNull() & ~F.concat(seam, F.col("opens")).isin("su", "ua", "au")).cast("long"))
        .withColumn("table", F.struct(*[(_folded(F.col("rows"), s) if s == 0 else F.when(~lone, _folded(F.col("rows"), s))).alias(f"f{s}") for s in STATES]))
    )
    whole = folded.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.coalesce(F.sum("seam"), F.lit(0))).cast("long").alias("illegal"),
        F.array_sort(F.collect_list(F.struct("nth", "table"))).alias("tables"),
    )
    end = _ended(_chained(F.col("tables")["table"]))
    return whole.withColumn("end", end).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Repair:
    """Walks an audit along the rows of one conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _next(self) -> str:
        self.state, role = (3, "assistant") if self.state == 2 else (2, "user")
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._next(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            if role[:1] == "s":
                self.state = 1
            else:
                self._next()
            yield role, text
        elif edit == "R":
            yield self._next(), text


def _sorted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's summary followed by its rows in order, conversations whole within a partition."""
    none = lambda df, *kept: [F.lit(None).cast(t).alias(n) for n, t in df if n not in kept]
    heads = found.select("conv_id", F.lit(0).alias("kind"), *none([("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"), ("copies", "int")]), "audit", *_COUNTS)
    body = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long"), "role", _digest().alias("digest"), "text", F.col("copies").cast("int"), F.lit(None).cast("string").alias("audit"), *[F.lit(None).cast("long").alias(c) for c in _COUNTS])
    return heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")


def repaired(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations as rows: conv_id, place (from 0), role, text. found: summary(rows) if it is known."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv, place = None, None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if walk is not None:
                        for role, text in walk.inserted():
                            out.append((conv, place, role, text))
                            place += 1
                    walk, conv, place = _Repair(r["audit"]), r["conv_id"], 0
                    continue
                for _ in range(r["copies"]):
                    for role, text in walk.row(r["role"], r["text"]):
                        out.append((conv, place, role, text))
                        place += 1
            yield _rows(out, batch)
        if walk is not None and (rest := [(conv, place + i, role, text) for i, (role, text) in enumerate(walk.inserted())]):
            yield _rows(rest, batch)

    def _rows(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        types = [like.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv_id", "place", "role", "text"])

    return arrow(_sorted(rows, summary(rows) if found is None else found), run, f"conv_id {kind.simpleString()}, place long, role string, text string")


def repair(rows: DataFrame) -> DataFrame:
    """summary(rows) with repaired_sha256, the digest of the repaired `role:text` lines, hashed as the rows stream by."""
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = head = sha = types = None
        empty = True

        def add(turns: Iterator[tuple[str, str]]) -> None:
            nonlocal empty
            for role, text in turns:
                sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False

        for batch in batches:
            types = [batch.schema.field(n).type for n in names[:-1]] + [pa.string()]
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if walk is not None:
                        add(walk.inserted())
                        out.append((*head, sha.hexdigest()))
                    walk, sha, empty = _Repair(r["audit"]), hashlib.sha256(), True
                    head = [r[n] for n in names[:-1]]
                    continue
                for _ in range(r["copies"]):
                    add(walk.row(r["role"], r["text"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        if walk is not None:
            add(walk.inserted())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*head, sha.hexdigest()), types, strict=True)], names)

    schema = f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return arrow(_sorted(rows, summary(rows)), run, schema)
