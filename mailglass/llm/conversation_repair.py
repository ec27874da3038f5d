"""Repair of conversations by weighted interval parsing.

A repaired conversation reads, by its roles' initials, ``(s?(ua)+)?``. The grammar is
in Chomsky normal form: a symbol X(p, q) derives the rows that lead from state p of
that pattern to state q, X(p, q) -> X(p, r) X(r, q). A row alone is derived by keeping
it, giving it another role or deleting it; before and after it stands the closure of
inserted rows. A cell holds, per symbol, the cheapest cost and of its edits the
least spelling (the audit); cells of neighbouring spans combine into the cell of the
joint span, bottom-up by span length: 1, 2, 4, ... rows in a block of 64, then 64
blocks at a time, so a conversation of any length is parsed by many tasks.

Only these spans are needed. For the symbols above every split of a span gives the
same cell, because the state between two neighbours is all they share. And the least
audit of a span is the least of its parts in turn: no cheapest audit of a cell is the
beginning of another one of it, since what follows could only be insertions, which cost.

Order: by turn, nulls first; rows of one turn by role, then by the MD5 of the text.
Defined results: null roles and texts are one space, rows without a conversation id
are one conversation; roles of other initials, and empty ones, are never kept as they
are. Equal rows are rows of their own, all but the first duplicates. An empty table
gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailglass.llm.shared import materialize

BLOCK = 64
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a. The first and the last may end.
STATES = range(4)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")

Cell = dict  # (p, q) -> (cost, audit)


def _closure() -> Cell:
    """Cheapest runs of inserted rows from any state to any other."""
    best = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, q), (cost, audit) in list(best.items()):
            for role in "ua":
                if q in STEPS[role]:
                    way = (p, STEPS[role][q])
                    best[way] = min(best.get(way, (np.inf, "")), (cost + INSERT, audit + "I"))
    return best


def combine(left: Cell, right: Cell) -> Cell:
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            other = right.get((r, q))
            if other:
                total = cost + other[0]
                now = out.get((p, q))
                if now is None or total <= now[0]:
                    found = (total, audit + other[1])
                    out[p, q] = found if now is None else min(now, found)
    return out


INSERTED = _closure()


@lru_cache(maxsize=None)
def leaf(code: str) -> Cell:
    """``code`` is a row's initial, a capital if it is truncated, x if it has to go."""
    row: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if code != "x":
        extra = TRUNCATED * code.isupper()
        for role, cost, edit in ((code.lower(), 0, "K"), ("u", RETYPE, "R"), ("a", RETYPE, "R")):
            for p, q in STEPS[role].items():
                row[p, q] = min(row.get((p, q), (np.inf, "")), (cost + extra, edit))
    return combine(combine(INSERTED, row), INSERTED)


@lru_cache(maxsize=1 << 14)
def parse(codes: str) -> Cell:
    """The cell of at most a block of rows, by the two shorter spans it is made of."""
    if len(codes) == 1:
        return leaf(codes)
    half = 1 << (len(codes) - 1).bit_length() - 1
    return combine(parse(codes[:half]), parse(codes[half:]))


def _together(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


WAYS = [(p, q) for p in STATES for q in STATES]
CELL = "costs array<long>, audits array<string>"


def _as_lists(cell: Cell) -> tuple[list, list]:
    found = [cell.get(way, (None, None)) for way in WAYS]
    return [f[0] for f in found], [f[1] for f in found]


def _columns(cells: list[Cell]) -> list[pa.Array]:
    pairs = [_as_lists(c) for c in cells]
    return [pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([p[1] for p in pairs], pa.list_(pa.string()))]


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [parse(c) for c in batch.column("codes").to_pylist()]
        rest = batch.drop_columns(["codes"])
        yield pa.RecordBatch.from_arrays(rest.columns + _columns(cells), names=rest.schema.names + ["costs", "audits"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [_together([{w: (c, a) for w, c, a in zip(WAYS, part["costs"], part["audits"]) if c is not None} for part in parts]) for parts in batch.column("parts").to_pylist()]
        rest = batch.drop_columns(["parts"])
        yield pa.RecordBatch.from_arrays(rest.columns + _columns(cells), names=rest.schema.names + ["costs", "audits"])


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows with ``at``, their place in the order of all conversations, written.

    Ranges of the sort key are dealt out, not conversations, so one of any length
    spreads over many tasks. Places are dense: a partition's rows follow those of the
    partitions before it.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # parts even equal rows
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.md5(F.col("text").cast("binary")), F.col("tie")]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    rows = materialize(rows.drop("tie").withColumn("place", F.monotonically_increasing_id()))
    part, bits = F.shiftrightunsigned("place", 33).alias("part"), F.lit((1 << 33) - 1)
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))  # as many rows as partitions
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("part", part).join(counts.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part").select(
        "conv_id", "turn", "role", "text", (F.col("before") + F.col("place").bitwiseAND(bits)).alias("at"))


def _initial() -> Column:
    first = F.left(F.col("role"), F.lit(1))
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def faults(rows: DataFrame) -> DataFrame:
    """``fault`` of each row (blank, duplicate, truncated or null) and its ``code``."""
    narrow = rows.select("at", "conv_id", "turn", _initial().alias("initial"), F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).alias("last"),
                         F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("digest"))
    first = narrow.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    narrow = narrow.join(first, "at", "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return narrow.withColumn("fault", fault).withColumn("code", code).drop("last", "digest", "is_first")


def _illegal(left: Column, right: Column) -> Column:
    return (~F.concat(left, right).isin(*LEGAL)).cast("long")


def parse_all(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, begin (its first place), illegal, cost, audit."""
    block = F.floor(F.col("at") / BLOCK).cast("long")
    grouped = rows.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "code", "initial"))).alias("r"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("r", lambda x: x[field]), "")

    grouped = grouped.select("conv_id", "block", F.col("r")[0]["at"].alias("begin"), joined("code").alias("codes"), joined("initial").alias("initials"))
    pair = F.transform(F.sequence(F.lit(1), F.length("initials")), lambda i: F.substring("initials", i, F.lit(2)))
    illegal = F.size(F.filter(pair, lambda x: (F.length(x) == 2) & ~x.isin(*LEGAL))).cast("long")
    grouped = grouped.select("conv_id", "block", "begin", "codes", F.left("initials", F.lit(1)).alias("head"), F.right("initials", F.lit(1)).alias("tail"), illegal.alias("illegal"))
    kind = dict(rows.dtypes)["conv_id"]
    shape = f"conv_id {kind}, block long, begin long, head string, tail string, illegal long, {CELL}"
    cells = grouped.mapInArrow(_parse_blocks, shape)
    last = rows.agg(F.max("at")).first()[0]
    reach = (last or 0) // BLOCK
    while reach:
        reach //= BLOCK
        up = cells.groupBy("conv_id", F.floor(F.col("block") / BLOCK).cast("long").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("block").alias("b"), "begin", "head", "tail", "illegal", "costs", "audits"))).alias("parts"))
        between = F.aggregate(F.sequence(F.lit(1), F.size("parts")), F.lit(0).cast("long"), lambda s, i: s + F.col("parts")[i - 1]["illegal"] + F.when(
            i < F.size("parts"), _illegal(F.col("parts")[i - 1]["tail"], F.col("parts")[i]["head"])).otherwise(0))
        up = up.select("conv_id", "block", F.col("parts")[0]["begin"].alias("begin"), F.col("parts")[0]["head"].alias("head"),
                       F.element_at("parts", -1)["tail"].alias("tail"), between.alias("illegal"), F.transform("parts", lambda p: F.struct(p["costs"].alias("costs"), p["audits"].alias("audits"))).alias("parts"))
        cells = up.mapInArrow(_merge, shape)
    whole = [F.struct(F.col("costs")[WAYS.index((0, q))].alias("cost"), F.col("audits")[WAYS.index((0, q))].alias("audit")) for q in ENDS]
    best = F.array_min(F.filter(F.array(*whole), lambda c: c["cost"].isNotNull()))
    return cells.select("conv_id", "begin", "illegal", best.alias("best")).select("conv_id", "begin", "illegal", "best.cost", "best.audit")


ITEMS = 1 << 16


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each audit as rows, a bounded number at a time."""
    for batch in batches:
        for i, (begin, audit) in enumerate(zip(batch.column("begin").to_pylist(), batch.column("audit").to_pylist())):
            letters = np.frombuffer(audit.encode(), np.uint8)
            kept = letters != ord("D")
            after = kept.sum() - np.cumsum(kept)  # a repaired conversation ends with an assistant, whatever it starts with
            role = np.where(after % 2 == 0, "assistant", "user")
            given = np.isin(letters, (ord("I"), ord("R")))
            own = letters != ord("I")
            at = begin + np.cumsum(own) - 1
            for lo in range(0, len(letters), ITEMS):
                part = slice(lo, lo + ITEMS)
                n = len(letters[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id").slice(i, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(np.arange(lo, lo + n)), pa.array(list(audit[part])),
                     pa.array(role[part].tolist(), pa.string(), mask=~given[part]), pa.array(at[part], mask=~own[part])],
                    names=["conv_id", "item", "edit", "new_role", "at"])


def apply_edits(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """All edits in order: conv_id, item, edit (K, R, D, I), turn, role, text.

    ``role`` is the one after the edit; an inserted row has no turn and an empty text.
    """
    kind = dict(rows.dtypes)["conv_id"]
    # written, as many rows come of one and two joins' sides of them
    edits = materialize(parsed.select("conv_id", "begin", "audit").mapInArrow(_edits, f"conv_id {kind}, item long, edit string, new_role string, at long"))
    own = rows.select("at", "turn", "role", "text")
    done = edits.filter(F.col("at").isNotNull()).join(own, "at").select("conv_id", "item", "edit", "turn", F.coalesce("new_role", "role").alias("role"), "text")
    new = edits.filter(F.col("at").isNull()).select("conv_id", "item", "edit", F.lit(None).cast("long").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    return done.unionByName(new)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per conversation, one row per edit).

    The first has conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit;
    the second is ``apply_edits``. A conversation's audit is one value of it, a letter
    per row; nothing else of it is ever gathered in one place.
    """
    rows = in_order(conversations)
    marked = materialize(faults(rows))
    parsed = materialize(parse_all(marked))
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    counts = marked.groupBy("conv_id").agg(
        F.count("*").alias("rows"), F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")))
    same = counts["conv_id"].eqNullSafe(parsed["conv_id"])
    return counts.join(parsed, same).drop(parsed["conv_id"]).drop("begin"), apply_edits(rows, parsed)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = running = kind = None
    for batch in batches:
        done: list = []
        kind = batch.schema.field("conv_id").type
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line")):
            if running is None or conv != now:
                if running is not None:
                    done.append((now, running.hexdigest()))
                now, running = conv, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(memoryview(line.as_buffer()))
        if done:
            yield _digests(done, kind)
    if running is not None:
        yield _digests([(now, running.hexdigest())], kind)


def _digests(done: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["conv_id", "sha256"])


def digests(edits: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation, ``role:text`` per line.

    A hash is taken in order, so a conversation goes through one task, a batch at a
    time: sorted, never gathered. Conversations without a row left are not returned.
    """
    lines = edits.filter(F.col("edit") != "D").select("conv_id", "item", F.concat_ws(":", "role", "text").alias("line"))
    kind = dict(edits.dtypes)["conv_id"]
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "item").mapInArrow(_digest, f"conv_id {kind}, sha256 string")
