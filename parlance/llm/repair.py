"""Repair of the structure of conversations by weighted interval parsing.

A conversation should read, by the initials of its roles, ``(s?(ua)+)?``. Rows are kept, given another
role or deleted, and rows are inserted, at a cost each. The repair grammar is in Chomsky normal form: a
nonterminal ``pq`` derives what leads from state ``p`` of that pattern to state ``q``, by ``pq -> pr rq``, or
by one row with an edit. A span's cell holds for each nonterminal the least (cost, audit), closed under
insertions at both ends. As states stand at both ends of a nonterminal, every cut of a span gives the
same cell, so one cut is enough: cells are combined bottom-up by span length, neighbours in pairs, inside
blocks of WIDTH rows and then, level by level as a Spark job each, of WIDTH blocks.

Of two audits of one span and cost none is a proper prefix of the other, as all it had more would be
insertions, which cost. So the least audit of a span is made of the least audits of its parts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored

BLANKS = " \t\n\x0b\x0c\r"
#: children that a span of the next level has at most
WIDTH = 64
#: turn numbers that are counted through in one task
STRETCH_BITS = 8

REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: faults of a row
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: (state, initial read) -> state; "0" is the start, the other states are the initial read last; "0" and "a" end a conversation
STEPS = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
STATES = "0sua"
LEGAL = {"su", "ua", "au"}

Cell = list  # for each nonterminal None or its least (cost, audit)


def _reach() -> list[tuple[str, str]]:
    pairs = {(p, p) for p in STATES} | {(p, q) for (p, _), q in STEPS.items()}
    while more := {(p, s) for p, q in pairs for r, s in pairs if q == r} - pairs:
        pairs |= more
    return sorted(pairs)


NONTERMINALS = _reach()
_AT = {pq: i for i, pq in enumerate(NONTERMINALS)}
#: places of (pq, pr, rq) in a cell
RULES = [(_AT[p, q], _AT[p, r], _AT[r, q]) for p, q in NONTERMINALS for r in STATES if (p, r) in _AT and (r, q) in _AT]


def join_cells(a: Cell, b: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out: Cell = [None] * len(NONTERMINALS)
    for to, left, right in RULES:
        x, y = a[left], b[right]
        if x is not None and y is not None:
            both = (x[0] + y[0], x[1] + y[1])
            if out[to] is None or both < out[to]:
                out[to] = both
    return out


@functools.cache
def insertions() -> Cell:
    """The cell of no rows: what insertions alone lead to."""
    cell: Cell = [(0, "") if p == q else None for p, q in NONTERMINALS]
    for (p, c), q in STEPS.items():
        if c != "s":
            cell[_AT[p, q]] = (INSERT, "I")
    while (more := join_cells(cell, cell)) != cell:
        cell = more
    return cell


@functools.cache
def row_cell(initial: str, fault: int) -> Cell:
    """The cell of one row, closed under insertions."""
    cell: Cell = [(DELETE, "D") if p == q else None for p, q in NONTERMINALS]
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_OFF * (fault == TRUNCATED)
        for (p, c), q in STEPS.items():
            edits = [(extra, "K")] * (c == initial) + [(REROLE + extra, "R")] * (c != "s")
            if edits:
                cell[_AT[p, q]] = min(edits)
    return join_cells(join_cells(insertions(), cell), insertions())


class Span(NamedTuple):
    """What is known of neighbouring rows of a conversation."""

    cell: Cell
    first: str
    last: str
    low: int | None
    high: int | None
    turns: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int


def row_span(turn: int | None, initial: str, fault: int) -> Span:
    return Span(row_cell(initial if initial in ("s", "u", "a") else "", fault), initial, initial, turn, turn, int(turn is not None), int(fault == BLANK), int(fault == DUPLICATE), int(fault == TRUNCATED), 0)


def join_spans(a: Span, b: Span) -> Span:
    return Span(
        join_cells(a.cell, b.cell), a.first, b.last, b.low if a.low is None else a.low, a.high if b.high is None else b.high,
        a.turns + b.turns - (a.high is not None and a.high == b.low), a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated, a.illegal + b.illegal + (a.last + b.first not in LEGAL),
    )


def combine(spans: list[Span]) -> Span:
    """One span from neighbouring ones, by span length."""
    while len(spans) > 1:
        spans = [join_spans(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def accepted(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(x for p, q in (("0", "0"), ("0", "a")) if (x := cell[_AT[p, q]]) is not None)


KINDS = {"key": pa.string(), "at": pa.int64(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()), "first": pa.string(), "last": pa.string()} | {c: pa.int64() for c in Span._fields[3:]}
NODE = "key string, at long, costs array<long>, audits array<string>, first string, last string, " + ", ".join(f"{c} long" for c in Span._fields[3:])


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, at, ...) rows or spans: one span for each key and block of WIDTH."""
    now, spans = None, []

    def row(now: tuple[str, int], spans: list[Span]) -> tuple:
        s = combine(spans)
        return (*now, [x and x[0] for x in s.cell], [x and x[1] for x in s.cell], *s[1:])

    for b in batches:
        out = []
        names = b.schema.names
        for r in zip(*(c.to_pylist() for c in b.columns)):
            key, at, *rest = r
            if (key, at // WIDTH) != now:
                if spans:
                    out.append(row(now, spans))
                now, spans = (key, at // WIDTH), []
            spans.append(row_span(*rest) if names[2] == "turn" else Span([None if c is None else (c, a) for c, a in zip(*rest[:2])], *rest[2:]))
        if out:
            yield _batch(out, KINDS)
    if spans:
        yield _batch([row(now, spans)], KINDS)


def _level(spans: DataFrame) -> DataFrame:
    """Spans of the next level; rows of a block meet in one task, those of a conversation need not."""
    block = F.floor(F.col("at") / WIDTH)
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(parts, "key", block).sortWithinPartitions("key", "at").mapInArrow(_combined, NODE)


def numbered(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, at): rows of each key counted from 0 by turn (nulls first), role and text, in stretches of turn numbers."""
    seg = F.coalesce(F.shiftright("turn", STRETCH_BITS), F.lit(-(1 << 62)))
    inside = F.row_number().over(_window("key", "seg").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    cut = rows.withColumn("seg", seg).withColumn("inside", inside)
    before = F.sum("n").over(_window("key").orderBy("seg").rowsBetween(-(1 << 63), -1))
    skip = cut.groupBy("key", "seg").agg(F.count("*").alias("n")).select("key", "seg", F.coalesce(before, F.lit(0)).alias("skip"))
    return cut.join(skip, ["key", "seg"]).select("key", "turn", "role", "text", (F.col("skip") + F.col("inside")).alias("at"))


def _window(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (key, at, role, text, ...) with the first fault of each."""
    h = [F.xxhash64("role", "text"), F.xxhash64(F.lit(1), F.col("text"), F.col("role"))]
    hashed = rows.withColumns({"h": h[0], "g": h[1]})
    seen = hashed.groupBy("key", "h", "g").agg(F.min("at").alias("seen"))
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(F.btrim("text", F.lit(BLANKS)) == "", BLANK).when(F.col("at") > F.col("seen"), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return hashed.join(seen, ["key", "h", "g"]).withColumn("fault", fault).drop("h", "g", "seen")


def conversation_key(conv_id: Column) -> Column:
    """A text for each id, and one for null."""
    return F.coalesce(F.concat(F.lit(":"), conv_id.cast("string")), F.lit(""))


def parse(rows: DataFrame) -> DataFrame:
    """(key, cost, audit, low, high, turns, blank, duplicate, truncated, illegal) of each key of ``rows`` (key, at, turn, role, text, fault)."""
    leaves = rows.select("key", "at", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    spans, most = stored(_level(leaves), "spans"), rows.agg(F.max("at")).first()[0] or 0
    while (most := most // WIDTH) > 0:
        spans = stored(_level(spans), "spans")
    ends = [NONTERMINALS.index(x) for x in (("0", "0"), ("0", "a"))]
    best = F.array_min(F.filter(F.array(*[F.struct(F.col("costs")[i].alias("cost"), F.col("audits")[i].alias("audit")) for i in ends]), lambda x: x["cost"].isNotNull()))
    return spans.withColumn("best", best).select("key", "best.cost", "best.audit", *Span._fields[3:])


def edits(parsed: DataFrame) -> DataFrame:
    """(key, place, at, edit, new_role) of the rows that the repaired conversations have: ``at`` is the row kept or given ``new_role``, null for one inserted."""
    kinds = {"key": pa.string(), "place": pa.int64(), "at": pa.int64(), "edit": pa.string(), "new_role": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, audit in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, place, odd = 0, 0, (len(audit) - audit.count("D")) % 2  # an odd number of rows begins with a system row
                for edit in audit:
                    if edit != "D":
                        role = "system" if odd and not place else ("assistant" if (place - odd) % 2 else "user")
                        out.append((key, place, None if edit == "I" else at, edit, role))
                        place += 1
                    at += edit != "I"
                    if len(out) >= 10_000:
                        yield _batch(out, kinds)
                        out = []
            if out:
                yield _batch(out, kinds)

    return parsed.select("key", "audit").mapInArrow(run, "key string, place long, at long, edit string, new_role string")


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows (key, place, edit, role, text) and for each key (key, cost, audit, low, high, turns, blank, duplicate, truncated, illegal) of ``turns`` (conv_id, turn, role, text).

    ``key`` is ``conversation_key`` of conv_id; rows without conv_id are one conversation. Rows go by turn
    (nulls first), ties by role and text; repeated rows are rows. Null roles and texts are one space. Costs,
    faults and the pattern are those of this module; an empty table gives no rows. Other columns are
    ignored. A row's place is counted in stretches of turn numbers and its edits are parsed in blocks, so a
    conversation of any length is shared among tasks; its audit is one value.
    """
    rows = turns.select(conversation_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = stored(with_faults(stored(numbered(rows), "placed-turns")), "turns")
    parsed = stored(parse(placed), "parsed")
    texts = placed.select("key", "at", F.col("role").alias("old_role"), "text")
    role = F.when(F.col("edit") == "K", F.col("old_role")).otherwise(F.col("new_role"))
    repaired = edits(parsed).join(texts, ["key", "at"], "left").select("key", "place", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return repaired, parsed


def conversation_sha256(repaired: DataFrame) -> DataFrame:
    """(key, sha256) of the ``role:text`` lines of each key of ``repaired``. A digest goes from the first byte to the last, so rows of a key pass through one task, a batch at a time."""
    kinds = {"key": pa.string(), "sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            out = []
            for key, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != now:
                    if digest:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode("utf-8", "surrogatepass"))
            if out:
                yield _batch(out, kinds)
        if digest:
            yield _batch([(now, digest.hexdigest())], kinds)

    parts = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = repaired.select("key", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition(parts, "key").sortWithinPartitions("key", "place")
    return dealt.select("key", "line").mapInArrow(run, "key string, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with planted faults, by crc32(``conv_id:turn``) mod 20: 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes its role user. Nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    copies = F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_"))
    return rows.drop("_")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults, repair and digest of each conv_id of ``conversations`` after ``damaged``; nulls, ties, repeats and empty tables as in ``repair_conversations``.

    A conversation without rows after damage has zeros, an empty audit and the digest of an empty text.
    ``gaps`` are turn numbers missing between the first and the last.
    """
    repaired, parsed = repair_conversations(damaged(conversations))
    ids = conversations.groupBy(conversation_key(F.col("conv_id")).alias("key")).agg(F.first("conv_id").alias("conv_id"))
    found = ids.join(parsed, "key", "left").join(conversation_sha256(repaired), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select(
        "conv_id", zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"), *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
