"""Mergeable collectors: folds with a state of any kind, given by the user, in two phases.

Tasks accumulate the rows that they have, sorted by key; the states that come of it are merged in two
levels, first by key and a salt, then by key, and finished. So a key with a third of all rows is
accumulated where its rows are, and what meets in a task is a state for each salt.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

#: keys whose states a task holds at a time; when there are more, it hands its states on
HELD = 10_000


@dataclass(frozen=True)
class Collector:
    """``supplier`` makes an empty state, ``accumulator`` folds rows of one key into it, ``combiner`` merges two states, ``finisher`` makes a row of it.

    Rows and states come in any order, so the order must not matter to the result. The accumulator has rows
    as the values of each column by its name, plain lists. States are pickled between tasks. The
    accumulator and the combiner may change and return their first argument.
    """

    supplier: Callable[[], Any]
    accumulator: Callable[[Any, Mapping[str, Sequence]], Any]
    combiner: Callable[[Any, Any], Any]
    finisher: Callable[[Any], tuple]


def _batch(kinds: list[pa.DataType], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def collect(df: DataFrame, keys: Sequence[str], values: Sequence[str], collector: Collector, schema: str, salts: int = 16) -> DataFrame:
    """(``keys``, columns of ``schema``): the finished state of each key of ``df``; the accumulator sees ``values``.

    Null keys are a key. A table without rows gives none.
    """
    keys = list(keys)
    kinds = [df.schema[k] for k in keys]
    partial = StructType([*kinds, StructField("_salt", IntegerType()), StructField("_state", BinaryType())])
    names, arrow_partial = partial.names, [f.type for f in to_arrow_schema(partial)]

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        salt = TaskContext.get().partitionId() % salts

        def out() -> pa.RecordBatch:
            return _batch(arrow_partial, [(*k, salt, pickle.dumps(s)) for k, s in states.items()], names)

        for b in batches:
            # rows of a key stand together, so a key is a slice of each column
            own = list(zip(*(b.column(k).to_pylist() for k in keys))) if keys else [()] * b.num_rows
            rows, start = {c: b.column(c).to_pylist() for c in values}, 0
            for k, run in groupby(own):
                stop = start + sum(1 for _ in run)
                states[k] = collector.accumulator(states[k] if k in states else collector.supplier(), {c: v[start:stop] for c, v in rows.items()})
                start = stop
            if len(states) > HELD:
                yield out()
                states = {}
        if states:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Any]]:
        now, state = None, None
        for b in batches:
            for *k, pickled in zip(*(b.column(c).to_pylist() for c in (*keys, "_state"))):
                own = pickle.loads(pickled)
                if now is not None and tuple(k) == now:
                    state = collector.combiner(state, own)
                else:
                    if now is not None:
                        yield now, state
                    now, state = tuple(k), own
        if now is not None:
            yield now, state

    def chunks(rows: Iterator[tuple], arrow: list[pa.DataType], out: list[str]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for r in rows:
            part.append(r)
            if len(part) == 1000:
                yield _batch(arrow, part, out)
                part = []
        if part:
            yield _batch(arrow, part, out)

    whole = df.select(*keys, *[c for c in values if c not in keys])
    whole = (whole.sortWithinPartitions(*keys) if keys else whole).mapInArrow(accumulate, partial)
    result = StructType([*kinds, *StructType.fromDDL(schema)])
    arrow_result = [f.type for f in to_arrow_schema(result)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunks(((*k, 0, pickle.dumps(s)) for k, s in merge(batches)), arrow_partial, names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunks(((*k, *collector.finisher(s)) for k, s in merge(batches)), arrow_result, result.names)

    by = keys or [F.lit(0)]
    salted = whole.repartition(parts, *by, "_salt").sortWithinPartitions(*keys, "_salt").mapInArrow(some, partial)
    return salted.repartition(parts, *by).sortWithinPartitions(*(keys or ["_salt"])).mapInArrow(finish, result)


def histogram_collector(width: float, value: str) -> Collector:
    """Counts of values by bucket of ``width``: (buckets array of lower ends, counts); null values are left out."""

    def add(counts: dict[int, int], rows: Mapping[str, Sequence]) -> dict[int, int]:
        for v in rows[value]:
            if v is not None and math.isfinite(v):
                bucket = int(v // width)
                counts[bucket] = counts.get(bucket, 0) + 1
        return counts

    def both(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
        for bucket, n in b.items():
            a[bucket] = a.get(bucket, 0) + n
        return a

    return Collector(dict, add, both, lambda counts: ([k * width for k in sorted(counts)], [counts[k] for k in sorted(counts)]))


def history_collector(name: str, time: str, ready: str, ignored: Sequence[str] = (), state: str | None = None, strict: bool = True) -> Collector:
    """A game's history: start (time of the ready event), number of events, first and last time, and number of ready events.

    Events named in ``ignored`` count for nothing. With ``strict`` a game has ready events at one time only, with
    ``state`` of one initial state, and at least one; anything else is an error. Else the first counts.
    """

    def checked(starts: set, states: set) -> tuple[set, set]:
        if strict and (len(starts) > 1 or len(states) > 1):
            raise ValueError("parts of a game differ in their start or initial state")
        return {min(starts)} if starts else set(), states if strict else set()

    def add(h: dict, rows: Mapping[str, Sequence]) -> dict:
        kept = [i for i, n in enumerate(rows[name]) if n not in ignored]
        if not kept:
            return h
        times, begun = [t for i in kept if (t := rows[time][i]) is not None], [i for i in kept if rows[name][i] == ready]
        starts, states = checked({t for i in begun if (t := rows[time][i]) is not None}, {rows[state][i] for i in begun} if state else set())
        return both(h, {"n": len(kept), "first": min(times, default=None), "last": max(times, default=None), "ready": len(begun), "starts": starts, "states": states})

    def edge(a: int | None, b: int | None, of: Callable) -> int | None:
        return of((x for x in (a, b) if x is not None), default=None)

    def both(a: dict, b: dict) -> dict:
        if not a or not b:
            return a or b
        starts, states = checked(a["starts"] | b["starts"], a["states"] | b["states"])
        return {"n": a["n"] + b["n"], "first": edge(a["first"], b["first"], min), "last": edge(a["last"], b["last"], max), "ready": a["ready"] + b["ready"], "starts": starts, "states": states}

    def done(h: dict) -> tuple:
        if strict and not (h and h["starts"]):
            raise ValueError("a game has no ready event")
        return (min(h["starts"]) if h["starts"] else None, h["n"], h["first"], h["last"], h["ready"]) if h else (None, 0, None, None, 0)

    return Collector(dict, add, both, done)
