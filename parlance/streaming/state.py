"""Stateful stream processors with typed state, timers and watermarks: pairing of players, and logs between triggers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_typed_state(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store; it is set for queries that this session starts from now on, unless it is."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _by_event_time(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """``event_time`` from ``time`` (microseconds), with a watermark if ``late`` says how late events may come."""
    stamped = events.withColumn("event_time", F.timestamp_micros(time))
    return stamped.withWatermark("event_time", late) if late else stamped


class Pairing(StatefulProcessor):
    """The first players of a game, one for each role, by event time and name.

    State: the earliest join of at most as many players as there are roles, and how often the pairing
    changed. With ``idle_ms`` a game's state goes once the watermark is so long after its last event.
    """

    def __init__(self, roles: Sequence[str], idle_ms: int | None = None) -> None:
        self.roles, self.idle_ms = list(roles), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "player string", "time long")
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {p[0]: t[0] for p, t in self.first.iterator()} if self.first.exists() else {}
        first, latest = dict(before), None
        for b in rows:
            joins = b.dropna(subset=["sender", "time"])
            for player, t in joins.groupby("sender")["time"].min().items():
                first[player] = min(int(t), first.get(player, int(t)))
            latest = max(x for x in (latest, joins["time"].max() if len(joins) else None, 0) if x is not None)
            # a player left out here comes back only with an earlier join
            first = dict(sorted(first.items(), key=lambda x: (x[1], x[0]))[: len(self.roles)])
        for player in before.keys() - first.keys():
            self.first.removeKey((player,))
        for player, t in first.items():
            if before.get(player) != t:
                self.first.updateValue((player,), (t,))
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(latest or 0) // 1000 + self.idle_ms)
        now, was = [p for p, _ in sorted(first.items(), key=lambda x: (x[1], x[0]))], [p for p, _ in sorted(before.items(), key=lambda x: (x[1], x[0]))]
        if len(now) == len(self.roles) and now != was:
            version = (self.version.get()[0] if self.version.exists() else 0) + 1
            self.version.update((version,))
            yield pd.DataFrame({"game": [key[0]] * len(now), "player": now, "role": self.roles, "version": [version] * len(now)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        self.version.clear()
        return iter(())


def live_pairing(joins: DataFrame, roles: Sequence[str], late: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """(game, player, role, version): the players who joined a game first, each time that this is known anew.

    As many distinct players as there are roles pair up. Events may come in any order: a join that
    comes late but was earlier gives a new ``version``, the last of which counts; other joins change
    nothing. Joins without player or time count for nothing; names may hold any character. With
    ``late`` (an interval) joins later than that behind the newest are dropped, and with ``idle_ms``
    besides, games end after so long without events.
    """
    if idle_ms and not late:
        raise ValueError("the end of a game is told by the watermark, so idle_ms needs late")
    with_typed_state(joins.sparkSession)
    mode = "EventTime" if late else "None"
    return _by_event_time(joins, "time", late).groupBy("game").transformWithStateInPandas(Pairing(roles, idle_ms), "game long, player string, role string, version long", "Append", mode)


class Triggered(StatefulProcessor):
    """Events of a source between a start and the next stop event, in order of event time.

    State: whether the log is on, and the events that the watermark has not passed. A timer at the
    earliest of these lets go what the watermark has passed, in order of time and line.
    """

    def __init__(self, start: str, stop: str) -> None:
        self.start, self.stop = start, stop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.on = handle.getValueState("on", "is_on boolean")
        self.waiting = handle.getListState("waiting", "time long, line long, name string")

    def _wait(self, rows: list[tuple]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if rows:
            self.handle.registerTimer(min(r[0] for r in rows) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        more = [(int(t), int(line), None if n is None or n != n else n) for b in rows for t, line, n in zip(b["time"], b["line"], b["name"])]
        if more:
            self.waiting.appendList(more)
            timers = [min(t[0] for t in more) // 1000, *self.handle.listTimers()]
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(min(timers))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()]
        ready = sorted(r for r in waiting if r[0] // 1000 <= passed)
        rest = [r for r in waiting if r[0] // 1000 > passed]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self._wait(rest)
        on, kept = self.on.get()[0] if self.on.exists() else False, []
        for r in ready:
            was, on = on, True if r[2] == self.start else False if r[2] == self.stop else on
            if on or was and r[2] == self.stop:
                kept.append(r)
        self.on.update((on,))
        if kept:
            yield pd.DataFrame({"game": [key[0]] * len(kept), "time": [r[0] for r in kept], "line": [r[1] for r in kept], "name": [r[2] for r in kept]})


def triggered_stream(events: DataFrame, start: str, stop: str, late: str) -> DataFrame:
    """(game, time, line, name) of events (game, time in microseconds, line, name) between a start and the next stop event, both included.

    Events may come in any order as long as they are not later than ``late`` (an interval) behind the
    newest; those are dropped. An event is let go when the watermark has passed it, so the newest wait
    for newer ones. Events without time or line are dropped; null names neither start nor stop.
    """
    with_typed_state(events.sparkSession)
    whole = events.select("game", "time", "line", "name").where("time is not null and line is not null")
    return _by_event_time(whole, "time", late).groupBy("game").transformWithStateInPandas(Triggered(start, stop), "game long, time long, line long, name string", "Append", "EventTime")
