"""Streams against plain folds: events that are late, repeated, out of order, or have odd names."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from parlance.streaming import live, state

SECOND = 1_000_000


def feed(spark, folder, batches):
    """A stream of files, one for each batch, in their order."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        path = f"{folder}/{i:03}.json"
        with open(path, "w") as f:
            f.writelines(json.dumps(dict(zip(("game", "time", "line", "name", "sender"), r))) + "\n" for r in rows)
        stamp = time.time() - 1000 + i
        os.utime(path, (stamp, stamp))
    return spark.readStream.schema(live.EVENT).option("maxFilesPerTrigger", 1).json(folder)


def test_pairing_with_odd_names_and_repeats(spark, tmp_path):
    batches = [
        [(1, 5, 1, "join", "b\nad\tname"), (1, 5, 2, "join", "b\nad\tname"), (2, 1, 3, "join", "x")],
        [(1, 7, 4, "join", "late"), (1, 9, 5, "join", "out"), (2, 2, 6, "join", None), (2, None, 7, "join", "y")],
        [(1, 3, 8, "join", "late"), (1, 8, 9, "join", "out")],
        [(1, 1, 10, "join", ""), (2, 4, 11, "join", "'quoted\"")],
    ]
    found = live.drain(state.live_pairing(feed(spark, f"{tmp_path}/in", batches), ("first", "second")), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    got = {}
    for r in found:
        got.setdefault((r.game, r.version), {})[r.role] = r.player
    odd = "b\nad\tname"
    assert got == {(1, 1): {"first": odd, "second": "late"}, (1, 2): {"first": "late", "second": odd}, (1, 3): {"first": "", "second": "late"}, (2, 1): {"first": "x", "second": "'quoted\""}}


def test_pairing_ends_idle_games(spark, tmp_path):
    at = lambda s: s * SECOND
    batches = [[(1, at(1), 1, "join", "a")], [(2, at(100), 2, "join", "z")], [(3, at(101), 3, "join", "z")], [(1, at(200), 4, "join", "b"), (2, at(1), 5, "join", "y")], [(1, at(201), 6, "join", "c")]]
    found = live.drain(state.live_pairing(feed(spark, f"{tmp_path}/in", batches), ("first", "second"), late="5 seconds", idle_ms=10_000), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert sorted((r.game, r.role, r.player) for r in found) == [(1, "first", "b"), (1, "second", "c")]  # a was forgotten; y came too late
    with pytest.raises(ValueError):
        state.live_pairing(feed(spark, f"{tmp_path}/in2", batches), ("first", "second"), idle_ms=10)


def test_scores_are_an_aggregate(spark, tmp_path):
    batches = [[(1, 1, 1, "new", "a"), (1, 2, 2, "won", "a"), (2, 1, 3, None, "a")], [(1, 3, 4, "lost", "a"), (1, 3, 4, "lost", "a")], [(2, 5, 5, "won", "b")]]
    scores = live.live_score(feed(spark, f"{tmp_path}/in", batches), "new", "won", "lost")
    got = live.drain_updates(scores, f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert sorted((r.batch, r.game, r.events, r.round, r.score) for r in got) == [(0, 1, 2, 1, 1), (0, 2, 1, 0, 0), (1, 1, 4, 1, -3), (2, 2, 2, 0, 1)]


def test_scores_of_idle_games_are_forgotten(spark, tmp_path):
    at = lambda s: s * SECOND
    batches = [[(1, at(1), 1, "new", "a"), (1, at(4), 2, "won", "a")], [(2, at(500), 3, "new", "b")], [(2, at(501), 6, "say", "b")], [(1, at(2), 4, "lost", "late"), (1, at(510), 5, "won", "a")]]
    scores = live.live_score(feed(spark, f"{tmp_path}/in", batches), "new", "won", "lost", late="10 seconds", idle="1 minute")
    got = live.drain(scores, f"{tmp_path}/out", f"{tmp_path}/state").collect()  # in mode append a play comes when it has ended
    assert [(r.game, r.events, r.round, r.score) for r in got] == [(1, 2, 1, 1)]


def plain_triggered(rows, start, stop):
    kept, on = [], {}
    for g, t, line, name, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        was, on[g] = on.get(g, False), True if name == start else False if name == stop else on.get(g, False)
        if on[g] or was and name == stop:
            kept.append((g, t, line, name))
    return sorted(kept)


def test_triggered_stream_out_of_order(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(g, (i * 700 + rng.randrange(5)) * 1000, g * 1000 + i, rng.choice(["go", "halt", "say", "say", None]), "s") for g in range(4) for i in range(60)]
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(3 * SECOND))  # up to 3 s out of order
    batches = [order[i : i + 24] for i in range(0, len(order), 24)] + [[(9, 1000 * SECOND, 1, "end", "s")], [(0, 5 * SECOND, 999_999, "go", "too late")]]
    log = state.triggered_stream(feed(spark, f"{tmp_path}/in", batches), "go", "halt", "4 seconds")
    got = sorted(tuple(r) for r in live.drain(log, f"{tmp_path}/out", f"{tmp_path}/state").collect())
    assert [r[:3] for r in got] == [r[:3] for r in plain_triggered(rows, "go", "halt")]
    batch = spark.createDataFrame(rows, "game long, time long, line long, name string, sender string")
    from parlance.operators import events

    twin = events.triggered_log(batch, F.col("name") == "go", F.col("name") == "halt")
    assert sorted((r.game, r.time, r.line) for r in twin.collect()) == [r[:3] for r in got]


def test_log_has_a_directory_for_each_start(spark, tmp_path):
    day = F.date_format(F.timestamp_micros("time"), "yyyy-MM-dd")
    stream = lambda n: feed(spark, f"{tmp_path}/in", [[(1, SECOND * i, i, "e", "s")] for i in range(n)])
    live.stream_log(stream(2), f"{tmp_path}/log", f"{tmp_path}/one", day).awaitTermination()
    time.sleep(0.01)
    live.stream_log(stream(3), f"{tmp_path}/log", f"{tmp_path}/two", day).awaitTermination()
    starts = sorted(os.listdir(f"{tmp_path}/log"))
    assert len(starts) == 2 and all(os.listdir(f"{tmp_path}/log/{x}").count("date=1970-01-01") for x in starts)
    live.stream_log(stream(4), f"{tmp_path}/log", f"{tmp_path}/one", day).awaitTermination()  # goes on where it was
    assert sorted(os.listdir(f"{tmp_path}/log")) == starts
    back = spark.read.schema(f"{live.EVENT}, start string, date string").json(f"{tmp_path}/log")
    assert sorted(r["count"] for r in back.groupBy("start").count().collect()) == [3, 4]
