"""Streaming queries: events are written as JSON files and streamed to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.plans import ORACLE_SQL, query
from parlance.plans.bindings import EVENTS_SQL, events
from parlance.plans.event_queries import ROLES
from parlance.sources.scratch import scratch
from parlance.streaming import live, state

E = f"with {EVENTS_SQL}"

#: a stream of files comes in so many batches, however many files there are, as each batch opens all partitions of the state
BATCHES = 4


def written(spark, e) -> tuple[str, int]:
    """Events as JSON files, in no order of time, as many as the session has shuffle partitions, with the files of a batch."""
    path, files = scratch(spark, "live-events"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    e.repartition(files, "line").write.json(path)
    return path, -(-files // BATCHES)


def state_partitions(spark) -> int:
    """Partitions of typed state: each takes a Python worker and a store of its own in every batch, so not many more than cores."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(16, 2 * spark.sparkContext.defaultParallelism))


def streamed(spark, sf, pattern="**"):
    path, files = written(spark, events(spark, sf).select("game", "time", "line", "name", "sender"))
    return live.stream_events(spark, path, pattern=pattern, files_per_trigger=files)


@query("t01_stream_ingest", f"{E} select line, name from e where name not in ('view', 'click')")
def stream_ingest(spark, sf):
    return live.drain(streamed(spark, sf, "* !view !click").select("line", "name"), scratch(spark, "t01"), scratch(spark, "t01-state"))


@query("t02_stream_log", f"{E} select strftime(make_timestamp(time), '%Y-%m-%d') as date, count(*) as n, cast(1 as bigint) as starts from e group by 1")
def stream_log(spark, sf):
    out = scratch(spark, "t02")
    day = F.date_format(F.timestamp_add("MICROSECOND", F.col("time"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd")
    live.stream_log(streamed(spark, sf).drop("received"), out, scratch(spark, "t02-state"), day).awaitTermination()
    return spark.read.schema(f"{live.EVENT}, date string, start string").json(out).groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("start").alias("starts"))


@query("t03_stream_route", f"{E}, s as (select * from (values ('p0'), ('p1')) as v(client)) select line, client from e join s on client <> sender where client = 'p0' or name = 'click'")
def stream_route(spark, sf):
    subs = events(spark, sf).select("game").distinct().crossJoin(spark.createDataFrame([("p0", "**"), ("p1", "click")], "client string, pattern string"))
    return live.drain(live.route_stream(streamed(spark, sf), subs, ["**", "click"], "game", "sender", "name").select("line", "client"), scratch(spark, "t03"), scratch(spark, "t03-state"))


@query("t04_live_score", f"{E} select game, count(*) filter (name = 'signup') as round, cast(sum(case name when 'purchase' then 1 when 'error' then -2 else 0 end) as bigint) as score from e group by game")
def live_score(spark, sf):
    steps = live.drain_updates(live.live_score(streamed(spark, sf), "signup", "purchase", "error"), scratch(spark, "t04"), scratch(spark, "t04-state"))
    return steps.groupBy("game").agg(F.max_by("round", "events").alias("round"), F.max_by("score", "events").alias("score"))


@query("t05_live_pairing", f"{E}, {ROLES} select game, player, ['MOVE_SUBMISSION', 'WAITING'][n] as role from rn where n <= 2 and (select count(*) from rn b where b.game = rn.game) >= 2")
def live_pairing(spark, sf):
    found = live.drain(state.live_pairing(streamed(spark, sf), ("MOVE_SUBMISSION", "WAITING")), scratch(spark, "t05"), scratch(spark, "t05-state"), state_partitions(spark))
    last = found.groupBy("game").agg(F.max("version").alias("version"))
    return found.join(last, ["game", "version"]).select("game", "player", "role")


@query("t06_live_log", ORACLE_SQL["t06_triggered_log"])
def live_log(spark, sf):
    """Events come in no order of time, so they may be as late as the table is long; one far event at the end passes them all."""
    e = events(spark, sf).select("game", "time", "line", "name", "sender")
    path, files = written(spark, e)
    e.groupBy().agg(F.lit(-1).cast("long").alias("game"), (F.max("time") + 800 * 86_400_000_000).alias("time"), F.lit(-1).cast("long").alias("line"), F.lit("end").alias("name")).where("time is not null").write.mode("append").json(path)
    log = live.stream_events(spark, path, files_per_trigger=files, pattern="**")
    return live.drain(state.triggered_stream(log, "signup", "error", "400 days").select("line"), scratch(spark, "t06"), scratch(spark, "t06-state"), state_partitions(spark))
