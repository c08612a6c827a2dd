"""Streams of events: ingest, log sink, routing and running score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.functions.text import name_filter
from parlance.operators.events import route

EVENT = "game long, time long, line long, name string, sender string"


def stream_events(spark: SparkSession, path: str, schema: str = EVENT, pattern: str = "**", name: str = "name", files_per_trigger: int = 100) -> DataFrame:
    """JSON events below ``path`` whose name fits, stamped with ``received``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path).where(name_filter(F.col(name), pattern)).withColumn("received", F.current_timestamp())


def started(spark: SparkSession, checkpoint: str) -> str:
    """When the query of this checkpoint was first started, as ``HH-mm-ss.SSS``; it stands beside the checkpoint's own files, so a restart finds it."""
    path = f"{checkpoint}/start"
    try:
        return spark.read.text(path).first()["value"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.range(1).select(F.date_format(F.current_timestamp(), "HH-mm-ss.SSS").alias("value")).coalesce(1).write.text(path)
    return spark.read.text(path).first()["value"]


def stream_log(events: DataFrame, path: str, checkpoint: str, day: Column) -> StreamingQuery:
    """Write a log as JSON lines in a directory for the query's start and, in it, for each date; ends when all there is has been read.

    A query that goes on from its checkpoint writes on in its own directory; one with another checkpoint
    has another, as queries of one directory would take each other's batches for their own.
    """
    at = started(events.sparkSession, checkpoint)
    return events.withColumn("date", day).writeStream.partitionBy("date").format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(f"{path}/start={at}")


def route_stream(events: DataFrame, subscriptions: DataFrame, patterns: Sequence[str], ticket: str, sender: str, name: str) -> DataFrame:
    """Stream-static form of ``route``."""
    return route(events, subscriptions, patterns, ticket, sender, name)


def live_score(events: DataFrame, new_round: str, won: str, lost: str, late: str | None = None, idle: str | None = None) -> DataFrame:
    """(game, events, round, score) of each game, anew in each batch that changes it: a streaming aggregate, for output mode update.

    With ``late`` and ``idle`` (intervals; ``time`` in microseconds) events later than ``late`` behind the
    newest are dropped, and a game ends, and its sums are forgotten, after ``idle`` without events; one that
    goes on later is another row, with ``from`` and ``until``. Null names count as events only.
    """
    name, keys = F.col("name"), ["game"]
    if idle:
        if not late:
            raise ValueError("the end of a game is told by the watermark, so idle needs late")
        events = events.withColumn("event_time", F.timestamp_micros("time")).withWatermark("event_time", late)
        keys.append(F.session_window("event_time", idle).alias("play"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = events.groupBy(*keys).agg(F.count("*").alias("events"), count(name == new_round).alias("round"), (count(name == won) - 2 * count(name == lost)).alias("score"))
    return sums.select("game", "play.start", "play.end", "events", "round", "score").withColumnsRenamed({"start": "from", "end": "until"}) if idle else sums


def drain(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Run a stream over all there is, into Parquet, and read the result. ``partitions`` is for the state of a new checkpoint, if the session's shuffle partitions are not meant."""
    spark = stream.sparkSession
    own = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if partitions:
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        run = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)  # has a session of its own from here
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream in output mode update over all there is: the rows of each batch with its number, ``batch``. A batch that is run again replaces its own rows."""
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(path)
