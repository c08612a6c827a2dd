"""Event logs in JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.values import event_time
from parlance.sources.text import lines

POINT = "struct<x:int,y:int>"
AREA = f"struct<start:{POINT},end:{POINT}>"
MOVE = f"struct<pieceId:int,source:{AREA},target:{AREA}>"
SELECTION = f"struct<pieceId:int,area:{AREA}>"
STATE = "struct<modelDescription:struct<colCount:int,coordOccupants:array<string>>,imgVizInfoDesc:struct<data:array<struct<color:int,size:string,resourceName:string>>,uniqueImgResourceCount:int>,playerRoles:array<array<string>>,seed:string,occupiedGridArea:double,allowFailedPlacements:boolean>"
RECORD = f"class string, event_id string, event_name string, event_sender string, system string, action string, event_time string, GAME_ID string, PLAYER_ID string, TIMESTAMP string, MOVE {MOVE}, SELECTION {SELECTION}, GAME_STATE {STATE}"


def parse_records(lines_: DataFrame, event_class: str = "Event") -> DataFrame:
    """Records of (path, line_no, value): blank lines are skipped, bad JSON stops the job, records of other classes are left out."""
    parsed = lines_.where(F.trim("value") != "").select("path", "line_no", F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r")).select("path", "line_no", "r.*")
    return parsed.where(F.element_at(F.split("class", r"\."), -1) == event_class)


def read_event_log(spark: SparkSession, paths: Sequence[str] | str, glob: str = "*", event_class: str = "Event") -> DataFrame:
    """Events of logs with their ``line_no``, typed."""
    return decode_events(parse_records(lines(spark, paths, glob), event_class))


def decode_events(records: DataFrame) -> DataFrame:
    """Typed attributes: times, game and player, move, selection, state."""
    return records.select(
        "path", "line_no", "event_id", F.col("event_name").alias("name"), F.col("event_sender").alias("sender"), "system", event_time(F.col("event_time")).alias("time"), F.col("GAME_ID").alias("game_id"),
        F.col("PLAYER_ID").alias("player_id"), F.col("MOVE").alias("move"), F.col("SELECTION").alias("selection"), F.col("GAME_STATE").alias("state"), event_time(F.col("TIMESTAMP")).alias("submitted"),
    )


def read_large_log(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """As ``read_event_log`` for logs of any size: split by Spark, ordered by the number at the end of ``event_id`` instead of a line number."""
    raw = spark.read.schema(RECORD).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(paths if isinstance(paths, str) else list(paths))
    numbered = raw.withColumn("path", F.col("_metadata.file_path")).withColumn("line_no", F.nullif(F.regexp_extract("event_id", r"([0-9]+)$", 1), F.lit("")).cast("long"))
    return decode_events(numbered.where(F.element_at(F.split("class", r"\."), -1) == "Event"))


def write_event_log(df: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    df.write.option("ignoreNullFields", "true").json(path)
