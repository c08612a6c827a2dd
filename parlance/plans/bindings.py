"""How the test tables stand for games, utterances and dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import split_words
from parlance.functions.values import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game = user, new round = signup, completed turn = purchase, rejection = error, selection = click."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("game"), micros(F.col("ts")).alias("time"), F.col("event_id").alias("line"), F.col("event_type").alias("name"), k.alias("entity"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("sender"), "value")


#: the same as a DuckDB CTE
EVENTS_SQL = "e as (select user_id as game, epoch_us(ts) as time, event_id as line, event_type as name, cast(json_extract(props, '$.k') as int) as entity, 'p' || cast(cast(json_extract(props, '$.k') as int) % 3 as varchar) as sender, value from events)"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dyad = conversation, speaker = role, a round = two turns, tokens = words."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("dyad"), F.floor(F.col("turn") / 2).alias("round"), F.col("role").alias("speaker"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).alias("end"), split_words(F.col("text")).alias("tokens"), "text")


CONVERSATIONS_SQL = r"c as (select conv_id as dyad, turn // 2 as round, role as speaker, cast(turn as double) as start, cast(turn as double) + 0.5 as \"end\", list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda t: t <> '') as tokens, text from conversations)".replace('\\"', '"')


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", "n_chars", "text", split_words(F.col("text")).alias("tokens"))


DOCUMENTS_SQL = r"d as (select doc_id, lang, source, n_chars, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda t: t <> '') as tokens from documents)"
