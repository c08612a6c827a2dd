"""Checks that stop a job: the checked column carries the error, so the optimizer cannot drop the check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked(value: Column, condition: Column, message: str) -> Column:
    """``value``, or an error where ``condition`` is not true."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def assert_unique(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """``df``; an error if two rows have the same ``keys``."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(keys[0], checked(F.col(keys[0]), n == 1, message))


def assert_single_value(df: DataFrame, keys: Sequence[str], value: str, message: str) -> DataFrame:
    """One row for each ``keys`` with its ``value``; an error if there are several."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v")).select(*keys, checked(F.col("_v"), F.col("_n") <= 1, message).alias(value))


def assert_single_game(log: DataFrame, logs: Sequence[str], game: str) -> DataFrame:
    """The one game of each log; an error if a log has several."""
    return assert_single_value(log, logs, game, "a log has more than one game")


def assert_same_state(games: DataFrame, game: str, state: str) -> DataFrame:
    """The initial state of each game; an error if players' logs differ."""
    return assert_single_value(games, [game], state, "the logs of a game have different initial states")
