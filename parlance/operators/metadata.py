"""Pseudonyms, participants, metadata tables and orders given by lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.guards import checked


def pseudonymise(df: DataFrame, session: str, who: str, initial: DataFrame, first: str) -> DataFrame:
    """``who`` becomes A for the session's initial player (``initial``: session, ``first``), B for the other; an error where a session has not one or two ids."""
    ids = df.groupBy(session).agg(F.count_distinct(who).alias("_ids"))
    named = df.join(ids.join(initial, session), session)
    return named.withColumn(who, checked(F.when(F.col(who) == F.col(first), F.lit("A")).otherwise(F.lit("B")), F.col("_ids") <= 2, "a session has more than two ids")).drop("_ids", first)


def assign_participants(roles: DataFrame, game: str, player: str, role: str, order: Sequence[str]) -> DataFrame:
    """Participants A, B, ... in the order of their roles; an error beyond Z."""
    n = F.row_number().over(Window.partitionBy(game).orderBy(list_rank(F.col(role), order), player))
    return roles.withColumn("_n", n).withColumn("participant", checked(F.char(F.col("_n") + 64), F.col("_n") <= 26, "a game has more than 26 players")).drop("_n")


def list_rank(c: Column, order: Sequence) -> Column:
    """The place of a value in a list, from 1; values that are not listed come after all."""
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def order_by_list(df: DataFrame, c: str, order: Sequence, seen: str) -> DataFrame:
    """Sorted by a list; values that are not listed follow in the order in which ``seen`` first has them."""
    first = F.min(seen).over(Window.partitionBy(c))
    return df.withColumn("_first", first).withColumn("_rank", list_rank(F.col(c), order)).orderBy("_rank", F.when(F.col("_rank") > len(order), F.col("_first")), c, seen).drop("_first", "_rank")


def upsert_metadata(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, known: Sequence[str] = ()) -> DataFrame:
    """New values win, keys that only one side has are kept; ``rank`` puts known keys first."""
    both = old.join(new.withColumnRenamed(value, "_new"), list(keys), "full_outer")
    return both.select(*keys, F.coalesce("_new", value).alias(value), list_rank(F.col(keys[-1]), known).alias("rank"))


def participant_metadata(long: DataFrame, metadatum: str, participant: str, value: str, participants: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row for each metadatum, one column for each participant."""
    return long.groupBy(*keys, metadatum).agg(*[F.min(F.when(F.col(participant) == p, F.col(value))).alias(p) for p in participants])


def initial_player(lines: DataFrame, session: str, line_no: str, text: str, regex: str) -> DataFrame:
    """(session, initial): the first group of ``regex`` in the first line that it matches; an error if a session has none."""
    found = F.regexp_extract(text, regex, 1)
    one = lines.groupBy(session).agg(F.min(F.when(F.col(text).rlike(regex), F.struct(F.col(line_no), found.alias("p"))))["p"].alias("initial"))
    return one.withColumn("initial", checked(F.col("initial"), F.col("initial").isNotNull(), "no line names the initial player"))


def pseudonymise_props(props: DataFrame, session: str, mapping: DataFrame) -> DataFrame:
    """Descriptor properties (session, key, value) with players' ids replaced as whole values and in event-log names. ``mapping`` is (session, old, new)."""
    pairs = mapping.groupBy(session).agg(F.array_sort(F.collect_list(F.struct((-F.length("old")).alias("n"), "old", "new"))).alias("_map"))
    swap = F.aggregate(F.coalesce("_map", F.array().cast("array<struct<n:int,old:string,new:string>>")), F.col("value"), lambda v, m: F.when(v == m["old"], m["new"]).otherwise(F.replace(v, F.concat(F.lit("-"), m["old"], F.lit(".")), F.concat(F.lit("-"), m["new"], F.lit(".")))))
    return props.join(pairs, session, "left").withColumn("value", F.when(F.col("key").rlike(r"(\.id|\.eventLog|^canonicalEvents)$"), swap).otherwise(F.col("value"))).drop("_map")


def rename_plan(files: DataFrame, session: str, name: str, mapping: DataFrame) -> DataFrame:
    """(session, old, new) file names: ids replaced in logs and recordings, screenshots renumbered (ids by one, rounds by two). Nothing is moved."""
    shot = r"^(selection|turn)-([0-9]+)-(.*)$"
    step = F.when(F.regexp_extract(name, shot, 1) == "turn", 2).otherwise(1)
    number = F.nullif(F.regexp_extract(name, shot, 2), F.lit("")).cast("long") + step
    moved = F.when(F.col(name).rlike(shot), F.concat(F.regexp_extract(name, shot, 1), F.lit("-"), number.cast("string"), F.lit("-"), F.regexp_extract(name, shot, 3))).otherwise(F.col(name))
    pairs = mapping.groupBy(session).agg(F.array_sort(F.collect_list(F.struct((-F.length("old")).alias("n"), "old", "new"))).alias("_map"))
    return files.join(pairs, session, "left").withColumn("_moved", moved).select(session, F.col(name).alias("old"), F.aggregate(F.coalesce("_map", F.array().cast("array<struct<n:int,old:string,new:string>>")), F.col("_moved"), lambda v, m: F.replace(v, m["old"], m["new"])).alias("new"))
