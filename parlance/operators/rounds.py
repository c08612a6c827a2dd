"""Rounds of games: their events, utterances, referents and text, from one exchange of events and utterances by game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import sentence
from parlance.functions.values import entity_features
from parlance.operators.events import SIDES, _to_time, assign_rounds, entity_position_asof, running


def utterance_table(utts: DataFrame, events: DataFrame, delimiter: Column, first_instructor: Column, game: str = "game") -> DataFrame:
    """Columns of an utterance table, and ``game``: ROUND, SPEAKER, DIALOGUE_ROLE, START_TIME, END_TIME, TOKENS.

    ``utts`` is (game, start, end, speaker, tokens), ``events`` (game, time, line, sender). Who sent the
    last delimiting event at or before an utterance's start is the instructor of its round, before the
    first round ``first_instructor``; others are manipulators. Nulls and repeats are kept as rows.
    """
    placed = assign_rounds(utts, events, delimiter, game)
    role = F.when(F.col("speaker") == F.coalesce("submitter", first_instructor), "INSTRUCTOR").otherwise("MANIPULATOR")
    return placed.select(game, F.col("round").cast("int").alias("ROUND"), F.col("speaker").alias("SPEAKER"), role.alias("DIALOGUE_ROLE"), F.col("start").cast("float").alias("START_TIME"), F.col("end").cast("float").alias("END_TIME"), F.col("tokens").alias("TOKENS"))


def along_game(utts: DataFrame, events: DataFrame, new: Column) -> DataFrame:
    """Events and utterances of games in one frame, by ``at``: ``round``, ``moved`` (the piece of the last new round up to then), ``since`` (the first event) and ``next`` (time and ``moved`` of the first event from then on).

    ``events`` is (game, time, line, name, sender, piece), ``utts`` (game, utt, start, end, speaker, tokens).
    An utterance comes after the events of its start.
    """
    said = utts.select("game", F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("utt").alias("line"), "end", "speaker", "tokens")
    done = events.select("game", F.col("time").alias("at"), F.lit(0).alias("kind"), "line", "name", "sender", "piece", new.alias("new"))
    both = done.unionByName(said, allowMissingColumns=True)
    is_event = F.col("kind") == 0
    folds = {"round": ("sum", F.coalesce(F.col("new").cast("int"), F.lit(0))), "since": ("min", F.when(is_event, F.col("at"))), "_moved": ("max", F.when(F.col("new"), F.struct("at", "line", "piece")), _to_time)}
    known = running(both, ["game"], ["at", "kind", "line"], folds).withColumn("moved", F.col("_moved")["piece"]).drop("_moved")
    return running(known, ["game"], ["at"], {"next": ("min", F.when(is_event, F.struct("at", "moved")))}, lambda w: w.rangeBetween(0, Window.unboundedFollowing), back=False)


def turns_text(said: Column) -> Column:
    """The text of utterances (array of at, line, speaker, s, in any order): a line ``**speaker:** "Sentence. Sentence."`` for each turn; null without utterances."""
    in_order = F.array_sort(said)

    def piece(x: Column, i: Column) -> Column:
        same = (i > 0) & x["speaker"].eqNullSafe(F.get(in_order, F.greatest(i - 1, F.lit(0)))["speaker"])
        opening = F.concat(F.when(i > 0, F.lit('"\n')).otherwise(F.lit("")), F.lit("**"), F.coalesce(x["speaker"], F.lit("")), F.lit(':** "'))
        return F.concat(F.when(same, F.lit(" ")).otherwise(opening), x["s"])

    return F.when(F.size(said) > 0, F.concat(F.array_join(F.transform(in_order, piece), ""), F.lit('"')))


def round_dialogue_table(utts: DataFrame, events: DataFrame, entities: DataFrame, moves: DataFrame, new: Column, rows: int, cols: int) -> DataFrame:
    """A row for each round of each game: its first event, the timing of the round before, what the referent looks like, where it stands, and what is said.

    Inputs as in ``along_game``; ``entities`` and ``moves`` as in ``event_entity_table``. The referent is seen at the
    first event during the round's first utterance, without one at the utterance's start, and in a round without
    utterances at its first event; it stands where its last move strictly before put it. Times are numbers;
    ``offset`` and ``previous_offset`` count from the game's first event, ``difference`` from the last event
    of the round before. A round of utterances alone has no event and no referent. Rounds and their
    text, timing and referents stay where the one exchange by game put their rows.
    """
    along = along_game(utts, events, new)
    event, said = F.col("kind") == 0, F.col("kind") == 1
    spoken = said & (F.size("tokens") > 0)
    within = F.col("next")["at"] <= F.col("end")
    seen = F.when(within, F.col("next")).otherwise(F.struct("at", "moved"))
    first = F.min(F.when(event, F.struct("at", "line", "name", "sender", "moved", "since")))
    one = along.groupBy("game", "round").agg(first.alias("e"), F.max(F.when(event, F.col("at"))).alias("last_time"), F.count_if(said).alias("utts"), F.min(F.when(said, F.struct("at", "line", seen.alias("seen"))))["seen"].alias("u"), F.collect_list(F.when(spoken, F.struct("at", "line", "speaker", sentence(F.col("tokens")).alias("s")))).alias("said"))
    before = F.lag("last_time").over(Window.partitionBy("game").orderBy("round"))
    e = F.col("e")
    timed = one.select(
        "game", "round", e["name"].alias("name"), e["sender"].alias("submitter"), e["at"].alias("time"), (e["at"] - e["since"]).alias("offset"), before.alias("previous_time"),
        (before - e["since"]).alias("previous_offset"), (e["at"] - before).alias("difference"), "utts", turns_text(F.col("said")).alias("text"), F.when(e.isNotNull(), F.coalesce(F.col("u")["at"], e["at"])).alias("seen_at"), F.when(e.isNotNull(), F.when(F.col("u").isNotNull(), F.col("u")["moved"]).otherwise(e["moved"])).alias("entity"),
    )
    looks = entities.select("game", "entity", "shape", "edge_count", "argb", F.struct(*SIDES).alias("first_place"))
    queries = timed.join(looks, ["game", "entity"], "left")
    places = moves.select("game", "entity", F.col("time").alias("seen_at"), F.struct(*SIDES).alias("place"))
    placed = entity_position_asof(queries, places, "game", "entity", "seen_at", "place", F.col("first_place"))
    features = entity_features(F.col("argb"), F.col("place"), rows, cols)
    return placed.select("game", "round", "name", "submitter", "time", "offset", "previous_time", "previous_offset", "difference", "utts", "entity", "shape", "edge_count", *[c.alias(n) for n, c in features.items()], "text")
