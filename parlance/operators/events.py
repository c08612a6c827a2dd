"""Event operators: as-of joins, rounds, scores and positions along the events of a game.

Events are ordered by ``time`` (a number), ties by ``line``. As-of joins are windows over the union
of both sides, partitioned by game, not range joins. A game with more than HOT_ROWS rows is cut into
stretches of time that are worked on side by side; what comes before a stretch is carried into it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import name_filter, strip_prefix
from parlance.functions.values import entity_features
from parlance.operators.geometry import STEP, level_of, levels_in
from parlance.operators.guards import checked
from parlance.sources import tables


#: games with more rows are cut into stretches of time of about so many
HOT_ROWS = 2_000_000
FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _to_here(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _to_time(w: Window) -> Window:
    """Up to the row's time, all rows of that time included."""
    return w.rangeBetween(Window.unboundedPreceding, 0)


def _on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal or null ``keys``; ``right`` is broadcast."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys] or [F.lit(True)]
    return left.join(F.broadcast(right), reduce(lambda a, b: a & b, same), "left").drop(*[f"_right_{k}" for k in keys])


def running(df: DataFrame, keys: Sequence[str], by: Sequence[str], values: Mapping[str, tuple], frame: Callable[[Window], Window] = _to_here, back: bool = True) -> DataFrame:
    """``df`` with running folds: ``values`` names (kind, column) or (kind, column, frame), kind a key of FOLD; ``by`` begins with a number, the time.

    ``frame`` reaches back to the first row, or with ``back=False`` on to the last; a value's own frame
    counts for it. Folds of one call share the exchange and the count of rows. Usually each is
    one window. Keys with over HOT_ROWS rows are cut into stretches of like length in time, as many as
    their rows ask for; each stretch's fold and those of the stretches before it are joined. Rows of
    the same time are in one stretch, so a key whose rows all have one time stays whole.
    """
    cut = _stretches(df, keys, by[0])
    return df.withColumns(_folds(Window.partitionBy(*keys), by, values, frame)) if cut is None else _carried(cut, keys, by, values, frame, back).drop("_stretch")


def _folds(part: Window, by: Sequence[str], values: Mapping[str, tuple], frame: Callable[[Window], Window]) -> dict[str, Column]:
    own = {c: v[2] if len(v) > 2 else frame for c, v in values.items()}
    return {c: FOLD[v[0]](v[1]).over(own[c](part.orderBy(*(by[:1] if own[c] is _to_time else by)))) for c, v in values.items()}


def _carried(cut: DataFrame, keys: Sequence[str], by: Sequence[str], values: Mapping[str, tuple], frame: Callable[[Window], Window], back: bool) -> DataFrame:
    """Folds over stretches, with those of the stretches before joined."""
    part = [*keys, "_stretch"]
    others = _before(Window.partitionBy(*keys).orderBy(F.col("_stretch").asc() if back else F.col("_stretch").desc()))
    sums = cut.where("_stretch >= 0").groupBy(*part).agg(*[FOLD[v[0]](v[1]).alias(f"_carry_{c}") for c, v in values.items()])
    carried = sums.select(*part, *[FOLD[v[0]](f"_carry_{c}").over(others).alias(f"_carry_{c}") for c, v in values.items()])
    local = cut.withColumns(_folds(Window.partitionBy(*part), by, values, frame))

    def both(c: str, kind: str) -> Column:
        here, there = F.col(c), F.col(f"_carry_{c}")
        return F.coalesce(here + there, here, there) if kind == "sum" else (F.array_max if kind == "max" else F.array_min)(F.array(here, there))

    return _on_keys(local, carried, part).withColumns({c: both(c, v[0]) for c, v in values.items()}).drop(*[f"_carry_{c}" for c in values])


def _stretches(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame | None:
    """``df`` with ``_stretch``: -1 for keys of at most HOT_ROWS rows, else a number of stretches of like length in ``time``; None if no key has more rows."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min(time).cast("double").alias("_lo"), F.max(time).cast("double").alias("_hi")).where(F.col("_rows") > HOT_ROWS)
    if hot.isEmpty():
        return None
    # at most one row of ``hot`` and two carried rows for each HOT_ROWS rows are broadcast
    n = F.ceil(F.col("_rows") / HOT_ROWS)
    stretch = F.coalesce(F.floor((F.col(time) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * n), F.lit(0))  # rows without time are first
    return _on_keys(df, hot, keys).withColumn("_stretch", F.when(F.col("_rows").isNull(), -1).otherwise(F.least(n - 1, stretch))).drop("_rows", "_lo", "_hi")


def neighbours(df: DataFrame, keys: Sequence[str], by: Sequence[str], back: Mapping[str, Column] | None = None, ahead: Mapping[str, Column] | None = None, folds: Mapping[str, tuple] | None = None) -> DataFrame:
    """``df`` with values of the row before (``back``) and after (``ahead``) in order of ``by``, which begins with a number, null where there is none; and with ``folds`` up to the row, as of ``running``.

    Keys with over HOT_ROWS rows are cut into stretches as in ``running``; the last row of a stretch is
    carried to the first of the next, and the first to the last before.
    """
    back, ahead, folds = back or {}, ahead or {}, folds or {}

    def near(part: Sequence[str]) -> dict[str, Column]:
        w = Window.partitionBy(*part).orderBy(*by)
        return {c: F.lag(x).over(w) for c, x in back.items()} | {c: F.lead(x).over(w) for c, x in ahead.items()}

    cut = _stretches(df, keys, by[0])
    if cut is None:
        return df.withColumns(near(keys) | _folds(Window.partitionBy(*keys), by, folds, _to_here))
    part = [*keys, "_stretch"]
    w = Window.partitionBy(*part).orderBy(*by)
    local = cut.withColumns(near(part) | {"_first": F.lag(F.lit(1)).over(w).isNull(), "_last": F.lead(F.lit(1)).over(w).isNull()})
    place = F.struct(*by)
    ends = cut.where("_stretch >= 0").groupBy(*part).agg(F.max_by(F.struct(*[x.alias(c) for c, x in back.items()], F.lit(0)), place).alias("_end"), F.min_by(F.struct(*[x.alias(c) for c, x in ahead.items()], F.lit(0)), place).alias("_begin"))
    along = Window.partitionBy(*keys).orderBy("_stretch")
    ends = ends.select(*part, F.lag("_end").over(along).alias("_end"), F.lead("_begin").over(along).alias("_begin"))
    joined = _on_keys(local, ends, part)
    kept = {c: F.when(F.col("_first"), F.col("_end")[c]).otherwise(F.col(c)) for c in back} | {c: F.when(F.col("_last"), F.col("_begin")[c]).otherwise(F.col(c)) for c in ahead}
    found = joined.withColumns(kept).drop("_first", "_last", "_end", "_begin")
    return (_carried(found, keys, by, folds, _to_here, True) if folds else found).drop("_stretch")


def match_types(df: DataFrame, name: str, *types: str) -> DataFrame:
    return df.where(F.col(name).isin(*types))


def apply_filters(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Filters in order; each may change or drop events."""
    for step in steps:
        df = df.transform(step)
    return df


def round_id(df: DataFrame, delimiter: Column, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    """``round``: how many delimiting events there were, this one included."""
    return running(df, [game], [time, line], {"round": ("sum", delimiter.cast("int"))})


def running_score(df: DataFrame, won: Column, lost: Column, gain: int = 1, loss: int = -2, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    """``score``: ``gain`` for each completed turn, ``loss`` for each rejection."""
    return running(df, [game], [time, line], {"score": ("sum", F.when(won, gain).when(lost, loss).otherwise(0))})


def event_no(df: DataFrame, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    """``event_no``: 1, 2, ... in a game."""
    return running(df, [game], [time, line], {"event_no": ("sum", F.lit(1))})


def max_time(df: DataFrame, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    return running(df, [game], [time, line], {"max_time": ("max", F.col(time))})


def last_event_asof(df: DataFrame, match: Column, value: str, game: str = "game", time: str = "time", line: str = "line", strict: bool = False) -> DataFrame:
    """``last_<value>``: of the last matching event at or before (``strict``: before) each event's time; events of the same time included."""
    found = running(df, [game], [time], {"_last": ("max", F.when(match, F.struct(time, line, value)))}, lambda w: w.rangeBetween(Window.unboundedPreceding, -1 if strict else 0))
    return found.withColumn(f"last_{value}", F.col("_last")[value]).drop("_last")


def last_event_distance(df: DataFrame, match: Column, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    """``distance``: how many events ago the last matching one was; 0 for itself, null before the first."""
    df = running(df, [game], [time, line], {"_n": ("sum", F.lit(1))})
    found = running(df, [game], [time, line], {"_last": ("max", F.when(match, F.col("_n")))})
    return found.withColumn("distance", F.col("_n") - F.col("_last")).drop("_n", "_last")


def round_intervals(df: DataFrame, delimiter: Column, label: str, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    """(game, start, end, label) from each delimiter to the next; the last, open one is left out."""
    return neighbours(df.where(delimiter), [game], [time, line], ahead={"end": F.col(time)}).select(game, F.col(time).alias("start"), "end", label).where("end is not null")


def dedupe_time(df: DataFrame, log: str, time: str = "time", line: str = "line") -> DataFrame:
    """The first event of each log and time."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(log, time).orderBy(line))).where("_r = 1").drop("_r")


def min_time_merge(df: DataFrame, log: str, time: str, line: str, same: Sequence[str]) -> DataFrame:
    """Events that several logs hold (equal in ``same``), once, at their earliest time."""
    return dedupe_time(df, log, time, line).groupBy(*same).agg(F.min(time).alias(time))


def sender_latency(df: DataFrame, match: Column, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    """``latency`` of events that match and whose predecessor does not: the time since it."""
    near = neighbours(df, [game], [time, line], {"_p": match, "_t": F.col(time)})
    return near.where(match & ~F.col("_p")).withColumn("latency", F.col(time) - F.col("_t")).drop("_p", "_t")


def latency_summary(latencies: DataFrame) -> DataFrame:
    return latencies.agg(F.count("latency").alias("n"), F.max("latency").alias("max_latency"), F.min("latency").alias("min_latency"), F.avg("latency").alias("mean_latency"))


def split_at(df: DataFrame, match: Column, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    """``part``: the number of delimiters before; a part ends with its delimiter."""
    return running(df, [game], [time, line], {"part": ("sum", match.cast("int"))}, _before).withColumn("part", F.coalesce("part", F.lit(0)))


def preceding(df: DataFrame, at: Column, time: str = "time", line: str = "line") -> DataFrame:
    """Events up to a time, latest first."""
    return df.where(F.col(time) <= at).orderBy(F.desc(time), F.desc(line))


def game_histories(df: DataFrame, name: str, ready: str, ignored: Sequence[str] = (), game: str = "game", time: str = "time", line: str = "line", strict: bool = True) -> DataFrame:
    """(game, start, n_events, first_time, last_time) by mergeable aggregates; with ``strict`` an error if a game has not exactly one ready event."""
    kept = df.where(~F.col(name).isin(*ignored)) if ignored else df
    agg = kept.groupBy(game).agg(F.sum((F.col(name) == ready).cast("int")).alias("n_ready"), F.min(F.when(F.col(name) == ready, F.col(time))).alias("start"), F.count("*").alias("n_events"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return agg.withColumn("start", checked(F.col("start"), F.col("n_ready") == 1, "a game needs exactly one ready event")) if strict else agg


def entity_rows(df: DataFrame, entities: DataFrame, game: str = "game") -> DataFrame:
    """Each event with each entity of its game."""
    return df.join(entities, game)


def entity_position_asof(pairs: DataFrame, moves: DataFrame, game: str, entity: str, time: str, position: str, initial: Column) -> DataFrame:
    """``position`` of the entity before each event: its last move strictly earlier, else ``initial``. ``pairs`` has a row for each event and entity."""
    both = pairs.withColumn("_move", F.lit(None).cast(moves.schema[position].dataType)).withColumn("_q", F.lit(True)).unionByName(moves.select(game, entity, time, F.col(position).alias("_move"), F.lit(False).alias("_q")), allowMissingColumns=True)
    found = running(both, [game, entity], [time], {"_last": ("max", F.when(F.col("_move").isNotNull(), F.struct(time, "_move")))}, lambda w: w.rangeBetween(Window.unboundedPreceding, -1))
    return found.where("_q").withColumn(position, F.coalesce(F.col("_last")["_move"], initial)).drop("_move", "_q", "_last")


def event_steps(log: DataFrame, new: Column, won: Column, lost: Column, game: str = "game", time: str = "time", line: str = "line", piece: str = "piece") -> DataFrame:
    """``log`` with ``event`` (1, 2, ...), ``round``, ``score``, ``since`` (the game's first time) and ``moved`` (the piece of the last new round up to this time), all from one exchange."""
    score = F.when(won, 1).when(lost, -2).otherwise(0)
    moved = ("max", F.when(new, F.struct(time, line, piece)), _to_time)
    steps = running(log, [game], [time, line], {"event": ("sum", F.lit(1)), "round": ("sum", new.cast("int")), "score": ("sum", score), "since": ("min", F.col(time)), "_moved": moved})
    return steps.withColumn("moved", F.col("_moved")[piece]).drop("_moved")


#: sides of a rectangle that a move leads to
SIDES = ("x0", "x1", "y0", "y1")


#: events of a game that stand in one row until they meet its entities
SPAN = 256
#: events whose pairs are made in one task
TASK_EVENTS = 20_000


def _stays(log: DataFrame, entities: DataFrame, moves: DataFrame) -> DataFrame:
    """(game, entity, looks, place, first, last): where each entity stands from one event of its game to another, by their numbers; ``entities`` is (game, entity, looks, place).

    A move holds from the first event after its time to the entity's next one, whatever the number of events between.
    """
    ends = log.groupBy("game").agg(F.count("*").alias("_events"))
    marks = log.select("game", "time", F.lit(1).alias("_n")).unionByName(moves.where("time is not null").select("game", "time", F.lit(0).alias("_n"), "entity", "place"), allowMissingColumns=True)
    moved = running(marks, ["game"], ["time"], {"_after": ("sum", F.col("_n"), _to_time)}).where("_n = 0").drop("_n")
    at_first = entities.join(ends, "game").withColumns({"time": F.lit(None).cast(log.schema["time"].dataType), "_after": F.lit(0).cast("long"), "_is": F.struct("looks", "_events")}).drop("looks", "_events")
    near = neighbours(at_first.unionByName(moved, allowMissingColumns=True), ["game", "entity"], ["time", "place"], ahead={"_until": F.col("_after")}, folds={"_of": ("max", F.col("_is"))})
    last = F.coalesce("_until", F.col("_of")["_events"])
    return near.where(F.col("_of").isNotNull() & (F.col("_after") < last)).select("game", "entity", F.col("_of")["looks"].alias("looks"), "place", (F.col("_after") + 1).alias("first"), last.alias("last"))


def _pairs(log: DataFrame, entities: DataFrame, moves: DataFrame, new: Column, won: Column, lost: Column, picks: Sequence[str], rows: int, cols: int, prefix: str, tell: Callable, show: Callable) -> DataFrame:
    """A row for each event of ``log`` and entity of its game: game, entity, what ``tell`` makes of the event's columns, what ``show`` makes of the entity's at that time, ``moved`` and ``picked`` of the event.

    Both are made where an event and a stay are one row each. SPAN events in a row and the stays that
    touch them are joined and become pairs of event and entity last, so what is shuffled grows with
    events, moves and entities, not with their pairs. Tasks follow from the number of events, as a row of
    the join becomes many.
    """
    place = F.struct(*SIDES).alias("place")
    looks = [c for c in entities.columns if c not in ("game", "entity", *SIDES)]
    stays = _stays(log, entities.select("game", "entity", F.struct(*looks).alias("looks"), place), moves.select("game", "entity", "time", place))
    span = lambda c: F.floor((F.col(c) - 1) / SPAN)
    touched = stays.withColumn("_span", F.explode(F.sequence(span("first"), span("last"))))
    told = {
        "EVENT": F.col("event").cast("int"), "ROUND": F.col("round").cast("int"), "SCORE": F.col("score").cast("int"), "TIME": ((F.col("time") - F.col("since")) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(20,6)"),
        "NAME": strip_prefix(F.col("name"), prefix) if prefix else F.col("name"), "SUBMITTER": F.col("sender"),
    }
    one = F.struct("event", tell(told).alias("told"), "moved", F.when(F.col("name").isin(*picks), F.col("piece")).alias("picked"))
    spans = event_steps(log, new, won, lost).groupBy("game", span("event").alias("_span")).agg(F.array_sort(F.collect_list(one)).alias("_told"))
    begin = F.greatest(F.col("first") - F.col("_span") * SPAN, F.lit(1)).cast("int")
    own = F.slice("_told", begin, F.least(F.col("last") - F.col("_span") * SPAN, F.lit(SPAN)).cast("int") - begin + 1)
    key, tasks = ["game", "_span"], log.count() // TASK_EVENTS + 1
    met = touched.repartition(tasks, *key).join(spans.repartition(tasks, *key), key)
    features = entity_features(F.col("argb"), F.col("place"), rows, cols)
    shown = {"SHAPE": F.col("shape"), "EDGE_COUNT": F.col("edge_count").cast("int"), **{n.upper(): c.cast("float") if n in ("hue", "saturation", "brightness") else c for n, c in features.items()}}
    seen = met.select("game", "entity", "looks.*", "place", "first", "last", "_span", "_told").select("game", "entity", show(shown).alias("_shown"), "first", "last", "_span", "_told")
    return seen.select("game", "entity", "_shown", F.explode(own).alias("_event")).select("game", "entity", "_shown", "_event.*")


def _flags() -> dict[str, Column]:
    """REFERENT and SELECTED of a pair."""
    return {"REFERENT": is_referent(F.col("moved"), F.col("entity")), "SELECTED": F.coalesce(F.col("picked") == F.col("entity"), F.lit(False))}


def event_entity_table(log: DataFrame, entities: DataFrame, moves: DataFrame, new: Column, won: Column, lost: Column, picks: Sequence[str], rows: int, cols: int, prefix: str = "") -> DataFrame:
    """A row for each event of ``log`` and entity of its game, with the event's 9 columns, the entity's 12 features at that time and ``game``.

    ``log`` is (game, time in microseconds, line, name, sender, piece); ``entities`` (game, entity, shape,
    edge_count, argb, x0, x1, y0, y1) has the looks and first places, one row for each; ``moves`` (game,
    entity, time, x0, x1, y0, y1) the places that entities are moved to. An entity stands where its last
    move strictly before the event put it. ``picks`` are names of events that select their piece,
    ``prefix`` is a pattern that is taken off names. Columns are those of an events table.
    """
    struct = lambda cols: F.struct(*[c.alias(n) for n, c in cols.items()])
    pairs = _pairs(log, entities, moves, new, won, lost, picks, rows, cols, prefix, struct, struct)
    return pairs.select("game", "told.*", entity_no(F.col("entity")).cast("int").alias("ENTITY"), *[c.alias(n) for n, c in _flags().items()], "_shown.*")


def event_entity_lines(log: DataFrame, entities: DataFrame, moves: DataFrame, new: Column, won: Column, lost: Column, picks: Sequence[str], rows: int, cols: int, prefix: str = "") -> DataFrame:
    """``event_entity_table``, with ``game`` first, as lines (``line``) of a tab-separated table.

    An event's and an entity's part of a line are written once, and a pair only joins them.
    """
    text = lambda cols: tables.cells(cols, tables.GAME_EVENTS)
    pairs = _pairs(log, entities, moves, new, won, lost, picks, rows, cols, prefix, lambda told: text({"GAME": F.col("game").cast("string")} | told), text)
    return pairs.select(F.concat_ws("\t", "told", entity_no(F.col("entity")).cast("int").cast("string"), *[F.when(c, "true").otherwise("false") for c in _flags().values()], "_shown").alias("line"))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, tie: str | None = None, strict: bool = False) -> DataFrame:
    """``left`` with ``value`` and ``<value>_time`` of the last row of ``right`` at or before (``strict``: before) its time."""
    return _asof(left, right, keys, time, value, tie, strict, True)


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, tie: str | None = None) -> DataFrame:
    """``left`` with ``value`` and ``<value>_time`` of the first row of ``right`` at or after its time; null if there is none."""
    return _asof(left, right, keys, time, value, tie, False, False)


def _asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, tie: str | None, strict: bool, back: bool) -> DataFrame:
    extra = [F.col(tie).alias("_tie")] if tie else [F.lit(0).alias("_tie")]
    r = right.select(*keys, time, F.struct(F.col(time).alias("t"), *extra, F.col(value).alias("v")).alias("_r"), F.lit(False).alias("_q"))
    both = left.withColumn("_q", F.lit(True)).unionByName(r, allowMissingColumns=True)
    reach = (Window.unboundedPreceding, -1 if strict else 0) if back else (0, Window.unboundedFollowing)
    found = running(both, keys, [time], {"_b": ("max" if back else "min", F.col("_r"))}, lambda w: w.rangeBetween(*reach), back)
    return found.where("_q").withColumn(value, F.col("_b.v")).withColumn(f"{value}_time", F.col("_b.t")).drop("_q", "_r", "_b")


def assign_rounds(utts: DataFrame, events: DataFrame, delimiter: Column, game: str = "game", start: str = "start", time: str = "time", line: str = "line") -> DataFrame:
    """``round`` of each utterance: the number of delimiting events at or before its start (0 before the first), and ``submitter`` of the last of them."""
    marks = events.where(delimiter).select(game, F.col(time).alias(start), F.struct(F.col(time).alias("t"), F.col(line).alias("l"), F.col("sender").alias("s")).alias("_e"), F.lit(0).alias("_kind"))
    both = utts.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    folds = {"round": ("sum", (F.col("_kind") == 0).cast("int")), "_last": ("max", F.col("_e"))}
    found = running(both, [game], [start], folds, lambda w: w.rangeBetween(Window.unboundedPreceding, 0))
    return found.where("_kind = 1").withColumn("submitter", F.col("_last")["s"]).drop("_kind", "_e", "_last")


def contexts(utts: DataFrame, events: DataFrame, game: str, start: str, end: str, time: str, line: str, bin_size: int) -> DataFrame:
    """Events during each utterance, both ends included; one row without event for an utterance that has none.

    An utterance stands in the at most two bins that it touches on the level of its length, the least
    level having bins of ``bin_size`` and each next one STEP times longer; an event looks into one bin of each level that
    occurs. So the join is an equi-join on game and bin, and an utterance of any length takes two rows.
    Repeated rows are rows of their own, whatever of them is null; an utterance without game or times has no event.
    """
    whole = [F.col(c) for c in utts.columns]
    same = Window.partitionBy(*whole).orderBy(F.lit(0))
    # equal rows are numbered, so that a row has the same name wherever it is worked out
    named = utts.withColumns({"_row": F.row_number().over(same), "_h": F.xxhash64(*whole), "_g": F.xxhash64(F.lit(1), *whole, *[c.isNull() for c in whole])})
    level = level_of(F.col(end) - F.col(start) + 1, bin_size)
    timed = named.where(F.col(start) <= F.col(end)).withColumn("_l", level)
    known = F.array(*map(F.lit, levels_in(utts.where(F.col(start) <= F.col(end)), level))).cast("array<int>")
    size = F.lit(float(bin_size)) * F.pow(F.lit(float(STEP)), F.col("_l"))
    spread = timed.select(F.col(game), F.col(start), F.col(end), "_row", "_h", "_g", "_l", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))).alias("_bin"))
    binned = events.select(F.col(game), F.col(time), F.col(line), F.explode(known).alias("_l")).withColumn("_bin", F.floor(F.col(time) / size))
    inside = spread.join(binned, [game, "_l", "_bin"]).where(F.col(time).between(F.col(start), F.col(end)))
    found = inside.select("_row", "_h", "_g", time, line)
    return named.join(found, ["_row", "_h", "_g"], "left").drop("_row", "_h", "_g").withColumn("at", F.coalesce(time, start))


def route(events: DataFrame, subscriptions: DataFrame, patterns: Sequence[str], ticket: str, sender: str, name: str) -> DataFrame:
    """Each event to every other client of its ticket whose pattern accepts its name. ``subscriptions`` is (ticket, client, pattern); ``patterns`` lists the patterns in use."""
    accepts = F.lit(False)
    for p in patterns:
        accepts = accepts | ((F.col("pattern") == p) & name_filter(F.col(name), p))
    return events.join(subscriptions, ticket).where((F.col("client") != F.col(sender)) & accepts)


def fill_roles(joins: DataFrame, game: str, player: str, time: str, roles: Sequence[str]) -> DataFrame:
    """(game, player, role, time): the first players who join a game get its roles in order; ``ready`` is when the last role was filled, null while one is open."""
    first = joins.groupBy(game, player).agg(F.min(time).alias(time))
    n = F.row_number().over(Window.partitionBy(game).orderBy(time, player))
    named = first.withColumn("_n", n).where(F.col("_n") <= len(roles)).withColumn("role", F.element_at(F.array(*map(F.lit, roles)), F.col("_n")))
    return named.withColumn("ready", F.max(F.when(F.col("_n") == len(roles), F.col(time))).over(Window.partitionBy(game))).drop("_n")


def triggered_log(df: DataFrame, start: Column, stop: Column, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    """Events between a start and the next stop event, both included."""
    state = F.when(start | stop, F.struct(time, line, start.alias("on")))
    df = running(df, [game], [time, line], {"_now": ("max", state), "_was": ("max", state, _before)})
    keep = F.coalesce(F.col("_now")["on"], F.lit(False)) | (F.coalesce(F.col("_was")["on"], F.lit(False)) & stop)
    return df.where(keep).drop("_now", "_was")


def last_name_by_log(df: DataFrame, log: str, name: str, line: str, prefix: str) -> DataFrame:
    """The last event name with ``prefix`` of each log; null for logs without one."""
    hit = F.col(name).startswith(prefix)
    return df.groupBy(log).agg(F.max(F.when(hit, F.struct(line, name)))[name].alias("last_name"))


def is_selected(name: Column, piece: Column, entity: Column, kinds: Sequence[str]) -> Column:
    """The event is a selection and its piece is the entity."""
    return F.coalesce(name.isin(*kinds) & (piece == entity), F.lit(False))


def is_referent(last_moved: Column, entity: Column) -> Column:
    """The last moved piece is the entity."""
    return F.coalesce(last_moved == entity, F.lit(False))


def entity_no(index: Column) -> Column:
    return index + 1


def session_metadata(df: DataFrame, delimiter: Column, won: Column, lost: Column, entity: str, sender: str, game: str = "game", time: str = "time", line: str = "line") -> DataFrame:
    """Long (game, key, value): end score, entity, event and round counts, duration in seconds, initial instructor, start time."""
    one = df.groupBy(game).agg(
        F.sum(F.when(won, 1).when(lost, -2).otherwise(0)).alias("end_score"),
        F.count_distinct(entity).alias("entity_count"),
        F.count("*").alias("event_count"),
        F.sum(delimiter.cast("int")).alias("round_count"),
        ((F.max(time) - F.min(time)) / 1_000_000).cast("decimal(20,6)").alias("duration"),
        F.min(F.when(delimiter, F.struct(time, line, sender)))[sender].alias("initial_instructor"),
        F.min(time).alias("start_time"),
    )
    keys = ["end_score", "entity_count", "event_count", "round_count", "duration", "initial_instructor", "start_time"]
    return one.select(game, F.explode(F.array(*[F.struct(F.lit(k.upper()).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("kv")).select(game, "kv.key", "kv.value")


def shift_times(df: DataFrame, time: str, matches: Column, micros: int) -> DataFrame:
    """``time`` (microseconds) of matching events moved by an addend, rounded half up to milliseconds."""
    moved = F.floor((F.col(time) + micros) / 1000 + 0.5).cast("long") * 1000
    return df.withColumn(time, F.when(matches, moved).otherwise(F.col(time)))


def stretch_times(df: DataFrame, time: str, matches: Column, factor: float, origin: Column | None = None) -> DataFrame:
    """``time`` of matching events multiplied, from 1970 or from ``origin``, rounded half up to milliseconds."""
    base = F.lit(0) if origin is None else origin
    moved = F.floor(((F.col(time) - base) * factor + base) / 1000 + 0.5).cast("long") * 1000
    return df.withColumn(time, F.when(matches, moved).otherwise(F.col(time)))
