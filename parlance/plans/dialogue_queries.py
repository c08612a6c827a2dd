"""Queries over conversations: merging, mentions, overlap of vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import values as v
from parlance.operators import dialogue as dl
from parlance.operators import metadata as md
from parlance.operators import rounds as rounds_
from parlance.operators import stats as st
from parlance.plans import query
from parlance.plans.bindings import CONVERSATIONS_SQL, EVENTS_SQL, conversations, events, table
from parlance.sources import tables
from parlance.sources.scratch import scratch

C = f"with {CONVERSATIONS_SQL}"
MACRO = "len(list_distinct(list_intersect({a}, {b}))) / len(list_distinct(list_concat({a}, {b})))"


def overlap_sql(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"case when {a} is null or {b} is null then null when {union} = 0 then 'NaN'::double else len(list_intersect({a}, {b})) / {union} end"


def text_of(c: str) -> str:
    return f"array_to_string({c}, ' ')"


@query("p01_clean_tokens", f"{C} select dyad, start, array_to_string(list_filter(list_transform(string_split(text, ','), lambda t: trim(t, ' ')), lambda t: t <> ''), '|') as tokens from c where len(list_filter(list_transform(string_split(text, ','), lambda t: trim(t, ' ')), lambda t: t <> '')) > 0")
def clean_tokens(spark, sf):
    c = conversations(spark, sf).withColumn("tokens", F.split("text", ","))
    return dl.transform_utts(c, tx.clean_tokens).select("dyad", "start", F.array_join("tokens", "|").alias("tokens"))


RELEVANT = "t not in ('a', 'e', 'er', 'err', 'eh', 'ehm', 'em', 'eugh', 'uff', 'uh', 'uhm', 'um', 'umm') or t in ('a', 'e')"


@query("p03_relevant_tokens", f"{C} select dyad, start, array_to_string(list_filter(tokens, lambda t: not (t in {tx.METALANGUAGE} or t in {tx.FILLERS} or starts_with(t, '-') or ends_with(t, '-'))), ' ') as tokens from c")
def relevant_tokens(spark, sf):
    return conversations(spark, sf).select("dyad", "start", F.array_join(tx.keep_tokens(F.col("tokens"), tx.is_relevant), " ").alias("tokens"))


@query("p04_drop_empty", f"{C} select dyad, start from c where len(tokens) > 0")
def drop_empty(spark, sf):
    return dl.drop_empty(conversations(spark, sf)).select("dyad", "start")


@query("p05_filter_role", f"{C} select dyad, start from c where speaker = 'assistant'")
def filter_role(spark, sf):
    return dl.filter_role(conversations(spark, sf), "speaker", "assistant").select("dyad", "start")


@query("p10_filter_order", f"{C}, n as (select dyad, count(*) as n from c group by dyad) select dyad, n, (select count(*) from n where n < 3) as removed_low, (select count(*) from n where n > 6) as removed_high from n where n between 3 and 6")
def filter_order(spark, sf):
    n = conversations(spark, sf).groupBy("dyad").agg(F.count("*").alias("n"))
    kept, removed = dl.filter_order(n, 3, 6, "n")
    return kept.join(F.broadcast(removed))


@query("p13_order_columns", f"{C} select speaker, dyad, round, start, \"end\", text from c")
def order_columns(spark, sf):
    return dl.order_columns(conversations(spark, sf).drop("tokens"), ["speaker", "dyad"])


@query("p22_assign_participants", f"{C}, r as (select distinct dyad, speaker from c) select dyad, speaker, chr(cast(64 + row_number() over (partition by dyad order by case speaker when 'user' then 1 when 'assistant' then 2 else 3 end, speaker) as int)) as participant from r")
def assign_participants(spark, sf):
    r = conversations(spark, sf).select("dyad", "speaker").distinct()
    return md.assign_participants(r, "dyad", "speaker", "speaker", ["user", "assistant"]).select("dyad", "speaker", "participant")


WITHIN = f"o as (select *, row_number() over w as ordinal, lag(start) over w as previous_start, lag(tokens) over w as before from c where len(tokens) > 0 window w as (partition by dyad, speaker order by round, start, \"end\")), ov as (select *, case when ordinal = 1 then 0.0 else {overlap_sql('tokens', 'before')} end as overlap from o)"


@query("w01_coref_order", f"{C}, {WITHIN} select dyad, start, ordinal from ov")
def coref_order(spark, sf):
    return dl.coref_order(dl.drop_empty(conversations(spark, sf)), ["dyad", "speaker"]).select("dyad", "start", "ordinal")


@query("w02_within_speaker_overlap", f"{C}, {WITHIN} select dyad, speaker, start, ordinal, previous_start, overlap from ov")
def within_speaker_overlap(spark, sf):
    return dl.within_speaker_overlap(dl.drop_empty(conversations(spark, sf))).select("dyad", "speaker", "start", "ordinal", "previous_start", "overlap")


@query("w03_between_speaker_overlap", f"{C}, k as (select * from (select *, lead(speaker) over (partition by dyad order by round, start, \"end\") as nxt from c where len(tokens) > 0) where nxt is null or nxt <> speaker), b as (select *, row_number() over w as ordinal, lag(tokens) over w as before from k window w as (partition by dyad order by round, start, \"end\")) select dyad, start, ordinal, case when ordinal = 1 then 0.0 else {overlap_sql('tokens', 'before')} end as overlap from b")
def between_speaker_overlap(spark, sf):
    return dl.between_speaker_overlap(dl.drop_empty(conversations(spark, sf))).select("dyad", "start", "ordinal", "overlap")


@query("w03_as_run_overlap", f"{C}, b as (select *, row_number() over w as ordinal, lag(tokens) over w as before from c where len(tokens) > 0 window w as (partition by dyad order by start, \"end\")) select dyad, start, ordinal, case when ordinal = 1 then 0.0 else {overlap_sql('tokens', 'before')} end as overlap from b")
def as_run_overlap(spark, sf):
    return dl.between_speaker_overlap(dl.drop_empty(conversations(spark, sf)), mode="as_run").select("dyad", "start", "ordinal", "overlap")


SUMMARY = "count(overlap) as n, avg(overlap) as mean, case when count(*) > 1 then stddev_samp(overlap) end as std, case when count(*) > 1 then stddev_samp(overlap) / sqrt(count(*)) end as sem"


@query("a09_overlap_summary", f"{C}, {WITHIN} select ordinal, {SUMMARY} from ov where ordinal >= 2 group by ordinal")
def overlap_summary(spark, sf):
    return dl.overlap_summary(dl.within_speaker_overlap(dl.drop_empty(conversations(spark, sf))))


PAIRS = f"m as (select tokens, row_number() over (partition by dyad order by round, start, \"end\") as ordinal from c where len(tokens) > 0), pr as (select a.ordinal, {overlap_sql('a.tokens', 'b.tokens')} as overlap from m a join m b on a.ordinal = b.ordinal + 1)"


def pairs(spark, sf):
    return dl.previous_order_pairs(dl.coref_order(dl.drop_empty(conversations(spark, sf)), ["dyad"]))


@query("j13_previous_order_pairs", f"{C}, {PAIRS} select ordinal, overlap, count(*) as n from pr group by all")
def previous_order_pairs(spark, sf):
    return pairs(spark, sf)


@query("a10_pair_overlap_summary", f"{C}, {PAIRS} select ordinal, count(*) as n, avg(overlap) as mean, stddev_samp(overlap) as std, stddev_samp(overlap) / sqrt(count(*)) as sem from pr group by ordinal")
def pair_overlap_summary(spark, sf):
    return dl.pair_overlap_summary(pairs(spark, sf))


@query("f01_token_overlap", f"{C}, p as (select dyad, start, tokens, lead(tokens) over (partition by dyad order by start) as nxt from c) select dyad, start, {overlap_sql('tokens', 'nxt')} as overlap from p")
def token_overlap(spark, sf):
    from pyspark.sql import Window

    nxt = F.lead("tokens").over(Window.partitionBy("dyad").orderBy("start"))
    return conversations(spark, sf).withColumn("nxt", nxt).select("dyad", "start", tx.token_overlap(F.col("tokens"), F.col("nxt")).alias("overlap"))


@query("f02_token_types", f"{C} select dyad, start, len(list_distinct(tokens)) as n, array_to_string(list_sort(list_distinct(tokens)), ' ') as types from c")
def token_types(spark, sf):
    t = tx.token_types(F.col("text"))
    return conversations(spark, sf).select("dyad", "start", F.size(t).cast("long").alias("n"), tx.set_repr(t).alias("types"))


@query("f03_set_repr", f"{C} select dyad, array_to_string(list_sort(list_distinct(list(speaker))), ' ') as speakers from c group by dyad")
def set_repr(spark, sf):
    return conversations(spark, sf).groupBy("dyad").agg(tx.set_repr(F.collect_set("speaker")).alias("speakers"))


CLEAN = f"list_filter(tokens, lambda t: not (t in {tx.METALANGUAGE} or t in {tx.FILLERS} or starts_with(t, '-') or ends_with(t, '-')))"


def dedupe_sql(c: str) -> str:
    return f"flatten(list_transform(range(0, (len({c}) + 3) // 4), lambda i: case when {c}[4 * i + 3 : 4 * i + 4] = {c}[4 * i + 1 : 4 * i + 2] then {c}[4 * i + 1 : 4 * i + 2] else {c}[4 * i + 1 : 4 * i + 4] end))"


@query("f10_clean", f"{C}, k as (select dyad, start, {CLEAN} as t from c) select dyad, start, array_to_string({dedupe_sql('t')}, ' ') as tokens from k")
def clean(spark, sf):
    return conversations(spark, sf).select("dyad", "start", F.array_join(tx.clean(F.col("tokens")), " ").alias("tokens"))


SENT = "case when len(tokens) = 0 then '' else upper(array_to_string(tokens, ' ')[1]) || substr(array_to_string(tokens, ' '), 2) || case when ends_with(array_to_string(tokens, ' '), '.') then '' else '.' end end"


@query("f16_sentence", f"{C} select dyad, start, {SENT} as s from c")
def sentence(spark, sf):
    return conversations(spark, sf).select("dyad", "start", tx.sentence(F.col("tokens")).alias("s"))


TURNS = "tn as (select *, sum(cast(new as int)) over (partition by dyad order by start) as turn_no from (select *, speaker is distinct from lag(speaker) over (partition by dyad order by start) as new from c where len(tokens) > 0))"


@query("f15_dialogue_text", f"{C}, {TURNS}, s as (select dyad, turn_no, speaker, string_agg({SENT}, ' ' order by start) as said from tn group by all) select dyad, string_agg('**' || speaker || ':** \"' || said || '\"', chr(10) order by turn_no) as text from s group by dyad")
def dialogue_text(spark, sf):
    return dl.dialogue_text(conversations(spark, sf))


@query("a06_speaker_turns", f"{C}, {TURNS} select dyad, start, cast(turn_no as bigint) as turn_no from tn")
def speaker_turns(spark, sf):
    return dl.speaker_turns(dl.drop_empty(conversations(spark, sf))).select("dyad", "start", "turn_no")


@query("a05_merge_consecutive", f"{C}, g as (select *, sum(cast(new as int)) over (partition by dyad, round order by start) as turn_no from (select *, speaker is distinct from lag(speaker) over (partition by dyad, round order by start) as new from c where len(tokens) > 0)) select dyad, round, speaker, min(start) as start, max(\"end\") as \"end\", string_agg({text_of('tokens')}, ' ' order by start) as tokens from g group by dyad, round, speaker, turn_no")
def merge_consecutive(spark, sf):
    return dl.merge_consecutive_utts(conversations(spark, sf)).select("dyad", "round", "speaker", "start", "end", F.array_join("tokens", " ").alias("tokens"))


@query("a04_merge_speaker", f"{C} select dyad, round, speaker, min(start) as start, max(\"end\") as \"end\", string_agg({text_of('tokens')}, ' ' order by start) as tokens from c where len(tokens) > 0 group by dyad, round, speaker")
def merge_speaker(spark, sf):
    return dl.merge_speaker_utts(dl.drop_empty(conversations(spark, sf))).select("dyad", "round", "speaker", "start", "end", F.array_join("tokens", " ").alias("tokens"))


@query("a03_segment_lengths", f"{C} select dyad, start, len(tokens) as n from c")
def segment_lengths(spark, sf):
    return conversations(spark, sf).select("dyad", "start", F.size("tokens").cast("long").alias("n")).orderBy("n", "dyad", "start")


STATS = 'max("end") - min(start) as duration, count(distinct round) as rounds, count(*) as utts, cast(sum(len(tokens)) as bigint) as tokens, cast(min(len(tokens)) as bigint) as min_tokens, cast(max(len(tokens)) as bigint) as max_tokens, avg(len(tokens)) as mean_tokens, min("end" - start) as min_duration, max("end" - start) as max_duration, avg("end" - start) as mean_duration'


@query("a11_session_stats", f"{C} select dyad, {STATS} from c group by dyad")
def session_stats(spark, sf):
    return dl.session_stats(conversations(spark, sf))


@query("a12_stats_rollup", f"{C}, s as (select dyad, {STATS} from c group by dyad) select 'MIN' as stat, cast(min(duration) as double) as duration, cast(min(utts) as double) as utts, cast(min(tokens) as double) as tokens from s union all select 'MAX', max(duration), max(utts), max(tokens) from s union all select 'MEAN', avg(duration), avg(utts), avg(tokens) from s union all select 'SUM', sum(duration), sum(utts), sum(tokens) from s")
def stats_rollup(spark, sf):
    return dl.stats_rollup(dl.session_stats(conversations(spark, sf)), ["duration", "utts", "tokens"])


@query("a17_pearson", None)
def pearson(spark, sf):
    rows = dl.within_speaker_overlap(dl.drop_empty(conversations(spark, sf)))
    return st.pearson_test(rows.where("ordinal > 1"), "ordinal", "overlap")


@query("a17_pearson_r", f"{C}, {WITHIN} select corr(ordinal, overlap) as r, count(*) as n from ov where ordinal > 1")
def pearson_r(spark, sf):
    return pearson(spark, sf).select("r", "n")


@query("a18_spearman", None)
def spearman(spark, sf):
    rows = dl.within_speaker_overlap(dl.drop_empty(conversations(spark, sf)))
    return st.spearman_test(rows.where("ordinal > 1"), "ordinal", "overlap")


@query("a18_spearman_rho", f"{C}, {WITHIN}, rk as (select rank() over (order by ordinal) + (count(*) over (partition by ordinal) - 1) / 2 as x, rank() over (order by overlap) + (count(*) over (partition by overlap) - 1) / 2 as y from ov where ordinal > 1) select corr(x, y) as r, count(*) as n from rk")
def spearman_rho(spark, sf):
    return spearman(spark, sf).select("r", "n")


@query("a22_frame_shape", f"{C} select count(distinct dyad) as dyads, count(*) as n_rows from c")
def frame_shape(spark, sf):
    return conversations(spark, sf).agg(F.count_distinct("dyad").alias("dyads"), F.count("*").alias("n_rows"))


@query("a23_attrition", f"{C} select 0 as step_no, 'all' as step, count(*) as rows, 7 as columns from c union all select 1, 'not empty', count(*), 7 from c where len(tokens) > 0 union all select 2, 'assistant', count(*), 7 from c where len(tokens) > 0 and speaker = 'assistant'")
def attrition(spark, sf):
    c = conversations(spark, sf)
    kept = dl.drop_empty(c)
    return dl.attrition([("all", c), ("not empty", kept), ("assistant", dl.filter_role(kept, "speaker", "assistant"))])


@query("a24_canonical_map", f"{C} select text, min(lower(text)) as referring from c group by text")
def canonical_map(spark, sf):
    return dl.canonical_map(conversations(spark, sf).withColumn("referring", F.lower("text")), "text", "referring")


@query("j09_join_transformed", f"{C} select dyad, start, case when speaker = 'user' then lower(text) else '' end as referring from c")
def join_transformed(spark, sf):
    c = conversations(spark, sf).withColumn("segment", F.concat_ws("-", "dyad", "start"))
    changed = c.where("speaker = 'user'").select("segment", F.lower("text").alias("referring"))
    return dl.join_transformed(c, changed, "segment", "referring").select("dyad", "start", "referring")


@query("s19_referring_tokens", f"{C} select dyad, cast(round as varchar) as round, speaker, {text_of('tokens')} as tokens, case when speaker = 'user' then {text_of(CLEAN)} else '' end as referring_tokens from c")
def referring_tokens(spark, sf):
    c = conversations(spark, sf).withColumn("segment", F.concat_ws("-", "dyad", "start"))
    changed = c.where("speaker = 'user'").select("segment", F.array_join(tx.keep_tokens(F.col("tokens"), tx.is_relevant), " ").alias("referring_tokens"))
    return dl.join_transformed(c, changed, "segment", "referring_tokens").select("dyad", F.col("round").cast("string").alias("round"), "speaker", F.array_join("tokens", " ").alias("tokens"), "referring_tokens")


@query("a26_participant_metadata", f"{C} select dyad, 'UTTS' as metadatum, cast(count(*) filter (speaker = 'user') as varchar) as \"user\", cast(count(*) filter (speaker = 'assistant') as varchar) as assistant from c group by dyad")
def participant_metadata(spark, sf):
    n = conversations(spark, sf).groupBy("dyad").agg(*[F.sum((F.col("speaker") == p).cast("int")).cast("string").alias(p) for p in ("user", "assistant")])
    long = n.select("dyad", F.lit("UTTS").alias("metadatum"), F.explode(F.map_from_arrays(F.array(F.lit("user"), F.lit("assistant")), F.array("user", "assistant"))).alias("participant", "value"))
    return md.participant_metadata(long, "metadatum", "participant", "value", ["user", "assistant"], ["dyad"])


@query("f41_format_secs", f"{C}, m as (select dyad, start, cast(floor(round(start * 37.1234 * 1000000) / 1000) as bigint) as ms from c) select dyad, start, printf('%02d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) as s from m")
def format_secs(spark, sf):
    return conversations(spark, sf).select("dyad", "start", v.format_secs(F.col("start") * 37.1234).alias("s"))


@query("o01_sort_segments", f"{C} select dyad, start, \"end\" from c")
def sort_segments(spark, sf):
    return conversations(spark, sf).orderBy("start", "end", "dyad").select("dyad", "start", "end")


@query("o02_sort_utts", f"{C} select dyad, start, \"end\", row_number() over (partition by dyad order by start, \"end\") as place from c")
def sort_utts(spark, sf):
    from pyspark.sql import Window

    return conversations(spark, sf).select("dyad", "start", "end", F.row_number().over(Window.partitionBy("dyad").orderBy("start", "end")).alias("place"))


@query("o05_sort_output", f"{C} select dyad, round, start, \"end\", speaker from c")
def sort_output(spark, sf):
    return conversations(spark, sf).orderBy("dyad", "round", "start", "end", "speaker").select("dyad", "round", "start", "end", "speaker")


@query("u01_union_sessions", f"{C} select dyad, start from c where speaker = 'user' union all select dyad, start from c where speaker <> 'user'")
def union_sessions(spark, sf):
    c = conversations(spark, sf).select("dyad", "start", "speaker")
    return c.where("speaker = 'user'").unionByName(c.where("speaker <> 'user'")).drop("speaker")


@query("x02_transform_utts", f"{C}, k as (select dyad, start, list_filter(tokens, lambda t: len(t) > 6) as t from c) select dyad, start, {text_of('t')} as tokens from k where len(t) > 0")
def transform_utts(spark, sf):
    return dl.transform_utts(conversations(spark, sf), lambda t: F.filter(t, lambda x: F.length(x) > 6)).select("dyad", "start", F.array_join("tokens", " ").alias("tokens"))


@query("w13_dialogue_edges", f"{C} select dyad, arg_min(speaker, start) as first, arg_max(speaker, start) as last from c group by dyad")
def dialogue_edges(spark, sf):
    return dl.dialogue_edges(conversations(spark, sf), ["dyad"], "speaker", ["start", "end"])


# utterances and rounds of the events table
UE = f"with {EVENTS_SQL}, x as (select game, time, cast(sum(cast(name = 'signup' as int)) over (partition by game order by time, line) as bigint) as round, name, sender from e)"


def rounds(spark, sf):
    from parlance.operators import events as ev

    return ev.round_id(events(spark, sf), F.col("name") == "signup")


LAST = "lr as (select game, round, max(time) as last_time from x where name <> 'view' group by all), lt as (select *, lag(last_time) over (partition by game order by round) as previous_time, min(last_time) over (partition by game) as t0 from lr)"


@query("w07_last_round_timing", f'{UE}, {LAST} select game, round, last_time, previous_time, previous_time - t0 as "offset", last_time - previous_time as difference from lt')
def last_round_timing(spark, sf):
    return dl.last_round_timing(rounds(spark, sf).where("name <> 'view'"))


@query("a32_game_summary", f"{UE} select game, max(round) filter (name <> 'view') as rounds, max(time) filter (name <> 'view') - min(time) filter (name <> 'view') as duration, count(*) filter (name = 'view') as utts from x group by game having count(*) filter (name <> 'view') > 0")
def game_summary(spark, sf):
    x = rounds(spark, sf)
    return dl.game_summary(x.where("name = 'view'"), x.where("name <> 'view'"))


@query("p29_has_relevant", f"{C}, g as (select dyad, round, flatten(list(tokens)) as t from c group by all) select dyad, round, len(list_filter(t, lambda t: not (t in {tx.METALANGUAGE} or t in {tx.FILLERS} or starts_with(t, '-') or ends_with(t, '-')))) > 0 as relevant from g")
def has_relevant(spark, sf):
    return conversations(spark, sf).groupBy("dyad", "round").agg(tx.has_relevant(F.collect_list("tokens")).alias("relevant"))


#: every other turn, a quarter before it, begins a round; the speakers take turns in sending it
DELIM = "d as (select conv_id as dyad, cast(turn as double) - 0.25 as time, turn as line, case when turn % 4 = 0 then 'user' else 'assistant' end as sender from conversations where turn % 2 = 0)"


def delimiters(spark, sf):
    c = table(spark, sf, "conversations").where("turn % 2 = 0")
    return c.select(F.col("conv_id").alias("dyad"), (F.col("turn").cast("double") - 0.25).alias("time"), F.col("turn").alias("line"), F.when(F.col("turn") % 4 == 0, "user").otherwise("assistant").alias("sender"))


@query(
    "s16_utterance_table",
    f"{C}, {DELIM}, r as (select *, (select count(*) from d where d.dyad = c.dyad and d.time <= c.start) as n, (select arg_max(d.sender, d.time) from d where d.dyad = c.dyad and d.time <= c.start) as sent from c) "
    f"select cast(dyad as varchar) as dyad, cast(n as int) as round, speaker, case when speaker = coalesce(sent, 'user') then 'INSTRUCTOR' else 'MANIPULATOR' end as role, cast(start as float) as start_time, cast(\"end\" as float) as end_time, {text_of('tokens')} as tokens from r",
)
def utterance_table(spark, sf):
    """The utterance tables of all sessions written as one, with the session as a column, and read back."""
    path = scratch(spark, "utts")
    utts = rounds_.utterance_table(conversations(spark, sf), delimiters(spark, sf), F.lit(True), F.lit("user"), "dyad")
    tables.write_tsv(utts.select(F.col("dyad").cast("string").alias("DYAD"), *[c for c in utts.columns if c != "dyad"]).repartition("DYAD").sortWithinPartitions("DYAD", "ROUND", "START_TIME"), path, compression="gzip")
    back = tables.read_utterances(spark, path, lambda t: F.lit(True), f"DYAD string, {tables.UTTS}")
    return back.select(F.col("DYAD").alias("dyad"), F.col("ROUND").alias("round"), F.col("SPEAKER").alias("speaker"), F.col("DIALOGUE_ROLE").alias("role"), F.col("START_TIME").alias("start_time"), F.col("END_TIME").alias("end_time"), F.array_join("TOKENS", " ").alias("tokens"))


@query("s12_read_utterances", f"{C} select dyad, start, {text_of(CLEAN)} as tokens from c where len({CLEAN}) > 0")
def read_utterances(spark, sf):
    return dl.transform_utts(conversations(spark, sf), lambda t: tx.keep_tokens(t, tx.is_relevant)).select("dyad", "start", F.array_join("tokens", " ").alias("tokens"))


@query("x01_token_predicate", f"{C} select dyad, start, {text_of('list_filter(tokens, lambda t: len(t) >= 3)')} as tokens from c")
def token_predicate(spark, sf):
    return conversations(spark, sf).select("dyad", "start", F.array_join(tx.keep_tokens(F.col("tokens"), lambda t: F.length(t) >= 3), " ").alias("tokens"))
