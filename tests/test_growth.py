"""Steps whose cost grew faster than their rows, and results that differed on odd rows."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx


@pytest.mark.parametrize("n", [1, 2, 3])
def test_chunks_of_long_lists(spark, n):
    rng = random.Random(n)
    lists = [[rng.choice("ab") for _ in range(k)] for k in range(14)] + [[rng.choice("ab") for _ in range(20_000)], [None, "a"] * 6 + [None], ["a", None, "a"], None]

    def plain(t):
        c = [t[i : i + n] for i in range(0, len(t), n)]
        return c, [x for i, x in enumerate(c) if i % 2 == 0 or x != c[i - 1]]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "id int, t array<string>").withColumn("t", F.filter("t", lambda x: x.isNull() | (x != "-")))
    t0 = time.time()
    got = {r.id: r for r in df.select("id", tx.chunks(F.col("t"), n).alias("c"), tx.dedupe_chunk_pairs(tx.chunks(F.col("t"), n)).alias("d"), tx.dedupe_bigrams(F.col("t"), n).alias("b")).collect()}
    assert time.time() - t0 < 30  # one pass; with a pass for each run it took minutes
    for i, t in enumerate(lists[:-1]):
        c, kept = plain(t)
        assert (got[i].c, got[i].d, got[i].b) == (c, kept, [x for part in kept for x in part])
    assert got[len(lists) - 1].c == []


def test_first_character_stays_one_character(spark):
    texts = ["ßa", "ŉa", "ﬁa", "ᾀa", "İa", "éa", "ǆa", "a", "", "\U00010428a"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").orderBy("i")
    got = [(r.u, r.l) for r in rows.select(tx.uc_first(F.col("s")).alias("u"), tx.lc_first(F.col("s")).alias("l")).collect()]
    want = duckdb.execute("select upper(s[1]) || substr(s, 2), lower(s[1]) || substr(s, 2) from (select unnest(?) as s)", [texts]).fetchall()
    assert got == want


def test_collectors_see_many_keys_once_a_task(spark):
    from parlance.operators import collect

    calls = spark.sparkContext.accumulator(0)
    count = collect.Collector(int, lambda n, rows: (calls.add(1), n + len(rows["x"]))[1], lambda a, b: a + b, lambda n: (n,))
    df = spark.range(100_000, numPartitions=2).select((F.col("id") % 500).alias("k"), F.col("id").alias("x"))
    got = collect.collect(df, ["k"], ["x"], count, "n long").collect()
    assert sorted((r.k, r.n) for r in got) == [(k, 200) for k in range(500)]
    assert calls.value < 2 * 500 + 100  # a key of a task, and again where a batch ends in its rows


def test_collector_counts_all_events(spark, sf_dir):
    from parlance.plans import QUERIES, load

    load()
    got = QUERIES["x04_collector"](spark, sf_dir).agg(F.sum("n_events")).first()[0]
    assert got == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_streams_take_few_batches_whatever_the_files(spark, sf_dir, tmp_path):
    import os

    from parlance.plans.stream_queries import BATCHES, streamed
    from parlance.streaming import live, state

    own = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "18")
        found = state.live_pairing(streamed(spark, sf_dir), ("first", "second"))
        assert live.drain(found, f"{tmp_path}/out", f"{tmp_path}/state", 3).count() > 0
        assert spark.conf.get("spark.sql.shuffle.partitions") == "18"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    assert len([x for x in os.listdir(f"{tmp_path}/state/commits") if x.isdigit()]) <= BATCHES + 1
    assert len([x for x in os.listdir(f"{tmp_path}/state/state/0") if x.isdigit()]) == 3


def test_packed_sessions_take_few_files(spark, tmp_path):
    import glob

    from parlance.sources import packed, tables, text

    rows = spark.range(300, numPartitions=3).select(F.when(F.col("id") > 0, F.col("id")).alias("d"), F.concat(F.lit("k = v"), "id").alias("a"), F.lit("# k = x").alias("b"))
    path = f"{tmp_path}/packed"
    packed.pack(packed.files_of(rows, packed.file_path("d", "one.properties"), F.col("a"), F.col("b")), path)
    packed.pack(packed.files_of(rows, packed.file_path("d", "two.tsv"), F.lit("ID\tx\ty"), F.lit("n\t1")), path)
    assert len(glob.glob(f"{path}/*.parquet")) == 6
    assert text.sessions_in(packed.unpack(spark, path, "*.properties")).count() == 300
    props = text.parse_properties(packed.unpack(spark, path, "one.prop*")).select(packed.session_of("path", "d").alias("s"), "key", "value")
    assert {tuple(r) for r in props.collect()} == {(str(i) if i else None, "k", f"v{i}") for i in range(300)}
    cells = tables.participant_metadata(packed.unpack(spark, path, "two.tsv")).select(packed.session_of("session", "d").alias("s"), "participant", "value")
    assert {tuple(r) for r in cells.where("s = '7' or s is null").collect()} == {(s, p, v) for s in ("7", None) for p, v in (("x", "1"), ("y", ""))}
    twice = spark.createDataFrame([("/d=1/m", 0, "k\ta"), ("/d=1/m", 1, "k\tb")], packed.LINES)
    with pytest.raises(Exception, match="twice"):
        tables.session_metadata(twice).collect()


def test_events_sink_is_one_compressed_table(spark, sf_dir):
    from parlance.plans import QUERIES, load

    load()
    back = QUERIES["s17_events_sink"](spark, sf_dir)
    files = back.inputFiles()
    assert all(f.endswith(".csv.gz") and "game=" not in f for f in files) and len(files) <= 4  # a file for each game before


@pytest.mark.parametrize("chunk", [4 << 20, 16])
def test_events_sink_keeps_every_text(spark, tmp_path, monkeypatch, chunk):
    """Names lost white space at their ends, empty ones became null, and one with a line break became two rows."""
    import datetime

    from parlance.operators import events as ev
    from parlance.plans import QUERIES, load
    from parlance.sources import tables

    load()
    monkeypatch.setattr(tables, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(tables, "FILE_ROWS", chunk, raising=False)
    monkeypatch.setattr(ev, "TASK_EVENTS", 6, raising=False)
    names = ["click", "signup", "purchase", "", "?", None, " a ", "a\tb", "a\nb\r\n", "\\", "\\t\\", "\\?", "\0#", "\x01", '"q"', "\u00e9\u2028\u0085", "x" * 100]
    rows = [(i, datetime.datetime(2024, 1, 1, 0, 0, i), g, n, i + 0.5, f'{{"k": {i % 7}}}') for i, (n, g) in enumerate((n, g) for g in (1, 2, None) for n in names)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    back = QUERIES["s17_events_sink"](spark, str(tmp_path))
    want = QUERIES["s17_event_entity_table"](spark, str(tmp_path)).withColumn("game", F.col("game").cast("string"))
    assert back.dtypes == want.dtypes and set(map(str, names)) == {str(r.NAME) for r in want.collect()}
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, want.collect()))) and want.count() == 2 * 7 * len(names)
    assert len(re.findall(r"RepartitionByExpression \[game#\w+, _span#\w+\], 9", plan(want))) == 2  # as many tasks as the events ask for; the session's number before


def test_lines_of_another_table_stop_the_job(spark, tmp_path):
    from parlance.sources import tables

    schema = "GAME string, N int"
    tables.write_lines(spark.range(3).select(tables.cells({"GAME": F.lit("a"), "N": F.col("id")}, schema).alias("line")), f"{tmp_path}/t", schema)
    assert {tuple(r) for r in tables.read_lines(spark, f"{tmp_path}/t", schema).collect()} == {("a", 0), ("a", 1), ("a", 2)}
    for other in ("GAME string, M int", "GAME int, N int", "GAME string"):
        with pytest.raises(Exception, match="header|onversion"):
            tables.read_lines(spark, f"{tmp_path}/t", other).collect()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trees_are_swept_where_they_are(spark):
    from parlance.operators import tokens

    trees = spark.createDataFrame([(1, "(S (NP (DT the) (NN cat)) (VP sat"), (2, ") ) (A (B x)) y"), (None, "(X)"), (4, None)], "sent int, tree string")
    words, nodes = tokens.read_trees(trees)
    assert {tuple(r) for r in words.collect()} == {(1, 0, "the"), (1, 1, "cat"), (1, 2, "sat"), (2, 0, "x"), (2, 1, "y")}
    want = {(1, "S", 0, 3, 0, "the"), (1, "NP", 0, 2, 1, "the"), (1, "DT", 0, 1, 2, "the"), (1, "NN", 1, 2, 2, "cat"), (1, "VP", 2, 3, 1, "sat"), (2, "A", 0, 1, -2, "x"), (2, "B", 0, 1, -1, "x"), (None, "X", 0, 0, 0, None)}
    assert {tuple(r) for r in nodes.collect()} == want
    assert "Window" not in plan(words) + plan(nodes)  # windows shuffled and sorted every mark


@pytest.mark.parametrize("most", [0, 10])
def test_lemmas_are_looked_up_where_rows_are(spark, monkeypatch, most):
    from parlance.operators import tokens

    monkeypatch.setattr(tokens, "LEXICON", most)
    rows = [(1, ["The", "cats", None, "the"]), (2, []), (3, None), (4, ["x"] * 5 + ["cats"])]
    lexicon = spark.createDataFrame([("The", "the"), ("cats", "cat"), ("x", "x"), (None, "n")], "token string, lemma string")
    found = tokens.lemmatise(spark.createDataFrame(rows, "k long, tokens array<string>"), lexicon, "k")
    assert {r.k: r.lemmas for r in found.collect()} == {1: ["the", "cat", None, "the"], 2: [], 3: [], 4: ["x"] * 5 + ["cat"]}
    assert most == 0 or "Join" not in plan(found) and "Aggregate" not in plan(found)


def test_sets_that_share_words_go_to_few_blocks(spark, monkeypatch):
    """Pairs that nearly all share tokens are compared in blocks of 20 * ``block`` sets; each set went to as many places as there are blocks of ``block``."""
    from parlance.operators import dialogue
    from parlance.sources import scratch as folder

    rng = random.Random(5)
    rows = [(o, [f"w{rng.randrange(30)}" for _ in range(rng.randrange(5, 15))]) for o in (1, 2) for _ in range(800)]
    paths = []
    monkeypatch.setattr(dialogue, "scratch", lambda s, what: paths.append(folder.scratch(s, what)) or paths[-1])
    got = {(r.ordinal, round(r.overlap, 9)): r.n for r in dialogue.previous_order_pairs(spark.createDataFrame(rows, "ordinal int, tokens array<string>"), block=20).collect()}
    copies = spark.read.parquet(paths[1]).selectExpr("explode(places) as p", "later").selectExpr("max(if(later, p.pb, p.pa))").first()[0]
    assert copies <= 2  # 40 before
    want = {}
    one, two = ([set(t) for o, t in rows if o == k] for k in (1, 2))
    for a in two:
        for b in one:
            key = 2, round(len(a & b) / len(a | b), 9)
            want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("most, wide, often", [(1 << 22, 2048, 0.003), (50, 3, 0.02), (7, 2048, 1), (1 << 22, 2, 0)])
def test_overlaps_of_whole_blocks(monkeypatch, most, wide, often):
    import numpy as np
    import pandas as pd

    from parlance.operators import dialogue

    rng = random.Random(7)
    side = lambda n, copies: pd.DataFrame({"t": [np.array([hash(("t", x)) for x in {int(rng.expovariate(0.1)) for _ in range(rng.randrange(0, 12))}], np.int64) for _ in range(n)], "n": [rng.randrange(1, 1 + copies) for _ in range(n)]})
    monkeypatch.setattr(dialogue, "OFTEN", often)
    for a, b in ((side(25, 1), side(31, 1)), (side(25, 3), side(31, 1 << 40)), (side(1, 1), side(9, 1)), (pd.DataFrame({"t": [np.array([], np.int64)], "n": [2]}), side(4, 1))):
        want = {}
        for s, n in a.itertuples(index=False):
            for t, m in b.itertuples(index=False):
                key = len(set(s) & set(t)), len(s) + len(t)
                want[key] = want.get(key, 0) + n * m
        got = dialogue._all_overlaps(a, b, 10, wide, most)
        assert dict(zip(zip(got["shared"], got["total"]), got["n"])) == want


@pytest.mark.parametrize("rows_of_board", [64, 0])
def test_free_places_by_boards(spark, monkeypatch, rows_of_board):
    """A task holds about TASK_ROWS rows, however many there are and whatever the session's partitions; partitions grew to any size before."""
    from parlance.operators import geometry

    monkeypatch.setattr(geometry, "BOARD_ROWS", rows_of_board)
    monkeypatch.setattr(geometry, "TASK_ROWS", 10)
    rng = random.Random(3)
    rows, cols = 7, 62
    taken = [(g, x, x + rng.randrange(0, 4), y, y + rng.randrange(0, 30)) for g in [None, *range(1, 12)] for _ in range(9) for x, y in [(rng.randrange(-2, rows), rng.randrange(-5, cols + 3))]]
    pieces = [(g, 10 * (g or 0) + i, rng.randrange(0, rows + 2), rng.choice([0, 1, 2, 5, 31, 62, 63])) for g in [None, *range(1, 14)] for i in range(6)] + [(2, 20, 1, 2), (3, 99, None, 2)]
    place = "game int, x0 int, x1 int, y0 int, y1 int"
    got = geometry.free_regions(spark.createDataFrame(pieces, "game int, piece int, height int, width int"), spark.createDataFrame(taken, place), rows, cols)
    assert not rows_of_board or got.rdd.getNumPartitions() >= 10  # 4 before
    free = lambda g, x, y, h, w: not any(t[0] == g and t[1] < t[2] and t[3] < t[4] and x < t[2] and t[1] < x + h and y < t[4] and t[3] < y + w for t in taken)
    want = sorted((g, p, x, x + h, y, y + w) for g, p, h, w in pieces if g and h and w for x in range(rows - h + 1) for y in range(cols - w + 1) if free(g, x, y, h, w))
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("hot, span", [(2_000_000, 256), (5, 256), (2_000_000, 4), (5, 1)])
def test_events_meet_entities_after_the_last_shuffle(spark, monkeypatch, hot, span):
    """Pairs of event and entity were shuffled and sorted; now they come of the last step."""
    from parlance.operators import events

    monkeypatch.setattr(events, "HOT_ROWS", hot)
    monkeypatch.setattr(events, "SPAN", span)
    rng = random.Random(11)
    log = [(g, rng.choice([None, *range(12)]), line, rng.choice(["new", "won", "x"]), "p", rng.randrange(3)) for line, g in enumerate([1] * 30 + [2] * 3 + [None] * 2 + [4])]
    entities = [(g, e, "disc", 1, 7, e, e + 1, 0, 1) for g in (None, 1, 2, 3) for e in (0, 1, 2, 9)]
    moves = [(g, e, t, x, x + 1, 3, 4) for x, (g, e, t) in enumerate([(1, 0, 3), (1, 0, 3), (1, 0, 5), (1, 1, -1), (1, 1, 11), (1, 2, None), (1, 8, 2), (2, 0, 4), (2, 0, 40), (3, 0, 1), (1, 9, 7), (1, 9, 8), (None, 1, 1)])]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    log_, entities_ = frame(log, "game int, time long, line long, name string, sender string, piece int"), frame(entities, "game int, entity int, shape string, edge_count int, argb int, x0 int, x1 int, y0 int, y1 int")
    found = events.event_entity_table(log_, entities_, frame(moves, "game int, entity int, time long, x0 int, x1 int, y0 int, y1 int"), F.col("name") == "new", F.col("name") == "won", F.col("name") == "x", ("x",), 20, 20)
    want = []
    for g in (1, 2):
        told = sorted((r for r in log if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for n, (_, time, *_) in enumerate(told, 1):
            for e in (0, 1, 2, 9):
                before = [(t, x) for mg, me, t, x, *_ in moves if (mg, me) == (g, e) and t is not None and time is not None and t < time]
                want.append((g, n, e + 1, ((max(before)[1] if before else e) + 0.5) / 20, (3.5 if before else 0.5) / 20))
    assert sorted((r.game, r.EVENT, r.ENTITY, r.POSITION_X, r.POSITION_Y) for r in found.collect()) == sorted(want)
    lines = plan(found).splitlines()
    pairs = [i for i, line in enumerate(lines) if "Generate explode(slice" in line]
    assert pairs and not [line for line in lines[: pairs[0]] if "Window" in line or "Join" in line or "Aggregate" in line]
