"""Operators on small files and rows written here."""

import struct

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import values as v
from parlance.operators import dialogue, events, geometry, guards, metadata, stats, tokens
from parlance.sources import audio, records, tables, text, transcripts


@pytest.fixture
def session(tmp_path):
    d = tmp_path / "s1"
    d.mkdir()
    (d / "desc.properties").write_text("# a comment\n! another\ncanonicalEvents = events-ann.txt\nplayer.0.id=ann\nplayer.0.source:src1\nplayer.0.eventLog=events-ann.txt\nplayer.1.id=bob\nplayer.1.source=src2\nplayer.1.eventLog=events-bob.txt\nodd\\=key=1=2\n")
    log = '{"class":"x.Event","event_id":"a.%d","event_name":"game.%s","event_sender":"ann","event_time":"2017-01-01 10:00:0%d.5","GAME_ID":"g","SELECTION":{"pieceId":3}}\n'
    for p in ("ann", "bob"):
        (d / f"events-{p}.txt").write_text(log % (1, "ready", 1) + "\n" + '{"class":"x.Other"}\n' + log % (2, "turn", 2))
    (d / "utts.xml").write_text('<annotation><tracks><track id="t1"><sources><source id="src1" href="a.wav" channel="0"/></sources></track></tracks><segments><segment id="s10" start="1.5" end="2" source="src1" track="t1"><transcription><t>it</t><t>looks</t></transcription></segment><segment id="s2" start="0.5" end="1" source="src2" track="t1"><transcription><t>eh</t></transcription></segment></segments></annotation>')
    (d / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 24000) + b"\0" * 24000)
    (d / "selection-0-101112345-ann.png").write_bytes(b"png")
    (d / "participant-metadata.tsv").write_text("PARTICIPANT_ID\tA\tB\nAGE\t30\t40\nNOTE\tx\n")
    return str(tmp_path)


def test_session_files(spark, session):
    found = text.discover_sessions(spark, session).collect()
    assert [r.session_dir.rsplit("/", 1)[1] for r in found] == ["s1"]
    props = text.read_properties(spark, session)
    assert {r.key: r.value for r in props.collect()}["odd=key"] == "1=2"
    assert sorted((r.player_id, r.source_id) for r in text.player_sources(props).collect()) == [("ann", "src1"), ("bob", "src2")]
    with pytest.raises(Exception, match="incomplete"):
        text.player_sources(props.where("key <> 'player.1.source'")).collect()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(session).select("path")
    assert text.complete_sessions(files, ["desc.properties", "utts.xml"]).count() == 1
    assert text.complete_sessions(files, ["desc.properties", "none.tsv"]).count() == 0
    assert sorted(r.player for r in text.player_event_logs(files, 2).collect()) == ["ann", "bob"]
    assert text.list_files(spark, session, "wav").count() == 1
    shot = text.read_screenshots(files).first()
    assert (shot.kind, shot.id, shot.participant, shot.time_of_day) == ("selection", "0", "ann", ((10 * 60 + 11) * 60 + 12) * 1000 + 345)


def test_event_log(spark, session):
    log = records.read_event_log(spark, session, "events-*.txt")
    rows = sorted((r.path[-7:-4], r.line_no, r.name, r.selection.pieceId) for r in log.collect())
    assert rows == [("ann", 0, "game.ready", 3), ("ann", 3, "game.turn", 3), ("bob", 0, "game.ready", 3), ("bob", 3, "game.turn", 3)]
    bad = spark.createDataFrame([("p", 0, "{not json")], "path string, line_no int, value string")
    with pytest.raises(Exception):
        records.parse_records(bad).collect()


def test_transcripts_and_audio(spark, session):
    path = f"{session}/s1/utts.xml"
    segments = transcripts.read_segments(spark, path)
    assert {r.id: r.tokens for r in segments.collect()} == {"s10": ["it", "looks"], "s2": ["eh"]}
    assert [r.id for r in segments.orderBy(tx.natural_key(F.col("id"))).collect()] == ["s2", "s10"]
    sources = transcripts.read_sources(spark, path)
    assert [(r.track, r.source, r.href) for r in sources.collect()] == [("t1", "src1", "a.wav")]
    wavs = audio.read_wav_durations(spark, session).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "duration")
    near = sources.withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    assert float(transcripts.source_durations(near, wavs).first().duration) == 1.5
    with pytest.raises(Exception, match="same id"):
        transcripts.merge_annotations(segments, segments, "").collect()
    long = tables.read_participant_metadata(spark, session, "participant-metadata.tsv").collect()
    assert {(r.metadatum, r.participant): r.value for r in long} == {("AGE", "A"): "30", ("AGE", "B"): "40", ("NOTE", "A"): "x", ("NOTE", "B"): ""}


def test_nested_segments(spark, tmp_path):
    from parlance.sources import transcripts

    (tmp_path / "a.xml").write_text(
        """<?xml version="1.0" encoding="UTF-8"?>
<annotation><segments>
<segment id="s1" start="0.5" end="2.5" source="x" track="t1"><transcription><t>a</t>
  <segment id="s1a"><features><feature name="x">1</feature></features><transcription><t start="1">b</t><segment id="s1b"><transcription><t>deep</t><segment id="s1c"/></transcription></segment><t>&amp; &lt;t&gt; \u00e9</t></transcription></segment>
  <segment id="s1d"/><t/><t>c</t></transcription></segment>
<segment id="s2" start="3" end="4" source="x" track="t1"><features/></segment>
<segment id="s3" start="4" end="5" source="x" track="t1"><transcription/></segment>
</segments></annotation>"""
    )
    got = {r.id: r.tokens for r in transcripts.read_segments(spark, str(tmp_path / "a.xml")).collect()}
    assert got == {"s1": ["a", "b", "deep", "& <t> \u00e9", "", "c"], "s2": [], "s3": []}


def test_markup_round_trip(spark, tmp_path):
    from parlance.sources import transcripts

    rows = [(f"s{i}", float(i), [f"w{j}" if j % 3 else 'a<b>&"c' for j in range(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, start double, tokens array<string>")
    marked = df.select("id", "start", F.col("start").alias("end"), F.lit("x").alias("source"), F.lit('t"1').alias("track"), F.when(F.size("tokens") > 0, transcripts.segment_markup(F.col("id"), transcripts.token_markup(F.col("tokens")))).alias("markup"))
    transcripts.write_markup(marked, str(tmp_path / "out"))
    back = transcripts.read_segments(spark, str(tmp_path / "out"))
    assert sorted((r.id, r.start, r.tokens) for r in back.collect()) == sorted(rows)
    assert {r.track for r in back.collect()} == {'t"1'}


def test_guards(spark):
    df = spark.createDataFrame([("g", "s1"), ("g", "s2")], "game string, state string")
    with pytest.raises(Exception, match="different initial states"):
        guards.assert_same_state(df, "game", "state").collect()
    e = spark.createDataFrame([("g", 1, 1, "ready"), ("g", 2, 2, "ready")], "game string, time int, line int, name string")
    with pytest.raises(Exception, match="exactly one"):
        events.game_histories(e, "name", "ready").collect()


def test_asof_ties(spark):
    e = spark.createDataFrame([("g", 1, 1, "m", 7), ("g", 1, 2, "m", 8), ("g", 1, 3, "q", 0)], "game string, time long, line int, name string, v int")
    assert {r.line: r.last_v for r in events.last_event_asof(e, F.col("name") == "m", "v").collect()} == {1: 8, 2: 8, 3: 8}
    assert {r.last_v for r in events.last_event_asof(e, F.col("name") == "m", "v", strict=True).collect()} == {None}


def test_text_functions(spark):
    df = spark.createDataFrame([("eh so it has one sh- CLICK eh",)], "s string").select(tx.split_words(F.col("s")).alias("t"))
    assert df.select(tx.clean(F.col("t"))).first()[0] == ["so", "it", "has", "one"]
    assert df.select(tx.token_overlap(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] != 0
    assert df.select(tx.dedupe_bigrams(F.array(*map(F.lit, ["I", "can't", "I", "can't"])))).first()[0] == ["I", "can't"]
    names = spark.createDataFrame([("a.b",), ("a.b.c",), ("x",)], "n string")
    accept = lambda p: [r.n for r in names.where(tx.name_filter(F.col("n"), p)).collect()]
    assert accept("a.*") == ["a.b"] and accept("a.**") == ["a.b", "a.b.c"] and accept("!x") == ["a.b", "a.b.c"] and accept("** !a.b;x") == ["a.b.c", "x"] and accept("") == []


def test_time_functions(spark):
    df = spark.createDataFrame([("2017-03-28 12:00:00.5",)], "s string").select(v.event_time(F.col("s")).alias("t"))
    assert df.select(v.format_event_time(F.col("t")), v.iso_offset(F.col("t"), "Europe/Stockholm")).first()[:] == ("2017-03-28 12:00:00.5", "2017-03-28T12:00:00.500000+02:00")
    assert spark.range(1).select(v.format_hours(F.lit(-3661001)), v.format_minutes(F.lit(61001))).first()[:] == ("-01:01:01.001", "01:01.001")


def test_phrases(spark):
    nodes = spark.createDataFrame([(1, 0, "S", 0, 6, 0, "looks"), (1, 1, "NP", 0, 1, 1, "it"), (1, 2, "PP", 2, 6, 2, "like"), (1, 3, "NP", 3, 6, 3, "shape"), (1, 4, "NP", 3, 4, 4, "a"), (2, 0, "S", 0, 1, 0, "yes")], "sent int, node int, label string, start int, end int, depth int, head string")
    assert sorted((r.sent, r.start, r.end) for r in tokens.outermost_spans(nodes, "NP").collect()) == [(1, 0, 1), (1, 3, 6), (2, 0, 1)]
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate("it looks like a bird shape".split())], "sent int, pos int, token string")
    assert [r.token for r in tokens.prune_spans(toks, nodes, "PP", ["like"]).orderBy("pos").collect()] == ["it", "looks"]


def test_pseudonyms(spark):
    lines = spark.createDataFrame([("s", 2, "start bob"), ("s", 1, "start ann")], "session string, n int, text string")
    assert metadata.initial_player(lines, "session", "n", "text", "start (\\w+)").first().initial == "ann"
    mapping = spark.createDataFrame([("s", "ann", "A"), ("s", "anna", "B")], "session string, old string, new string")
    props = spark.createDataFrame([("s", "player.0.id", "anna"), ("s", "player.0.eventLog", "events-anna.txt"), ("s", "note", "anna")], "session string, key string, value string")
    assert [r.value for r in metadata.pseudonymise_props(props, "session", mapping).orderBy("key").collect()] == ["anna", "events-B.txt", "B"]
    files = spark.createDataFrame([("s", "selection-3-101112345-anna.png"), ("s", "turn-3-101112345-ann.png")], "session string, name string")
    assert [r.new for r in metadata.rename_plan(files, "session", "name", mapping).orderBy("old").collect()] == ["selection-4-101112345-B.png", "turn-5-101112345-A.png"]


def test_statistics():
    assert abs(stats.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(stats.chi2_upper(8.858, 2) - 0.01193) < 1e-5
    assert abs(stats.normal_quantile(0.995) - 2.5758293) < 1e-6


def test_mixed_model(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(g, float(x), float(2 + 0.5 * x + u + rng.normal(0, 1))) for g, u in enumerate(rng.normal(0, 2, 40)) for x in rng.normal(0, 1, 25)]
    m = stats.random_intercept_ml(spark.createDataFrame(rows, "g int, x double, y double"), "y", ["x"], "g")
    assert abs(m["coefs"]["x"] - 0.5) < 0.12 and 1.5 < m["group_var"] < 8 and 0.85 < m["residual_var"] < 1.15


def test_merging(spark):
    u = spark.createDataFrame([(1, 0, "a", 0.0, 1.0, ["x"]), (1, 0, "a", 1.0, 2.0, []), (1, 0, "a", 2.0, 3.0, ["y"]), (1, 0, "b", 3.0, 4.0, ["z"]), (1, 0, "a", 4.0, 5.0, ["w"])], "dyad int, round int, speaker string, start double, end double, tokens array<string>")
    assert [(r.speaker, r.tokens) for r in dialogue.merge_consecutive_utts(u).orderBy("start").collect()] == [("a", ["x", "y"]), ("b", ["z"]), ("a", ["w"])]
    assert dialogue.dialogue_text(u).first().text == '**a:** "X. Y."\n**b:** "Z."\n**a:** "W."'


def test_ranks_of_odd_values(spark):
    nan = float("nan")
    rows = [(1.0,), (None,), (nan,), (2.0,), (1.0,), (nan,)] + [(float(i),) for i in range(3, 3000)] + [(1e30,)]
    got = stats.avg_rank(spark.createDataFrame(rows, "v double"), "v").collect()
    assert len(got) == len(rows)
    by = {str(r.v): r.rank for r in got}
    assert by["None"] is None and by["1.0"] == 1.5 and by["2.0"] == 3 and by["2999.0"] == 3000 and by["1e+30"] == 3001 and by["nan"] == 3002.5


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_medians_of_frequent_keys(spark, monkeypatch, few):
    import numpy as np

    monkeypatch.setattr(stats, "FEW_VALUES", few)

    rng = np.random.default_rng(1)
    rows = [(k, float(x)) for k, n in (("a", 900), (None, 301), ("b", 2)) for x in rng.integers(0, 500, n)] + [("c", None)]
    got = {r.k: r for r in stats.rank_averages(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(got) == {"a", "b", "c", None} and got["c"].n == 0 and got["c"].median is None
    for k in ("a", "b", None):
        x = np.array([v for q, v in rows if q == k])
        assert got[k].median == np.median(x) and abs(got[k].mad - 1.4826 * np.median(np.abs(x - np.median(x)))) < 1e-9


def test_contexts_of_repeated_and_null_rows(spark):
    utts = spark.createDataFrame([("g", 0, 5, None), ("g", 0, 5, None), ("g", 90, 95, "b"), (None, 0, 5, "c")], "game string, start long, end long, speaker string")
    log = spark.createDataFrame([("g", 1, 1), ("g", 2, 2)], "game string, time long, line long")
    got = sorted((str(r.speaker), str(r.time)) for r in events.contexts(utts, log, "game", "start", "end", "time", "line", 10).collect())
    assert got == [("None", "1"), ("None", "1"), ("None", "2"), ("None", "2"), ("b", "None"), ("c", "None")]


def test_block_overlaps_over_blocks(spark):
    import random

    random.seed(3)
    rows = [(o, random.sample("abcdefghij", random.randint(0, 6))) for o in (1, 2, 3, 5) for _ in range(40)]
    df = spark.createDataFrame(rows, "ordinal int, tokens array<string>")
    want = {}
    for o, a in rows:
        for p, b in rows:
            if p == o - 1:
                x, y = set(a), set(b)
                key = (o, f"{len(x & y) / len(x | y):.6f}" if x | y else "nan")
                want[key] = want.get(key, 0) + 1
    rows_too = df.union(spark.createDataFrame([(None, ["a"]), (2, None)], df.schema))
    for block, marks in ((7, 6), (7, 0), (7, 2), (1000, 6), (20, 8)):
        got = dialogue.previous_order_pairs(rows_too, block=block, marks=marks).collect()
        assert {(r.ordinal, "nan" if r.overlap != r.overlap else f"{r.overlap:.6f}"): r.n for r in got} == want


def test_overlaps_of_disjoint_vocabularies(spark, monkeypatch):
    """Ten times the dyads, each with words of its own, are ten times the products of blocks, not a hundred."""
    import pandas as pd

    from parlance.sources import scratch as folder

    def held(dyads: int) -> tuple[int, dict]:
        df = spark.range(dyads * 20).selectExpr("cast(id % 2 + 1 as int) as ordinal", "array('the', concat('x', id div 20), concat('y', id div 20, '-', id % 10)) as tokens")
        paths = []
        monkeypatch.setattr(dialogue, "scratch", lambda s, what: paths.append(folder.scratch(s, what)) or paths[-1])
        got = {(r.ordinal, round(r.overlap, 6)): r.n for r in dialogue.previous_order_pairs(df, block=50).collect()}
        return spark.read.parquet(paths[1]).selectExpr("explode(places) as p", "o", "later").selectExpr("if(later, p.pb, p.pa) as copies").groupBy().sum().first()[0], got

    few, small = held(10)
    many, large = held(100)
    assert many <= 12 * few
    assert sum(small.values()) == 100 * 100 and sum(large.values()) == 1000 * 1000
    assert small[2, 0.2] == 100 * 90 and large[2, 0.2] == 1000 * 990  # "the" alone
    assert pd.Series({k: v for k, v in large.items() if k[1] > 0.2}).sum() == 100 * 100


def test_geometry(spark):
    board = spark.createDataFrame([("g", ["1", "1", "null", "null", "1", "1", "null", "2", None], 3)], "game string, occ array<string>, cols int")
    found = geometry.element_regions(geometry.cells(board, "game", "occ", "cols"))
    assert {r.element: (r.x0, r.x1, r.y0, r.y1) for r in found.collect()} == {"1": (0, 2, 0, 3), "2": (2, 3, 1, 2)}
    with pytest.raises(Exception, match="unknown shape"):
        geometry.with_edge_count(spark.createDataFrame([("no",)], "shape string"), spark.createDataFrame([("yes", 3)], "shape string, edges int")).collect()


def test_hot_games_in_stretches(spark, sf_dir, monkeypatch):
    """Games cut into stretches give the rows that one window gives."""
    from parlance.plans import QUERIES, load
    from tests.compare import spark_rows

    load()
    names = [n for n in QUERIES if n.startswith(("w04_", "w05_", "w06_", "w14_", "w15_", "j03_", "j05_", "j06_", "t06_triggered", "w02_", "w03_", "w07_", "w08_", "w10_", "a05_", "a06_", "f15_", "s27_"))]
    assert len(names) == 19
    names += [n for n in QUERIES if "asof" in n and n not in names]
    plain = {n: spark_rows(QUERIES[n](spark, sf_dir)) for n in names}
    monkeypatch.setattr(events, "HOT_ROWS", 4)
    assert {n: spark_rows(QUERIES[n](spark, sf_dir)) for n in names} == plain
    rows = [(None if i % 2 else 1, i // 3, i) for i in range(60)]
    got = events.event_no(spark.createDataFrame(rows, "game int, time long, line long")).collect()
    assert {(r.game, r.line): r.event_no for r in got} == {(g, i): i // 2 + 1 for g, _, i in rows}
    left = spark.createDataFrame([(t,) for t in range(0, 40, 4)], "time long")
    right = spark.createDataFrame([(t, t) for t in range(1, 30, 7)], "time long, v long")
    back = {r.time: r.v for r in events.asof_backward(left, right, [], "time", "v").collect()}
    ahead = {r.time: r.v for r in events.asof_forward(left, right, [], "time", "v").collect()}
    assert back == {t: max([x for x in range(1, 30, 7) if x <= t], default=None) for t in range(0, 40, 4)}
    assert ahead == {t: min([x for x in range(1, 30, 7) if x >= t], default=None) for t in range(0, 40, 4)}


def test_a_game_log_is_read_in_parts(spark, sf_dir, monkeypatch):
    from parlance.plans import file_queries
    from parlance.sources import text

    monkeypatch.setattr(text, "lines", None)
    monkeypatch.setattr(file_queries.records, "lines", None)  # reads each file as one value
    rows = sorted(map(tuple, file_queries.event_log_lines(spark, sf_dir).collect()))
    assert rows and rows == sorted(map(tuple, file_queries.event_log_lines(spark, sf_dir, 100).collect()))


def test_collectors_merge_in_any_order(spark, monkeypatch):
    import random

    import pandas as pd

    from parlance.operators import collect

    rng = random.Random(3)
    rows = [(None if i % 7 == 0 else i % 3, rng.choice([None, rng.uniform(-9, 9)]), rng.choice(["go", "say"]), i) for i in range(500)] + [(5, None, "ready", 9)]
    df = spark.createDataFrame(rows, "game int, value double, name string, time long")
    want = {}
    for g, v, _, _ in rows:
        counts = want.setdefault(g, {})
        if v is not None:
            counts[v // 2.5] = counts.get(v // 2.5, 0) + 1
    want = {g: ([k * 2.5 for k in sorted(c)], [c[k] for k in sorted(c)]) for g, c in want.items()}
    sketch = collect.histogram_collector(2.5, "value")
    monkeypatch.setattr(collect, "HELD", 2)  # states are handed on in between
    for parts, salts in ((1, 1), (7, 3), (23, 16)):
        got = {r.game: (r.low, r.n) for r in collect.collect(df.repartition(parts), ["game"], ["value"], sketch, "low array<double>, n array<long>", salts).collect()}
        assert got == want
    frame = pd.DataFrame(rows, columns=["game", "value", "name", "time"])
    states = [sketch.accumulator(sketch.supplier(), frame.iloc[i : i + 50]) for i in range(0, 500, 50)]
    results = set()
    for _ in range(5):
        rng.shuffle(states)
        merged = sketch.supplier()
        for s in states:
            merged = sketch.combiner(merged, dict(s))
        results.add(str(sketch.finisher(merged)))
    assert len(results) == 1
    total = collect.collect(df, [], ["value"], sketch, "low array<double>, n array<long>").collect()
    assert len(total) == 1 and sum(total[0].n) == sum(v is not None for _, v, _, _ in rows)
    assert collect.collect(df.limit(0), ["game"], ["value"], sketch, "low array<double>, n array<long>").collect() == []


def test_history_collector_guards(spark):
    from parlance.operators import collect

    shape = "start long, n long, first long, last long, ready long"
    log = lambda rows: spark.createDataFrame(rows, "game int, name string, time long, board string")
    one = collect.history_collector("name", "time", "ready", ("join",), "board")
    got = collect.collect(log([(1, "ready", 3, "s"), (1, "say", 4, None), (1, "join", 1, None), (1, "ready", 3, "s")]).repartition(4), ["game"], ["name", "time", "board"], one, shape).collect()
    assert [tuple(r) for r in got] == [(1, 3, 3, 3, 4, 2)]
    for bad, message in (([(1, "say", 4, None)], "no ready"), ([(1, "ready", 3, "s"), (1, "ready", 5, "s")], "differ"), ([(1, "ready", 3, "s"), (1, "ready", 3, "t")], "differ")):
        for parts in (1, 3):
            with pytest.raises(Exception, match=message):
                collect.collect(log(bad).repartition(parts), ["game"], ["name", "time", "board"], one, shape).collect()


def test_bracketed_trees(spark):
    from parlance.operators import tokens

    rows = [(1, "(S (NP (DT the) (NN cat)) (VP (VB sat) (PP (IN on) (NP (NP (DT a) (NN mat)) (PP (IN by) (NP (PRP me)))))))"), (2, "(X (Y hey)"), (3, None), (4, "  "), (5, "(S (E) (NN a)) )")]
    words, nodes = tokens.read_trees(spark.createDataFrame(rows, "sent int, tree string"))
    assert [(r.sent, r.pos, r.token) for r in words.orderBy("sent", "pos").collect()] == [(1, i, t) for i, t in enumerate("the cat sat on a mat by me".split())] + [(2, 0, "hey"), (5, 0, "a")]
    got = {(r.sent, r.label, r.start, r.end, r.depth, r["head"]) for r in nodes.collect()}
    assert {(1, "S", 0, 8, 0, "the"), (1, "NP", 0, 2, 1, "the"), (1, "NP", 4, 8, 3, "a"), (1, "NP", 4, 6, 4, "a"), (1, "PP", 6, 8, 4, "by"), (1, "NP", 7, 8, 5, "me"), (2, "X", 0, 1, 0, "hey"), (2, "Y", 0, 1, 1, "hey"), (5, "S", 0, 1, 0, "a"), (5, "E", 0, 0, 1, None)} <= got
    assert len(got) == 16 + 2 + 3
    outer = tokens.outermost_spans(nodes, "NP")
    assert sorted((r.sent, r.label, r.start, r.end) for r in outer.collect()) == [(1, "NP", 0, 2), (1, "NP", 4, 8), (2, "X", 0, 1), (5, "S", 0, 1)]
    assert [r.token for r in tokens.prune_spans(words, nodes, "PP", ["by"]).where("sent = 1").orderBy("pos").collect()] == "the cat sat on a mat".split()
    plan = outer._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_joins_on_levels(spark, monkeypatch):
    import random

    from parlance.operators import geometry

    rng = random.Random(8)
    side = lambda: rng.choice([1, 2, 5, 30, 200, 10_000])
    rows = []
    for i in range(300):
        x, y = rng.randrange(-50, 12_000), rng.randrange(-50, 400)
        rows.append((rng.choice([1, 1, 2, None]), i, x, x + side(), y, y + rng.choice([1, 3, 40, 10_000])))
    rows += [(1, 900, 5, 5, 5, 9), (1, 901, 0, 10_000, 0, 10_000), rows[0]]
    df = spark.createDataFrame(rows, "game int, piece int, x0 int, x1 int, y0 int, y1 int")
    hit = lambda a, b: a[2] < b[3] and b[2] < a[3] and a[4] < b[5] and b[4] < a[5] and a[2] < a[3] and b[2] < b[3]
    holds = lambda a, b: hit(a, b) and a[2] <= b[2] and a[3] >= b[3] and a[4] <= b[4] and a[5] >= b[5]
    for op, true in ((geometry.intersecting, hit), (geometry.subsumed, holds)):
        got = sorted((r.piece_a, r.piece_b) for r in op(df, df).collect())
        assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and true(a, b))
    long = geometry.rect()
    level = geometry.level_of(F.greatest(long["x1"] - long["x0"], long["y1"] - long["y0"]), 8)
    spread = geometry._spread(df.where("x0 < x1"), level, 8, "").groupBy("game", "piece", "x0", "x1").count()
    assert spread.agg(F.max("count")).first()[0] <= 8  # the repeated row counts twice


def test_contexts_of_long_utterances(spark):
    import random

    rng = random.Random(2)
    utts = [(rng.choice([1, 2, None]), i, s, s + rng.choice([0, 5, 400, 86_400])) for i in range(120) for s in [rng.randrange(0, 100_000)]]
    utts += [utts[0], (1, 500, 9, None), (1, None, 3, 9), (1, None, 3, 9), (1, 600, 50, 40)]
    log = [(rng.choice([1, 2, None]), rng.randrange(0, 200_000), i) for i in range(200)]
    got = events.contexts(spark.createDataFrame(utts, "game int, utt int, start long, end long"), spark.createDataFrame(log, "game int, time long, line long"), "game", "start", "end", "time", "line", 60)
    want = []
    for g, u, s, e in utts:
        hits = [(u, line, t) for h, t, line in log if e is not None and g is not None and h == g and s <= t <= e]
        want += hits or [(u, None, s)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.utt, r.line, r["at"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_records_of_any_schema_merge(spark):
    import json

    from parlance.functions.values import merge_records

    def plain(a, b):
        if b is None:
            return a
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: plain(a.get(k), b.get(k)) for k in {**a, **b}}
        return a + b if isinstance(a, list) and isinstance(b, list) else b

    records = [None, {}, {"a": 1}, {"a": None, "l": [1, {"x": None}]}, {"a": {"b": {"c": {"d": [1]}}}}, {"a": {"b": {"c": {"d": [2], "e": "f"}}, "n": None}}, {"l": []}, {"l": {"not": "a list"}}, {"a": "text", "\u00e9 '": [[1], [2]]}, {"l": [None, "1"], "a": [3]}]
    text = lambda r: None if r is None else json.dumps(r)
    rows = [(i * 100 + j, text(a), text(b)) for i, a in enumerate(records) for j, b in enumerate(records)]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    got = df.select("n", F.to_json(merge_records(F.parse_json("a"), F.parse_json("b"), 5)).alias("m")).collect()
    load = lambda s: None if s is None else json.loads(s)
    assert {r.n: load(r.m) for r in got} == {i * 100 + j: plain(a, b) for i, a in enumerate(records) for j, b in enumerate(records)}


def test_correlations_against_a_second_computation(spark, sf_dir):
    """p by integrating Student's density, the interval by bisecting the normal distribution, ranks by hand."""
    import math

    import numpy as np

    from parlance.operators import stats

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") % 7).cast("double").alias("x"), (F.col("l_extendedprice") % 11 + F.col("l_quantity") % 3).cast("double").alias("y")).limit(400).persist()
    x, y = (np.array([r[c] for r in df.collect()]) for c in "xy")

    def ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    def second(x, y, alpha=0.01):
        n = len(x)
        a, b = x - x.mean(), y - y.mean()
        r = float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))
        t, k = abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2
        grid = np.linspace(0, t, 200_001)
        density = np.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi) * (1 + grid**2 / k) ** (-(k + 1) / 2)
        p = 1 - 2 * float(((density[1:] + density[:-1]) / 2).sum() * (grid[1] - grid[0]))
        lo, hi = 0.0, 10.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < 1 - alpha else (lo, mid)
        z, half = math.atanh(r), lo / math.sqrt(n - 3)
        return r, n, p, math.tanh(z - half), math.tanh(z + half)

    for test, (a, b) in ((stats.pearson_test, (x, y)), (stats.spearman_test, (ranks(x), ranks(y)))):
        got = test(df, "x", "y").first()
        assert np.allclose([got.r, got.n, got.p, got.low, got.high], second(a, b), rtol=1e-6, atol=1e-9)


def test_mixed_model_against_dense_likelihood(spark):
    """The likelihood from the whole covariance matrix is nowhere above that of the fit."""
    import math

    import numpy as np

    from parlance.operators import stats

    rng = np.random.default_rng(5)
    group = np.repeat(np.arange(9), rng.integers(2, 9, 9))
    x = rng.normal(size=len(group))
    y = 1.5 + 0.7 * x + rng.normal(size=9)[group] * 1.3 + rng.normal(size=len(group)) * 0.6
    fit = stats.random_intercept_ml(spark.createDataFrame([(int(g), float(a), float(b)) for g, a, b in zip(group, x, y)], "g int, x double, y double"), "y", ["x"], "g")
    design, same = np.c_[np.ones(len(x)), x], group[:, None] == group[None, :]

    def likelihood(between, within):
        v = within * np.eye(len(x)) + between * same
        inverse = np.linalg.inv(v)
        beta = np.linalg.solve(design.T @ inverse @ design, design.T @ inverse @ y)
        rest = y - design @ beta
        return -0.5 * (len(x) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + rest @ inverse @ rest), beta

    best, beta = likelihood(fit["group_var"], fit["residual_var"])
    assert math.isclose(best, fit["loglik"], rel_tol=1e-9) and np.allclose(beta, list(fit["coefs"].values()), rtol=1e-6)
    for a in (0.98, 1, 1.02):
        for b in (0.98, 1, 1.02):
            assert likelihood(fit["group_var"] * a, fit["residual_var"] * b)[0] <= best + 1e-6


def test_free_places_on_wide_boards(spark):
    import random

    from parlance.operators import geometry

    rng = random.Random(6)
    rows, cols = 9, 150
    taken = [(g, x, x + rng.randrange(0, 4), y, y + rng.randrange(0, 30)) for g in (1, 2) for _ in range(14) for x, y in [(rng.randrange(-2, rows), rng.randrange(-5, cols))]]
    pieces = [(1, 0, 2, 5), (1, 1, 1, 1), (1, 2, 2, 5), (2, 3, 3, 70), (2, 4, 9, 2), (2, 5, 10, 1), (3, 6, 8, 149), (3, 7, 0, 1)]
    got = geometry.free_regions(spark.createDataFrame(pieces, "game int, piece int, height int, width int"), spark.createDataFrame(taken, "game int, x0 int, x1 int, y0 int, y1 int"), rows, cols)
    blocked = lambda g, x, y, h, w: any(t[0] == g and t[1] < t[2] and t[3] < t[4] and x < t[2] and t[1] < x + h and y < t[4] and t[3] < y + w for t in taken)
    want = {(p, x, y) for g, p, h, w in pieces if h for x in range(rows - h + 1) for y in range(cols - w + 1) if not blocked(g, x, y, h, w)}
    found = [(r.piece, r.x0, r.y0) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
