"""Line dedup, whitening and conversation repair against plain versions, on odd rows and in small blocks."""

import hashlib
import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import lines, queries, repair, whitening
from tests.compare import connect, spark_rows, sql_rows

DOC = "doc_id long, text string, h long, t long, n long, gone string"


def with_table(name, columns, rows):
    con = connect("/root/testdata/sf0.001")
    con.sql(f"drop view {name}")
    con.sql(f"create table {name} ({columns})")
    if rows:
        con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    return con


def odd_documents():
    rng = np.random.default_rng(5)
    said = [f"{w} line that stands in more than one document, {w} again" for w in ("First", "second", "THIRD", "fourth é")]
    frames = ["{}", "  {}\t", "\x0b{}\x0c", "{} "]
    rows = []
    for i in range(60):
        part = [frames[rng.integers(0, 4)].format(said[j].upper() if rng.integers(0, 2) and j < 3 else said[j]) for j in rng.integers(0, 4, rng.integers(0, 6))]
        part += ["short", "", f"a line of document {i} alone, and long enough to count"][: rng.integers(0, 4)]
        rows.append((None if i % 13 == 0 else i % 40, "\n".join(part[k] for k in rng.permutation(len(part)))))
    rows += [rows[5], rows[5], (1000, None), (1001, ""), (1002, "\n"), (1003, "\n".join([said[0]] * 3000)), (None, said[0])]
    return [(*r, 1, 2, 3, "x") for r in rows]


def test_lines_on_odd_rows(spark):
    rows = odd_documents()
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, DOC))
    got = got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    con = with_table("documents", "doc_id bigint, text varchar", [r[:2] for r in rows])
    want = sql_rows(con, queries.ORACLE_SQL["op11_lines"])
    assert spark_rows(got) == want
    assert sum(int(r[want[0].index("n_dropped")]) for r in want[1]) > 50


def plain_lines(rows, least_chars, least_docs):
    held = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for x in (text or "").split("\n"):
            held[key(x)].add(-math.inf if doc is None else doc)
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if len(key(x)) < least_chars or len(held[key(x)]) < least_docs or max(held[key(x)]) == (-math.inf if doc is None else doc)]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fan", [(1, 2), (5, 2), (7, 3)])
def test_line_batches_and_compaction(spark, batches, fan):
    rows = [r[:2] for r in odd_documents()]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 8, 2, batches, fan).collect()
    assert sorted(map(tuple, got), key=repr) == plain_lines(rows, 8, 2)


def test_line_runs(spark):
    runs = lines.LineRuns(spark, 2)
    batches = [[(1, 1, 9), (2, 1, 9), (1, 1, 8)], [(1, 1, 7), (3, 1, None)], [(3, 1, 6), (4, 1, 6), (1, 1, 5)], [(9, 9, 4)], []]
    firsts = [{(r.h, r.holder) for r in runs.add(spark.createDataFrame(b, "h long, g long, doc_id long")).collect()} for b in batches]
    assert firsts == [{(1, 9), (2, 9)}, {(3, None)}, {(4, 6)}, {(9, 4)}, set()]
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h, r.n) for r in runs.totals().collect()} == {(1, 4), (2, 1), (3, 2), (4, 1), (9, 1)}
    merge = runs.runs()[0].join(runs.runs()[1], lines.KEY, "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in merge


def test_runs_merge_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        runs = lines.LineRuns(spark, 9)
        for i in range(2):
            runs.add(spark.range(100).select((F.col("id") * (i + 1)).alias("h"), F.lit(1).cast("long").alias("g"), F.lit(i).alias("doc_id")))
        a, b = runs.runs()
        plan = a.join(b.select(*lines.KEY), lines.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lines_empty(spark):
    assert lines.drop_repeated_lines(spark.createDataFrame([], DOC)).collect() == []
    assert lines.drop_repeated_lines(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect() == [(None, 1, 0, "")]


def plain_whitening(vectors):
    """By an eigenvalue routine: {x: (deviation, whitened components)}, shares, n."""
    x = np.array(sorted(set(vectors)), np.int64)
    centred = (len(x) * x - x.sum(axis=0)) / len(x)
    values, components = np.linalg.eigh(centred.T @ centred / len(x))
    values, components = values[::-1], components[:, ::-1]
    return x, values, components, centred


def test_whitening(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    raw = {r.vec_id: tuple(math.floor(64 * c) + 1000000 for c in r.embedding) for r in table.collect()}
    x, values, components, centred = plain_whitening(raw.values())
    total, at = x.sum(axis=0), {tuple(v): i for i, v in enumerate(x.tolist())}
    rows = queries.op12_whitening(spark, sf_dir).collect()
    assert len(rows) == 16 * len(raw) and {r.component for r in rows} == set(range(1, 17))
    signs = {}
    for r in rows:
        k = r.component - 1
        want = centred[at[raw[r.vec_id]]] @ components[:, k] / math.sqrt(values[k])
        assert abs(abs(r.whitened) - abs(want)) < 1e-8
        if abs(want) > 1e-3:
            assert signs.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert r.n == len(x) and r.deviation == sum((len(x) * a - b) ** 2 for a, b in zip(raw[r.vec_id], total.tolist()))
        assert math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9) and r.identity_error < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.0, 3.0], [0.5, 2.0, 1.0], [0.25, -1.0, 4.0], [0.5, 1.0, 3.0], [7.0, 0.0, 0.001]]
    rows = [(i, v) for i, v in enumerate(good)] + [(1, good[1]), (None, good[2]), (9, None), (10, []), (11, [1.0, None, 2.0]), (12, [nan, 1.0, 1.0]), (13, [inf, 1.0, 1.0]), (14, [1.0, 2.0]), (15, [1e300, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, n long, component string")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got if r.component == 1) == [(False, i) for i in (0, 1, 1, 2, 3, 4)] + [(True, None)]
    assert {r.n for r in got} == {4} and {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9
    by = defaultdict(set)
    for r in got:
        by[r.component].add(r.explained)
    assert abs(sum(max(v) for v in by.values()) - 1) < 1e-12
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id in (0, 3)")).collect() == []
    deep = whitening.whiten(df.where("vec_id in (0, 1)")).collect()  # two distinct vectors: one component
    assert {r.component for r in deep} == {1} and {round(abs(r.whitened), 9) for r in deep} == {1.0}


def test_factors():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 1), (7, 7), (40, 12), (33, 33)):
        b = rng.standard_normal((d, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
        v = b @ b.T
        low, order = whitening.cholesky_with_pivots(v)
        assert np.allclose(low @ low.T, v[np.ix_(order, order)], rtol=0, atol=1e-12 * v.max()) and np.allclose(np.triu(low[:, :], 1), 0)
        values, components = whitening.principal_components(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)], rtol=1e-9, atol=1e-12 * values[0])
        assert np.allclose(components.T @ components, np.eye(len(values)), atol=1e-12)
    assert whitening.principal_components(np.zeros((3, 3)))[0].size == 0


def test_deviations_beyond_long():
    model = whitening.Fit(10**9, np.array([0, 0]), np.ones(1), np.ones((2, 1)), np.ones(1))
    assert whitening.deviations(np.array([[3, 0], [1, 1], [2, 2]]), model) == [9 * 10**18, 2 * 10**18, 8 * 10**18]
    assert whitening.deviations(np.array([[3, 1]]), model) == [None]


def full_cyk(rows):
    """Every span from every cut, as in the textbook."""
    n = len(rows)
    cell = {(i, i + 1): repair.row_cell(*r) for i, r in enumerate(rows)}
    for width in range(2, n + 1):
        for i in range(n - width + 1):
            options = [repair.join_cells(cell[i, k], cell[k, i + width]) for k in range(i + 1, i + width)]
            cell[i, i + width] = [min((o[t] for o in options if o[t] is not None), default=None) for t in range(len(repair.NONTERMINALS))]
    return repair.accepted(cell[0, n])


def every_edit(rows):
    """The least (cost, audit) over all sequences of edits with at most two insertions at a place."""
    import re

    best = None
    for spots in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
        choices = [[("D", "", 3)] + ([] if fault in (1, 2) else [("K", initial, int(fault == 3)), ("R", "u", 2 + (fault == 3)), ("R", "a", 2 + (fault == 3))]) for initial, fault in rows]
        for edits in itertools.product(*choices):
            said = spots[0] + "".join(e[1] + s for e, s in zip(edits, spots[1:]))
            if re.fullmatch(r"(s?(ua)+)?", said):
                audit = "I" * len(spots[0]) + "".join(e[0] + "I" * len(s) for e, s in zip(edits, spots[1:]))
                found = (sum(e[2] for e in edits) + 2 * sum(map(len, spots)), audit)
                best = found if best is None else min(best, found)
    return best


def test_parsing():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3):
        for _ in range(12):
            rows = [("sua"[rng.integers(0, 3)], int(rng.integers(0, 4))) for _ in range(n)]
            assert repair.combine([repair.row_span(0, *r) for r in rows]).cell == repair.combine([repair.row_span(0, *r) for r in rows[:1]] + ([repair.combine([repair.row_span(0, *r) for r in rows[1:]])] if n > 1 else [])).cell
            assert repair.accepted(repair.combine([repair.row_span(0, *r) for r in rows]).cell) == every_edit(rows)
    for n in (7, 20, 33):
        rows = [("suax"[rng.integers(0, 4)], int(rng.integers(0, 4))) for _ in range(n)]
        rows = [(i if i != "x" else "", f) for i, f in rows]
        assert repair.accepted(repair.combine([repair.row_span(0, *r) for r in rows]).cell) == full_cyk(rows)
    assert repair.accepted(repair.insertions()) == (0, "")


def odd_conversations():
    rng = np.random.default_rng(9)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Yes.", "no", " ", "", None, "What? ", "a. b", "é!\t", "..."]
    rows = [(None if c == 7 else c, None if rng.integers(0, 9) == 0 else int(t), roles[rng.integers(0, 8)], texts[rng.integers(0, 9)]) for c in range(150) for t in rng.integers(-3, 12, rng.integers(1, 9))]
    rows += [(900, t, ["user", "assistant"][t % 2], f"turn {t}{'.' if t % 7 else ''}") for t in range(700)] + [rows[3]] * 3 + [(901, 1, "user", "x" * 50000)]
    return rows


def test_repair_on_odd_rows(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, at long, key string, fault int")
    con = with_table("conversations", "conv_id bigint, turn bigint, role varchar, text varchar", rows)
    assert spark_rows(repair.repair_report(df)) == sql_rows(con, queries.ORACLE_SQL["op13_repair"])


def test_repaired_conversations(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Hello."), ("a", 3, "assistant", "Hello."), ("a", 4, "user", "Go on."), ("b", 1, "user", "  "), ("c", 1, "tool", "Out."), ("c", 2, "assistant", "Yes.")]
    repaired, parsed = repair.repair_conversations(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert {r.key: (r.cost, r.audit) for r in parsed.collect()} == {":a": (5, "KKDKI"), ":b": (3, "D"), ":c": (2, "RK")}
    assert [(r.key, r.role, r.text) for r in repaired.orderBy("key", "place").collect()] == [(":a", "user", "Hi."), (":a", "assistant", "Hello."), (":a", "user", "Go on."), (":a", "assistant", ""), (":c", "user", "Out."), (":c", "assistant", "Yes.")]


def test_long_conversation(spark):
    n = 9000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), "id", F.expr("case when id % 2 = 0 then 'user' else 'assistant' end").alias("role"), F.concat(F.lit("turn "), "id", F.expr("case when id % 100 = 0 then '' else '.' end")).alias("text")).withColumnRenamed("id", "turn")
    repaired, parsed = repair.repair_conversations(rows)
    assert parsed.select("cost", "audit", "truncated", "illegal", "turns").collect() == [(90, "K" * n, 90, 0, n)]
    want = hashlib.sha256("\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:turn {i}{'' if i % 100 == 0 else '.'}" for i in range(n)).encode()).hexdigest()
    assert repair.conversation_sha256(repaired).collect() == [(":1", want)]


def test_repair_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(none).collect() == []
    lone = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in repair.repair_report(lone).collect()] == [None]
