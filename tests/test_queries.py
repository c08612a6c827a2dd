"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest

from parlance.plans import ORACLE_SQL, QUERIES, load
from tests.compare import connect, spark_rows, sql_rows

load()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLE_SQL:
        assert got == sql_rows(connect(sf_dir), ORACLE_SQL[name])
    else:
        assert got[1]


#: queries whose rows are in an order, with that order in SQL
ORDERED = {
    "a01_token_counts": "n desc, token",
    "a02_token_tag_counts": "n desc, token, tag",
    "a03_segment_lengths": "n, dyad, start",
    "o01_sort_segments": 'start, "end", dyad',
    "o05_sort_output": 'dyad, round, start, "end", speaker',
    "o06_sort_log": "game, time, line",
    "w16_preceding": "time desc, line desc",
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_order(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = connect(sf_dir).sql(f"select * from ({ORACLE_SQL[name]}) order by {ORDERED[name]}")
    assert [tuple(r[c] for c in want.columns) for r in got.collect()] == want.fetchall()


def test_natural_and_listed_order(spark):
    from parlance.functions.text import natural_key
    from parlance.operators.metadata import order_by_list

    ids = ["s10", "s9", "a2", "s2-b", "s2-a10", "s2-a9", ""]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, n int")
    assert [r.id for r in df.orderBy(natural_key(df["id"])).collect()] == ["", "a2", "s2-a9", "s2-a10", "s2-b", "s9", "s10"]
    listed = spark.createDataFrame([(1, "x"), (2, "b"), (3, "y"), (4, "a"), (5, "x"), (6, "b")], "n int, c string")
    assert [r.n for r in order_by_list(listed, "c", ["a", "b"], "n").collect()] == [4, 2, 6, 1, 5, 3]


def test_first_match_and_single_game_guards(spark):
    from parlance.operators import guards

    log = spark.createDataFrame([(1, "g"), (1, "g"), (2, "g"), (2, "h")], "log int, game string")
    assert [r.game for r in guards.assert_single_game(log.where("log = 1"), ["log"], "game").collect()] == ["g"]
    with pytest.raises(Exception, match="more than one game"):
        guards.assert_single_game(log, ["log"], "game").collect()
