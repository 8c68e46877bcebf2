"""Running values: the plain window and the blocked plan against a loop in Python."""

import random

import pytest
from pyspark.sql import functions as F

from gridtally.functions.scalars import outcome_win
from gridtally.operators import ordered as O
from gridtally.operators import relate as R
from gridtally.plans import history as H
from gridtally.plans import strength as T
from gridtally.sources import fixtures as fx


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most of the rows, a NULL group, small groups, and NULL values."""
    rnd = random.Random(4)
    rows = []
    for i in range(3_000):
        group = "hot" if i % 10 < 7 else rnd.choice(["a", "b", "c", None])
        rows.append((group, rnd.randint(1, 12), i, None if rnd.random() < 0.001 else rnd.randint(-9, 9)))
    return spark.createDataFrame(rows, "g string, week int, id int, x int").repartition(7)


def by_loop(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["week"], r["id"])):
        groups.setdefault(r["g"], []).append(r)
    out = {}
    for g, seq in groups.items():
        total, bad, dense, seen = 0, False, 0, None
        whole = [r["x"] for r in seq]
        for i, r in enumerate(seq, start=1):
            bad = bad or r["x"] is None
            total += r["x"] or 0
            dense += r["week"] != seen
            seen = r["week"]
            out[r["id"]] = (
                None if bad else total,
                None if bad else round(total / i, 9),
                i,
                seq[i - 2]["x"] if i > 1 else None,
                None if None in whole else sum(whole),
                len(seq),
            )
    return out


def specs():
    return dict(
        s=O.running_sum("x"),
        m=O.running_mean("x"),
        n=O.running_count(),
        p=O.previous("x"),
        t=O.group_sum("x"),
        c=O.group_count(),
    )


@pytest.mark.parametrize("hot_rows", [10**6, 900, 100, 13])
def test_running_equals_loop(skewed, hot_rows):
    o = O.ordered(skewed, ["g"], ["week", "id"], hot_rows)
    assert o.blocked == (hot_rows < 10**6)
    got = {
        r["id"]: (r["s"], None if r["m"] is None else round(r["m"], 9), r["n"], r["p"], r["t"], r["c"])
        for r in o.running(**specs()).frame.collect()
    }
    assert got == by_loop(skewed.collect())


def test_hot_group_is_cut_evenly(skewed):
    o = O.ordered(skewed, ["g"], ["week", "id"], 300)
    sizes = {
        (r["g"], r["__block"]): r["count"] for r in o._frame.groupBy("g", "__block").count().collect()
    }
    hot = [n for (g, _), n in sizes.items() if g == "hot"]
    assert len(hot) == 7 and max(hot) < 1.6 * 300
    assert all(b == 0 for g, b in sizes if g != "hot")


def test_schema_is_the_same_on_both_plans(skewed):
    plain = O.ordered(skewed, ["g"], ["week", "id"], 10**6).running(**specs()).frame
    cut = O.ordered(skewed, ["g"], ["week", "id"], 100).running(**specs()).frame
    assert plain.dtypes == cut.dtypes


@pytest.mark.parametrize("hot_rows", [10**6, 40])
def test_dense_position_without_keys(spark, hot_rows):
    rows = [(i, i * 7 % 50) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = O.ordered(df, [], ["v"], hot_rows).running(d=O.dense_position()).frame
    assert got.columns == ["id", "v", "d"]
    assert all(r["d"] == r["v"] + 1 for r in got.collect())


def test_history_is_the_same_when_every_team_is_hot(spark, data):
    games = fx.games(spark, data)
    plain = H.team_game_history(games, codes={})
    cut = H.team_game_history(games, codes={}, hot_rows=15)

    def rows(df):
        df = df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        return sorted(map(str, df.collect()))

    assert plain.columns == cut.columns
    assert rows(plain) == rows(cut)


def test_pregame_is_the_same_when_every_team_is_hot(spark, data):
    stats = H.running_team_stats(H.with_outcome(H.team_games(fx.games(spark, data), codes={}), 0.5))
    rows = stats.withColumns({"estimated_strength": F.col("wins") / F.col("game_num"), "initial_rating": F.lit(0.5)})
    keep = ["season", "team", "game_id", "pre_game_strength", "pre_point_mean"]
    plain = T.pregame_strengths(rows).select(*keep)
    cut = T.pregame_strengths(rows, hot_rows=15).select(*keep)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_exact_quantiles(spark, hot_rows):
    import numpy as np

    rnd = random.Random(1)
    rows = [("ab"[i % 3 == 0], rnd.choice([rnd.random(), 0.5])) for i in range(401)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = R.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.9}, hot_rows).collect()
    assert {r["g"] for r in got} == {"a", "b"}
    for r in got:
        want = np.quantile([v for g, v in rows if g == r["g"]], [0.25, 0.5, 0.9])
        assert [r["q1"], r["q2"], r["q3"]] == pytest.approx(list(want), abs=1e-12)


@pytest.mark.parametrize("hot_rows", [10**6, 30])
def test_level_table_counts_first_appearances(spark, hot_rows):
    rows = [(i, f"t{i * i % 97}") for i in range(400)]
    df = spark.createDataFrame(rows, "at int, team string").repartition(5)
    want = {}
    for _, t in rows:
        want.setdefault(t, len(want) + 1)
    got = R.level_table(df, "team", ["at"], hot_rows=hot_rows).collect()
    assert {r["team"]: r["ord"] for r in got} == want


def test_one_exchange_for_all_running_columns(spark, data):
    long = H.with_outcome(H.team_games(fx.games(spark, data), codes={}), 0.5)
    stored = long.select("*").persist()
    stored.count()
    try:
        plan = H.running_team_stats(stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        stored.unpersist()
    assert plan.split("InMemoryTableScan")[0].count("Exchange ") == 1
    assert "SinglePartition" not in plan


def test_sticky_null_needs_the_guard(spark):
    df = spark.createDataFrame([(1, 3), (2, None), (3, 5), (4, 1)], "i int, x int").withColumn("g", F.lit("a"))
    got = O.ordered(df, ["g"], ["i"]).running(s=O.running_sum("x")).frame.orderBy("i").collect()
    assert [r["s"] for r in got] == [3, None, None, None]


def test_win_and_margin_rules(spark):
    rows = [(3, "home"), (3, "away"), (-2, "home"), (-2, "away"), (0, "home"), (0, "away"), (None, "home"), (None, "away")]
    df = spark.createDataFrame(rows, "result int, set string")
    train = H.with_outcome(df, 0.5).collect()
    now = H.with_outcome(df, 0.0).collect()
    assert [r["win"] for r in train] == [1, 0, 0, 1, 0.5, 0.5, 0.5, 0.5]
    assert [r["delta"] for r in train] == [3, -3, -2, 2, 0, 0, 0, 0]
    assert [r["win"] for r in now] == [1, 0, 0, 1, 0.5, 0.5, 0, 0]
    assert [r["delta"] for r in now] == [3, -3, -2, 2, 0, 0, None, None]
    assert df.select(outcome_win("result", "set").alias("w")).agg(F.sum("w")).first()[0] == 4.0
