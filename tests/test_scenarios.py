"""Scenario draws and the tables built on them."""

import re

import pytest
from pyspark.sql import functions as F

from gridtally.functions.draws import draw_beta, draw_normal
from gridtally.operators import aggregate as A
from gridtally.operators import relate as R
from gridtally.operators import scenario as N
from gridtally.operators.fit import LinearModel
from gridtally.plans import reports as Q
from gridtally.sources import tables as src

MODEL = LinearModel(
    "result",
    ("pre_game_strength_home", "strength_diff", "is_after_week_1", "pre_game_strength_home_x_strength_diff"),
    0.5,
    (1.0, 25.0, 0.3, 2.0),
    12.0,
    0,
)


@pytest.fixture(scope="module")
def schedule(spark):
    teams = "ABCD"
    rows = []
    for w in range(1, 4):
        for k, (a, h) in enumerate([(0, w), tuple(sorted({1, 2, 3} - {w}))]):
            result = 3 if w == 1 else None
            rows.append((f"w{w}g{k}", 2022, "REG", w, teams[a], None, teams[h], None, result, 0))
    return spark.createDataFrame(rows, src.GAMES_SCHEMA)


@pytest.fixture(scope="module")
def strengths(spark):
    return spark.createDataFrame(
        [("A", 9.0, 3.0), ("B", 5.0, 5.0), ("C", 4.0, 6.0), ("D", 0.6, 0.8)], "team string, alpha double, beta double"
    )


def test_expand_is_every_pair_once(spark, schedule):
    for n in (1, 7, 120):
        rows = N.scenario_expand(schedule, n)
        assert rows.count() == 6 * n == rows.select("sim", "game_id").distinct().count()
        assert tuple(rows.agg(F.min("sim"), F.max("sim")).first()) == (1, n)


@pytest.mark.parametrize("n_sims,n_games,tasks", [(10_000, 272, 8), (10_000, 272, 4_000), (20, 15_000, 8), (1, 1, 200), (20, 10**9, 4_000)])
def test_layout_keeps_tasks_busy_and_pieces_small(n_sims, n_games, tasks):
    per_block, chunks = N._layout(n_sims, n_games, tasks)
    blocks = -(-n_sims // per_block)
    assert n_games / chunks <= N.GAMES_PER_CHUNK and per_block <= N.SIMS_PER_BLOCK
    assert blocks * chunks >= min(tasks, max(1, n_sims // 10) * max(1, n_games // N.SMALLEST_CHUNK))


def test_draws_differ_by_season_and_not_by_integer_type(spark, strengths):
    teams = strengths.crossJoin(spark.range(1, 40).withColumnRenamed("id", "sim")).withColumn("week", F.lit(3))
    both = teams.crossJoin(spark.createDataFrame([(2000,), (2001,)], "season int"))
    per = N.draw_strengths(both, 1).groupBy("sim", "team").agg(F.countDistinct("pre_game_strength").alias("n"))
    assert per.where("n <> 2").count() == 0
    one = N.draw_strengths(teams, 1).select("sim", "team", "pre_game_strength")
    two = N.draw_strengths(teams.withColumns({"sim": F.col("sim").cast("int"), "week": F.lit(3).cast("long")}), 1)
    assert one.exceptAll(two.select(*one.columns)).count() == 0


def test_beta_draws_have_the_right_moments_and_do_not_depend_on_layout(spark):
    for a, b in ((4.0, 6.0), (0.5, 0.5), (0.3, 2.0), (60.0, 40.0)):
        df = spark.range(20_000).withColumns({"a": F.lit(a), "b": F.lit(b)})
        x = draw_beta("a", "b", "id", seed=1).alias("x")
        one = df.repartition(2).select(x).agg(F.avg("x"), F.stddev_samp("x"), F.min("x"), F.max("x"), F.skewness("x")).first()
        two = df.repartition(7).select(x).agg(F.avg("x")).first()[0]
        sd = (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        skew = 2 * (b - a) * (a + b + 1) ** 0.5 / ((a + b + 2) * (a * b) ** 0.5)
        assert one[0] == pytest.approx(a / (a + b), abs=4 * sd / 20_000**0.5)
        assert one[1] == pytest.approx(sd, rel=0.03)
        assert one[4] == pytest.approx(skew, abs=0.08)
        assert 0 <= one[2] and one[3] <= 1
        assert two == pytest.approx(one[0], abs=1e-12)


def test_beta_draw_of_bad_parameters_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0), (None, 2.0), (1.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(draw_beta("a", "b", "a", seed=1)).collect()]
    assert got[0] is not None and got[1:] == [None, None, None]


def test_normal_draws(spark):
    z = draw_normal(F.lit(2.0), 3.0, "id", seed=1).alias("z")
    row = spark.range(50_000).select(z).agg(F.avg("z"), F.stddev_samp("z"), F.kurtosis("z")).first()
    assert row[0] == pytest.approx(2.0, abs=0.05) and row[1] == pytest.approx(3.0, rel=0.02)
    assert row[2] == pytest.approx(0.0, abs=0.1)


def test_known_results_stay_and_no_filled_game_is_tied(spark, schedule, strengths):
    rows = N.simulate_results(N.scenario_expand(schedule, 200), strengths, MODEL, 12.0, 3)
    assert rows.where("result is null or (week > 1 and result = 0)").count() == 0
    assert rows.where("week = 1 and result <> 3").count() == 0
    assert rows.where("week > 1").select("result").distinct().count() > 20


def test_one_week_leaves_the_others(spark, schedule, strengths):
    rows = N.simulate_results(N.scenario_expand(schedule, 5), strengths, MODEL, 12.0, 3, week=2)
    assert rows.where("week = 3 and result is not null").count() == 0
    assert rows.where("week = 2 and result is null").count() == 0


def test_week_step_equals_the_single_job(spark, schedule, strengths):
    games = N.scenario_expand(schedule, 40)
    teams = games.select("sim", F.explode(F.array("away_team", "home_team")).alias("team")).distinct()
    whole = N.simulate_results(games, strengths, MODEL, 12.0, 3)
    step = games
    for week in (2, 3):
        _, step = N.predict_week(teams, step, week, strengths, MODEL, 12.0, 3)
    pick = ["sim", "game_id", "result"]
    assert sorted(map(tuple, whole.select(pick).collect())) == sorted(map(tuple, step.select(pick).collect()))


def test_strengths_are_required(spark, schedule):
    with pytest.raises(ValueError, match="strengths"):
        N.simulate_results(N.scenario_expand(schedule, 2), None, MODEL, 12.0, 3)


def test_ties_in_wide_and_long_tables(spark):
    games = spark.createDataFrame(
        [(1, "REG", 1, "A", "B", 0), (1, "REG", 2, "A", "B", None), (1, "REG", 3, "A", "B", 4)],
        "sim long, game_type string, week int, away_team string, home_team string, result int",
    )
    colors = spark.createDataFrame([("A", "#1", "#2"), ("B", "#3", "#4")], "team_abbr string, preferred_color string, team_color string")
    wide = {r["week"]: r for r in N.scenario_games_wide(games, colors).collect()}
    assert (wide[1]["winner"], wide[2]["winner"], wide[3]["winner"]) == ("A", None, "B")
    assert wide[3]["matchup"] == "A_B_wk_3" and wide[3]["preferred_color_home"] == "#3"
    long = N.scenario_games_long(games)
    got = {(r["week"], r["team"]): r["win"] for r in long.collect()}
    assert got == {(1, "A"): None, (1, "B"): None, (2, "A"): None, (2, "B"): None, (3, "A"): 0.0, (3, "B"): 1.0}
    totals = {r["team"]: (r["wins"], r["decided"]) for r in A.scenario_team_totals(long).collect()}
    assert totals == {"A": (0.0, 1), "B": (1.0, 1)}


def test_cdf_rises_from_0_to_1(spark):
    rows = [(s, "A", float(s % 5) / 2) for s in range(100)]
    totals = spark.createDataFrame(rows, "sim int, team string, wins double")
    got = A.scenario_cdf(totals, max_wins=4).orderBy("wins").collect()
    under = [r["under_prob"] for r in got]
    assert [r["wins"] for r in got] == [i / 2 for i in range(9)]
    assert under == pytest.approx([0.0, 0.2, 0.4, 0.6, 0.8, 1, 1, 1, 1])
    assert [r["over_prob"] for r in got] == pytest.approx([0.8, 0.6, 0.4, 0.2, 0, 0, 0, 0, 0])


def test_totals_and_shares_go_by_season(spark):
    rows = [(y, s, "A", float((s + y) % 3)) for s in range(30) for y in (2000, 2001)] + [(2001, s, "A", 1.0) for s in range(30, 60)]
    totals = spark.createDataFrame(rows, "season int, sim int, team string, wins double")
    tops = spark.createDataFrame([(2000, 2), (2001, 1)], "season int, max_wins int")
    got = {(r["season"], r["wins"]): (r["under_prob"], r["over_prob"]) for r in A.scenario_cdf(totals, tops).collect()}
    assert set(got) == {(2000, i / 2) for i in range(5)} | {(2001, i / 2) for i in range(3)}
    assert got[2000, 1.0] == pytest.approx((1 / 3, 1 / 3)) and got[2001, 1.0] == pytest.approx((1 / 6, 1 / 6))
    occurring = {(r["season"], r["wins"]) for r in A.scenario_cdf(totals).collect()}
    assert occurring == {(y, float(w)) for y in (2000, 2001) for w in range(3)}
    blocked = {(r["season"], r["wins"]): (r["under_prob"], r["over_prob"]) for r in A.scenario_cdf(totals, tops, hot_rows=2).collect()}
    assert blocked.keys() == got.keys() and all(blocked[k] == pytest.approx(got[k]) for k in got)


def test_the_grid_of_totals_is_not_sorted_by_team(spark):
    rows = [("A", float(w)) for w in (3, 3, 9_000, 20_000)] + [("B", None), ("B", 0.5), (None, 2.0), ("C", None)]
    totals = spark.createDataFrame([(s, t, w) for s, (t, w) in enumerate(rows)], "sim int, team string, wins double")
    cdf = A.scenario_cdf(totals, max_wins=10_000)
    got = {(r["team"], r["wins"]): (r["under_prob"], r["over_prob"]) for r in cdf.collect()}
    assert set(got) == {(t, i / 2) for t in ("A", "B", "C", None) for i in range(20_001)} and cdf.count() == 4 * 20_001
    at = {2.5: (0, 1), 3.0: (0, 0.5), 3.5: (0.5, 0.5), 8_999.5: (0.5, 0.5), 9_000.0: (0.5, 0.25), 10_000.0: (0.75, 0.25)}
    assert {w: got["A", w] for w in at} == at
    # A total that is not known comes before all others.
    assert (got["B", 0.0], got["B", 0.5], got["B", 1.0]) == ((0.5, 0.5), (0.5, 0.0), (1.0, 0.0))
    assert got["C", 0.0] == (1.0, 0.0) and got[None, 2.0] == (0.0, 0.0) and got[None, 1.5] == (0.0, 1.0)
    plan = cdf._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Window" not in plan and "Sort [" not in plan.split("Generate", 1)[0]


def test_weekly_and_team_projections(spark):
    rows = [(s, "REG", 2, "A", "B", 7 if s < 7 else -3) for s in range(10)]
    rows += [(s, "REG", 2, "C", "D", 7 if s < 4 else -3) for s in range(10)]
    rows += [(s, "REG", 3, "B", "A", None if s == 0 else 1) for s in range(10)]
    games = spark.createDataFrame(rows, "sim int, game_type string, week int, away_team string, home_team string, result int")
    got = {r["clean_title"]: r for r in Q.weekly_projection(games, 2).collect()}
    ab, cd = got["A @ B"], got["C @ D"]
    assert (ab["winner"], ab["win_prob"], ab["exp_result"], ab["title_level"]) == ("B", "70.0%", "4.0", 2)
    assert (cd["winner"], cd["win_prob"], cd["exp_result"], cd["title_level"]) == ("C", "60.0%", "1.0", 1)
    assert ab["label"] == "B wins 70.0%\nwith an expected MOV of 4.0 points"
    colored = games.withColumns({"preferred_color_home": F.concat(F.lit("#"), "home_team"), "preferred_color_away": F.concat(F.lit("#"), "away_team")})
    bars = {(r["clean_title"], r["fill_col"], r["bin"]): r["height"] for r in Q.team_season_histogram(colored, "A", n_sims=10).collect()}
    assert bars == {("Week 2 @ B", "#B", 7): 0.7, ("Week 2 @ B", "#A", -3): 0.3, ("Week 3 vs B", "#A", 1): 0.9}
    mine = {r["clean_title"]: r for r in Q.team_season_projection(games, "A").collect()}
    assert set(mine) == {"Week 2 @ B", "Week 3 vs B"}
    assert mine["Week 3 vs B"]["winner"] is None  # a missing result leaves the mean unknown
    assert mine["Week 3 vs B"]["title_level"] == 2


def test_no_cross_join_in_the_scenario_job(spark, schedule, strengths):
    rows = N.simulate_results(N.scenario_expand(schedule, 50), strengths, MODEL, 12.0, 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) == 1  # shuffles, whatever deals them out


def _rated(spark, rows):
    return spark.createDataFrame(rows, "season int, sim long, team string, pre_game_strength double")


def test_ratings_of_a_scenario_in_one_map_or_joined_by_side(spark, monkeypatch):
    games = spark.createDataFrame(
        [(1, "A", "B", 2022, "g1"), (1, "B", "C", 2022, "g2"), (2, "A", "B", 2022, "g3"), (2, None, "B", 2022, "g4"),
         (None, "A", "B", 2022, "g5"), (1, "A", "B", 2023, "g6"), (1, "A", "B", 2022, "g1")],
        "sim long, away_team string, home_team string, season int, game_id string",
    )
    ratings = _rated(spark, [(2022, 1, "A", 0.1), (2022, 1, "B", None), (2022, 2, "A", 0.3), (2022, 2, "B", 0.4), (2022, 2, None, 0.5), (2022, None, "A", 0.6), (2022, None, "B", 0.6)])
    once = lambda: sorted(map(str, R.scenario_inner_join(games, ratings).collect()))
    mapped = once()
    monkeypatch.setattr(R, "MAP_TEAMS", 1)
    assert mapped == once() and len(mapped) == 3
    monkeypatch.undo()
    twice = ratings.unionByName(_rated(spark, [(2022, 2, "A", 0.9)]))
    assert R.scenario_inner_join(games, twice).where("game_id = 'g3'").count() == 2
    assert R.scenario_inner_join(games, ratings.limit(0)).count() == 0


def test_games_move_once_for_both_sides(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        games = spark.range(1000).selectExpr("id % 10 AS sim", "'A' AS away_team", "'B' AS home_team", "id AS game_id")
        ratings = spark.range(20).selectExpr("id % 10 AS sim", "if(id < 10, 'A', 'B') AS team", "0.5D AS pre_game_strength")
        plan = R.scenario_inner_join(games, ratings)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # the games, and the ratings
