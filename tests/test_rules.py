"""Hand-made rows for the rules that are easy to get wrong, and for clear errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtally.functions import scalars as S
from gridtally.functions.strict import strict_mean, strict_sd, strict_share, strict_sum
from gridtally.operators import aggregate as A
from gridtally.operators import columns as C
from gridtally.operators import evaluate as K
from gridtally.operators import features as X
from gridtally.operators import relate as R
from gridtally.operators import reshape as E
from gridtally.operators import splits as L
from gridtally.plans import history as H
from gridtally.plans import ratings as P
from gridtally.plans import reports as Q
from gridtally.plans import strength as T
from gridtally.sources import tables as src

GAMES = src.GAMES_SCHEMA


def game(i, season, week, away, a, home, h, kind="REG"):
    result = None if a is None else h - a
    return (f"g{i:03d}", season, kind, week, away, a, home, h, result, 0)


@pytest.fixture(scope="module")
def league(spark):
    """Two seasons; A has a bye in week 3; one tie; one game not yet played; a moved franchise."""
    rows = [
        game(1, 2020, 1, "A", 10, "B", 20),
        game(2, 2020, 2, "B", 7, "A", 7),
        game(3, 2020, 4, "STL", 14, "A", 21),
        game(4, 2020, 5, "A", 3, "B", 30, "POST"),
        game(5, 2021, 1, "B", None, "A", None),
        game(6, 2021, 1, "LA", 6, "C", 9),
        game(7, 2021, 2, "C", 0, "A", 1),
    ]
    return spark.createDataFrame(rows, GAMES)


def test_divisor_is_the_calendar_week(league):
    rows = H.team_game_history(league).where("season = 2020 and team = 'A'").orderBy("week").collect()
    assert [r["week"] for r in rows] == [1, 2, 4, 5]
    assert [r["game_num"] for r in rows] == [1, 2, 3, 4]
    gaps, total, mean, out = [], 0.0, 0.0, []
    for i, score in enumerate([10, 7, 21, 3], start=1):
        mean = (mean * (i - 1) + score) / i
        total += score - mean
        out.append(abs(total) / rows[i - 1]["week"] ** 0.5)
    assert [r["cumulative_point_sd"] for r in rows] == pytest.approx(out)


def test_regular_share_divides_by_sixteen(league):
    row = H.team_game_history(league).where("season = 2020 and team = 'A'").first()
    assert row["reg_wins"] == 1.5 and row["tot_wins"] == 1.5 and row["tot_games"] == 4
    assert row["reg_wp"] == 1.5 / 16 and row["final_wp"] == 1.5 / 4
    assert row["id"] == "2020_A"


def test_moved_franchise_keeps_one_name(league):
    teams = {r["team"] for r in H.team_games(league).select("team").distinct().collect()}
    assert teams == {"A", "B", "C", "LA"}


def test_unplayed_game_blanks_later_score_means(league):
    rows = H.team_game_history(league).where("season = 2021 and team = 'A'").orderBy("week").collect()
    assert [r["cumulative_point_mean"] for r in rows] == [None, None]
    assert [r["wins"] for r in rows] == [0.5, 1.5]


def test_current_state_takes_the_latest_started_row(league):
    rows = {r["team"]: r for r in T.current_state(league, 2021, 2).collect()}
    assert rows["A"]["week"] == 2 and rows["A"]["wins"] == 1.0  # the open game counts nothing
    assert rows["B"]["week"] == 1 and rows["B"]["wins"] == 0.0  # first week kept though unplayed
    assert rows["A"]["cumulative_pd"] is None


def test_current_state_stops_at_the_week(league):
    assert T.current_state(league, 2021, 1).agg(F.max("week")).first()[0] == 1


def test_league_running_crosses_seasons_only_in_training(spark):
    weeks = spark.createDataFrame(
        [(2000, 1, 10.0), (2000, 2, 20.0), (2001, 1, 30.0), (2001, 2, 50.0)],
        "season int, week int, season_week_points_mean double",
    )
    train = {(r["season"], r["week"]): r for r in A.league_running(weeks).collect()}
    now = {(r["season"], r["week"]): r for r in A.league_running(weeks, across_seasons=False).collect()}
    # order (week, season): gaps 0, 0, 5, 10
    assert train[2000, 2]["cumulative_season_points_sd"] == pytest.approx(5 / 2**0.5)
    assert train[2001, 2]["cumulative_season_points_sd"] == pytest.approx(15 / 2**0.5)
    assert now[2001, 2]["cumulative_season_points_sd"] == pytest.approx(10 / 2**0.5)


def test_final_table_equals_distinct_history(league):
    short = sorted(map(tuple, H.season_final_table(league).collect()))
    long = H.team_game_history(league).select("season", "team", "final_wp").distinct().collect()
    assert short == sorted(map(tuple, long))


def test_levels_follow_first_appearance(league):
    rows = H.team_levels(league).orderBy("ord").collect()
    assert [r["team"] for r in rows] == ["A", "B", "LA", "C"]


def test_unknown_level_turns_null(spark, league):
    levels = H.team_levels(league)
    df = spark.createDataFrame([("A",), ("ZZZ",), (None,)], "team string")
    assert sorted(str(r["team"]) for r in R.known_levels(df, "team", levels).collect()) == ["A", "None", "None"]


@pytest.fixture(scope="module")
def rating_rows(spark):
    d = dt.date
    rows = [
        (d(2020, 9, 1), 2020, "LAR", "OAK", 1500.0, 1400.0),
        (d(2020, 12, 1), 2020, "OAK", "LAR", 1420.0, 1530.0),
        (d(2020, 12, 1), 2020, "WSH", "XYZ", 1380.0, 1300.0),
        (d(2021, 9, 1), 2021, "LAR", "WSH", 1510.0, 1390.0),
    ]
    return spark.createDataFrame(rows, src.RATINGS_SCHEMA)


def test_current_ratings_are_last_and_reverted(spark, rating_rows):
    final = spark.createDataFrame([(2020, "LA", 0.75), (2020, None, 0.1)], "season int, team string, final_wp double")
    levels = spark.createDataFrame([("LA", 1), ("LV", 2), ("WAS", 3)], "team string, ord int")
    rows = P.current_ratings_inputs(final, rating_rows, 2021, levels=levels).collect()
    got = {r["team"]: (r["season"], r["elo"], r["prev_season_wp"]) for r in rows}
    assert got["LA"] == (2021, pytest.approx(1530 - (1530 - 1505) / 3), 0.75)
    assert got["LV"][2] is None
    assert got[None] == (2021, pytest.approx(1300 - (1300 - 1505) / 3), 0.1)  # NULL meets NULL


def test_equal_latest_dates_are_all_kept(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, None, 4)], "g string, at int, id int")
    assert sorted(r["id"] for r in R.latest_per_group(df, ["g"], "at").collect()) == [2, 3, 4]
    assert sorted(r["id"] for r in R.earliest_per_group(df, ["g"], "at").collect()) == [1, 4]


def test_preseason_inputs_skip_season_gaps(spark):
    d = dt.date
    final = spark.createDataFrame(
        [(1999, "A", 0.5), (2001, "A", 0.6), (1999, "B", 0.1), (2000, "B", 0.2)], "season int, team string, final_wp double"
    )
    ratings = spark.createDataFrame(
        [(d(s, 9, 1), s, "A", "B", 1500.0, 1400.0) for s in (2000, 2001)], src.RATINGS_SCHEMA
    )
    assert [tuple(r) for r in P.preseason_inputs(final, ratings).collect()] == [(2000, "B", 0.1, 1400.0, 0.2)]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None), ("c", 2.0)], "g string, x double")
    rows = df.groupBy("g").agg(
        strict_mean("x").alias("m"),
        strict_sd("x").alias("sd"),
        strict_sum("x").alias("s"),
        strict_share(F.col("x") > 1, "x").alias("p"),
    )
    got = {r["g"]: (r["m"], r["sd"], r["s"], r["p"]) for r in rows.collect()}
    assert got["a"] == (2.0, pytest.approx(2**0.5), 4.0, 0.5)
    assert got["b"] == (None, None, None, None)
    assert got["c"] == (2.0, None, 2.0, 1.0)


def test_round_decimals_is_round(spark):
    """On halves, values next to them, and values up to those without places, of either sign."""
    u = F.rand(5)
    ties = (F.floor(u * 20_000_001) / 10_000 + 0.00005) * F.element_at(F.array(*[F.lit(10.0**k) for k in range(0, 13, 3)]), (F.col("id") % 5 + 1).cast("int"))
    x = F.when(F.col("id") % 3 == 0, ties).otherwise((u - 0.5) * F.pow(F.lit(10.0), F.col("id") % 17 - 2))
    x = F.when(F.col("id") % 7 == 0, x + x * 1.1e-16 * (F.col("id") % 5 - 2)).otherwise(x)
    odd = spark.createDataFrame([(v,) for v in (None, float("nan"), float("inf"), 0.0, -0.00001, 0.00005, -2.00005, 0.99996, 1e300)], "x double")
    rows = spark.range(200_000).select(x.alias("x")).unionByName(odd)
    for digits in (0, 4, 6):
        same = F.round("x", digits).eqNullSafe(S.round_decimals("x", digits))
        assert rows.where(~same).limit(3).collect() == []


def test_round_away(spark):
    df = spark.createDataFrame([(-2.3,), (0.0,), (1.2,), (None,), (-4.0,)], "x double")
    assert [r[0] for r in df.select(S.round_away("x")).collect()] == [-3.0, 0.0, 2.0, None, -4.0]


def test_beta_parameters_reproduce_mean(spark):
    df = spark.createDataFrame([(0.4, 0.1), (0.001, 1e-6), (0.999, 0.2), (0.5, 0.0)], "pred double, std_error double")
    rows = T.beta_columns(df).collect()
    assert rows[0]["alpha"] / (rows[0]["alpha"] + rows[0]["beta"]) == pytest.approx(0.4)
    assert rows[1]["alpha"] > 0
    assert rows[2]["alpha"] is None and rows[3]["alpha"] is None


def test_text_formats(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.45,), (1234.56,)], "x double")
    assert [r[0] for r in df.select(S.number_text("x")).collect()] == ["0.2", "0.3", "2.5", "1234.6"]
    assert df.select(S.percent_text("x", 0)).first()[0] == "25%"


def test_strip_first_match_only(spark):
    df = spark.createDataFrame([("AFC NFC East",), ("West AFC NFC ",), (None,)], "d string")
    got = [r[0] for r in df.select(S.strip_first("d", "AFC |NFC ")).collect()]
    assert got == ["NFC East", "West NFC ", None]


def test_keys_and_templates_treat_null_apart(spark):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    row = df.select(S.compose_key("x", F.lit("_"), "y").alias("k"), S.template("{x}:{y}!").alias("t")).first()
    assert row["k"] is None and row["t"] == "a:NA!"
    assert df.select(S.template("{x}:{y}!", keep_null=True)).first()[0] is None


def test_long_and_back(league):
    names = ["away_team", "away_score", "home_team", "home_score"]
    long = E.sides_to_long(league, names)
    back = E.long_to_sides(long, ["game_id", "result"], ["team", "score"])
    want = league.select("game_id", "result", "away_team", "home_team", "away_score", "home_score")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_sides_with_a_missing_value_column(spark):
    df = spark.createDataFrame([(1, "x", 5, "y")], "id int, away_team string, away_score int, home_team string")
    rows = E.sides_to_long(df, ["away_team", "away_score", "home_team"]).collect()
    assert [(r["set"], r["team"], r["score"]) for r in rows] == [("away", "x", 5), ("home", "y", None)]
    with pytest.raises(ValueError, match="does not match"):
        E.sides_to_long(df, ["id"])


def test_later_columns_see_earlier_ones(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert C.derive_cols(df, x=F.col("x") + 1, y=F.col("x") * 10).first()["y"] == 20


def test_cast_truncates(spark):
    df = spark.createDataFrame([(-2.7,), (2.7,)], "x double")
    assert [r["x"] for r in C.cast_cols(df, x="int").collect()] == [-2, 2]


def test_incomplete_rows_go_with_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert C.drop_incomplete(df).count() == 1


def test_relocate_and_prefix(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert C.relocate_cols(df, "c").columns == ["c", "a", "b"]
    assert C.relocate_cols(df, "a", after="b").columns == ["b", "a", "c"]
    assert C.select_prefix(df, "a", keep=False).columns == ["b", "c"]


def test_sort_puts_missing_last(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r["x"] for r in R.sort_multi(df, "x").collect()] == [1, 2, None]
    assert [r["x"] for r in R.sort_multi(df, "-x").collect()] == [2, 1, None]


def test_join_suffixes(spark):
    left = spark.createDataFrame([(1, "l")], "k int, v string")
    right = spark.createDataFrame([(1, "r")], "id int, v string")
    out = R.join_renamed_key(left, right, {"k": "id"}, suffixes=("_away", "_home"))
    assert out.columns == ["k", "v_away", "v_home"]


def test_metrics_leave_out_incomplete_pairs_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 1.0)], "truth double, estimate double")
    got = {r["metric"]: r["estimate"] for r in K.regression_metrics(df).collect()}
    assert got == {"rmse": 1.0, "rsq": None, "mae": 1.0}


def test_correlation_with_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.5), (3.0, 5.0, 6.0), (4.0, 5.0, None)], "a double, b double, c double")
    got = {(r["parameter1"], r["parameter2"]): r for r in K.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"]["r"] is None and got["a", "b"]["n_obs"] == 4
    assert got["a", "c"]["n_obs"] == 3 and 0.98 < got["a", "c"]["r"] < 1


def test_zero_variance_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (2.0, 3.0, None)], "a double, b double, c double")
    assert X.zero_variance(df, ["a", "b", "c"]) == ["b", "c"]
    out = X.standardize(df, X.scaling_stats(df, ["a", "b"]), ["a", "b"]).collect()
    assert [r["a"] for r in out] == pytest.approx([-(0.5**0.5), 0.5**0.5]) and out[0]["b"] is None


@pytest.mark.parametrize("share", [0.0, 0.3, 0.75, 1.0])
def test_stratified_split_is_exact(spark, share):
    df = spark.range(503).select(F.col("id"), (F.col("id") % 9).alias("season"))
    rows = L.stratified_split(df, ["id"], "season", 3, share).collect()
    assert sorted(r["id"] for r in rows) == list(range(503))
    for s in {r["stratum"] for r in rows}:
        mine = [r["split"] for r in rows if r["stratum"] == s]
        assert mine.count("train") == int(share * len(mine))


def test_splits_do_not_depend_on_layout(spark):
    df = spark.range(2_000).select("id", (F.col("id") % 50).alias("g"))
    a = L.kfold(L.group_split(df.repartition(3), "g", 9), ["id"], 9)
    b = L.kfold(L.group_split(df.repartition(11), "g", 9), ["id"], 9)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r[0] for r in a.select("fold").distinct().collect()} == set(range(1, 11))


def test_snapshot_keeps_other_weeks(spark, tmp_path):
    path = str(tmp_path / "snap")
    src.snapshot_write(spark.range(3), path, 1)
    src.snapshot_write(spark.range(5), path, 2)
    src.snapshot_write(spark.range(4), path, 1)
    assert src.snapshot_read(spark, path, 1).count() == 4
    assert src.snapshot_read(spark, path, 2).count() == 5


def test_csv_reads_na_and_refuses_bad_values(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    head = "date,season,team1,team2,elo1_pre,elo2_pre\n"
    good.write_text(head + "2020-09-01,2020,A,B,1500.5,NA\n")
    bad.write_text(head + "2020-09-01,2020,A,B,oops,1.0\n")
    row = src.ratings_csv_source(spark, str(good)).first()
    assert row["elo1_pre"] == 1500.5 and row["elo2_pre"] is None and row["date"] == dt.date(2020, 9, 1)
    with pytest.raises(Exception, match="(?i)malformed|cast|parse"):
        src.ratings_csv_source(spark, str(bad)).collect()


def test_standings_texts_and_order(spark):
    rows = [("AFC", "AFC East", "x", 9.25, 0.5), ("AFC", "AFC East", "y", 11.0, 1.0), ("NFC", "NFC West", "z", 3.0, 0.0)]
    df = spark.createDataFrame(rows, "conf string, division string, team string, wins double, playoff double")
    for f in ("div1", "seed1", "won_conf", "won_sb"):
        df = df.withColumn(f, F.col("playoff"))
    got = Q.standings_report(df).collect()
    assert [r["team"] for r in got] == ["y", "x", "z"]
    assert got[1]["wins"] == "9.2" and got[1]["playoff"] == "50%" and got[0]["division"] == "East"


def test_schedule_title(spark):
    names = spark.createDataFrame([("PIT", "Pittsburgh"), ("NE", "New England")], "team_abbr string, team_name string")
    assert [r["title"] for r in Q.schedule_title(names, "PIT", 2022).collect()] == ["2022 Schedule: Pittsburgh"]


def test_rmse_by_week_starts_before_the_season(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 4.0)], "week int, t double, e double")
    start = spark.createDataFrame([("rmse", 0.5), ("mae", 9.0)], "metric string, estimate double")
    assert [(r["week"], r["estimate"]) for r in Q.rmse_by_week(df, start, "t", "e").collect()] == [(2, 3.0), (1, 1.0), (0, 0.5)]


def test_new_team_and_early_seasons_are_left_out(spark):
    df = spark.createDataFrame([(1999, "A"), (2000, "A"), (2002, "HOU"), (2003, "HOU")], "season int, team string")
    assert sorted(map(tuple, T.strength_training_rows(df).collect())) == [(2000, "A"), (2003, "HOU")]


def test_season_length_rule(spark):
    df = spark.createDataFrame([(2020, 0.5), (2021, 0.5), (None, 0.5)], "season int, pred double")
    assert [r["exp_wins"] for r in T.expected_wins(df).collect()] == [8.0, 8.5, None]
    table = spark.createDataFrame([(2020, 10)], "season int, games int")
    assert [r["exp_wins"] for r in T.expected_wins(df, lengths=table).orderBy(F.desc("season")).collect()] == [None, 5.0, None]


def test_missing_columns_are_named(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="missing column\\(s\\) week"):
        C.filter_started(df.withColumn("result", F.lit(1)))
    with pytest.raises(ValueError, match="no column in common"):
        R.left_join_common(df, df.withColumnRenamed("id", "other"))


def test_too_many_levels_is_an_error(spark):
    with pytest.raises(ValueError, match="more than 5 levels"):
        X.find_levels(spark.range(10), "id", 5)
