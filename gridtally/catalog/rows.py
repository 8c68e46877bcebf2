"""Queries for sources, sinks, columns, filters, scalar functions and reshaping (A-E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import columns as C
from ..operators import features as X
from ..operators import relate as R
from ..operators import reshape as E
from ..plans import history as H
from ..plans.strength import expected_wins
from ..sources import fixtures as fx
from ..sources import tables as src
from . import query
from .views import GAME_COLUMNS, rd, rounded, sql

GAMES_WITHOUT_DATE = GAME_COLUMNS.replace(" game_date,", "")
STAND_IN_SCHEMA = src.GAMES_SCHEMA.replace("game_id string", "game_id bigint")
SIDES = ["away_team", "away_score", "home_team", "home_score"]

# ------------------------------------------------------------------ A. sources and sinks


@query("a1_games_source", sql(f"SELECT {GAMES_WITHOUT_DATE} FROM games", "games"))
def games_source(spark, d):
    path = src.shared_folder(spark)
    src.table_write(fx.games(spark, d).drop("game_date"), path)
    return src.games_source(spark, path, STAND_IN_SCHEMA)


@query(
    "a2_ratings_csv_source",
    sql('SELECT CAST("date" AS VARCHAR) AS "date", season, team1, team2, elo1_pre, elo2_pre FROM ratings', "ratings"),
)
def ratings_csv_source(spark, d):
    path = src.shared_folder(spark)
    src.ratings_csv_write(fx.ratings(spark, d), path)
    return src.ratings_csv_source(spark, path).withColumn("date", F.col("date").cast("string"))


@query("a3_table_read", "SELECT * FROM customer")
def table_read(spark, d):
    return src.table_read(spark, f"{d}/customer.parquet")


@query("a4_table_write", sql(f"SELECT season, team, {rd('final_wp')} FROM final", "final"))
def table_write(spark, d):
    path = src.shared_folder(spark)
    src.table_write(H.season_final_table(fx.games(spark, d), codes={}), path)
    return rounded(src.table_read(spark, path))


@query(
    "a5_snapshot_write",
    sql(
        f"SELECT season, team, {rd('final_wp')}, CAST(w AS INTEGER) AS as_of_week FROM final CROSS JOIN range(0, 2) t(w)",
        "final",
    ),
)
def snapshot_write(spark, d):
    path = src.shared_folder(spark)
    final = H.season_final_table(fx.games(spark, d), codes={})
    for week in (0, 1, 1):  # writing a week twice replaces that week only
        src.snapshot_write(final, path, week)
    return rounded(src.table_read(spark, path))


@query(
    "a7_dim_lookup",
    sql("SELECT game_id, home_team, preferred_color, team_color FROM games LEFT JOIN colors ON home_team = team_abbr", "games", "colors"),
)
def dim_lookup(spark, d):
    games = fx.games(spark, d).select("game_id", "home_team")
    return R.join_renamed_key(games, R.small(fx.colors(spark, d)), {"home_team": "team_abbr"})


# ------------------------------------------------------------------ B. columns


@query("b1_select_cols", sql("SELECT season, week, home_team AS host FROM games", "games"))
def select_cols(spark, d):
    return C.select_cols(fx.games(spark, d), "season", "week", host="home_team")


@query("b2_select_range", sql("SELECT game_id, season, game_type, away_team, away_score, home_team, home_score FROM games", "games"))
def select_range(spark, d):
    return C.select_range(fx.games(spark, d), ("game_id", "game_type"), ("away_team", "home_score"))


@query("b3_drop_cols", sql("SELECT season, team1, team2, elo1_pre, elo2_pre FROM ratings", "ratings"))
def drop_cols(spark, d):
    return C.drop_cols(fx.ratings(spark, d), "date")


@query("b4_select_prefix", sql("SELECT away_team, away_score FROM games", "games"))
def select_prefix(spark, d):
    return C.select_prefix(fx.games(spark, d), "away_")


@query("b5_rename_cols", sql("SELECT season, team, final_wp AS prev_season_wp FROM final", "final"))
def rename_cols(spark, d):
    return C.rename_cols(H.season_final_table(fx.games(spark, d), codes={}), prev_season_wp="final_wp")


@query("b6_relocate_cols", sql("SELECT result, game_id, season, home_team FROM games", "games"))
def relocate_cols(spark, d):
    games = C.select_cols(fx.games(spark, d), "game_id", "season", "home_team", "result")
    return C.relocate_cols(games, "result")


@query("b7_pull_scalar", sql("SELECT game_id, 'Schedule: Team NATION_3' AS title FROM games", "games"))
def pull_scalar(spark, d):
    names = fx.team_names(spark, d)
    games = fx.games(spark, d).select("game_id")
    return C.label_from_lookup(
        games, names, F.col("team_abbr") == "NATION_3", S.template("Schedule: {team_name}"), "title"
    )


@query("b8_derive_cols", sql("SELECT game_id, away_score + home_score AS total, (away_score + home_score) * 2 AS twice FROM games", "games"))
def derive_cols(spark, d):
    return C.derive_cols(
        fx.games(spark, d), total=F.col("away_score") + F.col("home_score"), twice=F.col("total") * 2
    ).select("game_id", "total", "twice")


@query("b9_apply_across", sql("SELECT game_id, lower(away_team) AS away_team, lower(home_team) AS home_team FROM games", "games"))
def apply_across(spark, d):
    return C.apply_across(
        fx.games(spark, d).select("game_id", "away_team", "home_team"), ["away_team", "home_team"], F.lower
    )


@query(
    "b10_append_predictions",
    sql(
        f"SELECT game_id, {rd('1 / (1 + exp(-0.1 * estimate)) AS pred', '0.05 * pred * (1 - pred) AS std_error')} "
        "FROM (SELECT *, 1 / (1 + exp(-0.1 * estimate)) AS pred FROM predictions)",
        "predictions",
    ),
)
def append_predictions(spark, d):
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("estimate") * -0.1))
    both = F.struct(p.alias("pred"), (p * (1 - p) * 0.05).alias("std_error"))
    return rounded(C.append_struct(fx.predictions(spark, d).select("game_id", "estimate"), both).drop("estimate"))


@query("b11_constant_col", sql("SELECT game_id, 1 AS game_played, 0 AS as_of FROM games", "games"))
def constant_col(spark, d):
    return C.constant_col(fx.games(spark, d).select("game_id"), game_played=1, as_of=0)


@query(
    "b12_cast_numeric",
    sql(
        "SELECT CAST(result AS DOUBLE) AS result, CAST(trunc(estimate / 3) AS INTEGER) AS third, CAST(game_id AS VARCHAR) AS game_id "
        "FROM games JOIN predictions USING (game_id)",
        "games",
        "predictions",
    ),
)
def cast_numeric(spark, d):
    rows = fx.predictions(spark, d).select(
        "game_id", F.col("truth").cast("int").alias("result"), (F.col("estimate") / 3).alias("third")
    )
    return C.cast_cols(rows, result="double", third="int", game_id="string")


# ------------------------------------------------------------------ C. filters


@query("c1_filter_range", sql("SELECT * EXCLUDE (game_date) FROM games WHERE season >= 1996 AND season < 2001", "games"))
def filter_range(spark, d):
    return C.filter_range(fx.games(spark, d).drop("game_date"), "season", 1996, 2001, high_open=True)


@query(
    "c2_filter_or_and",
    sql("SELECT * EXCLUDE (game_date) FROM games WHERE (home_team = 'NATION_3' OR away_team = 'NATION_3') AND week <= 18", "games"),
)
def filter_or_and(spark, d):
    return C.filter_team_games(fx.games(spark, d).drop("game_date"), "NATION_3")


@query("c3_filter_not_and", sql("SELECT * FROM final WHERE season > 1996 AND NOT (season <= 1998 AND team = 'NATION_3')", "final"))
def filter_not_and(spark, d):
    final = H.season_final_table(fx.games(spark, d), codes={})
    return C.filter_without(
        final, F.col("season") > 1996, (F.col("season") <= 1998) & (F.col("team") == "NATION_3")
    )


@query("c4_filter_null_or", sql("SELECT * EXCLUDE (game_date) FROM games WHERE week = 1 OR result IS NOT NULL", "games"))
def filter_null_or(spark, d):
    return C.filter_started(fx.games(spark, d).drop("game_date"))


@query("c5_filter_equality", sql("SELECT * EXCLUDE (game_date) FROM games WHERE game_type = 'REG'", "games"))
def filter_equality(spark, d):
    return C.filter_equal(fx.games(spark, d).drop("game_date"), game_type="REG")


@query(
    "c6_drop_incomplete",
    sql("SELECT * EXCLUDE (game_date) FROM games WHERE away_score IS NOT NULL AND home_score IS NOT NULL AND result IS NOT NULL", "games"),
)
def drop_incomplete(spark, d):
    return C.drop_incomplete(fx.games(spark, d).drop("game_date"))


# ------------------------------------------------------------------ D. scalar functions


@query(
    "d1_recode_values",
    sql(
        "SELECT game_id, \"set\", CASE team WHEN 'NATION_1' THEN 'NATION_0' WHEN 'NATION_7' THEN 'MOVED' ELSE team END AS team FROM long",
        "long",
    ),
)
def recode_values(spark, d):
    long = H.team_games(fx.games(spark, d), codes={})
    return long.select(
        "game_id", "set", S.recode_values("team", {"NATION_1": "NATION_0", "NATION_7": "MOVED"}).alias("team")
    )


@query(
    "d2_outcome_win",
    sql('SELECT o.game_id, o."set", o.win, n.win AS win_now FROM outcome o JOIN outcome_now n ON o.game_id = n.game_id AND o."set" = n."set"', "outcome", "outcome_now"),
)
def outcome_win(spark, d):
    long = H.team_games(fx.games(spark, d), codes={})
    return long.select(
        "game_id", "set", S.outcome_win("result", "set").alias("win"), S.outcome_win("result", "set", 0.0).alias("win_now")
    )


@query(
    "d3_outcome_delta",
    sql('SELECT o.game_id, o."set", o.delta, n.delta AS delta_now FROM outcome o JOIN outcome_now n ON o.game_id = n.game_id AND o."set" = n."set"', "outcome", "outcome_now"),
)
def outcome_delta(spark, d):
    long = H.team_games(fx.games(spark, d), codes={})
    return long.select(
        "game_id",
        "set",
        S.outcome_delta(S.outcome_win("result", "set"), "result", "set").alias("delta"),
        S.outcome_delta(S.outcome_win("result", "set", 0.0), "result", "set").alias("delta_now"),
    )


@query(
    "d4_if_else_flag",
    sql(
        "SELECT game_id, CASE WHEN game_type = 'REG' THEN 'REG' ELSE 'PLAYOFF' END AS kind, "
        "CASE WHEN result > 0 THEN home_team WHEN result <= 0 THEN away_team END AS winner FROM games",
        "games",
    ),
)
def if_else_flag(spark, d):
    return fx.games(spark, d).select(
        "game_id",
        S.if_else(F.col("game_type") == "REG", F.lit("REG"), F.lit("PLAYOFF")).alias("kind"),
        S.if_else(F.col("result") > 0, F.col("home_team"), F.col("away_team")).alias("winner"),
    )


@query("d5_null_default", sql("SELECT game_id, coalesce(result, week) AS a, coalesce(result, 0) AS b FROM games", "games"))
def null_default(spark, d):
    return fx.games(spark, d).select(
        "game_id", S.null_default("result", F.col("week")).alias("a"), S.null_default("result", 0).alias("b")
    )


@query("d6_mean_reversion", sql(f"SELECT season, team, {rd('elo - (elo - 1505) / 3 AS elo')} FROM rated", "rated"))
def mean_reversion(spark, d):
    from ..plans.ratings import ratings_long

    return rounded(ratings_long(fx.ratings(spark, d)).select("season", "team", S.mean_reversion("elo").alias("elo")))


@query(
    "d7_round_away",
    sql(
        "SELECT game_id, x, CASE WHEN x < 0 THEN floor(x) WHEN x > 0 THEN ceil(x) ELSE x END + 0.0 AS y "
        "FROM (SELECT game_id, truth / 8 AS x FROM predictions)",
        "predictions",
    ),
)
def round_away(spark, d):
    x = F.col("truth") / 8
    return fx.predictions(spark, d).select("game_id", x.alias("x"), (S.round_away(x) + 0.0).alias("y"))


_MOMENTS = "SELECT *, (game_id % 97 + 1) / 100.0::DOUBLE AS p, (game_id % 13) / 200.0::DOUBLE AS se FROM games"


def _moments(spark, d):
    return fx.games(spark, d).select(
        "game_id", ((F.col("game_id") % 97 + 1) / 100).alias("p"), ((F.col("game_id") % 13) / 200).alias("se")
    )


@query(
    "d8_beta_moments",
    sql(
        f"SELECT game_id, {rd('alpha', 'alpha * (1 / p - 1) AS beta')} FROM "
        "(SELECT *, CASE WHEN se > 0 THEN p * p * (1 - p) / (se * se) - p END AS alpha FROM moments)",
        "games",
        moments=_MOMENTS,
    ),
)
def beta_moments(spark, d):
    rows = _moments(spark, d).withColumn("alpha", S.beta_alpha("p", "se"))
    return rounded(rows.select("game_id", "alpha", S.beta_beta("alpha", "p").alias("beta")))


@query(
    "d9_dist_struct",
    sql(
        f"SELECT team, {rd('alpha', 'beta', 'alpha / (alpha + beta) AS mean', 'sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS sd')} FROM strengths",
        "strengths",
    ),
)
def dist_struct(spark, d):
    rows = fx.strengths(spark, d).select("team", S.beta_struct("alpha", "beta").alias("dist"))
    return rounded(rows.select("team", "dist.*", S.beta_mean("dist").alias("mean"), S.beta_sd("dist").alias("sd")))


@query(
    "d10_math_basic",
    sql(
        f"SELECT game_id, {rd('sqrt(week) AS root', 'pow(result, 2) AS square', 'abs(result) AS size', 'floor(result / 3.0::DOUBLE) AS low', 'ceil(result / 3.0::DOUBLE) AS high')} FROM games",
        "games",
    ),
)
def math_basic(spark, d):
    r = F.col("result")
    return rounded(
        fx.games(spark, d).select(
            "game_id",
            F.sqrt("week").alias("root"),
            F.pow(r, F.lit(2.0)).alias("square"),
            F.abs(r).cast("double").alias("size"),
            F.floor(r / 3).cast("double").alias("low"),
            F.ceil(r / 3).cast("double").alias("high"),
        )
    )


@query("d11_compose_key", sql("SELECT game_id, season || '_' || home_team || '_' || result AS id FROM games", "games"))
def compose_key(spark, d):
    return fx.games(spark, d).select(
        "game_id", S.compose_key("season", F.lit("_"), "home_team", F.lit("_"), "result").alias("id")
    )


@query(
    "d12_template_label",
    sql("SELECT game_id, 'Week ' || week || ': ' || away_team || ' @ ' || home_team || ' ends ' || coalesce(CAST(result AS VARCHAR), 'NA') AS label FROM games", "games"),
)
def template_label(spark, d):
    return fx.games(spark, d).select(
        "game_id", S.template("Week {week}: {away_team} @ {home_team} ends {result}").alias("label")
    )


@query("d13_strip_prefix", sql("SELECT team, substr(division, 5) AS division FROM divisions", "divisions"))
def strip_prefix(spark, d):
    return fx.divisions(spark, d).select("team", S.strip_first("division", "AFC |NFC ").alias("division"))


@query(
    "d14_format_percent",
    sql(
        "SELECT game_id, format('{:.1f}', truth / 20) AS number_text, format('{:.1f}', (game_id % 1000) / 1000.0::DOUBLE * 100) || '%' AS percent_text FROM predictions",
        "predictions",
    ),
)
def format_percent(spark, d):
    return fx.predictions(spark, d).select(
        "game_id",
        S.number_text(F.col("truth") / 20).alias("number_text"),
        S.percent_text(F.col("game_id") % 1000 / 1000).alias("percent_text"),
    )


@query(
    "d15_season_length_scale",
    sql(f"SELECT season, team, {rd('final_wp * games AS exp_wins')} FROM final JOIN season_length USING (season)", "final", "season_length"),
)
def season_length_scale(spark, d):
    final = H.season_final_table(fx.games(spark, d), codes={})
    return rounded(expected_wins(final, "final_wp", fx.season_length(spark, d)).drop("final_wp"))


# ------------------------------------------------------------------ E. reshape


@query("e1_sides_to_long", sql("SELECT * FROM long", "long"))
def sides_to_long(spark, d):
    return E.sides_to_long(fx.games(spark, d).drop("game_date"), SIDES)


@query("e2_suffix_to_long", sql('SELECT CAST("date" AS VARCHAR) AS "date", season, team, elo FROM rated', "rated"))
def suffix_to_long(spark, d):
    from ..plans.ratings import ratings_long

    return ratings_long(fx.ratings(spark, d)).withColumn("date", F.col("date").cast("string"))


@query(
    "e3_unpivot_simple",
    sql(
        "SELECT game_id, week, 'away_team' AS setting, away_team AS team FROM games UNION ALL SELECT game_id, week, 'home_team', home_team FROM games",
        "games",
    ),
)
def unpivot_simple(spark, d):
    return E.unpivot_simple(
        fx.games(spark, d).select("game_id", "week", "away_team", "home_team"), ["away_team", "home_team"], "setting", "team"
    )


@query(
    "e4_long_to_sides",
    sql("SELECT game_id, week, result, away_team AS team_away, home_team AS team_home, away_score AS score_away, home_score AS score_home FROM games", "games"),
)
def long_to_sides(spark, d):
    long = E.sides_to_long(fx.games(spark, d).drop("game_date"), SIDES)
    return E.long_to_sides(long, ["game_id", "week", "result"], ["team", "score"])


_WEEKS = range(1, 20)
_DUMMIES = ", ".join(f"CAST(week = {w} AS DOUBLE) AS week_{w}" for w in _WEEKS[1:])


@query("m2_dummy_encode", sql(f"SELECT game_id, {_DUMMIES} FROM games", "games"))
def dummy_encode(spark, d):
    return X.dummy_encode(fx.games(spark, d).select("game_id", "week"), "week", list(_WEEKS)).drop("week")
