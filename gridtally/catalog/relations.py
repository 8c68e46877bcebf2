"""Queries for joins, aggregates, windows, ordering, unions, evaluation and splits (F-L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import outcome_win
from ..functions.strict import strict_mean, strict_share
from ..operators import aggregate as A
from ..operators import evaluate as K
from ..operators import ordered as O
from ..operators import relate as R
from ..operators import splits as L
from ..plans import history as H
from ..plans.ratings import ratings_long
from ..sources import fixtures as fx
from . import query
from .views import rd, rounded, sql


def _long(spark, d):
    return H.team_games(fx.games(spark, d), codes={})


def _outcomes(spark, d):
    return H.with_outcome(_long(spark, d), 0.5)


def _final(spark, d):
    return H.season_final_table(fx.games(spark, d), codes={})


# ------------------------------------------------------------------ F. joins


@query(
    "f1_left_join_on",
    sql(f"SELECT g.game_id, g.season, g.team, {rd('final_wp')} FROM long g LEFT JOIN final USING (season, team)", "long", "final"),
)
def left_join_on(spark, d):
    rows = _long(spark, d).select("game_id", "season", "team")
    return rounded(R.left_join_on(rows, _final(spark, d), ["season", "team"]))


@query(
    "f2_left_join_common",
    sql(f"SELECT game_id, season, week, \"set\", {rd('season_week_points_mean', 'season_week_points_sd')} FROM long LEFT JOIN weeks USING (season, week)", "long", "weeks"),
)
def left_join_common(spark, d):
    long = _long(spark, d)
    return rounded(R.left_join_common(long.select("game_id", "season", "week", "set"), A.week_mean_sd(long)))


@query(
    "f3_join_renamed_key",
    sql(
        "SELECT game_id, home_team, preferred_color, conf FROM games LEFT JOIN colors ON home_team = team_abbr JOIN divisions ON home_team = team",
        "games",
        "colors",
        "divisions",
    ),
)
def join_renamed_key(spark, d):
    rows = fx.games(spark, d).select("game_id", "home_team")
    rows = R.join_renamed_key(rows, R.small(fx.colors(spark, d)), {"home_team": "team_abbr"}).drop("team_color")
    return R.join_renamed_key(rows, R.small(fx.divisions(spark, d)), {"home_team": "team"}, "inner").drop("division")


@query(
    "f4_role_playing_join",
    sql(
        "SELECT game_id, a.preferred_color AS preferred_color_away, a.team_color AS team_color_away, h.preferred_color AS preferred_color_home, h.team_color AS team_color_home "
        "FROM games LEFT JOIN colors a ON away_team = a.team_abbr LEFT JOIN colors h ON home_team = h.team_abbr",
        "games",
        "colors",
    ),
)
def role_playing_join(spark, d):
    rows = fx.games(spark, d).select("game_id", "away_team", "home_team")
    joined = R.role_playing_join(rows, fx.colors(spark, d), "team_abbr", {"away_team": "_away", "home_team": "_home"})
    return joined.drop("away_team", "home_team")


@query("f6_inner_join_on", sql("SELECT game_id, team, alpha, beta FROM long JOIN strengths USING (team)", "long", "strengths"))
def inner_join_on(spark, d):
    return R.inner_join_on(_long(spark, d).select("game_id", "team"), fx.strengths(spark, d), ["team"]).select(
        "game_id", "team", "alpha", "beta"
    )


@query(
    "f7_prior_period_join",
    sql(
        f"SELECT f.season, f.team, {rd('f.final_wp AS final_wp', 'p.final_wp AS prev_season_wp')} FROM final f LEFT JOIN final p ON f.team = p.team AND f.season = p.season + 1",
        "final",
    ),
)
def prior_period_join(spark, d):
    final = _final(spark, d)
    return rounded(R.prior_period_join(final, final, ["team"], "final_wp", "prev_season_wp"))


_NULLABLE = "SELECT game_id, CASE WHEN home_team <> 'NATION_3' THEN home_team END AS team FROM games"


@query(
    "f8_null_safe_join",
    sql(
        "SELECT k.game_id, k.team, n.n FROM keyed k LEFT JOIN (SELECT team, count(*) AS n FROM keyed GROUP BY team) n ON k.team IS NOT DISTINCT FROM n.team",
        "games",
        keyed=_NULLABLE,
    ),
)
def null_safe_join(spark, d):
    rows = fx.games(spark, d).select(
        "game_id", F.when(F.col("home_team") != "NATION_3", F.col("home_team")).alias("team")
    )
    return R.null_safe_join(rows, rows.groupBy("team").agg(F.count(F.lit(1)).alias("n")), ["team"])


# ------------------------------------------------------------------ G. aggregates


@query("g1_week_mean_sd", sql(f"SELECT season, week, {rd('season_week_points_mean', 'season_week_points_sd')} FROM weeks", "weeks"))
def week_mean_sd(spark, d):
    return rounded(A.week_mean_sd(_long(spark, d)))


@query(
    "g2_conditional_sum",
    sql("SELECT season, team, sum(CASE WHEN game_type = 'REG' THEN win ELSE 0 END) AS reg_wins FROM outcome GROUP BY season, team", "outcome"),
)
def conditional_sum(spark, d):
    return A.conditional_sum(_outcomes(spark, d), ["season", "team"], F.col("game_type") == "REG", "win", "reg_wins")


@query(
    "g3_group_share",
    sql(
        f"SELECT season, home_team, {rd('CASE WHEN count(result) = count(*) THEN avg(CASE WHEN result > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS win_prob')} FROM games GROUP BY season, home_team",
        "games",
    ),
)
def group_share(spark, d):
    return rounded(A.group_share(fx.games(spark, d), ["season", "home_team"]))


@query(
    "g4_group_abs_mean",
    sql(
        f"SELECT season, week, home_team, {rd('CASE WHEN count(result) = count(*) THEN abs(avg(result)) END AS exp_result')} FROM games GROUP BY season, week, home_team",
        "games",
    ),
)
def group_abs_mean(spark, d):
    return rounded(A.group_abs_mean(fx.games(spark, d), ["season", "week", "home_team"]))


@query("g5_distinct_rows", sql("SELECT DISTINCT season, home_team, away_team FROM games", "games"))
def distinct_rows(spark, d):
    return R.distinct_rows(fx.games(spark, d), "season", "home_team", "away_team")


# ------------------------------------------------------------------ H. running values


def _team_order(df):
    return O.ordered(df, ["season", "team"], ["week", "game_id"])


@query("h1_running_sum", sql(f"SELECT season, team, game_id, wins, {rd('cumulative_pd')} FROM running", "running"))
def running_sum(spark, d):
    rows = _team_order(_outcomes(spark, d)).running(wins=O.running_sum("win"), cumulative_pd=O.running_sum("delta"))
    return rounded(rows.frame.select("season", "team", "game_id", "wins", "cumulative_pd"))


@query("h2_running_mean", sql(f"SELECT season, team, game_id, {rd('cumulative_point_mean')} FROM running", "running"))
def running_mean(spark, d):
    rows = _team_order(_long(spark, d)).running(cumulative_point_mean=O.running_mean("score"))
    return rounded(rows.frame.select("season", "team", "game_id", "cumulative_point_mean"))


@query(
    "h3_running_dispersion",
    sql(f"SELECT season, team, game_id, {rd('cumulative_point_sd', 'cumulative_pd_sd', digits=4)} FROM running", "running"),
)
def running_dispersion(spark, d):
    rows = H.running_team_stats(_outcomes(spark, d))
    return rounded(rows.select("season", "team", "game_id", "cumulative_point_sd", "cumulative_pd_sd"), 4)


@query("h4_running_count", sql("SELECT season, team, game_id, game_num FROM running", "running"))
def running_count(spark, d):
    rows = _team_order(_long(spark, d)).running(game_num=O.running_count())
    return rows.frame.select("season", "team", "game_id", "game_num")


@query("h5_group_total", sql("SELECT season, team, game_id, reg_wins, tot_wins, tot_games FROM running", "running"))
def group_total(spark, d):
    rows = _outcomes(spark, d)
    reg = F.sum(F.when(F.col("game_type") == "REG", F.col("win")).otherwise(0.0))
    stats = A.group_stat_attach(
        rows, ["season", "team"], reg_wins=reg, tot_wins=F.sum("win"), tot_games=F.count(F.lit(1))
    )
    return stats.select("season", "team", "game_id", "reg_wins", "tot_wins", "tot_games")


@query("h6_final_share", sql(f"SELECT season, team, game_id, {rd('reg_wp', 'final_wp')} FROM running", "running"))
def final_share(spark, d):
    rows = H.running_team_stats(_outcomes(spark, d))
    return rounded(rows.select("season", "team", "game_id", "reg_wp", "final_wp"))


_LEAGUE = "cumulative_season_points_mean", "cumulative_season_points_sd"


@query("h7_league_running", sql(f"SELECT season, week, {rd(*_LEAGUE, digits=4)} FROM league", "league"))
def league_running(spark, d):
    return rounded(A.league_running(A.week_mean_sd(_long(spark, d))).select("season", "week", *_LEAGUE), 4)


@query(
    "h8_lag_value",
    sql(
        "SELECT season, team, game_id, coalesce(lag(score) OVER (PARTITION BY season, team ORDER BY week, game_id), 0) AS pre_score FROM long",
        "long",
    ),
)
def lag_value(spark, d):
    rows = _team_order(_long(spark, d)).running(pre_score=O.previous("score")).frame
    return rows.select("season", "team", "game_id", F.coalesce("pre_score", F.lit(0)).alias("pre_score"))


@query(
    "h9_group_stat_attach",
    sql(
        f"""SELECT game_id, {rd('CASE WHEN count(result) OVER h = count(*) OVER h THEN avg(result) OVER h END AS mean_result',
            'CASE WHEN count(result) OVER h = count(*) OVER h THEN avg(CASE WHEN result > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER h END AS win_prob')}
            FROM games WINDOW h AS (PARTITION BY season, home_team)""",
        "games",
    ),
)
def group_stat_attach(spark, d):
    rows = A.group_stat_attach(
        fx.games(spark, d),
        ["season", "home_team"],
        mean_result=strict_mean("result"),
        win_prob=strict_share(F.col("result") > 0, "result"),
    )
    return rounded(rows.select("game_id", "mean_result", "win_prob"))


# ------------------------------------------------------------------ I. order and top rows


@query("i1_sort_multi", sql("SELECT season, week, game_id, result FROM games ORDER BY season, week, result DESC NULLS LAST, game_id", "games"))
def sort_multi(spark, d):
    rows = fx.games(spark, d).select("season", "week", "game_id", "result")
    return R.sort_multi(rows, "season", "week", "-result", "game_id")


def _extreme(pick: str) -> str:
    return sql(
        f"SELECT season, team, elo FROM rated r WHERE \"date\" = (SELECT {pick}(\"date\") FROM rated x WHERE x.season = r.season AND x.team = r.team)",
        "rated",
    )


@query("i2_latest_per_group", _extreme("max"))
def latest_per_group(spark, d):
    return R.latest_per_group(ratings_long(fx.ratings(spark, d)), ["season", "team"], "date").drop("date")


@query("i3_earliest_per_group", _extreme("min"))
def earliest_per_group(spark, d):
    return R.earliest_per_group(ratings_long(fx.ratings(spark, d)), ["season", "team"], "date").drop("date")


def _levels(stat: str) -> str:
    return sql(
        f"SELECT home_team, {rd('stat')}, dense_rank() OVER (ORDER BY stat) AS level "
        f"FROM (SELECT home_team, {stat}(result) AS stat FROM games GROUP BY home_team)",
        "games",
    )


@query("i4_level_reorder", _levels("median"))
def level_reorder(spark, d):
    return rounded(R.level_reorder(fx.games(spark, d), "home_team", "result"))


@query("i4_level_reorder_mean", _levels("avg"))
def level_reorder_mean(spark, d):
    return rounded(R.level_reorder(fx.games(spark, d), "home_team", "result", "mean"))


@query(
    "i5_level_table",
    sql(
        """SELECT team, CAST(row_number() OVER (ORDER BY season, week, game_id, "set") AS INTEGER) AS ord
           FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY season, week, game_id, "set") AS rn FROM long) WHERE rn = 1""",
        "long",
    ),
)
def level_table(spark, d):
    return H.team_levels(fx.games(spark, d), codes={})


_BY_TEAM = """SELECT home_team AS candidate, sqrt(avg((truth - estimate) * (truth - estimate))) AS rmse
              FROM predictions JOIN games USING (game_id) WHERE truth IS NOT NULL GROUP BY home_team"""


@query(
    "i6_best_candidate",
    sql(f"SELECT candidate, {rd('rmse')} FROM (SELECT * FROM by_team ORDER BY rmse, candidate LIMIT 5)", "predictions", by_team=_BY_TEAM),
)
def best_candidate(spark, d):
    games = fx.games(spark, d).select(
        "home_team", "result", ((F.col("game_id") * 7) % 41 - 20).cast("double").alias("estimate")
    )
    scored = K.grouped_metrics(games, ["home_team"], "result", "estimate").where(F.col("metric") == "rmse")
    table = scored.select(F.col("home_team").alias("candidate"), F.col("estimate").alias("rmse"))
    return rounded(R.top_candidates(table, "rmse", 5, "candidate"))


# ------------------------------------------------------------------ J. union


@query(
    "j1_bind_rows",
    sql("SELECT season, team, reg_wins, NULL::DOUBLE AS score FROM (SELECT season, team, sum(win) AS reg_wins FROM outcome GROUP BY season, team) UNION ALL SELECT season, team, NULL, CAST(score AS DOUBLE) FROM long", "outcome"),
)
def bind_rows(spark, d):
    wins = _outcomes(spark, d).groupBy("season", "team").agg(F.sum("win").alias("reg_wins"))
    return R.bind_rows(wins, _long(spark, d).select("season", "team", F.col("score").cast("double").alias("score")))


# ------------------------------------------------------------------ K. evaluation


def _metrics(keys: str = "", source: str = "predictions") -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
    SELECT {k}unnest(['rmse', 'rsq', 'mae']) AS metric, unnest([rmse, rsq, mae]) AS estimate
    FROM (SELECT {k}sqrt(avg((truth - estimate) * (truth - estimate))) AS rmse, pow(corr(truth, estimate), 2) AS rsq,
                 avg(abs(truth - estimate)) AS mae
          FROM {source} WHERE truth IS NOT NULL AND estimate IS NOT NULL {group})"""


@query("k1_regression_metrics", sql(f"SELECT metric, {rd('estimate')} FROM m", "predictions", m=_metrics()))
def regression_metrics(spark, d):
    return rounded(K.regression_metrics(fx.predictions(spark, d)))


@query("k2_grouped_metrics", sql(f"SELECT week, metric, {rd('estimate')} FROM m", "predictions", m=_metrics("week")))
def grouped_metrics(spark, d):
    return rounded(K.grouped_metrics(fx.predictions(spark, d), ["week"]))


_NAMES = ["away_score", "home_score", "result", "week"]


def _correlations() -> str:
    pairs = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS parameter1, '{b}' AS parameter2, regr_count({a}, {b}) AS n_obs, corr({a}, {b}) AS r FROM games"
        for a, b in pairs
    )
    half = "1.959963984540054 / sqrt(n_obs - 3)"
    return sql(
        f"""SELECT parameter1, parameter2, CAST(n_obs AS BIGINT) AS n_obs, {rd('r', 'tanh(atanh(r) - ' + half + ') AS ci_low', 'tanh(atanh(r) + ' + half + ') AS ci_high')},
            {rd('r * sqrt(n_obs - 2) / sqrt(1 - r * r) AS t', digits=4)} FROM pairs""",
        "games",
        pairs=rows,
    )


@query("k3_correlation_pairs", _correlations())
def correlation_pairs(spark, d):
    rows = K.correlation_pairs(fx.games(spark, d), _NAMES)
    return rounded(rows.withColumn("t", F.round("t", 4)))


@query(
    "k4_group_linear_fit",
    sql(
        f"SELECT week, {rd('regr_slope(truth, estimate) AS slope', 'regr_intercept(truth, estimate) AS intercept', 'regr_r2(truth, estimate) AS r2')}, CAST(regr_count(truth, estimate) AS BIGINT) AS n FROM predictions GROUP BY week",
        "predictions",
    ),
)
def group_linear_fit(spark, d):
    return rounded(K.group_linear_fit(fx.predictions(spark, d), ["week"], "truth", "estimate"))


def _bucket(key: str, seed: int = 5, word: int = 0) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), {1 + 8 * word}, 8) AS BIGINT)"


@query(
    "k5_resample_metrics",
    sql(
        f"SELECT metric, {rd('avg(estimate) AS mean', 'stddev_samp(estimate) / sqrt(count(*)) AS std_err')}, count(*) AS n FROM m GROUP BY metric",
        "predictions",
        folded=f"SELECT *, {_bucket('game_id', word=1)} % 10 + 1 AS fold FROM predictions",
        m=_metrics("fold", "folded"),
    ),
)
def resample_metrics(spark, d):
    return rounded(K.resample_metrics(L.kfold(fx.predictions(spark, d), ["game_id"], 5)))


# ------------------------------------------------------------------ L. splits


@query(
    "l1_random_split",
    sql(f"SELECT game_id, CASE WHEN {_bucket('game_id')} % 100 < 75 THEN 'train' ELSE 'test' END AS split FROM games", "games"),
)
def random_split(spark, d):
    return L.random_split(fx.games(spark, d).select("game_id"), ["game_id"], 5)


@query(
    "l2_stratified_split",
    sql(
        f"""SELECT game_id, season, CAST(stratum AS INTEGER) AS stratum,
                   CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY h, game_id) <= floor(0.75 * count(*) OVER (PARTITION BY stratum))
                        THEN 'train' ELSE 'test' END AS split
            FROM (SELECT game_id, season, {_bucket('game_id')} AS h,
                         1 + CAST(season > q[1] AS INTEGER) + CAST(season > q[2] AS INTEGER) + CAST(season > q[3] AS INTEGER) AS stratum
                  FROM games CROSS JOIN (SELECT quantile_cont(season, [0.25, 0.5, 0.75]) AS q FROM games))""",
        "games",
    ),
)
def stratified_split(spark, d):
    return L.stratified_split(fx.games(spark, d).select("game_id", "season"), ["game_id"], "season", 5)


@query(
    "l3_group_split",
    sql(f"SELECT game_id, id, CASE WHEN {_bucket('id')} % 100 < 75 THEN 'train' ELSE 'test' END AS split FROM (SELECT game_id, season || '_' || home_team AS id FROM games)", "games"),
)
def group_split(spark, d):
    rows = fx.games(spark, d).select("game_id", F.concat_ws("_", "season", "home_team").alias("id"))
    return L.group_split(rows, "id", 5)


@query("l4_kfold", sql(f"SELECT game_id, CAST({_bucket('game_id', word=1)} % 10 + 1 AS INTEGER) AS fold FROM games", "games"))
def kfold(spark, d):
    return L.kfold(fx.games(spark, d).select("game_id"), ["game_id"], 5)
