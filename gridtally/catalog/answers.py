"""Queries for whole answers (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round_decimals
from ..operators import aggregate as A
from ..operators import columns as C
from ..operators import evaluate as K
from ..operators import relate as R
from ..plans import history as H
from ..plans import margin as G
from ..plans import ratings as P
from ..plans import reports as Q
from ..plans import state as S
from ..plans import strength as T
from ..sources import fixtures as fx
from ..sources.shared import settle, shared_folder
from . import query, scenarios
from .models import _of_seventeen, _preseason
from .views import least_squares, rd, rounded, sql

_TEAM = "id, game_id, season, game_type, week, div_game, \"set\", team, score, result, win, wins, game_num, reg_wins, tot_wins, tot_games"
_STATS = (
    "delta", "cumulative_point_mean", "cumulative_pd", "reg_wp", "final_wp",
    "season_week_points_mean", "season_week_points_sd", "cumulative_season_points_mean",
)
_SDS = ("cumulative_point_sd", "cumulative_pd_sd", "cumulative_season_points_sd")


@query(
    "o1_team_game_history",
    sql(f"SELECT {_TEAM}, {rd(*_STATS)}, {rd(*_SDS, digits=4)} FROM history", "history"),
)
def team_game_history(spark, d):
    rows = H.team_game_history(fx.games(spark, d), codes={})
    return rounded(rows.withColumns({c: F.round(c, 4) for c in _SDS}))


@query("o2_season_final_table", sql(f"SELECT season, team, {rd('final_wp')} FROM final", "final"))
def season_final_table(spark, d):
    return rounded(H.season_final_table(fx.games(spark, d), codes={}))


_OPENING = """
SELECT season, team, elo FROM rated r
WHERE "date" = (SELECT min("date") FROM rated x WHERE x.season = r.season AND x.team = r.team)"""


@query(
    "o3_preseason_inputs",
    sql(
        f"""SELECT f.season, f.team, {rd('p.final_wp AS prev_season_wp', 'o.elo AS elo', 'f.final_wp AS final_wp')}
            FROM final f JOIN final p ON f.team = p.team AND f.season = p.season + 1
            JOIN opening o ON f.season = o.season AND f.team = o.team""",
        "final",
        "rated",
        opening=_OPENING,
    ),
)
def preseason_inputs(spark, d):
    return rounded(_preseason(spark, d))


_LAST = _OPENING.replace("min(", "max(")


@query(
    "o4_current_ratings_inputs",
    sql(
        f"""SELECT l.season + 1 AS season, l.team, {rd('l.elo - (l.elo - 1505) / 3 AS elo', 'f.final_wp AS prev_season_wp')}
            FROM last l LEFT JOIN final f ON f.season = l.season AND f.team = l.team""",
        "final",
        "rated",
        last=_LAST,
    ),
)
def current_ratings_inputs(spark, d):
    final = H.season_final_table(fx.games(spark, d), codes={})
    return rounded(P.current_ratings_inputs(final, fx.ratings(spark, d), codes={}))


@query(
    "o5_current_state",
    sql(
        f"""SELECT season || '_' || team AS id, season, team, week, game_id, game_num, wins,
                   {rd('cumulative_point_mean', 'cumulative_pd', 'cumulative_season_points_mean')},
                   {rd(*_SDS, digits=4)}
            FROM (SELECT *, rank() OVER (PARTITION BY season, team ORDER BY week DESC) AS place
                  FROM running_now JOIN league_now USING (season, week) WHERE week = 1 OR result IS NOT NULL)
            WHERE place = 1""",
        "running_now",
        "league_now",
    ),
)
def current_state(spark, d):
    games = fx.games(spark, d)
    return _state_columns(T.current_state(games, None, 12, levels=H.team_levels(games, codes={})))


def _state_columns(rows):
    picked = rows.select(
        "id", "season", "team", "week", "game_id", "game_num", "wins",
        "cumulative_point_mean", "cumulative_pd", "cumulative_season_points_mean", *_SDS,
    )
    return rounded(picked.withColumns({c: F.round(c, 4) for c in _SDS}))


def _at_week(text: str, week: int) -> str:
    return text.replace("week <= 12", f"week <= {week}")


@query(
    "a5_state_from_snapshot",
    _at_week(
        sql(
            f"""SELECT season || '_' || team AS id, season, team, week, game_id, game_num, wins,
                       {rd('cumulative_point_mean', 'cumulative_pd', 'cumulative_season_points_mean')}, {rd(*_SDS, digits=4)}
                FROM (SELECT *, rank() OVER (PARTITION BY season, team ORDER BY week DESC) AS place
                      FROM running_now JOIN league_now USING (season, week) WHERE week = 1 OR result IS NOT NULL)
                WHERE place = 1""",
            "running_now",
            "league_now",
        ),
        14,
    ),
)
def state_from_snapshot(spark, d):
    """The state of week 14 from the stored state of week 12 and the games of weeks 13 and 14 only."""
    games = fx.games(spark, d)
    path = shared_folder(spark)
    S.store_state(S.running_state(games, 12, codes={}), path, 12)
    later = games.where(F.col("week").between(13, 14))
    return _state_columns(S.state_rows(S.extend_state(S.stored_state(spark, path, 12), later, codes={})))


_STORED_GAMES = 500_000


@query("o6_strength_table")
def strength_table(spark, d):
    """Pre-season model, in-season model, and the table for every season as of week 12."""
    # Read by every counting pass, aggregate and window below. Many games are joined once; of few the order in which
    # doubles are added stays as it is, which shows in the sixth digit where games come twice.
    stored = settle if fx.table(spark, d, "orders").count() > _STORED_GAMES else lambda rows: rows
    games = stored(fx.games(spark, d))
    preseason = stored(_preseason(spark, d, games))
    first = T.preseason_model(preseason)
    history = _of_seventeen(H.team_game_history(games, codes={}), games)
    rows, rated = T.strength_inputs(history, preseason, first, joined=False)
    second = T.strength_model(rows, rated=rated)
    table = T.strength_table(preseason, first, _of_seventeen(T.current_state(games, None, 12), games), second)
    table = C.derive_cols(table, alpha=F.col("strength_dist.alpha"), beta=F.col("strength_dist.beta")).drop("strength_dist")
    return table.withColumns({c: round_decimals(c, 4) + 0.0 for c in ("elo", "estimated_strength", "alpha", "beta")})


# Stand-in strengths: the running share of wins, and last season's final share before it.
_RATED_HISTORY = """
SELECT r.*, wins / game_num AS estimated_strength, coalesce(p.final_wp, 0.5) AS initial_rating
FROM running r LEFT JOIN final p ON r.team = p.team AND r.season = p.season + 1"""
_PREGAME = """
SELECT *, coalesce(lag(estimated_strength) OVER w, initial_rating) AS pre_game_strength,
       coalesce(lag(cumulative_point_mean) OVER w, 0) AS pre_point_mean
FROM rated_history WINDOW w AS (PARTITION BY season, team ORDER BY week, game_id)"""


def _pregame(spark, d):
    games = fx.games(spark, d)
    stats = H.running_team_stats(H.with_outcome(H.team_games(games, codes={}), 0.5))
    final = H.season_final_table(games, codes={})
    return T.pregame_strengths(_with_prior(stats, final))


def _with_prior(stats, final):
    prior = R.shift_period(final, "final_wp", "initial_rating")
    rows = R.left_join_on(stats, R.small(prior), ["season", "team"])
    return rows.withColumns(
        {
            "initial_rating": F.coalesce("initial_rating", F.lit(0.5)),
            "estimated_strength": F.col("wins") / F.col("game_num"),
        }
    )


@query(
    "o7_pregame_strengths",
    sql(f"SELECT season, team, game_id, {rd('pre_game_strength', 'pre_point_mean')} FROM pregame", "running", "final", rated_history=_RATED_HISTORY, pregame=_PREGAME),
)
def pregame_strengths(spark, d):
    return rounded(_pregame(spark, d).select("season", "team", "game_id", "pre_game_strength", "pre_point_mean"))


_COMPARED = """
SELECT a.game_id, a.game_type, a.week, a.team AS away_team, h.team AS home_team, h.pre_game_strength AS pre_game_strength_home,
       a.score AS score_away, h.score AS score_home, h.pre_point_mean AS pre_point_mean_home, a.pre_point_mean AS pre_point_mean_away,
       a.pre_game_strength AS pre_game_strength_away, a.result, h.pre_game_strength - a.pre_game_strength AS strength_diff,
       CASE WHEN a.game_type = 'REG' THEN 'REG' ELSE 'PLAYOFF' END AS game_type_adj,
       CASE WHEN a.week = 1 THEN 0 ELSE 1 END AS is_after_week_1
FROM pregame a JOIN pregame h ON a.game_id = h.game_id AND a."set" = 'away' AND h."set" = 'home'"""
_COMPARED_STATS = ("pre_game_strength_home", "pre_point_mean_home", "pre_point_mean_away", "pre_game_strength_away", "strength_diff")


@query(
    "o8_game_comparison",
    sql(
        f"SELECT * EXCLUDE ({', '.join(_COMPARED_STATS)}), {rd(*_COMPARED_STATS)} FROM compared",
        "running",
        "final",
        rated_history=_RATED_HISTORY,
        pregame=_PREGAME,
        compared=_COMPARED,
    ),
)
def game_comparison(spark, d):
    return rounded(G.game_comparison(_pregame(spark, d)))


_TERMS = ["pre_game_strength_home", "strength_diff", "is_after_week_1", "pre_game_strength_home * strength_diff"]
_PREDICTED = f"""
SELECT *, b0 + b1 * {_TERMS[0]} + b2 * {_TERMS[1]} + b3 * {_TERMS[2]} + b4 * {_TERMS[3]} AS pred
FROM parted CROSS JOIN ols WHERE result IS NOT NULL"""
_PARTED = """
SELECT *, CASE WHEN CAST('0x' || substr(md5('13|' || game_id), 1, 8) AS BIGINT) % 100 < 75 THEN 'train' ELSE 'test' END AS part
FROM compared"""
_PART_METRICS = """
SELECT part, unnest(['rmse', 'rsq', 'mae']) AS metric,
       unnest([sqrt(avg(pow(result - pred, 2))), pow(corr(result, pred), 2), avg(abs(result - pred))]) AS estimate
FROM predicted GROUP BY part"""


@query(
    "o8_margin_model",
    sql(
        f"SELECT part, metric, {rd('estimate')} FROM part_metrics",
        "running",
        "final",
        rated_history=_RATED_HISTORY,
        pregame=_PREGAME,
        compared=_COMPARED,
        parted=_PARTED,
        **least_squares("parted WHERE part = 'train' AND result IS NOT NULL", "result", _TERMS),
        predicted=_PREDICTED,
        part_metrics=_PART_METRICS,
    ),
)
def margin_model(spark, d):
    """Margin model fitted on the training games, with metrics on both sides."""
    fit = G.fit_margin_model(G.game_comparison(_pregame(spark, d)))
    parts = [fit.train_metrics.withColumn("part", F.lit("train")), fit.test_metrics.withColumn("part", F.lit("test"))]
    return rounded(R.bind_rows(*parts))


@query("o8_margin_resamples")
def margin_resamples(spark, d):
    """Metrics of the margin model over held-out folds of the training games."""
    return rounded(G.fit_margin_model(G.game_comparison(_pregame(spark, d))).resamples)


_LABEL = "winner || ' wins ' || win_prob || chr(10) || 'with an expected MOV of ' || exp_result || ' points'"


@query(
    "o9_weekly_projection",
    sql(
        f"""SELECT season, week, away_team, home_team, exp_result, winner, {rd('win_prob_num')}, win_prob,
                   away_team || ' @ ' || home_team AS clean_title, {_LABEL} AS label,
                   home_team || ' wins ->' AS home_label, '<- ' || away_team || ' wins' AS away_label,
                   dense_rank() OVER (PARTITION BY season, week ORDER BY win_prob_num) AS title_level
            FROM matchup_summary""",
        "matchup_summary",
    ),
)
def weekly_projection(spark, d):
    return rounded(Q.weekly_projection(scenarios.filled(spark, d)))


@query(
    "o9_weekly_histogram",
    sql(
        f"""SELECT season, week, away_team || ' @ ' || home_team AS clean_title,
                   CASE WHEN result > 0 THEN preferred_color_home WHEN result <= 0 THEN preferred_color_away END AS fill_col,
                   CAST(floor(result + 0.5) AS INTEGER) AS bin, {rd('count(*) / 20.0::DOUBLE AS height')}
            FROM wide GROUP BY ALL""",
        "wide",
    ),
)
def weekly_histogram(spark, d):
    return rounded(Q.weekly_histogram(scenarios.wide(spark, d), n_sims=scenarios.SIMS))


_SCHEDULE = """
SELECT *, home_team AS team, ' vs ' || away_team AS setting FROM matchup_summary WHERE week <= 18
UNION ALL SELECT *, away_team, ' @ ' || home_team FROM matchup_summary WHERE week <= 18"""


@query(
    "o10_team_season_projection",
    sql(
        """SELECT season, week, away_team, home_team, exp_result, winner, win_prob, team,
                  'Week ' || week || setting AS clean_title,
                  winner || ' wins ' || win_prob || chr(10) || 'Expected MOV: ' || exp_result || ' points' AS label,
                  home_team || ' wins ->' AS home_label, '<- ' || away_team || ' wins' AS away_label,
                  dense_rank() OVER (PARTITION BY season, team ORDER BY week) AS title_level
           FROM schedule""",
        "matchup_summary",
        schedule=_SCHEDULE,
    ),
)
def team_season_projection(spark, d):
    return rounded(Q.team_season_projection(scenarios.filled(spark, d)))


_SIDED = """
SELECT *, home_team AS team, 'Week ' || week || ' vs ' || away_team AS clean_title FROM wide WHERE week <= 18
UNION ALL SELECT *, away_team, 'Week ' || week || ' @ ' || home_team FROM wide WHERE week <= 18"""


@query(
    "o10_team_season_histogram",
    sql(
        f"""SELECT season, week, team, clean_title,
                   CASE WHEN result > 0 THEN preferred_color_home WHEN result <= 0 THEN preferred_color_away END AS fill_col,
                   CAST(floor(result + 0.5) AS INTEGER) AS bin, {rd('count(*) / 20.0::DOUBLE AS height')}
            FROM sided WHERE result IS NOT NULL GROUP BY ALL""",
        "wide",
        sided=_SIDED,
    ),
)
def team_season_histogram(spark, d):
    return rounded(Q.team_season_histogram(scenarios.wide(spark, d), n_sims=scenarios.SIMS))


@query(
    "o11_standings_report",
    sql(
        "SELECT season, conf, substr(division, 5) AS division, team, format('{:.1f}', wins) AS wins, "
        + ", ".join(f"format('{{:.0f}}', {f} * 100) || '%' AS {f}" for f in scenarios.FLAGS)
        + " FROM overall",
        "overall",
    ),
)
def standings_report(spark, d):
    return Q.standings_report(A.scenario_overall(scenarios.flagged(spark, d)))


@query(
    "o12_rmse_by_week",
    sql(
        f"""SELECT week, 'rmse' AS metric, {rd('estimate')} FROM (
              SELECT week, sqrt(avg((truth - estimate) * (truth - estimate))) AS estimate FROM predictions WHERE truth IS NOT NULL GROUP BY week
              UNION ALL SELECT 0, sqrt(avg((truth - estimate) * (truth - estimate))) FROM predictions WHERE truth IS NOT NULL)""",
        "predictions",
    ),
)
def rmse_by_week(spark, d):
    rows = fx.predictions(spark, d)
    return rounded(Q.rmse_by_week(rows, K.regression_metrics(rows), "truth", "estimate"))
