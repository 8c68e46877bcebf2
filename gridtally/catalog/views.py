"""The stand-in tables as DuckDB text, and helpers to write query texts and rounded results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAME_COLUMNS = (
    "game_id, season, game_type, week, game_date, away_team, away_score, home_team, home_score, result, div_game"
)


def _outcome(unplayed: str) -> str:
    return f"""
    SELECT *, CASE WHEN win = 0.5 THEN 0.0 WHEN "set" = 'home' THEN CAST(result AS DOUBLE)
                   ELSE CAST(-result AS DOUBLE) END AS delta
    FROM (SELECT *, CAST(CASE WHEN result IS NULL THEN {unplayed}
                    WHEN result = 0 THEN 0.5
                    WHEN (result > 0) = ("set" = 'home') THEN 1 ELSE 0 END AS DOUBLE) AS win FROM long)"""


def _running(source: str) -> str:
    return f"""
    SELECT *, abs(CASE WHEN bool_or(score_gap IS NULL) OVER w THEN NULL ELSE sum(score_gap) OVER w END) / sqrt(week) AS cumulative_point_sd,
           abs(CASE WHEN bool_or(delta_gap IS NULL) OVER w THEN NULL ELSE sum(delta_gap) OVER w END) / sqrt(week) AS cumulative_pd_sd,
           reg_wins / 16.0 AS reg_wp, tot_wins / tot_games AS final_wp
    FROM (
      SELECT *, score - cumulative_point_mean AS score_gap, delta - delta_mean AS delta_gap
      FROM (
        SELECT *, sum(win) OVER w AS wins,
               CASE WHEN bool_or(score IS NULL) OVER w THEN NULL ELSE avg(score) OVER w END AS cumulative_point_mean,
               CASE WHEN bool_or(delta IS NULL) OVER w THEN NULL ELSE sum(delta) OVER w END AS cumulative_pd,
               CASE WHEN bool_or(delta IS NULL) OVER w THEN NULL ELSE avg(delta) OVER w END AS delta_mean,
               row_number() OVER w AS game_num,
               sum(CASE WHEN game_type = 'REG' THEN win ELSE 0.0 END) OVER g AS reg_wins,
               sum(win) OVER g AS tot_wins, count(*) OVER g AS tot_games
        FROM {source}
        WINDOW w AS (PARTITION BY season, team ORDER BY week, game_id ROWS UNBOUNDED PRECEDING),
               g AS (PARTITION BY season, team)))
    WINDOW w AS (PARTITION BY season, team ORDER BY week, game_id ROWS UNBOUNDED PRECEDING)"""


def _league(source: str, frame: str) -> str:
    return f"""
    SELECT *, abs(CASE WHEN bool_or(gap IS NULL) OVER s THEN NULL ELSE sum(gap) OVER s END) / sqrt(week) AS cumulative_season_points_sd
    FROM (SELECT *, season_week_points_mean - cumulative_season_points_mean AS gap
          FROM (SELECT *, CASE WHEN bool_or(season_week_points_mean IS NULL) OVER m THEN NULL
                               ELSE avg(season_week_points_mean) OVER m END AS cumulative_season_points_mean
                FROM {source}
                WINDOW m AS (PARTITION BY season ORDER BY week ROWS UNBOUNDED PRECEDING)))
    WINDOW s AS ({frame} ROWS UNBOUNDED PRECEDING)"""


# name -> (views it reads, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "games": (
        [],
        """
    SELECT game_id, season, CASE WHEN step >= 17 THEN 'POST' ELSE 'REG' END AS game_type, step + 1 AS week, game_date,
           away_team, CASE WHEN open THEN NULL ELSE away_points END AS away_score,
           home_team, CASE WHEN open THEN NULL ELSE home_points END AS home_score,
           CASE WHEN open THEN NULL ELSE home_points - away_points END AS result, div_game
    FROM (
      SELECT *, season = 2001 AND step >= 9 AS open FROM (
        SELECT o.o_orderkey AS game_id, CAST(year(o.o_orderdate) AS INTEGER) AS season,
               CAST((dayofyear(o.o_orderdate) - 1) // 20 AS INTEGER) AS step, CAST(o.o_orderdate AS DATE) AS game_date,
               a.n_name AS away_team, CAST(floor(o.o_totalprice / 45) AS BIGINT) % 45 AS away_long,
               h.n_name AS home_team, CAST(floor(o.o_totalprice) AS BIGINT) % 45 AS home_long,
               CAST(away_long AS INTEGER) AS away_points, CAST(home_long AS INTEGER) AS home_points,
               CAST(h.n_regionkey = a.n_regionkey AS INTEGER) AS div_game
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation h ON h.n_nationkey = c.c_nationkey
        JOIN nation a ON a.n_nationkey = (c.c_nationkey + 1 + o.o_orderkey % 24) % 25))""",
    ),
    "ratings": (
        ["games"],
        """
    SELECT game_date AS "date", season, home_team AS team1, away_team AS team2,
           CAST(1300 + game_id * 37 % 400 AS DOUBLE) AS elo1_pre, CAST(1300 + game_id * 53 % 400 AS DOUBLE) AS elo2_pre
    FROM games""",
    ),
    "strengths": (
        [],
        """
    SELECT n_name AS team, CAST(2 + n_nationkey % 7 AS DOUBLE) AS alpha, CAST(2 + n_nationkey % 5 AS DOUBLE) AS beta
    FROM nation""",
    ),
    "divisions": (
        [],
        """
    SELECT n_name AS team, conf, conf || ' ' || r_name AS division
    FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'AFC' ELSE 'NFC' END AS conf FROM nation)
    JOIN region ON n_regionkey = r_regionkey""",
    ),
    "colors": (
        [],
        """
    SELECT n_name AS team_abbr, '#' || substr(md5(n_name), 1, 6) AS preferred_color,
           '#' || substr(md5('t' || n_name), 1, 6) AS team_color
    FROM nation""",
    ),
    "team_names": (
        [],
        """
    SELECT n_name AS team_abbr, 'Team ' || n_name AS team_name, 'T' || n_nationkey AS team_nick,
           CAST(n_nationkey AS VARCHAR) AS team_id
    FROM nation""",
    ),
    "predictions": (
        ["games"],
        """
    SELECT game_id, season, week, CAST(result AS DOUBLE) AS truth, CAST(game_id * 7 % 41 - 20 AS DOUBLE) AS estimate
    FROM games""",
    ),
    "season_length": (
        ["games"],
        "SELECT DISTINCT season, CASE WHEN season < 2001 THEN 16 ELSE 17 END AS games FROM games",
    ),
    "long": (
        ["games"],
        """
    SELECT game_id, season, game_type, week, div_game, 'away' AS "set", away_team AS team, away_score AS score, result FROM games
    UNION ALL
    SELECT game_id, season, game_type, week, div_game, 'home', home_team, home_score, result FROM games""",
    ),
    "outcome": (["long"], _outcome("0.5")),
    "outcome_now": (["long"], _outcome("0")),
    "running": (["outcome"], _running("outcome")),
    "running_now": (["outcome_now"], _running("(SELECT * FROM outcome_now WHERE week <= 12)")),
    "weeks": (
        ["long"],
        """
    SELECT season, week, CASE WHEN count(score) = count(*) THEN avg(score) END AS season_week_points_mean,
           CASE WHEN count(score) = count(*) THEN stddev_samp(score) END AS season_week_points_sd
    FROM long GROUP BY season, week""",
    ),
    "league": (["weeks"], _league("weeks", "ORDER BY week, season")),
    "league_now": (["weeks"], _league("(SELECT * FROM weeks WHERE week <= 12)", "PARTITION BY season ORDER BY week")),
    "history": (["running", "league"], "SELECT season || '_' || team AS id, * FROM running JOIN league USING (season, week)"),
    "final": (["outcome"], "SELECT season, team, sum(win) / count(*) AS final_wp FROM outcome GROUP BY season, team"),
    "rated": (
        ["ratings"],
        """
    SELECT "date", season, team1 AS team, elo1_pre AS elo FROM ratings
    UNION ALL SELECT "date", season, team2, elo2_pre FROM ratings""",
    ),
    "scenario": (["games"], "SELECT t.sim, g.* FROM range(1, 21) t(sim) CROSS JOIN games g"),
    "matchups": (
        ["scenario", "strengths"],
        """
    SELECT s.*, a.alpha / (a.alpha + a.beta) AS pre_game_strength_away, h.alpha / (h.alpha + h.beta) AS pre_game_strength_home,
           pre_game_strength_home - pre_game_strength_away AS strength_diff,
           CASE WHEN game_type = 'REG' THEN 'REG' ELSE 'PLAYOFF' END AS game_type_adj,
           CASE WHEN week = 1 THEN 0 ELSE 1 END AS is_after_week_1
    FROM scenario s JOIN strengths a ON s.away_team = a.team JOIN strengths h ON s.home_team = h.team""",
    ),
    "drawn": (
        ["matchups"],
        """
    SELECT *, pred + 12.5 * (sqrt(ln(u1) * -2.0) * cos(u2 * (2.0 * pi()))) AS outcome_gen
    FROM (SELECT *, ((draw_key >> 30) + 0.5) / 1073741824.0 AS u1, ((draw_key & 1073741823) + 0.5) / 1073741824.0 AS u2,
                 0.25 + pre_game_strength_home * 1.5 + strength_diff * 30.0 + is_after_week_1 * 0.5 AS pred
          FROM (SELECT *, CAST('0x' || substr(md5('7|' || sim || '|' || game_id), 1, 15) AS BIGINT) AS draw_key FROM matchups))""",
    ),
    "filled": (
        ["drawn"],
        f"""
    SELECT sim, {GAME_COLUMNS.replace("result", "CASE WHEN result IS NULL THEN CAST(sign(outcome_gen) * ceil(abs(outcome_gen)) AS INTEGER) ELSE result END AS result")}
    FROM drawn""",
    ),
    "wide": (
        ["filled", "colors"],
        """
    SELECT f.*, away_team || '_' || home_team || '_wk_' || week AS matchup,
           a.preferred_color AS preferred_color_away, a.team_color AS team_color_away,
           h.preferred_color AS preferred_color_home, h.team_color AS team_color_home,
           CASE WHEN result > 0 THEN home_team WHEN result <= 0 THEN away_team END AS winner
    FROM filled f LEFT JOIN colors a ON f.away_team = a.team_abbr LEFT JOIN colors h ON f.home_team = h.team_abbr""",
    ),
    "sides": (
        ["filled"],
        """
    SELECT away_team || '_' || home_team || '_wk_' || week AS matchup, game_id, sim, season, game_type, week, result,
           setting, team, CASE WHEN own > 0 THEN 1.0 WHEN own < 0 THEN 0.0 END::DOUBLE AS win
    FROM (SELECT *, 'away_team' AS setting, away_team AS team, -result AS own FROM filled
          UNION ALL SELECT *, 'home_team', home_team, result FROM filled)""",
    ),
    "totals": (
        ["sides"],
        """
    SELECT season, sim, team, coalesce(sum(win), 0.0) AS wins, count(win) AS decided FROM sides GROUP BY season, sim, team""",
    ),
    "flagged": (
        ["totals", "divisions"],
        """
    SELECT season, sim, conf, division, team, wins, CAST(wins = max(wins) OVER (PARTITION BY season, sim, conf, division) AS INTEGER) AS div1,
           CAST(wins = max(wins) OVER (PARTITION BY season, sim, conf) AS INTEGER) AS seed1,
           CAST(wins = max(wins) OVER (PARTITION BY season, sim) AS INTEGER) AS won_sb, div1 AS playoff, seed1 AS won_conf
    FROM totals JOIN divisions USING (team)""",
    ),
    "overall": (
        ["flagged"],
        """
    SELECT season, conf, division, team, avg(wins) AS wins, avg(playoff) AS playoff, avg(div1) AS div1, avg(seed1) AS seed1,
           avg(won_conf) AS won_conf, avg(won_sb) AS won_sb
    FROM flagged GROUP BY season, conf, division, team""",
    ),
    "matchup_summary": (
        ["filled"],
        """
    SELECT *, CASE WHEN home_share > 0.5 THEN home_team WHEN home_share <= 0.5 THEN away_team END AS winner,
           CASE WHEN home_share > 0.5 THEN home_share ELSE 1.0 - home_share END AS win_prob_num,
           format('{:.1f}', margin) AS exp_result, format('{:.1f}', win_prob_num * 100) || '%' AS win_prob
    FROM (SELECT season, week, away_team, home_team, abs(avg(result)) AS margin,
                 avg(CASE WHEN result > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS home_share
          FROM filled GROUP BY season, week, away_team, home_team)""",
    ),
}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` with the views it reads (and theirs) in front of it."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in VIEWS[name][0]:
            need(n)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({t})" for n, t in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def rd(*columns: str, digits: int = 6) -> str:
    """Rounded columns: ``"x"`` or ``"expression AS name"``."""
    out = []
    for c in columns:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"round(CAST({expr or name} AS DOUBLE), {digits}) + 0.0 AS {name}")
    return ", ".join(out)


def least_squares(source: str, y: str, xs: list[str]) -> dict[str, str]:
    """Views ending in ``ols`` (columns b0, b1, ...): least squares by successive simple
    regressions. Each predictor is cleared of those before it, then slopes are put back."""
    k = len(xs)
    names = range(1, k + 1)
    out = {
        "ls_base": f"SELECT {y} AS y, {', '.join(f'CAST({x} AS DOUBLE) AS x{i}' for i, x in zip(names, xs))} FROM {source}",
        "ls_mean": f"SELECT avg(y) AS my, {', '.join(f'avg(x{i}) AS m{i}' for i in names)} FROM ls_base",
        "ls_0": f"SELECT y, {', '.join(f'x{i} - m{i} AS x{i}' for i in names)} FROM ls_base CROSS JOIN ls_mean",
    }
    for i in names:
        later = range(i + 1, k + 1)
        slopes = [f"regr_slope(y, x{i}) AS c{i}", *[f"regr_slope(x{j}, x{i}) AS r{i}_{j}" for j in later]]
        out[f"ls_t{i}"] = f"SELECT {', '.join(slopes)} FROM ls_{i - 1}"
        cleared = [f"x{j} - r{i}_{j} * x{i} AS x{j}" for j in later]
        out[f"ls_{i}"] = f"SELECT {', '.join(['y', *[f'x{j}' for j in range(1, i + 1)], *cleared])} FROM ls_{i - 1} CROSS JOIN ls_t{i}"
    tables = " CROSS JOIN ".join(f"ls_t{i}" for i in names)
    inner = f"SELECT * FROM {tables} CROSS JOIN ls_mean"
    for i in reversed(names):
        back = "".join(f" - r{i}_{j} * b{j}" for j in range(i + 1, k + 1))
        inner = f"SELECT *, c{i}{back} AS b{i} FROM ({inner})"
    out["ols"] = f"SELECT my{''.join(f' - b{i} * m{i}' for i in names)} AS b0, {', '.join(f'b{i}' for i in names)} FROM ({inner})"
    return out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that the order in which doubles were added does not show."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
