"""Queries for season scenarios (N, F5, G6-G9): every game of every season, 20 scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_normal
from ..operators import aggregate as A
from ..operators import relate as R
from ..operators import scenario as N
from ..operators.fit import LinearModel
from ..operators.ordered import attach
from ..sources import fixtures as fx
from . import query
from .views import rd, rounded, sql

SIMS = 20
SEED = 7
SIGMA = 12.5
MARGIN = LinearModel(
    "result", ("pre_game_strength_home", "strength_diff", "is_after_week_1"), 0.25, (1.5, 30.0, 0.5), SIGMA, 0
)
FLAGS = ("playoff", "div1", "seed1", "won_conf", "won_sb")


def scenario(spark, d):
    return N.scenario_expand(fx.games(spark, d), SIMS)


def matchups(spark, d):
    rows = N.attach_strengths(scenario(spark, d), fx.strengths(spark, d))
    return N.matchup_features(N.mean_game_strengths(rows))


def drawn(spark, d):
    return N.draw_margins(MARGIN.predict(matchups(spark, d)), SIGMA, SEED)


def filled(spark, d):
    columns = ["sim", *fx.games(spark, d).columns]
    return N.fill_results(drawn(spark, d)).select(*columns)


def wide(spark, d):
    return N.scenario_games_wide(filled(spark, d), fx.colors(spark, d))


def totals(spark, d):
    return A.scenario_team_totals(N.scenario_games_long(filled(spark, d)))


def flagged(spark, d):
    """Team totals with stand-in flags: first in division, conference and league, ties shared."""
    rows = R.inner_join_on(totals(spark, d), fx.divisions(spark, d), ["team"])
    for flag, within in (("div1", ["conf", "division"]), ("seed1", ["conf"]), ("won_sb", [])):
        keys = ["season", "sim", *within]
        rows = attach(rows, rows.groupBy(*keys).agg(F.max("wins").alias("__top")), keys)
        rows = rows.withColumn(flag, (F.col("wins") == F.col("__top")).cast("int")).drop("__top")
    return rows.withColumns({"playoff": F.col("div1"), "won_conf": F.col("seed1")})


@query("n1_scenario_expand", sql("SELECT sim, game_id, week FROM scenario", "scenario"))
def scenario_expand(spark, d):
    return scenario(spark, d).select("sim", "game_id", "week")


def _scenario_teams(spark, d):
    """(sim, week, team, alpha, beta): every team of every week, per scenario."""
    games = fx.games(spark, d)
    teams = games.select("week", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    rows = teams.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(SIMS))))
    return R.inner_join_on(rows, fx.strengths(spark, d), ["team"])


_WORD = 1 << 64


def _spread_bits(x: int) -> int:
    """The generator's step on a whole number."""
    x = (x + 0x9E3779B97F4A7C15) % _WORD
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % _WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB % _WORD
    return x ^ x >> 31


def beta_draw_views(source: str, turns: int = 16) -> dict[str, str]:
    """Views ending in ``beta_drawn`` (draw_key, alpha, beta, draw): the Beta draws for a source of
    those three columns with parameters of 1 and more. The turns of the rejection are unrolled; that
    none of so many is accepted has a chance below 1e-20."""
    wide = lambda x: f"CAST('{x}' AS UHUGEINT)"
    low = lambda x: f"CAST(({x}) % {wide(_WORD)} AS UBIGINT)"
    streams = ", ".join(
        f"({lane}, {turn}, {word}, CAST('{_spread_bits(lane + 8 * turn + word)}' AS UBIGINT))"
        for lane in (0, 4)
        for turn in range(turns)
        for word in range(3)
    )
    return {
        "beta_parameters": f"SELECT DISTINCT draw_key, alpha, beta FROM {source}",
        "beta_bits_0": f"""
            SELECT draw_key, alpha, beta, lane, turn, word, {low(f"CAST(xor(CAST(draw_key AS UBIGINT), stream) AS UHUGEINT) + {wide(0x9E3779B97F4A7C15)}")} AS x
            FROM beta_parameters CROSS JOIN (VALUES {streams}) s(lane, turn, word, stream)""",
        "beta_bits_1": f"SELECT * REPLACE ({low(f'CAST(xor(x, x >> 30) AS UHUGEINT) * {wide(0xBF58476D1CE4E5B9)}')} AS x) FROM beta_bits_0",
        "beta_bits_2": f"SELECT * REPLACE ({low(f'CAST(xor(x, x >> 27) AS UHUGEINT) * {wide(0x94D049BB133111EB)}')} AS x) FROM beta_bits_1",
        "beta_uniform": """
            SELECT draw_key, alpha, beta, lane, turn, max(u) FILTER (word = 0) AS u0, max(u) FILTER (word = 1) AS u1, max(u) FILTER (word = 2) AS u2
            FROM (SELECT *, (CAST(xor(x, x >> 31) >> 11 AS DOUBLE) + 0.5) / 9007199254740992.0 AS u FROM beta_bits_2)
            GROUP BY draw_key, alpha, beta, lane, turn""",
        "beta_tried": """
            SELECT *, pow(1.0 + x / sqrt(9.0 * d), 3) AS v
            FROM (SELECT *, CASE WHEN lane = 0 THEN alpha ELSE beta END - 1.0 / 3.0 AS d, sqrt(-2.0 * ln(u0)) * cos(2.0 * pi() * u1) AS x FROM beta_uniform)""",
        "beta_gamma": """
            SELECT draw_key, alpha, beta, lane, arg_min(d * v, turn) FILTER (CASE WHEN v > 0 THEN ln(u2) < 0.5 * x * x + d * (1.0 - v + ln(v)) END) AS g
            FROM beta_tried GROUP BY draw_key, alpha, beta, lane""",
        "beta_drawn": """
            SELECT a.draw_key, a.alpha, a.beta, a.g / (a.g + b.g) AS draw
            FROM beta_gamma a JOIN beta_gamma b ON a.draw_key = b.draw_key AND a.alpha = b.alpha AND a.beta = b.beta AND a.lane = 0 AND b.lane = 4""",
    }


_TEAM_KEYS = """
SELECT *, CAST('0x' || substr(md5('7|' || sim || '|' || week || '|' || team), 1, 15) AS BIGINT) AS draw_key
FROM (SELECT DISTINCT sim, week, team, alpha, beta FROM scenario JOIN strengths ON team IN (home_team, away_team))"""


@query(
    "n2_draw_beta",
    sql(
        f"SELECT sim::INTEGER AS sim, week, team, {rd('draw AS pre_game_strength')} FROM team_keys JOIN beta_drawn USING (draw_key, alpha, beta)",
        "scenario",
        "strengths",
        team_keys=_TEAM_KEYS,
        **beta_draw_views("team_keys"),
    ),
)
def draw_beta(spark, d):
    rows = N.draw_strengths(_scenario_teams(spark, d), SEED)
    return rows.select("sim", "week", "team", F.round("pre_game_strength", 6).alias("pre_game_strength"))


@query(
    "n2_draw_beta_moments",
    sql(
        "SELECT team, 20 * count(DISTINCT week) AS n, 1 AS inside, 1 AS mean_fits, 1 AS sd_fits FROM long JOIN strengths USING (team) GROUP BY team",
        "long",
        "strengths",
    ),
)
def draw_beta_moments(spark, d):
    """Sample mean and deviation of the draws of each team against those of its distribution,
    within five standard errors (and a quarter of the deviation)."""
    rows = N.draw_strengths(_scenario_teams(spark, d), SEED)
    x, a, b = F.col("pre_game_strength"), F.col("alpha"), F.col("beta")
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    stats = rows.groupBy("team", mean.alias("m"), sd.alias("s")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(((x > 0) & (x < 1)).cast("int")).alias("inside"),
        F.avg(x).alias("xm"),
        F.stddev_samp(x).alias("xs"),
    )
    return stats.select(
        "team",
        "n",
        "inside",
        (F.abs(F.col("xm") - F.col("m")) < 5 * F.col("s") / F.sqrt("n")).cast("int").alias("mean_fits"),
        (F.abs(F.col("xs") - F.col("s")) < F.col("s") / 4).cast("int").alias("sd_fits"),
    )


@query("n3_draw_normal", sql(f"SELECT sim, game_id, {rd('outcome_gen')} FROM drawn", "drawn"))
def draw_normal_(spark, d):
    return rounded(drawn(spark, d).select("sim", "game_id", "outcome_gen"))


@query(
    "n4_matchup_features",
    sql(f"SELECT sim, game_id, game_type_adj, is_after_week_1, {rd('pre_game_strength_away', 'pre_game_strength_home', 'strength_diff')} FROM matchups", "matchups"),
)
def matchup_features(spark, d):
    return rounded(
        matchups(spark, d).select(
            "sim", "game_id", "game_type_adj", "is_after_week_1",
            "pre_game_strength_away", "pre_game_strength_home", "strength_diff",
        )
    )


@query("n5_fill_results", sql("SELECT sim, game_id, week, result FROM filled", "filled"))
def fill_results(spark, d):
    return filled(spark, d).select("sim", "game_id", "week", "result")


@query(
    "n5_fill_results_week",
    sql(
        "SELECT sim, game_id, week, CASE WHEN result IS NULL AND week = 12 THEN CAST(sign(outcome_gen) * ceil(abs(outcome_gen)) AS INTEGER) ELSE result END AS result FROM drawn",
        "drawn",
    ),
)
def fill_results_week(spark, d):
    return N.fill_results(drawn(spark, d), 12).select("sim", "game_id", "week", "result")


def _side_key(side: str) -> str:
    return f"CAST('0x' || substr(md5('7|' || season || '|' || sim || '|' || week || '|' || {side}_team), 1, 15) AS BIGINT)"


_KEYED = f"""
SELECT s.*, a.alpha AS alpha_away, a.beta AS beta_away, h.alpha AS alpha_home, h.beta AS beta_home,
       {_side_key('away')} AS key_away, {_side_key('home')} AS key_home,
       CAST('0x' || substr(md5('7|' || sim || '|' || game_id), 1, 15) AS BIGINT) AS draw_key
FROM scenario s JOIN strengths a ON s.away_team = a.team JOIN strengths h ON s.home_team = h.team"""
_SIDE_KEYS = """
SELECT key_away AS draw_key, alpha_away AS alpha, beta_away AS beta FROM keyed WHERE result IS NULL
UNION SELECT key_home, alpha_home, beta_home FROM keyed WHERE result IS NULL"""
_SIMULATED = """
SELECT sim, game_id, week, CASE WHEN result IS NULL THEN CAST(sign(margin) * ceil(abs(margin)) AS INTEGER) ELSE result END AS result
FROM (SELECT k.*, 0.25 + h.draw * 1.5 + (h.draw - a.draw) * 30.0 + CASE WHEN week = 1 THEN 0.0 ELSE 0.5 END
             + 12.5 * (sqrt(ln(((k.draw_key >> 30) + 0.5) / 1073741824.0) * -2.0)
                       * cos(((k.draw_key & 1073741823) + 0.5) / 1073741824.0 * (2.0 * pi()))) AS margin
      FROM keyed k
      LEFT JOIN beta_drawn a ON k.key_away = a.draw_key AND alpha_away = a.alpha AND beta_away = a.beta
      LEFT JOIN beta_drawn h ON k.key_home = h.draw_key AND alpha_home = h.alpha AND beta_home = h.beta)"""


@query(
    "n5_simulate_results",
    sql(_SIMULATED, "scenario", "strengths", keyed=_KEYED, side_keys=_SIDE_KEYS, **beta_draw_views("side_keys")),
)
def simulate_results(spark, d):
    """The whole step with drawn strengths."""
    rows = N.simulate_results(scenario(spark, d), fx.strengths(spark, d), MARGIN, SIGMA, SEED)
    return rows.select("sim", "game_id", "week", "result")


_COLOR_COLUMNS = "preferred_color_away, team_color_away, preferred_color_home, team_color_home"


@query("n6_scenario_games_wide", sql(f"SELECT sim, game_id, matchup, {_COLOR_COLUMNS}, winner FROM wide", "wide"))
def scenario_games_wide(spark, d):
    return wide(spark, d).select("sim", "game_id", "matchup", *_COLOR_COLUMNS.split(", "), "winner")


@query(
    "n7_scenario_games_long",
    sql("SELECT sim, game_id, matchup, setting, team, win, preferred_color FROM sides LEFT JOIN colors ON team = team_abbr", "sides", "colors"),
)
def scenario_games_long(spark, d):
    rows = N.scenario_games_long(filled(spark, d), fx.colors(spark, d), drop=["team_color"])
    return rows.select("sim", "game_id", "matchup", "setting", "team", "win", "preferred_color")


_RATINGS = """
SELECT t.sim, team, (CAST('0x' || substr(md5('3|' || t.sim || '|' || team), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS strength
FROM range(1, 21) t(sim) CROSS JOIN strengths"""


@query(
    "f5_scenario_inner_join",
    sql(
        f"SELECT s.sim, s.game_id, {rd('a.strength AS pre_game_strength_away', 'h.strength AS pre_game_strength_home')} FROM scenario s "
        "JOIN rating a ON s.sim = a.sim AND s.away_team = a.team JOIN rating h ON s.sim = h.sim AND s.home_team = h.team",
        "scenario",
        "strengths",
        rating=_RATINGS,
    ),
)
def scenario_inner_join(spark, d):
    from ..functions.draws import uniform_draw

    ratings = (
        fx.strengths(spark, d)
        .withColumn("sim", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(SIMS).cast("long"))))
        .select("sim", "team", uniform_draw("sim", "team", seed=3).alias("pre_game_strength"))
    )
    rows = R.scenario_inner_join(scenario(spark, d), ratings)
    return rounded(rows.select("sim", "game_id", "pre_game_strength_away", "pre_game_strength_home"))


@query(
    "g6_histogram_unit",
    sql(f"SELECT home_team, CAST(floor(result + 0.5) AS INTEGER) AS bin, {rd('count(*) / 20.0::DOUBLE AS height')} FROM filled GROUP BY ALL", "filled"),
)
def histogram_unit(spark, d):
    return rounded(A.histogram_unit(filled(spark, d), ["home_team"], n_sims=SIMS))


@query(
    "g7_scenario_cdf",
    sql(
        f"""SELECT g.season, g.team, CAST(g.place * 0.5 AS DOUBLE) AS wins, {rd('count(t.wins) FILTER (t.wins < g.place * 0.5) / count(*)::DOUBLE AS under_prob', 'count(t.wins) FILTER (t.wins > g.place * 0.5) / count(*)::DOUBLE AS over_prob')}
            FROM (SELECT season, team, unnest(range(0, 2 * top + 1)) AS place
                  FROM (SELECT DISTINCT season, team FROM totals)
                  JOIN (SELECT season, max(n) AS top FROM (SELECT season, team, count(*) AS n FROM long GROUP BY season, team) GROUP BY season) USING (season)) g
            JOIN totals t ON g.season = t.season AND g.team = t.team GROUP BY g.season, g.team, g.place""",
        "totals",
        "long",
    ),
)
def scenario_cdf(spark, d):
    return rounded(A.scenario_cdf(totals(spark, d), A.most_games(fx.games(spark, d))))


@query("g8_scenario_overall", sql(f"SELECT season, conf, division, team, {rd('wins', *FLAGS)} FROM overall", "overall"))
def scenario_overall(spark, d):
    return rounded(A.scenario_overall(flagged(spark, d)))


@query("g9_scenario_team_totals", sql("SELECT season, sim, team, wins, decided FROM totals", "totals"))
def scenario_team_totals(spark, d):
    return totals(spark, d)


@query(
    "n3_draw_normal_moments",
    sql(f"SELECT count(*) AS n, {rd('avg(z) AS mean', 'stddev_samp(z) AS sd')} FROM (SELECT (outcome_gen - pred) / 12.5 AS z FROM drawn)", "drawn"),
)
def draw_normal_moments(spark, d):
    z = draw_normal(F.lit(0.0), 1.0, "sim", "game_id", seed=SEED)
    return rounded(
        scenario(spark, d).select(z.alias("z")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd")
        )
    )
