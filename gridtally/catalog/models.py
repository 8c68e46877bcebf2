"""Queries for features, fitting and scoring (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import features as X
from ..operators import fit as M
from ..operators import relate as R
from ..operators.ordered import attach
from ..plans import history as H
from ..plans import ratings as P
from ..plans import strength as T
from ..operators.splits import kfold
from ..sources import fixtures as fx
from ..sources import tables as src
from . import query
from .views import least_squares, rd, rounded, sql


def _games(spark, d):
    """Games with a stand-in prediction; ``flat`` never varies."""
    return fx.games(spark, d).withColumns(
        {"estimate": ((F.col("game_id") * 7) % 41 - 20).cast("double"), "flat": F.lit(3.0)}
    )


@query("m1_interaction_feature", sql("SELECT game_id, week * div_game AS week_x_div_game FROM games", "games"))
def interaction_feature(spark, d):
    return X.interaction_feature(fx.games(spark, d), "week", "div_game").select("game_id", "week_x_div_game")


@query("m3_drop_zero_variance", sql("SELECT game_id, week, estimate FROM predictions", "predictions"))
def drop_zero_variance(spark, d):
    rows = _games(spark, d).select("game_id", "week", "flat", "estimate")
    return X.drop_zero_variance(rows, ["week", "flat", "estimate"])


@query(
    "m4_standardize",
    sql(
        f"SELECT game_id, {rd('(week - mw) / sw AS week', '(estimate - me) / se AS estimate')} FROM predictions CROSS JOIN "
        "(SELECT avg(week) AS mw, stddev_samp(week) AS sw, avg(estimate) AS me, stddev_samp(estimate) AS se FROM predictions WHERE season < 2000)",
        "predictions",
    ),
)
def standardize(spark, d):
    rows = fx.predictions(spark, d)
    stats = X.scaling_stats(rows.where(F.col("season") < 2000), ["week", "estimate"])
    return rounded(X.standardize(rows.select("game_id", "week", "estimate"), stats, ["week", "estimate"]))


_COEFFICIENTS = sql(
    f"SELECT unnest(['(intercept)', 'week', 'div_game', 'estimate']) AS term, {rd('unnest([b0, b1, b2, b3]) AS estimate')} FROM ols",
    "games",
    "predictions",
    **least_squares(
        "games JOIN predictions USING (game_id) WHERE result IS NOT NULL",
        "result",
        ["games.week", "div_game", "predictions.estimate"],
    ),
)


@query("m5_linear_fit", _COEFFICIENTS)
def linear_fit(spark, d):
    model = M.linear_fit(_games(spark, d), "result", ["week", "div_game", "estimate"])
    return rounded(model.to_frame(spark).select("term", "estimate"))


@query("a6_model_write", _COEFFICIENTS)
def model_write(spark, d):
    """A fitted model written, read back, and shown."""
    path = src.shared_folder(spark)
    src.model_write(spark, M.linear_fit(_games(spark, d), "result", ["week", "div_game", "estimate"]), path)
    return rounded(src.model_read(spark, path).to_frame(spark).select("term", "estimate"))


@query(
    "m6_residual_sigma",
    sql(f"SELECT {rd('sqrt(sum((truth - estimate) * (truth - estimate)) / (count(*) - 2)) AS sigma')} FROM predictions WHERE truth IS NOT NULL", "predictions"),
)
def residual_sigma(spark, d):
    return rounded(M.residual_sigma(fx.predictions(spark, d), "truth", "estimate", 1))


@query(
    "m7_linear_predict",
    sql(f"SELECT game_id, {rd('1.5 + 0.25 * estimate - 0.5 * week AS pred')} FROM predictions", "predictions"),
)
def linear_predict(spark, d):
    model = M.LinearModel("truth", ("estimate", "week"), 1.5, (0.25, -0.5), 1.0, 0)
    return rounded(model.predict(fx.predictions(spark, d)).select("game_id", "pred"))


_SMOOTH = X.Smooth("estimate", 0.5, 11.0, (-1.0, 0.0, 1.0))
_OTHER = X.Smooth("week", 10.0, 5.0, (-1.0, 0.25, 1.0))
_Z = "(estimate - 0.5) / 11.0"
_W = "(week - 10.0) / 5.0"


@query(
    "m8_spline_basis",
    sql(
        f"SELECT game_id, {rd('z AS b1', 'z * z AS b2', 'pow(z, 3) AS b3', 'pow(greatest(z + 1, 0), 3) AS b4', 'pow(greatest(z, 0), 3) AS b5', 'pow(greatest(z - 1, 0), 3) AS b6')} FROM (SELECT *, {_Z} AS z FROM predictions)",
        "predictions",
    ),
)
def spline_basis(spark, d):
    basis = X.spline_basis(_SMOOTH)
    rows = fx.predictions(spark, d)
    return rounded(rows.select("game_id", *[b.column.alias(f"b{i}") for i, b in enumerate(basis, start=1)]))


@query(
    "m9_tensor_interaction",
    sql(
        f"SELECT game_id, {rd('z * w AS t1', 'z * k AS t2', 'j * w AS t3', 'j * k AS t4', digits=9)} FROM (SELECT *, {_Z} AS z, {_W} AS w, pow(greatest(z, 0), 3) AS j, pow(greatest(w - 0.25, 0), 3) AS k FROM predictions)",
        "predictions",
    ),
)
def tensor_interaction(spark, d):
    basis = X.tensor_interaction(_SMOOTH, _OTHER)
    rows = fx.predictions(spark, d)
    return rounded(rows.select("game_id", *[b.column.alias(f"t{i}") for i, b in enumerate(basis, start=1)]), 9)


def _preseason(spark, d, games=None):
    games = fx.games(spark, d) if games is None else games
    final = H.season_final_table(games, codes={})
    return P.preseason_inputs(final, fx.ratings(spark, d, games), codes={})


_TEAMS = [f"NATION_{i}" for i in range(25)]
_EFFECTS = ", ".join(
    [f"CAST(home_team = '{t}' AS DOUBLE) AS r{i}" for i, t in enumerate(_TEAMS, start=1)]
    + [rd(f"CASE WHEN home_team = $${t}$$ THEN (week - 10.0) / 5.0 ELSE 0 END AS r{i}") for i, t in enumerate(_TEAMS, start=26)]
)


@query("m10_random_effect_basis", sql(f"SELECT game_id, {_EFFECTS} FROM games", "games"))
def random_effect_basis(spark, d):
    basis = [*X.random_effect("home_team", _TEAMS), *X.random_effect("home_team", _TEAMS, _OTHER)]
    rows = fx.games(spark, d)
    return rounded(rows.select("game_id", *[b.column.alias(f"r{i}") for i, b in enumerate(basis, start=1)]))


# Least squares with a shrunken intercept for each team of each season: the levels are eliminated from
# the penalised normal equations, the 2 x 2 system that is left is solved, and the levels put back.
_LEVEL_VIEWS = {
    "level_sums": """
        SELECT season || '_' || team AS team_season, count(*) AS n, sum(z) AS sz, sum(z * z) AS szz, sum(y) AS sy, sum(z * y) AS szy
        FROM (SELECT season, team, CAST(score AS DOUBLE) AS y, (week - 10.0) / 5.0 AS z FROM long WHERE score IS NOT NULL)
        GROUP BY ALL""",
    "reduced": """
        SELECT sum(n - n * n / (n + 3.0)) AS a, sum(sz - n * sz / (n + 3.0)) AS b, sum(szz - sz * sz / (n + 3.0)) AS c,
               sum(sy - n * sy / (n + 3.0)) AS r, sum(szy - sz * sy / (n + 3.0)) AS s FROM level_sums""",
    "fixed_part": "SELECT (r * c - b * s) / (a * c - b * b) AS b0, (a * s - b * r) / (a * c - b * b) AS b1 FROM reduced",
}


@query(
    "m10_random_effect_levels",
    sql(
        f"""SELECT term, {rd('estimate')} FROM (
              SELECT unnest(['(intercept)', 'week']) AS term, unnest([b0, b1]) AS estimate FROM fixed_part
              UNION ALL SELECT team_season, (sy - n * b0 - sz * b1) / (n + 3.0) FROM level_sums CROSS JOIN fixed_part)""",
        "long",
        **_LEVEL_VIEWS,
    ),
)
def random_effect_levels(spark, d):
    """An intercept for each team of each season, without a column for each."""
    long = H.team_games(fx.games(spark, d), codes={}).withColumn("team_season", F.concat_ws("_", "season", "team"))
    line = X.Basis("week", (X.Part("week", 10.0, 5.0),), "s(week)")
    model = M.level_effect_fit(long, "score", [line], "team_season", 3.0, logit=False)
    fixed = spark.createDataFrame([("(intercept)", float(model.beta[0])), ("week", float(model.beta[1]))], "term string, estimate double")
    return rounded(fixed.unionByName(model.effects.select(F.col("team_season").alias("term"), F.col("effect").alias("estimate"))))


# A two-column logit fit (intercept and scaled rating) by reweighted least squares, unrolled:
# each step solves a 2 x 2 system from sums over the rows. Penalty on the slope only.
_STEPS = 8


def _solved(gram: str, penalty: str) -> str:
    """Coefficients and inverse Gram matrix from the sums s0, s1, s2 (weights) and t0, t1."""
    return f"""
    SELECT (t0 * k - s1 * t1) / det AS b0, (s0 * t1 - s1 * t0) / det AS b1, k / det AS v00, -s1 / det AS v01, s0 / det AS v11,
           s0, s1, s2, extra FROM (SELECT *, s2 + {penalty} AS k, s0 * k - s1 * s1 AS det FROM ({gram}))"""


def _sums(source: str) -> str:
    return f"""
    SELECT sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2, sum(w * eta + y - mu) AS t0, sum(w * z * eta + z * (y - mu)) AS t1,
           struct_pack(n := count(*), pearson := sum((y - mu) * (y - mu) / w)) AS extra
    FROM (SELECT *, mu * (1 - mu) AS w FROM ({source}))"""


def _logit_steps(penalty: str) -> dict[str, str]:
    start = "SELECT y, z, (y + 0.5) / 2 AS mu, ln(((y + 0.5) / 2) / (1 - (y + 0.5) / 2)) AS eta FROM data"
    out = {
        "data": "SELECT season, team, final_wp AS y, (elo - 1500.0) / 100.0 AS z FROM inputs",
        "step0": _solved(_sums(start), penalty),
    }
    for i in range(1, _STEPS + 1):
        at = f"SELECT y, z, b0 + b1 * z AS eta, 1 / (1 + exp(-(b0 + b1 * z))) AS mu FROM data CROSS JOIN step{i - 1}"
        out[f"step{i}"] = _solved(_sums(at), penalty)
    return out


_INPUTS = """
SELECT f.season, f.team, p.final_wp AS prev_season_wp, r.elo, f.final_wp
FROM final f JOIN final p ON f.team = p.team AND f.season = p.season + 1
JOIN rated r ON f.season = r.season AND f.team = r.team
WHERE r."date" = (SELECT min("date") FROM rated x WHERE x.season = r.season AND x.team = r.team)"""

_LINE = X.Basis("elo", (X.Part("elo", 1500.0, 100.0),), "s(elo)")
_LAST = f"step{_STEPS}"


def _line_fit(spark, d, quasi: bool):
    inputs = _preseason(spark, d)
    return inputs, M.smooth_fit(inputs, "final_wp", [_LINE], 2.0, quasi=quasi)


@query(
    "m11_binomial_fit_line",
    sql(
        f"SELECT unnest(['(intercept)', 'elo']) AS term, {rd('unnest([b0, b1]) AS estimate', 'unnest([sqrt(v00), sqrt(v11)]) AS std_error')} FROM {_LAST}",
        "final",
        "rated",
        inputs=_INPUTS,
        **_logit_steps("2.0"),
    ),
)
def binomial_fit_line(spark, d):
    _, model = _line_fit(spark, d, quasi=False)
    rows = model.to_frame(spark)
    return rounded(rows.select("term", "estimate", F.sqrt(F.expr("covariance[pos]")).alias("std_error")))


_DISPERSION = "extra.pearson / (extra.n - (v00 * s0 + 2 * v01 * s1 + v11 * s2))"


@query(
    "m12_quasibinomial_fit_line",
    sql(
        f"SELECT unnest(['(intercept)', 'elo']) AS term, {rd('unnest([b0, b1]) AS estimate', f'unnest([sqrt(v00 * phi), sqrt(v11 * phi)]) AS std_error', 'phi AS dispersion')} FROM (SELECT *, {_DISPERSION} AS phi FROM {_LAST})",
        "final",
        "rated",
        inputs=_INPUTS,
        **_logit_steps("2.0"),
    ),
)
def quasibinomial_fit_line(spark, d):
    _, model = _line_fit(spark, d, quasi=True)
    rows = model.to_frame(spark)
    return rounded(
        rows.select("term", "estimate", F.sqrt(F.expr("covariance[pos]")).alias("std_error"), "dispersion")
    )


_Q = "1.959963984540054"


@query(
    "m13_predict_with_se_line",
    sql(
        f"""SELECT season, team, elo, {rd('mu AS pred', 'mu * (1 - mu) * se AS std_error', f'1 / (1 + exp(-(eta - {_Q} * se))) AS pred_lower', f'1 / (1 + exp(-(eta + {_Q} * se))) AS pred_upper')}
            FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (
              SELECT season, team, z * 100 + 1500 AS elo, b0 + b1 * z AS eta, sqrt(v00 + 2 * v01 * z + v11 * z * z) AS se
              FROM data CROSS JOIN {_LAST}))""",
        "final",
        "rated",
        inputs=_INPUTS,
        **_logit_steps("2.0"),
    ),
)
def predict_with_se_line(spark, d):
    inputs, model = _line_fit(spark, d, quasi=False)
    rows = model.predict_with_se(inputs)
    return rounded(rows.select("season", "team", "elo", "pred", "std_error", "pred_lower", "pred_upper"))


_GRID = [0.1, 1.0, 10.0, 100.0]


def _grid_text() -> str:
    """Cross-validated rmse: fold sums at the fit of all folds, one solve per fold and candidate."""
    bucket = "CAST('0x' || substr(md5('11|' || season || '|' || team), 9, 8) AS BIGINT) % 10 + 1"
    steps = _logit_steps("1.0")
    views = {
        **steps,
        "at_fit": f"SELECT {bucket} AS fold, y, z, b0 + b1 * z AS eta, 1 / (1 + exp(-(b0 + b1 * z))) AS mu FROM data CROSS JOIN {_LAST}",
        "weighted": "SELECT *, mu * (1 - mu) AS w FROM at_fit",
        "fold_sums": """SELECT fold, sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2, sum(w * eta + y - mu) AS t0,
                               sum(w * z * eta + z * (y - mu)) AS t1 FROM weighted GROUP BY fold""",
        "rest": """SELECT f.fold, sum(o.s0) AS s0, sum(o.s1) AS s1, sum(o.s2) AS s2, sum(o.t0) AS t0, sum(o.t1) AS t1
                   FROM fold_sums f JOIN fold_sums o ON o.fold <> f.fold GROUP BY f.fold""",
        "grid": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {g}::DOUBLE)" for i, g in enumerate(_GRID, start=1)) + ") g(candidate, smoothing)",
        "betas": """SELECT fold, candidate, smoothing, (t0 * k - s1 * t1) / det AS b0, (s0 * t1 - s1 * t0) / det AS b1
                    FROM (SELECT *, s2 + smoothing AS k, s0 * k - s1 * s1 AS det FROM rest CROSS JOIN grid)""",
        "by_fold": """SELECT candidate, smoothing, fold, sqrt(avg(pow(y - 1 / (1 + exp(-(b0 + b1 * z))), 2))) AS rmse
                      FROM at_fit JOIN betas USING (fold) GROUP BY ALL""",
    }
    return sql(
        f"SELECT candidate, smoothing, {rd('avg(rmse) AS rmse')}, CAST(count(*) AS INTEGER) AS folds, {rd('stddev_samp(rmse) / sqrt(count(*)) AS std_err')} FROM by_fold GROUP BY candidate, smoothing",
        "final",
        "rated",
        inputs=_INPUTS,
        **views,
    )


@query("m14_grid_search_line", _grid_text())
def grid_search_line(spark, d):
    with M.held(kfold(_preseason(spark, d), ["season", "team"], 11)) as inputs:
        return rounded(M.grid_search(inputs, "final_wp", [_LINE], grid=_GRID))


@query("m10_random_effect")
def random_effect(spark, d):
    """Shrunken team intercepts and slopes over seasons of the share of wins."""
    with M.held(_preseason(spark, d)) as inputs:
        season = X.find_smooths(inputs, ["season"])["season"]
        teams = X.find_levels(inputs, "team")
        basis = [*X.random_effect("team", teams), *X.random_effect("team", teams, season)]
        model = M.binomial_smooth_fit(inputs, "final_wp", basis, {"re(team)": 4.0, "re(team,season)": 8.0})
    return model.to_frame(spark).select("term", F.round("estimate", 6).alias("estimate"))


@query("m11_binomial_smooth_fit")
def binomial_smooth_fit(spark, d):
    model = T.preseason_model(_preseason(spark, d))
    return model.to_frame(spark).select("term", "block", F.round("estimate", 6).alias("estimate"))


def _strength_inputs(spark, d):
    """Regular-season history with last season's share of wins as initial rating.

    A team of the stand-in games plays hundreds in a season; ``game_num`` is put on a scale of 1 to
    17, so that it is the factor that it is with one game a week."""
    games = fx.games(spark, d)
    history = H.team_game_history(games, codes={})
    final = H.season_final_table(games, codes={})
    rows = history.where(F.col("game_type") == "REG")
    rows = A.group_stat_attach(rows, ["season", "team"], season_games=F.max("game_num"))
    rows = rows.withColumn("game_num", F.ceil(F.col("game_num") * 17 / F.col("season_games")).cast("int"))
    return R.prior_period_join(rows, final, ["team"], "final_wp", "initial_rating")


def _of_seventeen(rows, games):
    """``game_num`` on a scale of 1 to 17 over all the games of the team's season."""
    lengths = H.team_games(games, codes={}).groupBy("season", "team").agg(F.count(F.lit(1)).alias("season_games"))
    rows = attach(rows, lengths, ["season", "team"])
    return rows.withColumn("game_num", F.ceil(F.col("game_num") * 17 / F.col("season_games")).cast("int")).drop("season_games")


@query("m12_quasibinomial_smooth_fit")
def quasibinomial_smooth_fit(spark, d):
    model = T.strength_model(_strength_inputs(spark, d))
    return model.to_frame(spark).select("term", "block", F.round("estimate", 6).alias("estimate"), F.round("dispersion", 6).alias("dispersion"))


@query("m13_predict_with_se")
def predict_with_se(spark, d):
    with M.held(_preseason(spark, d)) as inputs:
        smooths = X.find_smooths(inputs, ["elo", "prev_season_wp"], 3)
        basis = [*X.spline_basis(smooths["elo"]), *X.spline_basis(smooths["prev_season_wp"])]
        model = M.binomial_smooth_fit(inputs, "final_wp", basis, 1.0)
    return rounded(model.predict_with_se(inputs))


@query("m14_grid_search")
def grid_search(spark, d):
    with M.held(kfold(_preseason(spark, d), ["season", "team"], 11)) as inputs:
        return rounded(M.grid_search(inputs, "final_wp", T.preseason_basis(inputs), select=0.1))
