"""Queries that train both strength models, evaluate them on held-out rows, and score games by them.

The queries with SQL beside them run the same plans with two columns to a model, so that SQL can
solve the fits; ``o12_model_rmse_by_week`` and ``o8_model_margin`` have all terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import fit as M
from ..operators import relate as R
from ..operators import scenario as N
from ..operators.splits import group_split, kfold, stratified_split
from ..plans import history as H
from ..plans import margin as G
from ..plans import strength as T
from ..plans import training as E
from ..sources import fixtures as fx
from ..sources import tables as src
from ..sources.shared import settle
from . import query, scenarios
from .answers import _COMPARED, _PART_METRICS, _PARTED, _PREDICTED, _PREGAME, _TERMS
from .models import _INPUTS, _LAST, _LINE, _logit_steps, _of_seventeen, _preseason
from .views import least_squares, rd, rounded, sql

_KEPT = {"first_season": 1994, "new_team": "NATION_3", "new_team_last_season": 1995}


def _column(name: str, center: float, scale: float) -> X.Basis:
    return X.Basis(name, (X.Part(name, center, scale),), f"s({name})")


_PRE_BASIS = [_column("elo", 1500.0, 100.0), _column("prev_season_wp", 0.5, 0.1)]
_NOW_BASIS = [_column("cumulative_point_mean", 22.0, 5.0), _column("initial_rating", 0.5, 0.1)]
_PRE_XS = ["(elo - 1500.0) / 100.0", "(prev_season_wp - 0.5) / 0.1"]
_NOW_XS = ["(cumulative_point_mean - 22.0) / 5.0", "(initial_rating - 0.5) / 0.1"]
_PENALTY = 2.0


# ------------------------------------------------------------------------- SQL


def _solved(sums: str, p: int) -> str:
    """b0, b1, ... from the upper triangle a0_0, a0_1, ... and the right side r0, r1, ...: elimination
    of one column after the other, then the values from the last to the first. Other columns stay."""
    text = sums
    for k in range(p - 1):
        less = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, p) for j in range(i, p)]
        less += [f"r{i} - a{k}_{i} * r{k} / a{k}_{k} AS r{i}" for i in range(k + 1, p)]
        text = f"SELECT * REPLACE ({', '.join(less)}) FROM ({text})"
    for i in reversed(range(p)):
        back = "".join(f" - a{i}_{j} * b{j}" for j in range(i + 1, p))
        text = f"SELECT *, (r{i}{back}) / a{i}_{i} AS b{i} FROM ({text})"
    return text


def _eta(xs: Sequence[str], b: str = "b") -> str:
    return " + ".join([f"{b}0", *[f"{b}{i} * ({x})" for i, x in enumerate(xs, start=1)]])


def _share(xs: Sequence[str]) -> str:
    return f"1 / (1 + exp(-({_eta(xs)})))"


def _weighted_sums(p: int) -> str:
    """Sums of a reweighted step, without the penalty."""
    xs = ["1.0", *[f"x{i}" for i in range(1, p)]]
    grams = [f"sum(w * {xs[i]} * {xs[j]}) AS a{i}_{j}" for i in range(p) for j in range(i, p)]
    return ", ".join(grams + [f"sum({x} * (w * eta + y - mu)) AS r{i}" for i, x in enumerate(xs)])


def _penalised(sums: str, p: int) -> str:
    return f"SELECT * REPLACE ({', '.join(f'a{i}_{i} + {_PENALTY} AS a{i}_{i}' for i in range(1, p))}) FROM ({sums})"


def logit_fit(name: str, source: str, y: str, xs: Sequence[str], steps: int = 8) -> dict[str, str]:
    """Views ending in ``<name>_fit`` (b0, b1, ...): a penalised logit fit of a share by reweighted least
    squares, its steps unrolled. ``<name>_rows`` holds the complete rows as y, x1, x2, ..."""
    p = len(xs) + 1
    names = [f"x{i}" for i in range(1, p)]
    out = {
        f"{name}_rows": f"""SELECT * FROM (SELECT CAST({y} AS DOUBLE) AS y, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for x, n in zip(xs, names))} FROM {source})
                            WHERE {' AND '.join(f'{n} IS NOT NULL' for n in ['y', *names])}"""
    }
    at = f"SELECT *, (y + 0.5) / 2 AS mu, ln(((y + 0.5) / 2) / (1 - (y + 0.5) / 2)) AS eta FROM {name}_rows"
    for i in range(steps + 1):
        sums = f"SELECT {_weighted_sums(p)} FROM (SELECT *, mu * (1 - mu) AS w FROM ({at}))"
        last = f"{name}_fit" if i == steps else f"{name}_step{i}"
        out[last] = f"SELECT {', '.join(f'b{j}' for j in range(p))} FROM ({_solved(_penalised(sums, p), p)})"
        at = f"SELECT *, {_share(names)} AS mu, {_eta(names)} AS eta FROM {name}_rows CROSS JOIN {last}"
    return out


def _word(key: str, word: int = 0) -> str:
    return f"CAST('0x' || substr(md5({key}), {1 + 8 * word}, 8) AS BIGINT)"


# One rating a team-season: the larger where two games tie for the first.
_ONE = f"""
SELECT season, team, max(prev_season_wp) AS prev_season_wp, max(elo) AS elo, max(final_wp) AS final_wp
FROM ({_INPUTS}) GROUP BY season, team"""
_PRE_PARTS = f"""
SELECT * EXCLUDE (h, stratum),
       CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY h, season, team) <= floor(0.75 * count(*) OVER (PARTITION BY stratum))
            THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, {_word("'11|' || season || '|' || team")} AS h,
             1 + CAST(season > q[1] AS INTEGER) + CAST(season > q[2] AS INTEGER) + CAST(season > q[3] AS INTEGER) AS stratum
      FROM one_rating CROSS JOIN (SELECT quantile_cont(season, [0.25, 0.5, 0.75]) AS q FROM one_rating))"""
_PRE = {
    "one_rating": _ONE,
    "pre_parts": _PRE_PARTS,
    **logit_fit("pre", "pre_parts WHERE split = 'train'", "final_wp", _PRE_XS),
    "pre_scored": f"SELECT pre_parts.*, {_share(_PRE_XS)} AS expected_wp FROM pre_parts CROSS JOIN pre_fit",
}
_NOW = {
    **_PRE,
    "rated_rows": "SELECT h.*, s.expected_wp AS initial_rating FROM history h LEFT JOIN pre_scored s USING (season, team)",
    "now_parts": f"""
        SELECT *, CASE WHEN {_word("'12|' || id")} % 100 < 75 THEN 'train' ELSE 'test' END AS split FROM rated_rows
        WHERE game_type = 'REG' AND season >= {_KEPT['first_season']}
          AND NOT (season <= {_KEPT['new_team_last_season']} AND team = '{_KEPT['new_team']}')""",
    **logit_fit("now", "now_parts WHERE split = 'train'", "final_wp", _NOW_XS),
    "now_scored": f"SELECT now_parts.*, {_share(_NOW_XS)} AS expected_wp FROM now_parts CROSS JOIN now_fit",
}


def _metrics(source: str, truth: str, estimate: str, key: str) -> str:
    return f"""
    SELECT {key}, unnest(['rmse', 'rsq', 'mae']) AS metric,
           unnest([sqrt(avg(pow({truth} - {estimate}, 2))), pow(corr({truth}, {estimate}), 2), avg(abs({truth} - {estimate}))]) AS estimate
    FROM {source} GROUP BY {key}"""


# ----------------------------------------------------------------------- plans


def _one_rating(spark, d, games=None):
    return _preseason(spark, d, games).groupBy("season", "team").agg(
        *[F.max(c).alias(c) for c in ("prev_season_wp", "elo", "final_wp")]
    )


def _first(spark, d):
    """The pre-season model of two columns on the training side, evaluated."""
    rows = settle(stratified_split(settle(_one_rating(spark, d)), ["season", "team"], "season", 11))
    model = M.binomial_smooth_fit(rows.where(F.col("split") == "train"), "final_wp", _PRE_BASIS, _PENALTY)
    return E.evaluate_preseason(model, rows, fx.season_length(spark, d))


def _history(spark, d):
    return settle(H.team_game_history(fx.games(spark, d), codes={}))


def _second(spark, d, first, history):
    """The in-season model of two columns on the training side, evaluated."""
    rated = T.strength_inputs(history, first.rows, first.model)
    rows = settle(group_split(T.strength_training_rows(rated, **_KEPT), "id", 12))
    model = M.quasibinomial_smooth_fit(rows.where(F.col("split") == "train"), "final_wp", _NOW_BASIS, _PENALTY)
    return E.evaluate_strength(model, rows, fx.season_length(spark, d))


@query(
    "k1_preseason_evaluation",
    sql(f"SELECT split, metric, {rd('estimate')} FROM ({_metrics('pre_scored', 'final_wp', 'expected_wp', 'split')})", "final", "rated", **_PRE),
)
def preseason_evaluation(spark, d):
    return rounded(_first(spark, d).metrics)


@query(
    "d15_expected_season_wins",
    sql(
        f"SELECT season, team, split, {rd('final_wp * games AS tot_wins', 'expected_wp * games AS exp_wins')} FROM pre_scored JOIN season_length USING (season)",
        "final",
        "rated",
        "season_length",
        **_PRE,
    ),
)
def expected_season_wins(spark, d):
    return rounded(_first(spark, d).rows.select("season", "team", "split", "tot_wins", "exp_wins"))


@query(
    "k1_strength_evaluation",
    sql(
        f"""SELECT split, metric, {rd('estimate')} FROM ({_metrics('(SELECT *, expected_wp * games AS exp_wins FROM now_scored JOIN season_length USING (season))', 'reg_wins', 'exp_wins', 'split')})""",
        "final",
        "rated",
        "history",
        "season_length",
        **_NOW,
    ),
)
def strength_evaluation(spark, d):
    return rounded(_second(spark, d, _first(spark, d), _history(spark, d)).metrics)


@query(
    "o12_held_out_rmse_by_week",
    sql(
        f"""SELECT week, 'rmse' AS metric, {rd('estimate')} FROM (
              SELECT week, sqrt(avg(pow(final_wp - expected_wp, 2))) AS estimate FROM now_scored WHERE split = 'test' GROUP BY week
              HAVING count(expected_wp) > 0
              UNION ALL SELECT 0, sqrt(avg(pow(final_wp - expected_wp, 2))) FROM pre_scored WHERE split = 'test')""",
        "final",
        "rated",
        "history",
        **_NOW,
    ),
)
def held_out_rmse_by_week(spark, d):
    """Errors of the share of wins on held-out teams and seasons, before the season and after each week."""
    first = _first(spark, d)
    return rounded(E.held_out_rmse_by_week(first, _second(spark, d, first, _history(spark, d))))


_SCORED_HISTORY = f"SELECT r.*, {_share(_NOW_XS)} AS estimated_strength FROM rated_rows r CROSS JOIN now_fit"


def _models(spark, d, history):
    """The pre-season rows and both models."""
    first = _first(spark, d)
    return first.rows, first.model, _second(spark, d, first, history).model


@query(
    "o7_model_strengths",
    sql(
        f"SELECT season, team, game_id, {rd('pre_game_strength', 'pre_point_mean')} FROM pregame",
        "final",
        "rated",
        "history",
        **_NOW,
        rated_history=_SCORED_HISTORY,
        pregame=_PREGAME,
    ),
)
def model_strengths(spark, d):
    """What each team brings into each game by the two fitted models."""
    history = _history(spark, d)
    rows = T.pregame_strengths(E.scored_history(history, *_models(spark, d, history)))
    return rounded(rows.select("season", "team", "game_id", "pre_game_strength", "pre_point_mean"))


@query(
    "o8_model_margin_metrics",
    sql(
        f"SELECT part, metric, {rd('estimate')} FROM part_metrics",
        "final",
        "rated",
        "history",
        **_NOW,
        rated_history=_SCORED_HISTORY,
        pregame=_PREGAME,
        compared=_COMPARED,
        parted=_PARTED,
        **least_squares("parted WHERE part = 'train' AND result IS NOT NULL AND strength_diff IS NOT NULL", "result", _TERMS),
        predicted=_PREDICTED,
        part_metrics=_PART_METRICS,
    ),
)
def model_margin_metrics(spark, d):
    """The margin model on strengths by the two fitted models."""
    history = _history(spark, d)
    return rounded(_parts(E.train_margin(history, *_models(spark, d, history))))


def _parts(fit: G.MarginFit):
    parts = [fit.train_metrics.withColumn("part", F.lit("train")), fit.test_metrics.withColumn("part", F.lit("test"))]
    return R.bind_rows(*parts)


def _out_of_fold_text() -> str:
    p, names = 3, ["x1", "x2"]
    sums = [f"a{i}_{j}" for i in range(p) for j in range(i, p)] + [f"r{i}" for i in range(p)]
    fold = f"{_word(chr(39) + '11|' + chr(39) + ' || season || ' + chr(39) + '|' + chr(39) + ' || team', 1)} % 10 + 1"
    views = {
        "one_rating": _ONE,
        **logit_fit("all", "one_rating", "final_wp", _PRE_XS),
        "folded": f"SELECT season, team, final_wp AS y, {', '.join(f'{x} AS {n}' for x, n in zip(_PRE_XS, names))}, {fold} AS fold FROM one_rating",
        "fold_sums": f"""SELECT fold, {_weighted_sums(p)} FROM (SELECT *, mu * (1 - mu) AS w FROM (
                           SELECT *, {_share(names)} AS mu, {_eta(names)} AS eta FROM folded CROSS JOIN all_fit)) GROUP BY fold""",
        "rest": f"SELECT f.fold, {', '.join(f'sum(o.{s}) AS {s}' for s in sums)} FROM fold_sums f JOIN fold_sums o ON o.fold <> f.fold GROUP BY f.fold",
        "betas": _solved(_penalised("SELECT * FROM rest", p), p),
    }
    return sql(
        f"SELECT season, team, CAST(fold AS INTEGER) AS fold, {rd(_share(names) + ' AS initial_rating')} FROM folded JOIN betas USING (fold)",
        "final",
        "rated",
        **views,
    )


@query("m13_out_of_fold_ratings", _out_of_fold_text())
def out_of_fold_ratings(spark, d):
    """Every team-season's pre-season rating by the model that has not seen its fold."""
    rows = settle(kfold(_one_rating(spark, d), ["season", "team"], 11))
    models = M.smooth_fit_without_folds(rows, "final_wp", _PRE_BASIS, "fold", _PENALTY)
    return rounded(models.predict(rows, "initial_rating").select("season", "team", "fold", "initial_rating"))


@query(
    "a6_smooth_model_write",
    sql(
        f"SELECT unnest(['(intercept)', 'elo']) AS term, {rd('unnest([b0, b1]) AS estimate', 'unnest([sqrt(v00), sqrt(v11)]) AS std_error')} FROM {_LAST}",
        "final",
        "rated",
        inputs=_INPUTS,
        **_logit_steps("2.0"),
    ),
)
def smooth_model_write(spark, d):
    """A fitted smooth model written, read back, and shown."""
    path = src.shared_folder(spark)
    src.model_write(spark, M.binomial_smooth_fit(_preseason(spark, d), "final_wp", [_LINE], 2.0), path)
    rows = src.model_read(spark, path).to_frame(spark)
    return rounded(rows.select("term", "estimate", F.sqrt(F.expr("covariance[pos]")).alias("std_error")))


_WEEK = 15


@query(
    "n5_predict_week",
    sql(
        scenarios._SIMULATED.replace("CASE WHEN result IS NULL THEN", f"CASE WHEN result IS NULL AND week = {_WEEK} THEN"),
        "scenario",
        "strengths",
        keyed=scenarios._KEYED,
        side_keys=scenarios._SIDE_KEYS,
        **scenarios.beta_draw_views("side_keys"),
    ),
)
def predict_week(spark, d):
    """One week of all scenarios as the season simulator asks for it: teams and games in, games out."""
    games = scenarios.scenario(spark, d)
    teams = fx.strengths(spark, d).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(scenarios.SIMS).cast("long"))).alias("sim"), "team")
    _, rows = N.predict_week(teams, games, _WEEK, fx.strengths(spark, d), scenarios.MARGIN, scenarios.SIGMA, scenarios.SEED)
    return rows.select("sim", "game_id", "week", "result")


# ------------------------------------------------------------------- all terms


def _whole_chain(spark, d):
    # Read by every counting pass, aggregate and window below; joined once.
    games = settle(fx.games(spark, d))
    history = settle(_of_seventeen(H.team_game_history(games, codes={}), games))
    inputs = settle(_one_rating(spark, d, games))
    return history, inputs, E.train_strengths(history, inputs, fx.season_length(spark, d, games), **_KEPT)


@query("o12_model_rmse_by_week")
def model_rmse_by_week(spark, d):
    """Split, folds, 20 candidates, refit; group split, fit; errors by week on the held-out sides."""
    return rounded(_whole_chain(spark, d)[2].weekly)


@query("o8_model_margin")
def model_margin(spark, d):
    """The margin model on strengths by both models with all terms, pre-season ratings out of fold."""
    history, inputs, trained = _whole_chain(spark, d)
    best = R.best_candidate(trained.search, "rmse", "candidate").first()["smoothing"]
    first, folded = E.preseason_without_folds(inputs, best)
    return rounded(_parts(E.train_margin(history, folded, first, trained.strength.model)))
