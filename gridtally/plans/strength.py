"""Team strength: pre-season and in-season models, current state, Beta-distributed strengths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    GAME_TEAM_CODES,
    beta_alpha,
    beta_beta,
    beta_struct,
    clip_probability,
    scheduled_games,
)
from ..operators.columns import filter_started, filter_without, require
from ..operators.features import (
    Basis,
    Smooth,
    factor_basis,
    find_levels,
    find_smooths,
    random_effect,
    spline_basis,
    tensor_interaction,
)
from ..operators.fit import (
    SmoothModel,
    binomial_smooth_fit,
    grid_search,
    held,
    joined_predict_with_se,
    joined_smooth_fit,
    pair_counts,
    quasibinomial_smooth_fit,
    weighted_smooths,
)
from ..operators.ordered import HOT_ROWS, attach, ordered, previous
from ..operators.relate import best_candidate, known_levels, left_join_on, small, sort_multi
from ..operators.splits import group_split, kfold, stratified_split
from ..sources.shared import settle
from .history import running_team_stats, team_games, with_league_stats, with_outcome

# Terms of the in-season strength model.
STRENGTH_SMOOTHS = (
    "cumulative_point_mean",
    "cumulative_season_points_mean",
    "cumulative_point_sd",
    "cumulative_pd",
    "game_num",
    "initial_rating",
)
STRENGTH_TENSORS = (
    ("cumulative_point_mean", "cumulative_season_points_mean"),
    ("cumulative_point_sd", "cumulative_season_points_mean"),
    ("cumulative_pd", "game_num"),
    ("initial_rating", "game_num"),
)
STRENGTH_FACTORS = ("week", "game_num")

# Seasons the strength model is trained on, and the first seasons of a new team.
FIRST_STRENGTH_SEASON = 2000
NEW_TEAM, NEW_TEAM_LAST_SEASON = "HOU", 2002


def preseason_basis(inputs: DataFrame, n_knots: int = 5, teams: Sequence[str] | None = None) -> list[Basis]:
    """Smooths of rating and previous share of wins, team intercepts, team-by-season slopes."""
    require(inputs, "elo", "prev_season_wp", "team", "season")
    smooths = find_smooths(inputs, ["elo", "prev_season_wp", "season"], n_knots)
    teams = list(teams) if teams is not None else find_levels(inputs, "team")
    return [
        *spline_basis(smooths["elo"]),
        *spline_basis(smooths["prev_season_wp"]),
        *random_effect("team", teams),
        *random_effect("team", teams, smooths["season"]),
    ]


def fit_preseason_model(
    inputs: DataFrame, seed: int = 11, n_knots: int = 5, folds: int = 10, grid: Sequence[float] | None = None
) -> tuple[SmoothModel, DataFrame, DataFrame]:
    """Split, search the smoothing multiplier over folds, refit on all training rows.

    Returns the model, the search table, and the input with ``split`` and ``fold``.
    """
    rows = kfold(stratified_split(inputs, ["season", "team"], "season", seed), ["season", "team"], seed, folds)
    with held(rows.where(F.col("split") == "train")) as train:
        basis = preseason_basis(train, n_knots)
        search = grid_search(train, "final_wp", basis, "fold", folds, grid, select=0.1)
        best = best_candidate(search, "rmse", "candidate").first()["smoothing"]
        return binomial_smooth_fit(train, "final_wp", basis, best, select=0.1), search, rows


def preseason_model(inputs: DataFrame, smoothing: float = 1.0, n_knots: int = 5) -> SmoothModel:
    """The pre-season model on all given rows with a known smoothing multiplier."""
    with held(inputs) as rows:
        return binomial_smooth_fit(rows, "final_wp", preseason_basis(rows, n_knots), smoothing, select=0.1)


def strength_inputs(
    history: DataFrame, preseason: DataFrame, model: SmoothModel, joined: bool = True
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Regular-season history with each team-season's predicted pre-season share of wins. Without
    ``joined`` these are two tables, the second (season, team, initial_rating)."""
    require(history, "season", "team", "game_type", "tot_wins", "tot_games")
    rated = model.predict(preseason, "initial_rating").select("season", "team", "initial_rating")
    rows = history.where(F.col("game_type") == "REG").withColumns(
        {"round_wins": F.floor("tot_wins").cast("int"), "tot_games": F.col("tot_games").cast("int")}
    )
    return attach(rows, rated, ["season", "team"]) if joined else (rows, rated)


def strength_training_rows(
    inputs: DataFrame,
    first_season: int = FIRST_STRENGTH_SEASON,
    new_team: str = NEW_TEAM,
    new_team_last_season: int = NEW_TEAM_LAST_SEASON,
) -> DataFrame:
    return filter_without(
        inputs,
        F.col("season") >= first_season,
        (F.col("season") <= new_team_last_season) & (F.col("team") == new_team),
    )


def strength_basis(
    inputs: DataFrame,
    n_knots: int = 4,
    factors: Sequence[str] = STRENGTH_FACTORS,
    max_levels: int = 25,
    smooths: Mapping[str, Smooth] | None = None,
) -> list[Basis]:
    """All terms of the in-season model: smooths, tensors, and one column per level of each factor.
    A factor with more than ``max_levels`` values raises an error; ``factors`` names others. Smooths are found
    in ``inputs`` unless they are given."""
    smooths = smooths or find_smooths(inputs, list(STRENGTH_SMOOTHS), n_knots)
    out: list[Basis] = []
    for name in STRENGTH_SMOOTHS:
        out += spline_basis(smooths[name])
    for a, b in STRENGTH_TENSORS:
        out += tensor_interaction(smooths[a], smooths[b])
    for name in factors:
        out += factor_basis(name, find_levels(inputs, name, max_levels))
    return out


def strength_model(
    inputs: DataFrame,
    smoothing: float = 1.0,
    n_knots: int = 4,
    factors: Sequence[str] = STRENGTH_FACTORS,
    rated: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> SmoothModel:
    """The in-season model on all given rows. Only the columns of the model are kept while it is fitted.

    With ``rated`` (season, team, initial_rating) the rows are those of ``inputs`` with all ratings of their
    team-season. Where a team-season has many, these are far more than the rows of either; above ``hot_rows`` the
    fit is done without making them. Both ways differ in the order in which doubles are added, and in knots by the error
    of approximate quantiles.
    """
    used = dict.fromkeys(["final_wp", *STRENGTH_SMOOTHS, *factors])
    if rated is not None:
        keys = ["season", "team"]
        counts, n = pair_counts(inputs, rated, keys)
        if n > hot_rows:
            inputs = settle(inputs.select(*dict.fromkeys([*keys, *[c for c in used if c not in rated.columns]])))
            rated = settle(rated)
            rows = attach(inputs, counts.select(*keys, F.greatest("n_right", F.lit(1)).alias("pairs")), keys)
            smooths = weighted_smooths(rows, [c for c in STRENGTH_SMOOTHS if c in inputs.columns], "pairs", n_knots)
            rows = attach(rated, counts.select(*keys, F.col("n_left").alias("pairs")), keys)
            smooths |= weighted_smooths(rows, ["initial_rating"], "pairs", n_knots)
            basis = strength_basis(inputs, n_knots, factors, smooths=smooths)
            return joined_smooth_fit(inputs, rated, keys, counts, "final_wp", basis, smoothing, select=0.1, quasi=True)
        inputs = attach(inputs, rated, keys)
    require(inputs, *used)
    with held(inputs.select(*used)) as rows:
        return quasibinomial_smooth_fit(rows, "final_wp", strength_basis(rows, n_knots, factors), smoothing, select=0.1)


def fit_strength_model(
    inputs: DataFrame,
    seed: int = 12,
    n_knots: int = 4,
    smoothing: float = 1.0,
    factors: Sequence[str] = STRENGTH_FACTORS,
    **rows_kept,
) -> tuple[SmoothModel, DataFrame]:
    """Group split on the team-season id, then one quasi-binomial fit on the training side."""
    require(inputs, "id")
    rows = group_split(strength_training_rows(inputs, **rows_kept), "id", seed)
    return strength_model(rows.where(F.col("split") == "train"), smoothing, n_knots, factors), rows


def expected_wins(scored: DataFrame, share: str = "pred", lengths: DataFrame | None = None) -> DataFrame:
    """Add ``exp_wins``: a share of wins times the season's games, from a (season, games) table
    or, without one, from the fixed rule."""
    require(scored, "season", share)
    if lengths is None:
        return scored.withColumn("exp_wins", F.col(share) * scheduled_games("season"))
    joined = left_join_on(scored, small(lengths.withColumnRenamed("games", "__games")), ["season"])
    return joined.withColumn("exp_wins", F.col(share) * F.col("__games")).drop("__games")


def beta_columns(scored: DataFrame) -> DataFrame:
    """Beta parameters from prediction and standard error. The share is kept inside
    [1e-6, 1 - 1e-6]; a standard error too large for any Beta gives NULL parameters."""
    require(scored, "pred", "std_error")
    rows = scored.withColumn("pred", clip_probability("pred"))
    rows = rows.withColumn("alpha", beta_alpha("pred", "std_error"))
    rows = rows.withColumn("alpha", F.when(F.col("alpha") > 0, F.col("alpha")))
    rows = rows.withColumn("beta", beta_beta("alpha", "pred"))
    return rows.withColumn("strength_dist", beta_struct("alpha", "beta"))


def preseason_strengths(inputs: DataFrame, model: SmoothModel) -> DataFrame:
    """Strengths before the first week: (season, team, elo, estimated_strength, alpha, beta, strength_dist)."""
    scored = beta_columns(model.predict_with_se(inputs)).withColumnRenamed("pred", "estimated_strength")
    return scored.select("season", "team", "elo", "estimated_strength", "alpha", "beta", "strength_dist")


def current_state(
    games: DataFrame,
    season: int | None,
    week: int,
    codes: Mapping[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Latest started row of every team with its running statistics, as of a week.

    With a table of ``levels`` (team) a code that is not in it is NULL, and the games of all unknown
    codes of a season count as one team's. An unplayed game counts 0 wins and no margin here. Without ``season``, for every season.
    The latest week per team comes from the games, so the running statistics are computed once.
    """
    if season is not None:
        games = games.where(F.col("season") == season)
    games = games.where(F.col("week") <= week)
    long = team_games(games, codes=codes or {})
    if levels is not None:
        long = known_levels(long, "team", levels)
    stats = with_league_stats(
        running_team_stats(with_outcome(long, 0.0), hot_rows), long, across_seasons=False
    )
    keys = ["season", "team"]
    latest = filter_started(long).groupBy(*keys).agg(F.max("week").alias("week"))
    return attach(filter_started(stats), latest, [*keys, "week"], "left_semi")


def strength_table(
    preseason: DataFrame,
    preseason_model: SmoothModel,
    state: DataFrame | None = None,
    strength_model: SmoothModel | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Strength, Beta parameters and distribution per team, strongest first; one schema for
    every week (``elo`` is NULL in season).

    In season these are the rows of the state with all ratings of their team-season. Above ``hot_rows`` what they share
    is computed once for each side and not for each pair; the two ways differ in the order in which doubles are added.
    """
    before = preseason_strengths(preseason, preseason_model)
    if state is None:
        return sort_multi(before, "-estimated_strength", "team")
    if strength_model is None:
        raise ValueError("an in-season table needs the in-season model")
    initial = before.select("season", "team", F.col("estimated_strength").alias("initial_rating"))
    keys = ["season", "team"]
    counts, n = pair_counts(state, initial, keys)
    if n > hot_rows:
        used = dict.fromkeys([*keys, *[p.column for b in strength_model.basis for p in b.parts]])
        state, initial = settle(state.select(*[c for c in used if c in state.columns and c != "initial_rating"])), settle(initial)
        scored = beta_columns(joined_predict_with_se(strength_model, state, initial, keys, counts))
    else:
        scored = beta_columns(strength_model.predict_with_se(attach(state, initial, keys)))
    out = scored.withColumnRenamed("pred", "estimated_strength").withColumn("elo", F.lit(None).cast("double"))
    return sort_multi(
        out.select("season", "team", "elo", "estimated_strength", "alpha", "beta", "strength_dist"),
        "-estimated_strength",
        "team",
    )


def pregame_strengths(history: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Strength and point mean each team brought into each game: the values after its previous
    game, the initial rating and 0 before its first."""
    require(history, "season", "team", "week", "game_id", "estimated_strength", "initial_rating", "cumulative_point_mean")
    lagged = (
        ordered(history, ["season", "team"], ["week", "game_id"], hot_rows)
        .running(
            pre_game_strength=previous("estimated_strength"), pre_point_mean=previous("cumulative_point_mean")
        )
        .frame
    )
    return lagged.withColumns(
        {
            "pre_game_strength": F.coalesce("pre_game_strength", "initial_rating"),
            "pre_point_mean": F.coalesce("pre_point_mean", F.lit(0.0)),
        }
    )
