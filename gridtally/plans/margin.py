"""Margin of victory: one row per game with both sides' features, and the linear model on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import regression_metrics, resample_metrics
from ..operators.features import interaction_feature, zero_variance
from ..operators.fit import (
    LinearModel,
    held,
    linear_fit,
    linear_fit_without_folds,
    predict_held_out,
)
from ..operators.reshape import long_to_sides
from ..operators.scenario import matchup_features
from ..operators.splits import kfold, random_split

MARGIN_FEATURES = ("pre_game_strength_home", "strength_diff", "is_after_week_1")
GAME_KEYS = ["game_id", "game_type", "week", "div_game", "result"]


def game_comparison(pregame: DataFrame) -> DataFrame:
    """Both sides' strengths, scores and point means on one row per game (unplayed ones too)."""
    values = ["team", "pre_game_strength", "score", "pre_point_mean"]
    wide = long_to_sides(pregame, GAME_KEYS, values).withColumnsRenamed(
        {"team_home": "home_team", "team_away": "away_team"}
    )
    return matchup_features(wide).select(
        "game_id", "game_type", "week", "away_team", "home_team", "pre_game_strength_home", "score_away",
        "score_home", "pre_point_mean_home", "pre_point_mean_away", "pre_game_strength_away", "result",
        "strength_diff", "game_type_adj", "is_after_week_1",
    )


@dataclass(frozen=True)
class MarginFit:
    model: LinearModel
    rows: DataFrame
    train_metrics: DataFrame
    test_metrics: DataFrame
    resamples: DataFrame


def margin_features(games: DataFrame) -> DataFrame:
    return interaction_feature(games, "pre_game_strength_home", "strength_diff")


def fit_margin_model(games: DataFrame, seed: int = 13, folds: int = 10) -> MarginFit:
    """Split 3:1, drop constant predictors, fit on the training games, evaluate on both sides.

    Scaling the predictors does not change a least-squares prediction, so the model is kept on
    the original scale and can be applied as it is. The fits without each fold come from sums
    per fold, not from more passes over the games.
    """
    rows = kfold(random_split(margin_features(games), ["game_id"], seed), ["game_id"], seed, folds)
    names = [*MARGIN_FEATURES, "pre_game_strength_home_x_strength_diff"]
    with held(rows.where(F.col("split") == "train").select("fold", "result", *names)) as train:
        constant = zero_variance(train, names)
        names = [n for n in names if n not in constant]
        model = linear_fit(train, "result", names)
        without = linear_fit_without_folds(train, "result", names)
    scored = model.predict(rows)
    train_rows = F.col("split") == "train"
    held_out = predict_held_out(rows.where(train_rows), without)
    return MarginFit(
        model,
        scored,
        regression_metrics(scored.where(train_rows), "result", "pred"),
        regression_metrics(scored.where(~train_rows), "result", "pred"),
        resample_metrics(held_out, "fold", "result", "pred"),
    )
