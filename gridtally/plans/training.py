"""Training, held-out evaluation and scoring of the strength models, as one chain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import require
from ..operators.evaluate import grouped_metrics
from ..operators.fit import FoldModels, SmoothModel, smooth_fit_without_folds
from ..operators.ordered import HOT_ROWS, attach
from ..operators.splits import kfold
from ..sources.shared import settle
from .margin import MarginFit, fit_margin_model, game_comparison
from .reports import rmse_by_week
from .strength import (
    STRENGTH_FACTORS,
    expected_wins,
    fit_preseason_model,
    fit_strength_model,
    preseason_basis,
    pregame_strengths,
    strength_inputs,
)


@dataclass(frozen=True)
class Evaluation:
    """A fitted model, all rows scored by it, and metrics by side of the split (split, metric, estimate)."""

    model: SmoothModel
    rows: DataFrame
    metrics: DataFrame

    def side(self, split: str) -> DataFrame:
        return self.metrics.where(F.col("split") == split).drop("split")


def evaluate_preseason(model: SmoothModel, rows: DataFrame, lengths: DataFrame | None = None) -> Evaluation:
    """Share of wins against its prediction, and both as wins of the season (``tot_wins, exp_wins``)."""
    require(rows, "season", "team", "final_wp", "split")
    won = expected_wins(rows, "final_wp", lengths).withColumnRenamed("exp_wins", "tot_wins")
    scored = expected_wins(model.predict(won, "expected_wp"), "expected_wp", lengths)
    return Evaluation(model, scored, grouped_metrics(scored, ["split"], "final_wp", "expected_wp"))


def evaluate_strength(model: SmoothModel, rows: DataFrame, lengths: DataFrame | None = None) -> Evaluation:
    """Wins of the season against those expected after each of its weeks."""
    require(rows, "id", "season", "week", "team", "final_wp", "reg_wins", "split")
    scored = expected_wins(model.predict(rows, "expected_wp"), "expected_wp", lengths)
    scored = scored.select("id", "season", "week", "team", "final_wp", "expected_wp", "reg_wins", "exp_wins", "split")
    return Evaluation(model, scored, grouped_metrics(scored, ["split"], "reg_wins", "exp_wins"))


def held_out_rmse_by_week(preseason: Evaluation, strength: Evaluation) -> DataFrame:
    """Error of the share of wins on the test sides: the pre-season model's as week 0, then after each week."""
    test = strength.rows.where(F.col("split") == "test")
    return rmse_by_week(test, preseason.side("test"), "final_wp", "expected_wp")


@dataclass(frozen=True)
class StrengthChain:
    preseason: Evaluation
    search: DataFrame
    strength: Evaluation
    weekly: DataFrame


def train_strengths(
    history: DataFrame,
    inputs: DataFrame,
    lengths: DataFrame | None = None,
    folds: int = 10,
    grid: Sequence[float] | None = None,
    factors: Sequence[str] = STRENGTH_FACTORS,
    **rows_kept,
) -> StrengthChain:
    """Both models, each fitted on its training side and evaluated on both.

    ``inputs`` are the pre-season inputs, ``history`` the team-game history; the rows of the second
    model are written once, so that the windows behind them run once.
    """
    first, search, rows = fit_preseason_model(inputs, folds=folds, grid=grid)
    before = evaluate_preseason(first, rows, lengths)
    rated = settle(strength_inputs(history, inputs, first))
    second, rows = fit_strength_model(rated, factors=factors, **rows_kept)
    after = evaluate_strength(second, rows, lengths)
    return StrengthChain(before, search, after, held_out_rmse_by_week(before, after))


def preseason_without_folds(
    inputs: DataFrame, smoothing: float = 1.0, seed: int = 11, n_knots: int = 5, folds: int = 10
) -> tuple[FoldModels, DataFrame]:
    """Pre-season models that have not seen the team-seasons they score, and the inputs with ``fold``."""
    rows = settle(kfold(inputs, ["season", "team"], seed, folds))
    return smooth_fit_without_folds(rows, "final_wp", preseason_basis(rows, n_knots), "fold", smoothing, select=0.1), rows


def scored_history(
    history: DataFrame, preseason: DataFrame, first: SmoothModel | FoldModels, second: SmoothModel
) -> DataFrame:
    """The history with ``initial_rating`` by the pre-season model and ``estimated_strength`` after
    each game by the in-season model. A team without pre-season inputs has neither."""
    require(history, "season", "team")
    rated = first.predict(preseason, "initial_rating").select("season", "team", "initial_rating")
    return second.predict(attach(history, rated, ["season", "team"]), "estimated_strength")


def model_game_comparison(
    history: DataFrame,
    preseason: DataFrame,
    first: SmoothModel | FoldModels,
    second: SmoothModel,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Both sides' strengths by the models before each game, one row per game."""
    return game_comparison(pregame_strengths(scored_history(history, preseason, first, second), hot_rows))


def train_margin(
    history: DataFrame,
    preseason: DataFrame,
    first: SmoothModel | FoldModels,
    second: SmoothModel,
    seed: int = 13,
    folds: int = 10,
) -> MarginFit:
    """The margin model on strengths by the models. The comparison is written once, for the model
    reads it several times."""
    return fit_margin_model(settle(model_game_comparison(history, preseason, first, second)), seed, folds)
