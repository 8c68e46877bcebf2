"""Team-game history: one row per game and side with running team and league statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    GAME_TEAM_CODES,
    compose_key,
    outcome_delta,
    outcome_win,
    recode_values,
)
from ..operators.aggregate import league_running, week_mean_sd
from ..operators.columns import column_range, relocate_cols, require
from ..operators.ordered import (
    HOT_ROWS,
    group_count,
    group_sum,
    ordered,
    running_count,
    running_mean,
    running_sum,
)
from ..operators.relate import known_levels, left_join_common, level_table, small
from ..operators.reshape import sides_to_long
from ..sources.shared import settle

# Fixed value: games of a regular season by which ``reg_wp`` is divided in every season.
REGULAR_GAMES = 16

TEAM_KEYS = ["season", "team"]
GAME_ORDER = ["week", "game_id"]


def team_games(
    games: DataFrame,
    before_season: int | None = None,
    codes: Mapping[str, str] = GAME_TEAM_CODES,
) -> DataFrame:
    """One row per game and side, team codes brought up to date."""
    require(games, "game_id", "season", "game_type", "week", "result", "div_game")
    if before_season is not None:
        games = games.where(F.col("season") < before_season)
    sides = column_range(games, "away_team", "home_score")
    long = sides_to_long(games, sides).withColumn("team", recode_values("team", codes))
    return long.select("game_id", "season", "game_type", "week", "div_game", "set", "team", "score", "result")


def with_outcome(long: DataFrame, unplayed_win: float) -> DataFrame:
    return long.withColumn("win", outcome_win("result", "set", unplayed_win)).withColumn(
        "delta", outcome_delta("win", "result", "set")
    )


def running_team_stats(long: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running and whole-season statistics of every team in every season.

    ``cumulative_*_sd`` is |running sum of (value - running mean)| / sqrt(week), with the
    calendar week as divisor: a running imbalance, not a standard deviation.
    """
    require(long, "win", "delta", "score", "week", "game_id", "season", "team", "game_type")
    score, delta, win = F.col("score").cast("double"), F.col("delta"), F.col("win")
    first = ordered(long, TEAM_KEYS, GAME_ORDER, hot_rows).running(
        wins=running_sum(win),
        cumulative_point_mean=running_mean(score),
        cumulative_pd=running_sum(delta),
        __delta_mean=running_mean(delta),
        game_num=running_count(),
        reg_wins=group_sum(F.when(F.col("game_type") == "REG", win).otherwise(0.0)),
        tot_wins=group_sum(win),
        tot_games=group_count(),
    )
    second = first.running(
        __score_gap=running_sum(score - F.col("cumulative_point_mean")),
        __delta_gap=running_sum(delta - F.col("__delta_mean")),
    ).frame
    scale = F.sqrt("week")
    return second.withColumns(
        {
            "cumulative_point_sd": F.abs("__score_gap") / scale,
            "cumulative_pd_sd": F.abs("__delta_gap") / scale,
            "reg_wp": F.col("reg_wins") / F.lit(float(REGULAR_GAMES)),
            "final_wp": F.col("tot_wins") / F.col("tot_games"),
        }
    ).drop("__delta_mean", "__score_gap", "__delta_gap")


def with_league_stats(teams: DataFrame, long: DataFrame, across_seasons: bool = True) -> DataFrame:
    """Join the season-week league statistics (one row per calendar week) and the team-season id."""
    weeks = settle(league_running(week_mean_sd(long), across_seasons))
    joined = left_join_common(teams, small(weeks))
    return relocate_cols(joined.withColumn("id", compose_key("season", F.lit("_"), "team")), "id")


def team_game_history(
    games: DataFrame,
    before_season: int | None = None,
    unplayed_win: float = 0.5,
    codes: Mapping[str, str] = GAME_TEAM_CODES,
    across_seasons: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    long = team_games(games, before_season, codes)
    stats = running_team_stats(with_outcome(long, unplayed_win), hot_rows)
    return with_league_stats(stats, long, across_seasons)


def season_final_table(
    games: DataFrame,
    before_season: int | None = None,
    codes: Mapping[str, str] = GAME_TEAM_CODES,
    levels: DataFrame | None = None,
) -> DataFrame:
    """(season, team, final_wp), one row each.

    The same rows as the distinct (season, team, final_wp) of the history, taken from one
    aggregate instead of its windows.
    """
    long = with_outcome(team_games(games, before_season, codes), 0.5)
    final = long.groupBy("season", "team").agg((F.sum("win") / F.count(F.lit(1))).alias("final_wp"))
    return final if levels is None else known_levels(final, "team", levels)


def team_levels(games: DataFrame, codes: Mapping[str, str] = GAME_TEAM_CODES) -> DataFrame:
    """Teams numbered by first appearance (season, week, game, away before home)."""
    levels = level_table(team_games(games, codes=codes), "team", ["season", "week", "game_id", "set"])
    return levels.withColumn("ord", F.col("ord").cast("int"))
