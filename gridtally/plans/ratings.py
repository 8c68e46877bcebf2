"""Inputs of the pre-season model: opening ratings and last season's share of wins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import RATING_TEAM_CODES, mean_reversion, recode_values
from ..operators.columns import drop_incomplete, require
from ..operators.ordered import attach
from ..operators.relate import (
    earliest_per_group,
    known_levels,
    latest_per_group,
    left_join_on,
    shift_period,
)
from ..operators.reshape import suffix_to_long


def ratings_long(ratings: DataFrame) -> DataFrame:
    """(date, season, team, elo), one row per rated side."""
    require(ratings, "date", "season", "team1", "team2", "elo1_pre", "elo2_pre")
    wide = ratings.select(
        "date",
        "season",
        F.col("team1").alias("team_1"),
        F.col("team2").alias("team_2"),
        F.col("elo1_pre").alias("elo_1"),
        F.col("elo2_pre").alias("elo_2"),
    )
    return suffix_to_long(wide, ["team_1", "team_2", "elo_1", "elo_2"]).drop("set")


def opening_ratings(
    ratings: DataFrame,
    from_season: int | None = None,
    codes: Mapping[str, str] = RATING_TEAM_CODES,
    levels: DataFrame | None = None,
) -> DataFrame:
    """First rating of every team in every season (all of them when dates tie)."""
    if from_season is not None:
        ratings = ratings.where(F.col("season") >= from_season)
    long = ratings_long(ratings).withColumn("team", recode_values("team", codes))
    if levels is not None:
        long = known_levels(long, "team", levels)
    return earliest_per_group(long, ["season", "team"], "date").drop("date")


def preseason_inputs(
    final: DataFrame,
    ratings: DataFrame,
    from_season: int | None = None,
    before_season: int | None = None,
    codes: Mapping[str, str] = RATING_TEAM_CODES,
    levels: DataFrame | None = None,
) -> DataFrame:
    """(season, team, prev_season_wp, elo, final_wp), complete rows only."""
    previous = shift_period(final, "final_wp", "prev_season_wp")
    if before_season is not None:
        previous = previous.where(F.col("season") < before_season)
    opening = opening_ratings(ratings, from_season, codes, levels)
    keys = ["season", "team"]
    joined = left_join_on(left_join_on(previous, opening, keys), final, keys)
    return drop_incomplete(joined).select(*keys, "prev_season_wp", "elo", "final_wp")


def current_ratings_inputs(
    final: DataFrame,
    ratings: DataFrame,
    season: int | None = None,
    codes: Mapping[str, str] = RATING_TEAM_CODES,
    levels: DataFrame | None = None,
) -> DataFrame:
    """(season, team, elo, prev_season_wp) for the coming season: the last rating of the season
    before, drawn to the mean, and that season's share of wins.

    Without ``season``, for the season after every season rated.
    """
    if season is not None:
        ratings = ratings.where(F.col("season") == season - 1)
        final = final.where(F.col("season") == season - 1)
    last = latest_per_group(ratings_long(ratings), ["season", "team"], "date").drop("date")
    last = last.withColumns(
        {
            "elo": mean_reversion("elo"),
            "season": F.col("season") + 1,
            "team": recode_values("team", codes),
        }
    )
    if levels is not None:
        last = known_levels(last, "team", levels)
    # A code outside the level table is NULL on both sides and still meets its match.
    previous = shift_period(final, "final_wp", "prev_season_wp")
    return attach(last, previous, ["season", "team"]).select("season", "team", "elo", "prev_season_wp")
