"""Answers read off the scenarios: weekly and team projections, standings, error by week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import if_else, number_text, percent_text, strip_first, template
from ..functions.strict import strict_mean, strict_share
from ..operators.aggregate import histogram_unit
from ..operators.columns import require
from ..operators.evaluate import grouped_metrics
from ..operators.ordered import HOT_ROWS, dense_position, ordered
from ..operators.relate import bind_rows, sort_multi
from ..sources.shared import settle

# Texts of the reports.
MATCHUP_TITLE = "{away_team} @ {home_team}"
HOME_TITLE = "Week {week} vs {away_team}"
AWAY_TITLE = "Week {week} @ {home_team}"
WEEK_LABEL = "{winner} wins {win_prob}\nwith an expected MOV of {exp_result} points"
SEASON_LABEL = "{winner} wins {win_prob}\nExpected MOV: {exp_result} points"
HOME_LABEL = "{home_team} wins ->"
AWAY_LABEL = "<- {away_team} wins"
SCHEDULE_TITLE = "{season} Schedule: {team_name}"


def _game_keys(games: DataFrame) -> list[str]:
    return [c for c in ("season", "week", "away_team", "home_team") if c in games.columns]


def _game_summary(games: DataFrame) -> DataFrame:
    """One row per matchup: home win share and absolute mean margin over all scenarios.

    The only pass over scenario rows; it combines map-side and is stored, and everything after
    it works on matchups.
    """
    require(games, "away_team", "home_team", "week", "result")
    summary = games.groupBy(*_game_keys(games)).agg(
        F.abs(strict_mean("result")).alias("margin"), strict_share(F.col("result") > 0, "result").alias("home_share")
    )
    return settle(summary)


def _favourite(summary: DataFrame) -> DataFrame:
    home = F.col("home_share") > 0.5
    return summary.withColumns(
        {
            "exp_result": number_text("margin", 1),
            "winner": if_else(home, F.col("home_team"), F.col("away_team")),
            "win_prob_num": if_else(home, F.col("home_share"), F.lit(1.0) - F.col("home_share")),
        }
    ).withColumn("win_prob", percent_text("win_prob_num", 1))


def _side_labels() -> dict[str, Column]:
    return {
        "home_label": template(HOME_LABEL),
        "away_label": template(AWAY_LABEL),
    }


def weekly_projection(games: DataFrame, week: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per matchup of a week (None: of every week): favourite, its win share, expected margin,
    label texts, and the place of the matchup when sorted by win share within its week."""
    if week is not None:
        games = games.where(F.col("week") == week)
    rows = _favourite(_game_summary(games)).withColumns(
        {
            "clean_title": template(MATCHUP_TITLE, keep_null=True),
            "label": template(WEEK_LABEL),
            **_side_labels(),
        }
    )
    period = [c for c in ("season", "week") if c in rows.columns]
    placed = ordered(rows, period, ["win_prob_num"], hot_rows).running(title_level=dense_position()).frame
    return placed.drop("margin", "home_share")


def weekly_histogram(games: DataFrame, week: int | None = None, n_sims: int = 10_000) -> DataFrame:
    """Heights of unit-wide margin bins per matchup and winner colour."""
    require(games, "preferred_color_home", "preferred_color_away", "result", "week")
    if week is not None:
        games = games.where(F.col("week") == week)
    fill = if_else(F.col("result") > 0, F.col("preferred_color_home"), F.col("preferred_color_away"))
    title = template(MATCHUP_TITLE, keep_null=True)
    period = [c for c in ("season", "week") if c in games.columns]
    return histogram_unit(
        games.withColumns({"fill_col": fill, "clean_title": title}),
        [*period, "clean_title", "fill_col"],
        "result",
        n_sims,
    )


def _both_sides() -> Column:
    return F.array(
        F.struct(F.col("home_team").alias("team"), template(HOME_TITLE).alias("clean_title")),
        F.struct(F.col("away_team").alias("team"), template(AWAY_TITLE).alias("clean_title")),
    )


def team_season_projection(
    games: DataFrame, team: str | None = None, last_week: int = 18, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The same for the schedule of one team (None: of every team), titled "Week n vs/@ X".

    Scenario rows are summed up per matchup first; only matchups are put under both teams.
    """
    games = games.where(F.col("week") <= last_week)
    if team is not None:
        games = games.where((F.col("home_team") == team) | (F.col("away_team") == team))
    rows = _favourite(_game_summary(games))
    rows = rows.select("*", F.inline(_both_sides()))
    if team is not None:
        rows = rows.where(F.col("team") == team)
    rows = rows.withColumns(
        {
            "label": template(SEASON_LABEL),
            **_side_labels(),
        }
    )
    keys = [c for c in ("season", "team") if c in rows.columns]
    placed = ordered(rows, keys, ["week"], hot_rows).running(title_level=dense_position()).frame
    return placed.drop("margin", "home_share", "win_prob_num")


def team_season_histogram(
    games: DataFrame, team: str | None = None, last_week: int = 18, n_sims: int = 10_000
) -> DataFrame:
    """Heights of unit-wide margin bins per game of one team's schedule (None: of every team's),
    titled "Week n vs/@ X" and filled with the winner's colour.

    Bins are counted per matchup first, so scenario rows are not repeated for the two sides.
    """
    require(games, "preferred_color_home", "preferred_color_away", "result", "week")
    games = games.where(F.col("week") <= last_week)
    if team is not None:
        games = games.where((F.col("home_team") == team) | (F.col("away_team") == team))
    fill = if_else(F.col("result") > 0, F.col("preferred_color_home"), F.col("preferred_color_away"))
    bins = histogram_unit(games.withColumn("fill_col", fill), [*_game_keys(games), "fill_col"], "result", n_sims)
    rows = bins.select("*", F.inline(_both_sides()))
    if team is not None:
        rows = rows.where(F.col("team") == team)
    return rows.drop("home_team", "away_team")


def schedule_title(names: DataFrame, team: str, season: int) -> DataFrame:
    """One row with the title of a team's schedule report."""
    require(names, "team_abbr", "team_name")
    return names.where(F.col("team_abbr") == team).select(
        "team_abbr", template(SCHEDULE_TITLE, season=F.lit(season)).alias("title")
    )


def standings_report(
    overall: DataFrame, flags: Sequence[str] = ("playoff", "div1", "seed1", "won_conf", "won_sb")
) -> DataFrame:
    """Teams by season (if there is one), conference and division, most wins first, with texts for wins and shares."""
    require(overall, "conf", "division", "team", "wins", *flags)
    period = ["season"] if "season" in overall.columns else []
    rows = sort_multi(
        overall.withColumn("division", strip_first("division", "AFC |NFC ")), *period, "conf", "division", "-wins", "team"
    )
    return rows.select(
        *period,
        "conf",
        "division",
        "team",
        number_text("wins", 1).alias("wins"),
        *[percent_text(f, 0).alias(f) for f in flags],
    )


def rmse_by_week(predictions: DataFrame, preseason_rmse: DataFrame, truth: str, estimate: str) -> DataFrame:
    """rmse of each week with the pre-season value as week 0, last week first."""
    require(preseason_rmse, "metric", "estimate")
    weekly = grouped_metrics(predictions, ["week"], truth, estimate).where(F.col("metric") == "rmse")
    start = preseason_rmse.where(F.col("metric") == "rmse").withColumn("week", F.lit(0))
    return sort_multi(bind_rows(weekly, start), "-week")
