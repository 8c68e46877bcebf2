"""The running state of every team as of a week, stored and carried on by later weeks' games.

A state holds sums, counts and marks of missing values, so that games of later weeks extend it
without the games before being read again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import compose_key
from ..operators.aggregate import league_running, week_mean_sd
from ..operators.columns import filter_started, require
from ..operators.ordered import HOT_ROWS, attach, ordered, running_count, running_sum
from ..operators.relate import bind_rows, left_join_common, small
from ..sources.shared import settle
from ..sources.tables import snapshot_read, snapshot_write
from .history import GAME_ORDER, REGULAR_GAMES, TEAM_KEYS, team_games, with_outcome

#: What is summed of every game, and whether one was missing.
_SUMS = ("win", "score", "delta", "score_gap", "delta_gap")


@dataclass(frozen=True)
class RunningState:
    """``teams``: sums per season and team; ``latest``: the rows of each team's last started week;
    ``weeks``: league means by season and week."""

    teams: DataFrame
    latest: DataFrame
    weeks: DataFrame


def _nothing(long: DataFrame) -> DataFrame:
    zero = [F.lit(0.0).alias(f"sum_{c}") for c in _SUMS] + [F.lit(False).alias(f"missing_{c}") for c in _SUMS]
    zero += [F.lit(0).cast("bigint").alias("games"), F.lit(0.0).alias("sum_reg"), F.lit(False).alias("missing_reg")]
    return long.select(*TEAM_KEYS).distinct().select(*TEAM_KEYS, *zero)


def _known(name: str, missing: Column) -> Column:
    return F.when(~missing, F.col(name))


def _advance(base: DataFrame, weeks: DataFrame | None, latest: DataFrame | None, games: DataFrame, codes: Mapping[str, str], hot_rows: int) -> RunningState:
    """Carry sums on over the games, in their order."""
    long = with_outcome(team_games(games, codes=codes), 0.0)
    long = long.withColumns({"score": F.col("score").cast("double"), "reg": F.when(F.col("game_type") == "REG", F.col("win")).otherwise(0.0)})
    if base is None:
        base = _nothing(long)
    rows = attach(long, base, TEAM_KEYS, "left")
    helpers = [c for c in base.columns if c not in TEAM_KEYS]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0) if c == "games" else F.lit(False) if c.startswith("missing") else F.lit(0.0)) for c in helpers})
    sums = {f"add_{c}": running_sum(F.coalesce(c, F.lit(0.0))) for c in ("win", "score", "delta", "reg")}
    sums |= {f"bad_{c}": running_sum(F.col(c).isNull().cast("int")) for c in ("win", "score", "delta", "reg")}
    first = ordered(rows, TEAM_KEYS, GAME_ORDER, hot_rows).running(game=running_count(), **sums)

    def carried(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("games", F.col("games") + F.col("game"))
        for c in ("win", "score", "delta", "reg"):
            frame = frame.withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.col(f"add_{c}"), f"missing_{c}": F.col(f"missing_{c}") | (F.col(f"bad_{c}") > 0)})
        for c in ("score", "delta"):
            mean = _known(f"sum_{c}", F.col(f"missing_{c}")) / F.col("games")
            frame = frame.withColumns({f"mean_{c}": mean, f"gap_{c}": F.col(c) - mean})
        return frame

    gaps = {f"add_{c}_gap": running_sum(F.coalesce(f"gap_{c}", F.lit(0.0))) for c in ("score", "delta")}
    gaps |= {f"bad_{c}_gap": running_sum(F.col(f"gap_{c}").isNull().cast("int")) for c in ("score", "delta")}
    done = first.then(carried).running(**gaps).frame
    for c in ("score_gap", "delta_gap"):
        done = done.withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.col(f"add_{c}"), f"missing_{c}": F.col(f"missing_{c}") | (F.col(f"bad_{c}") > 0)})
    done = settle(done.select(*long.columns, *helpers, "mean_score"))
    last = done.groupBy(*TEAM_KEYS).agg(F.max_by(F.struct(*helpers), F.struct(*GAME_ORDER)).alias("s")).select(*TEAM_KEYS, "s.*")
    old = attach(base, last, TEAM_KEYS, "left_anti")
    started = filter_started(done)
    top = started.groupBy(*TEAM_KEYS).agg(F.max("week").alias("week"))
    shown = attach(started, top, [*TEAM_KEYS, "week"], "left_semi").select(
        *long.drop("reg").columns,
        _known("sum_win", F.col("missing_win")).alias("wins"),
        F.col("mean_score").alias("cumulative_point_mean"),
        _known("sum_delta", F.col("missing_delta")).alias("cumulative_pd"),
        F.col("games").alias("game_num"),
        (F.abs(_known("sum_score_gap", F.col("missing_score_gap"))) / F.sqrt("week")).alias("cumulative_point_sd"),
        (F.abs(_known("sum_delta_gap", F.col("missing_delta_gap"))) / F.sqrt("week")).alias("cumulative_pd_sd"),
    )
    if latest is not None:
        shown = bind_rows(shown, attach(latest, top, TEAM_KEYS, "left_anti"))
    league = week_mean_sd(team_games(games, codes=codes))
    if weeks is not None:
        league = bind_rows(weeks, league)
    return RunningState(settle(bind_rows(old, last)), settle(shown), settle(league))


def running_state(games: DataFrame, week: int, codes: Mapping[str, str] | None = None, hot_rows: int = HOT_ROWS) -> RunningState:
    """The state as of a week, from all games up to it. An unplayed game counts 0 wins and no margin."""
    require(games, "season", "week", "game_id")
    return _advance(None, None, None, games.where(F.col("week") <= week), codes or {}, hot_rows)


def extend_state(state: RunningState, games: DataFrame, codes: Mapping[str, str] | None = None, hot_rows: int = HOT_ROWS) -> RunningState:
    """The state after further games, all of later weeks than those before."""
    require(games, "season", "week", "game_id")
    return _advance(state.teams, state.weeks, state.latest, games, codes or {}, hot_rows)


def state_rows(state: RunningState) -> DataFrame:
    """Latest started row of every team with its running, season and league statistics: the rows and
    columns of ``current_state``."""
    totals = state.teams.select(
        *TEAM_KEYS,
        _known("sum_reg", F.col("missing_reg")).alias("reg_wins"),
        _known("sum_win", F.col("missing_win")).alias("tot_wins"),
        F.col("games").alias("tot_games"),
    )
    rows = attach(state.latest, totals, TEAM_KEYS, "inner").withColumns(
        {"reg_wp": F.col("reg_wins") / F.lit(float(REGULAR_GAMES)), "final_wp": F.col("tot_wins") / F.col("tot_games")}
    )
    league = settle(league_running(state.weeks, across_seasons=False))
    return left_join_common(rows, small(league)).withColumn("id", compose_key("season", F.lit("_"), "team"))


_PARTS = ("teams", "latest", "weeks")


def store_state(state: RunningState, path: str, week: int) -> None:
    for part in _PARTS:
        snapshot_write(getattr(state, part), f"{path}/{part}", week)


def stored_state(spark: SparkSession, path: str, week: int) -> RunningState:
    return RunningState(*[snapshot_read(spark, f"{path}/{part}", week).drop("as_of_week") for part in _PARTS])
