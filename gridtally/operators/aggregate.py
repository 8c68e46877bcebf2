"""Group aggregates and group statistics attached to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strict import strict_mean, strict_sd, strict_share
from ..sources.shared import settle
from .columns import require
from .ordered import HOT_ROWS, attach, group_sum, ordered, previous, running_sum

#: Multiples of a step that are opened from one row.
STRETCH = 4096


def week_mean_sd(df: DataFrame, keys: Sequence[str] = ("season", "week"), value: str = "score") -> DataFrame:
    """Mean and sample standard deviation by week; NULL as soon as one score is missing."""
    require(df, value, *keys)
    return df.groupBy(*keys).agg(
        strict_mean(value).alias("season_week_points_mean"),
        strict_sd(value).alias("season_week_points_sd"),
    )


def conditional_sum(df: DataFrame, keys: Sequence[str], cond: Column, value: str, name: str) -> DataFrame:
    """Sum of ``value`` where ``cond`` holds, 0 elsewhere."""
    return df.groupBy(*keys).agg(F.sum(F.when(cond, F.col(value)).otherwise(0.0)).alias(name))


def group_share(df: DataFrame, keys: Sequence[str], value: str = "result", name: str = "win_prob") -> DataFrame:
    """Share of rows with a positive value."""
    return df.groupBy(*keys).agg(strict_share(F.col(value) > 0, value).alias(name))


def group_abs_mean(df: DataFrame, keys: Sequence[str], value: str = "result", name: str = "exp_result") -> DataFrame:
    return df.groupBy(*keys).agg(F.abs(strict_mean(value)).alias(name))


def group_stat_attach(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Group statistics on every row of the group.

    Aggregated first and joined back, so a group larger than a task never has to be held by
    one: the aggregate combines map-side, and the join is broadcast or split by Spark.
    """
    require(df, *keys)
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return attach(df.drop(*stats), table, keys, "left")


def league_running(weeks: DataFrame, across_seasons: bool = True) -> DataFrame:
    """Running league mean by season, and the running dispersion of weekly means.

    The dispersion is |running sum of (weekly mean - running mean)| / sqrt(week). In training
    the sum runs on across seasons in (week, season) order; with ``across_seasons=False`` it
    restarts each season. The input is the season-week aggregate - one row per calendar week,
    whatever the number of games - which is why an unpartitioned window is fine here.
    """
    require(weeks, "season", "week", "season_week_points_mean")
    mean = F.col("season_week_points_mean")
    per_season = Window.partitionBy("season").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    with_mean = weeks.withColumn(
        "cumulative_season_points_mean",
        F.when(~F.max(mean.isNull()).over(per_season), F.avg(mean).over(per_season)),
    )
    every = (
        Window.orderBy("week", "season").rowsBetween(Window.unboundedPreceding, 0) if across_seasons else per_season
    )
    gap = mean - F.col("cumulative_season_points_mean")
    total = F.when(~F.max(gap.isNull()).over(every), F.sum(gap).over(every))
    return with_mean.withColumn("cumulative_season_points_sd", F.abs(total) / F.sqrt("week"))


def histogram_unit(
    df: DataFrame, keys: Sequence[str], value: str = "result", n_sims: int = 10_000, name: str = "height"
) -> DataFrame:
    """Counts in unit-wide bins centred on whole numbers, as a share of ``n_sims``."""
    require(df, value, *keys)
    bins = F.floor(F.col(value) + 0.5).cast("int")
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, bins.alias("bin"))
        .agg((F.count(F.lit(1)) / F.lit(float(n_sims))).alias(name))
    )


def _period(rows: DataFrame) -> list[str]:
    """The season as the first part of a key, where the rows have one."""
    return ["season"] if "season" in rows.columns else []


def scenario_team_totals(long_games: DataFrame) -> DataFrame:
    """Wins by season (if the rows have one), scenario and team; a tied or unplayed row adds nothing."""
    require(long_games, "sim", "team", "win")
    return long_games.groupBy(*_period(long_games), "sim", "team").agg(
        F.coalesce(F.sum("win"), F.lit(0.0)).alias("wins"), F.count("win").alias("decided")
    )


def most_games(games: DataFrame) -> DataFrame:
    """``max_wins``: games of the busiest team of each season, the top of the grid of win totals."""
    keys = _period(games)
    teams = games.select(*keys, F.explode(F.array("home_team", "away_team")).alias("team"))
    return teams.groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("max_wins"))


def scenario_cdf(
    totals: DataFrame, max_wins: int | DataFrame | None = None, step: float = 0.5, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Probability that a team wins fewer (or more) than n games.

    The (season, team, wins) histogram is made first: one row per distinct total however many
    scenarios there are. Running sums over it give both shares. n takes the totals that occur, or
    with ``max_wins`` (a number, or a table with one per season) every multiple of ``step`` from 0
    up to it; totals beyond it count for the shares, and are not shown. The multiples are opened
    from the histogram's rows, so that those of a team need not be sorted or held together.
    """
    keys = [*_period(totals), "team"]
    require(totals, *keys, "wins")
    place = F.round(F.col("wins") / step).cast("bigint")
    hist = settle(totals.groupBy(*keys, place.alias("place")).agg(F.count(F.lit(1)).alias("n")))
    places = ordered(hist, keys, ["place"], hot_rows)
    rows = places.running(upto=running_sum("n"), all=group_sum("n"), before=previous("place")).frame
    if max_wins is not None:
        rows = _on_grid(settle(rows), keys, max_wins, step)
    return rows.select(
        *keys,
        (F.col("place") * F.lit(step)).alias("wins"),
        ((F.col("upto") - F.col("n")) / F.col("all")).alias("under_prob"),
        (1.0 - F.col("upto") / F.col("all")).alias("over_prob"),
    )


def _on_grid(rows: DataFrame, keys: list[str], max_wins: int | DataFrame, step: float) -> DataFrame:
    """(keys, place, n, upto, all) of every place from 0 to the top: a row of a total that occurs stands
    for the places since the total before it, at which nothing is added, and for its own."""
    zero = F.lit(0).cast("bigint")
    tops = rows.groupBy(*keys).agg(F.max("place").alias("last"), F.max("all").alias("all"))
    if isinstance(max_wins, DataFrame):
        of = [k for k in max_wins.columns if k in keys]
        # One row a season; without seasons there is one row, which has nothing to be joined on.
        highest = max_wins.groupBy(*of).agg(F.max("max_wins").alias("max_wins"))
        tops = tops.join(highest, of) if of else tops.withColumn("max_wins", max_wins.select("max_wins").scalar())
    else:
        tops = tops.withColumn("max_wins", F.lit(max_wins))
    tops = settle(tops.withColumn("top", F.round(F.col("max_wins") / step).cast("bigint")))
    known = attach(rows, tops.select(*keys, "top"), keys, "inner")

    def ranges(df: DataFrame, low, high, n, upto) -> DataFrame:
        low, high = F.greatest(low, zero), F.least(high, F.col("top"))
        return df.select(*keys, low.alias("low"), high.alias("high"), n.alias("n"), upto.alias("upto"), "all").where("low <= high")

    own, upto, place = F.col("n"), F.col("upto"), F.col("place")
    since = F.coalesce(F.col("before") + 1, zero)
    found = ranges(known.where(place >= 0), place, place, own, upto)
    gaps = ranges(known.where(place >= 0), since, place - 1, zero, upto - own)
    after = ranges(tops, F.coalesce(F.col("last") + 1, zero), F.col("top"), zero, F.col("all"))
    pieces = found.unionByName(gaps).unionByName(after)
    low, high = F.col("low"), F.col("high")
    pieces = pieces.withColumn("low", F.explode(F.sequence(low, high, F.lit(STRETCH)))).withColumn("high", F.least(high, low + (STRETCH - 1)))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # A given number, or the few rows would be put in one task, which would open them all.
    dealt = pieces.repartition(tasks, *keys, "low")
    return dealt.select(*keys, F.explode(F.sequence(low, high)).alias("place"), "n", "upto", "all")


def scenario_overall(
    teams: DataFrame,
    keys: Sequence[str] = ("conf", "division", "team"),
    flags: Sequence[str] = ("playoff", "div1", "seed1", "won_conf", "won_sb"),
) -> DataFrame:
    """Per season (if the rows have one) and team: mean wins and the share of scenarios that reach each flag."""
    require(teams, "wins", *keys, *flags)
    return teams.groupBy(*_period(teams), *keys).agg(
        F.avg("wins").alias("wins"), *[F.avg(F.col(f).cast("double")).alias(f) for f in flags]
    )
