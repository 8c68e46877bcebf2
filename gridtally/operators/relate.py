"""Joins, per-group extremes, ordering, level tables and union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from ..sources.shared import settle
from .columns import require
from .ordered import HOT_ROWS, attach, dense_position, group_sum, ordered, running_count, running_sum

# A lookup table is broadcast only when counting it (no further than this) shows it is small.
BROADCAST_ROWS = 100_000
# Teams of one scenario that may stand in one map.
MAP_TEAMS = 1_000


def fits_broadcast(dim: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if the table has at most ``limit`` rows (counts no further than that)."""
    return dim.limit(limit + 1).count() <= limit


def small(dim: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the table is small; else leave the join to Spark."""
    return F.broadcast(dim) if fits_broadcast(dim, limit) else dim


def left_join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    require(left, *keys)
    require(right, *keys)
    return left.join(right, list(keys), "left")


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the tables have no column in common")
    return keys


def left_join_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column the two tables share."""
    return left_join_on(left, right, common_columns(left, right))


def join_renamed_key(
    left: DataFrame,
    right: DataFrame,
    keys: dict[str, str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join ``left.key = right.value`` for every pair; the right key is dropped and other
    columns that occur on both sides get a suffix."""
    require(left, *keys.keys())
    require(right, *keys.values())
    rest = [c for c in right.columns if c not in keys.values()]
    clash = {c for c in rest if c in left.columns and c not in keys}
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    other = right.select(
        *[F.col(r).alias(f"__r_{l}") for l, r in keys.items()],
        *[F.col(c).alias(c + suffixes[1] if c in clash else c) for c in rest],
    )
    cond = None
    for l in keys:
        part = left[l] == other[f"__r_{l}"]
        cond = part if cond is None else cond & part
    return left.join(other, cond, how).drop(*[f"__r_{l}" for l in keys])


def role_playing_join(games: DataFrame, dim: DataFrame, dim_key: str, roles: dict[str, str]) -> DataFrame:
    """Join one dimension once per role; its columns get the role as suffix.

    ``roles`` maps a key column of ``games`` to the suffix, e.g. ``{"away_team": "_away"}``.
    """
    is_small = fits_broadcast(dim)
    for key, suffix in roles.items():
        role = dim.select(
            F.col(dim_key).alias(key), *[F.col(c).alias(c + suffix) for c in dim.columns if c != dim_key]
        )
        games = games.join(F.broadcast(role) if is_small else role, key, "left")
    return games


def scenario_inner_join(games: DataFrame, ratings: DataFrame, value: str = "pre_game_strength") -> DataFrame:
    """Attach each side's rating of the same scenario (and season, if both tables have one); games
    without a rating go.

    A scenario's ratings become one row with a map by team, so that games are joined, and moved,
    once for both sides. Where a scenario rates more than MAP_TEAMS teams, or a team twice, each
    side is a join of its own instead, with the same rows. NULL keys meet nothing; a NULL rating stays.
    """
    require(games, "sim", "away_team", "home_team")
    require(ratings, "sim", "team", value)
    keys = [c for c in ("season", "sim") if c in games.columns and c in ratings.columns]
    columns = games.columns
    rated = ratings.select(*keys, "team", F.col(value).alias("__value")).where(F.col("team").isNotNull())
    per_team = rated.groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_team.groupBy(*keys).agg(F.count(F.lit(1)).alias("teams"), F.max("n").alias("n"))
    teams, times = sizes.agg(F.max("teams"), F.max("n")).first()
    if (teams or 0) <= MAP_TEAMS and (times or 0) <= 1:
        entries = F.collect_list(F.struct("team", "__value"))
        games = games.join(rated.groupBy(*keys).agg(F.map_from_entries(entries).alias("__ratings")), keys, "inner")
        has = [F.coalesce(F.map_contains_key("__ratings", F.col(f"{s}_team")), F.lit(False)) for s in ("away", "home")]
        own = [F.col("__ratings")[F.col(f"{s}_team")].alias(f"{value}_{s}") for s in ("away", "home")]
        return games.where(has[0] & has[1]).select(*columns, *own)
    for side in ("away", "home"):
        games = games.join(
            rated.select(*keys, F.col("team").alias(f"{side}_team"), F.col("__value").alias(f"{value}_{side}")),
            [*keys, f"{side}_team"],
            "inner",
        )
    return games.select(*columns, f"{value}_away", f"{value}_home")


def inner_join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    require(left, *keys)
    require(right, *keys)
    return left.join(small(right), list(keys), "inner")


def shift_period(df: DataFrame, value: str, renamed: str, period: str = "season") -> DataFrame:
    """Move a table one period on, so that joining it gives the period before."""
    require(df, period, value)
    return df.withColumn(period, F.col(period) + 1).withColumnRenamed(value, renamed)


def prior_period_join(
    df: DataFrame, history: DataFrame, keys: Sequence[str], value: str, renamed: str, period: str = "season"
) -> DataFrame:
    """Value of exactly one period before (a gap gives NULL, unlike a lag)."""
    return left_join_on(df, shift_period(history, value, renamed, period), [period, *keys])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a NULL key meets a NULL key."""
    require(left, *keys)
    require(right, *keys)
    return attach(left, right, keys, how)


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Union by column name; columns a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def sort_multi(df: DataFrame, *keys: str) -> DataFrame:
    """Sort by several keys, ``-name`` for descending, missing values last either way."""
    require(df, *[k.removeprefix("-") for k in keys])
    return df.orderBy(
        *[
            F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last()
            for k in keys
        ]
    )


def _extreme_per_group(df: DataFrame, keys: Sequence[str], order: str, pick) -> DataFrame:
    require(df, order, *keys)
    best = df.groupBy(*keys).agg(pick(order).alias(order))
    return attach(df, best, [*keys, order], "left_semi")


def latest_per_group(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with the greatest value per group, ties kept.

    The extreme is aggregated first (map-side combine, one row per group leaves a task) and
    rows are kept by a semi-join on (group, value). Unlike a rank window, no group and no
    set of ties has to fit one task.
    """
    return _extreme_per_group(df, keys, order, F.max)


def earliest_per_group(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with the least value per group, ties kept."""
    return _extreme_per_group(df, keys, order, F.min)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact quantiles per group (linear between neighbours), one column per entry of ``probs``.

    Works on counts of distinct values: equal values are combined before the shuffle, and the
    running count over the distinct values of a group is cut into blocks when there are too
    many of them, so no task has to hold the values of a group.
    """
    counts = settle(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")))
    placed = ordered(counts, keys, [value], hot_rows).running(__to=running_sum("__c"), __n=group_sum("__c")).frame
    after, upto, v = F.col("__to") - F.col("__c"), F.col("__to"), F.col(value).cast("double")

    def pick(at: Column) -> Column:
        return F.max(F.when((after <= at) & (upto > at), v))

    columns = []
    for name, p in probs.items():
        at = (F.col("__n") - 1) * F.lit(float(p))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        columns.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*keys).agg(*columns)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", hot_rows: int = HOT_ROWS) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, hot_rows)


def level_reorder(
    df: DataFrame,
    label: str,
    value: str | None = None,
    by: str = "median",
    name: str = "level",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per label with its place when labels are ordered by a statistic.

    ``by``: ``median``, ``mean`` or ``min`` of ``value``. Labels with equal statistics share
    a place. The ranking runs over labels, not rows, and is cut into blocks beyond ``hot_rows``.
    """
    require(df, label, value)
    if by == "median":
        stat = exact_median(df, [label], value, "stat", hot_rows)
    else:
        agg = {"mean": F.avg, "min": F.min}[by]
        stat = df.groupBy(label).agg(agg(value).alias("stat"))
    return ordered(settle(stat), [], ["stat"], hot_rows).running(**{name: dense_position()}).frame


def level_table(
    df: DataFrame, value: str, order: Sequence[str], name: str = "ord", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Distinct values numbered by first appearance in the given order.

    First appearances are aggregated per value before anything is shuffled; the numbering runs
    over distinct values, and is cut into blocks beyond ``hot_rows`` of them.
    """
    require(df, value, *order)
    first = settle(
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.min(F.struct(*order)).alias("__at"))
        .select(value, *[F.col("__at").getField(c).alias(c) for c in order])
    )
    rows = ordered(first, [], [*order, value], hot_rows).running(**{name: running_count()}).frame
    return rows.select(value, name)


def known_levels(df: DataFrame, name: str, levels: DataFrame, level: str = "team") -> DataFrame:
    """Turn values outside the level table into NULL."""
    require(df, name)
    known = small(levels.select(F.col(level).alias("__level")).distinct())
    joined = df.join(known, F.col(name) == F.col("__level"), "left")
    return joined.withColumn(name, F.col("__level")).drop("__level")


def top_candidates(df: DataFrame, metric: str, n: int = 5, key: str | None = None) -> DataFrame:
    """The n rows with the smallest metric."""
    require(df, metric)
    order = [F.col(metric).asc_nulls_last()] + ([F.col(key).asc()] if key else [])
    return df.orderBy(*order).limit(n)


def best_candidate(df: DataFrame, metric: str, key: str | None = None) -> DataFrame:
    return top_candidates(df, metric, 1, key)


def distinct_rows(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*[col(c) for c in columns]).distinct()
