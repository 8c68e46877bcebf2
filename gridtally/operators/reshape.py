"""Wide to long and back."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import require

PREFIX_FORM = r"(.+)_(.+)"
SUFFIX_FORM = r"(.*)_(.)"


def _split_names(names: Sequence[str], pattern: str, value_first: bool) -> tuple[list[str], list[str], dict]:
    sides: list[str] = []
    values: list[str] = []
    source: dict[tuple[str, str], str] = {}
    for n in names:
        m = re.fullmatch(pattern, n)
        if m is None:
            raise ValueError(f"column {n!r} does not match {pattern!r}")
        value, side = m.groups() if value_first else m.groups()[::-1]
        if side not in sides:
            sides.append(side)
        if value not in values:
            values.append(value)
        source[side, value] = n
    return sides, values, source


def _to_long(df: DataFrame, names: Sequence[str], set_name: str, pattern: str, value_first: bool) -> DataFrame:
    require(df, *names)
    sides, values, source = _split_names(names, pattern, value_first)
    types = {v: df.schema[source[s, v]].dataType for s, v in source}
    keep = [c for c in df.columns if c not in names]
    rows = [
        F.struct(
            F.lit(s).alias(set_name),
            *[
                (F.col(source[s, v]) if (s, v) in source else F.lit(None).cast(types[v])).alias(v)
                for v in values
            ],
        )
        for s in sides
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def sides_to_long(df: DataFrame, names: Sequence[str], set_name: str = "set") -> DataFrame:
    """``away_team, away_score, home_team, ...`` to one row per side with ``team, score``."""
    return _to_long(df, names, set_name, PREFIX_FORM, value_first=False)


def suffix_to_long(df: DataFrame, names: Sequence[str], set_name: str = "set") -> DataFrame:
    """``team_1, elo_1, team_2, ...`` to one row per side with ``team, elo``."""
    return _to_long(df, names, set_name, SUFFIX_FORM, value_first=True)


def unpivot_simple(df: DataFrame, names: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    require(df, *names)
    keep = [c for c in df.columns if c not in names]
    return df.unpivot(keep, list(names), names_to, values_to)


def long_to_sides(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    set_name: str = "set",
    sides: Sequence[str] = ("away", "home"),
) -> DataFrame:
    """One row per key with ``<value>_<side>`` columns; key columns may be NULL.

    One conditional aggregate, so a single shuffle on the keys with map-side combine. A key
    has one row per side; ``max`` keeps the result repeatable if that is ever broken.
    """
    require(df, set_name, *keys, *values)
    cells = [
        F.max(F.when(F.col(set_name) == s, F.col(v))).alias(f"{v}_{s}") for v in values for s in sides
    ]
    return df.groupBy(*keys).agg(*cells)
