"""Column management and row filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *names: str) -> DataFrame:
    """Raise a clear error when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {', '.join(missing)}; found {', '.join(df.columns)}")
    return df


def select_cols(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Keep columns; ``new=old`` keeps a column under a new name."""
    require(df, *names, *renamed.values())
    return df.select(*names, *[F.col(old).alias(new) for new, old in renamed.items()])


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    require(df, first, last)
    i, j = df.columns.index(first), df.columns.index(last)
    return df.columns[i : j + 1] if i <= j else df.columns[j : i + 1][::-1]


def select_range(df: DataFrame, *ranges: tuple[str, str] | str) -> DataFrame:
    """Keep columns by position: single names or (first, last) pairs."""
    names: list[str] = []
    for r in ranges:
        for n in [r] if isinstance(r, str) else column_range(df, *r):
            if n not in names:
                names.append(n)
    return df.select(*names)


def drop_cols(df: DataFrame, *names: str) -> DataFrame:
    require(df, *names)
    return df.drop(*names)


def select_prefix(df: DataFrame, prefix: str, keep: bool = True) -> DataFrame:
    """Keep (or, with ``keep=False``, leave out) the columns whose name starts with ``prefix``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.startswith(prefix) == keep])


def rename_cols(df: DataFrame, **new_to_old: str) -> DataFrame:
    require(df, *new_to_old.values())
    return df.withColumnsRenamed({old: new for new, old in new_to_old.items()})


def relocate_cols(df: DataFrame, *names: str, before: str | None = None, after: str | None = None) -> DataFrame:
    """Move columns to the front, or next to another column."""
    require(df, *names)
    rest = [c for c in df.columns if c not in names]
    if before is not None:
        at = rest.index(before)
    elif after is not None:
        at = rest.index(after) + 1
    else:
        at = 0
    return df.select(*rest[:at], *names, *rest[at:])


def label_from_lookup(df: DataFrame, lookup: DataFrame, where: Column, value: Column, name: str) -> DataFrame:
    """Put one value of a small lookup table on every row, without a trip to the driver.

    The lookup is reduced to one row by the aggregate, the least value if several rows meet the
    condition, so what is joined to every row is one value whatever the lookup holds.
    """
    one = lookup.where(where).agg(F.min(value).alias(name))
    return df.withColumn(name, one.scalar())


def derive_cols(df: DataFrame, **exprs: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Add or overwrite columns one after another, so later ones see earlier ones."""
    for name, e in exprs.items():
        df = df.withColumn(name, e(df) if callable(e) else e)
    return df


def apply_across(df: DataFrame, names: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    require(df, *names)
    return df.withColumns({n: fn(F.col(n)) for n in names})


def append_struct(df: DataFrame, value: Column, prefix: str = "") -> DataFrame:
    """Append every field of a struct-valued expression, computed once per row."""
    tmp = "__appended"
    out = df.withColumn(tmp, value)
    fields = out.schema[tmp].dataType.fieldNames()
    taken = [c for c in df.columns if f"{prefix}{c}" not in fields and c not in [prefix + f for f in fields]]
    return out.select(*taken, *[F.col(tmp).getField(f).alias(prefix + f) for f in fields])


def constant_col(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({n: F.lit(v) for n, v in values.items()})


def cast_cols(df: DataFrame, **types: str) -> DataFrame:
    """Cast columns by name; a cast to a whole-number type truncates."""
    require(df, *types)
    return df.withColumns({n: F.col(n).cast(t) for n, t in types.items()})


def filter_range(df: DataFrame, name: str, low=None, high=None, high_open: bool = False) -> DataFrame:
    """Keep low <= value <= high (``high_open``: value < high); either bound may be left out."""
    require(df, name)
    c = F.col(name)
    if low is not None:
        df = df.where(c >= F.lit(low))
    if high is not None:
        df = df.where(c < F.lit(high)) if high_open else df.where(c <= F.lit(high))
    return df


def filter_team_games(df: DataFrame, team: str, last_week: int = 18) -> DataFrame:
    """Games of one team, at home or away, up to a week."""
    require(df, "home_team", "away_team", "week")
    plays = (F.col("home_team") == team) | (F.col("away_team") == team)
    return df.where(plays & (F.col("week") <= last_week))


def filter_without(df: DataFrame, keep: Column, without: Column) -> DataFrame:
    """Rows that meet one condition and not another (rows where either is NULL go)."""
    return df.where(keep & ~without)


def filter_started(df: DataFrame) -> DataFrame:
    """First-week rows and every played row."""
    require(df, "week", "result")
    return df.where((F.col("week") == 1) | F.col("result").isNotNull())


def filter_equal(df: DataFrame, **values: object) -> DataFrame:
    require(df, *values)
    for n, v in values.items():
        df = df.where(F.col(n) == F.lit(v))
    return df


def drop_incomplete(df: DataFrame, *names: str) -> DataFrame:
    """Drop rows with a NULL or NaN in any (given) column."""
    return df.na.drop("any", subset=list(names) or None)

