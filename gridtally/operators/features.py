"""Predictors: interactions, dummies, scaling and smooth bases.

A basis column is a product of simple parts. It can be written as SQL (scoring inside the JVM)
and computed from Arrow batches (fitting); the parts are plain values, so a fitted model is a
table that can be stored and read back.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from .columns import require

MAX_LEVELS = 100


def interaction_feature(df: DataFrame, a: str, b: str) -> DataFrame:
    require(df, a, b)
    return df.withColumn(f"{a}_x_{b}", F.col(a) * F.col(b))


def find_levels(df: DataFrame, name: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct values; an error when there are more than a model can take."""
    require(df, name)
    found = df.select(name).where(F.col(name).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{name} has more than {max_levels} levels")
    return sorted(r[0] for r in found)


def dummy_encode(df: DataFrame, name: str, levels: Sequence, drop_first: bool = True) -> DataFrame:
    """0/1 columns ``<name>_<level>`` for the given levels; a missing value gives NULL."""
    require(df, name)
    c = F.col(name)
    return df.withColumns(
        {f"{name}_{v}": (c == F.lit(v)).cast("double") for v in list(levels)[1 if drop_first else 0 :]}
    )


def zero_variance(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns that hold a single value (or none)."""
    require(df, *names)
    row = df.agg(*[F.max(F.col(n)).eqNullSafe(F.min(F.col(n))).alias(n) for n in names]).first()
    return [n for n in names if row[n]]


def drop_zero_variance(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*zero_variance(df, names))


def scaling_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: mean and sample standard deviation of each column."""
    require(df, *names)
    return df.agg(
        *[F.avg(n).alias(f"{n}__mean") for n in names], *[F.stddev_samp(n).alias(f"{n}__sd") for n in names]
    )


def standardize(df: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """(x - mean) / sd with the statistics of another (training) table."""
    require(df, *names)
    one = stats.select(F.struct("*").alias("s"))
    rows = df.withColumn("__stats", one.scalar())
    s = F.col("__stats")
    return rows.withColumns(
        {n: F.try_divide(F.col(n) - s.getField(f"{n}__mean"), s.getField(f"{n}__sd")) for n in names}
    ).drop("__stats")


@dataclass(frozen=True)
class Part:
    """One factor of a basis column.

    With ``level``: 1 where the column equals it, else 0 (also for NULL). Otherwise z^power with
    z = (column - center) / scale, or max(z - knot, 0)^power when there is a knot.
    """

    column: str
    center: float = 0.0
    scale: float = 1.0
    power: int = 1
    knot: float | None = None
    level: str | int | None = None

    @property
    def sql(self) -> str:
        if self.level is not None:
            text = repr(self.level)
            if isinstance(self.level, str):
                text = "'" + self.level.replace("\\", "\\\\").replace("'", "\\'") + "'"
            return f"(CASE WHEN `{self.column}` = {text} THEN 1.0D ELSE 0.0D END)"
        z = f"((`{self.column}` - ({self.center!r}D)) / {self.scale!r}D)"
        if self.knot is not None:
            z = f"greatest({z} - ({self.knot!r}D), 0.0D)"
        return "(" + " * ".join([z] * self.power) + ")"


@dataclass(frozen=True)
class Basis:
    """One model column, and the penalty block it belongs to (None: not penalised)."""

    name: str
    parts: tuple[Part, ...]
    block: str | None = None

    @property
    def sql(self) -> str:
        return " * ".join(p.sql for p in self.parts)

    @property
    def column(self) -> Column:
        return F.expr(self.sql)

    @property
    def level_part(self) -> Part | None:
        return next((p for p in self.parts if p.level is not None), None)

    def to_json(self) -> str:
        return json.dumps([asdict(p) for p in self.parts])

    @classmethod
    def from_json(cls, name: str, text: str, block: str | None) -> Basis:
        return cls(name, tuple(Part(**p) for p in json.loads(text)), block)


@dataclass(frozen=True)
class Smooth:
    """Place, scale and knots (in scaled units) of a smooth of one column."""

    column: str
    center: float
    scale: float
    knots: tuple[float, ...]

    def z(self, power: int = 1) -> Part:
        return Part(self.column, self.center, self.scale, power)

    def hinge(self, knot: float) -> Part:
        return Part(self.column, self.center, self.scale, 3, knot)


def find_smooths(df: DataFrame, names: Sequence[str], n_knots: int = 5) -> dict[str, Smooth]:
    """Centre, scale and quantile knots of every column, in one aggregate."""
    require(df, *names)
    probs = [(i + 1) / (n_knots + 1) for i in range(n_knots)]
    aggs = []
    for n in names:
        aggs += [
            F.avg(n).alias(f"{n}__m"),
            F.stddev_samp(n).alias(f"{n}__s"),
            F.percentile_approx(n, probs, 1_000).alias(f"{n}__q"),
        ]
    row = df.agg(*aggs).first()
    out = {}
    for n in names:
        m, s = row[f"{n}__m"], row[f"{n}__s"]
        if m is None or not s:
            raise ValueError(f"{n} does not vary, so no smooth can be built on it")
        knots = sorted({round((float(q) - m) / s, 6) for q in row[f"{n}__q"]})
        out[n] = Smooth(n, float(m), float(s), tuple(knots))
    return out


def spline_basis(s: Smooth, block: str | None = None) -> list[Basis]:
    """Cubic truncated-power basis of the scaled column: z, z^2, z^3 and one cube per knot.

    Columns from z^2 on carry the smoothness penalty.
    """
    block = block or f"s({s.column})"
    parts = [s.z(1), s.z(2), s.z(3), *[s.hinge(k) for k in s.knots]]
    return [
        Basis(f"{s.column}.{i}", (part,), f"{block}:linear" if i == 1 else block)
        for i, part in enumerate(parts, start=1)
    ]


def tensor_interaction(a: Smooth, b: Smooth, block: str | None = None) -> list[Basis]:
    """Products of small marginal bases (z and one cube at the middle knot of each column)."""
    block = block or f"ti({a.column},{b.column})"

    def margin(s: Smooth) -> list[Part]:
        return [s.z(), s.hinge(s.knots[len(s.knots) // 2] if s.knots else 0.0)]

    return [
        Basis(f"{a.column}:{b.column}.{i}{j}", (x, y), block)
        for i, x in enumerate(margin(a), start=1)
        for j, y in enumerate(margin(b), start=1)
    ]


def random_effect(name: str, levels: Sequence, slope: Smooth | None = None) -> list[Basis]:
    """Ridge-shrunk column per level, or slope of another column per level.

    A level not in the list (or NULL) gets 0 in every column: the population value.
    """
    if slope is None:
        return [Basis(f"{name}[{v}]", (Part(name, level=v),), f"re({name})") for v in levels]
    return [
        Basis(f"{name}[{v}]:{slope.column}", (Part(name, level=v), slope.z()), f"re({name},{slope.column})")
        for v in levels
    ]


def factor_basis(name: str, levels: Sequence) -> list[Basis]:
    """Unpenalised 0/1 columns for every level but the first."""
    return [Basis(b.name, b.parts, None) for b in random_effect(name, list(levels)[1:])]


def basis_columns(df: DataFrame, basis: Sequence[Basis], keep: Sequence[str]) -> DataFrame:
    """Kept columns followed by the basis columns ``b0, b1, ...``."""
    return df.select(*[col(k) for k in keep], *[b.column.cast("double").alias(f"b{i}") for i, b in enumerate(basis)])


@dataclass(frozen=True)
class Packing:
    """The few columns a basis is computed from, and how.

    Only these travel to the Arrow batches: a number per numeric column and the place in the
    level list (0: none) per labelled column, in place of one number per basis column.
    """

    numbers: tuple[str, ...]
    labels: tuple[str, ...]
    levels: dict[str, tuple]
    recipe: tuple

    @classmethod
    def of(cls, basis: Sequence[Basis]) -> Packing:
        numbers: list[str] = []
        levels: dict[str, list] = {}
        for b in basis:
            for p in b.parts:
                if p.level is None:
                    if p.column not in numbers:
                        numbers.append(p.column)
                elif p.level not in levels.setdefault(p.column, []):
                    levels[p.column].append(p.level)
        labels = list(levels)
        recipe = tuple(
            tuple(
                (numbers.index(p.column), p.center, p.scale, p.power, p.knot)
                if p.level is None
                else (len(numbers) + labels.index(p.column), levels[p.column].index(p.level) + 1)
                for p in b.parts
            )
            for b in basis
        )
        return cls(tuple(numbers), tuple(labels), {k: tuple(v) for k, v in levels.items()}, recipe)

    def columns(self) -> list[Column]:
        """Packed columns ``x0, x1, ...``; NULL only where a numeric column is missing."""
        place = [
            F.coalesce(F.array_position(F.array(*[F.lit(v) for v in self.levels[n]]), F.col(n)), F.lit(0))
            for n in self.labels
        ]
        out = [F.col(n) for n in self.numbers] + place
        return [c.cast("double").alias(f"x{i}") for i, c in enumerate(out)]

    def design(self):
        """A function from a packed matrix to the model matrix, intercept first."""
        recipe = self.recipe

        def build(m):
            import numpy

            out = numpy.ones((len(m), len(recipe) + 1), order="F")
            for i, parts in enumerate(recipe, start=1):
                for part in parts:
                    if len(part) == 2:
                        out[:, i] *= m[:, part[0]] == part[1]
                        continue
                    at, center, scale, power, knot = part
                    z = (m[:, at] - center) / scale
                    if knot is not None:
                        z = numpy.maximum(z - knot, 0.0)
                    for _ in range(power):
                        out[:, i] *= z
            return out

        return build
