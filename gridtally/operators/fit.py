"""Model fitting from sums gathered on executors.

Rows never leave the executors: a fit needs sums of products only (p x p numbers, whatever
the number of rows), and only those reach the driver, for the p x p solve.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import settle
from .columns import require
from .features import Basis, Packing, Smooth
from .ordered import attach

MAX_COLUMNS = 400
MAX_LEVEL_COLUMNS = 20
MAX_FOLDS = 100


class NotConverged(RuntimeError):
    """A fit that ran out of steps."""


def _stored_rows(df: DataFrame) -> list:
    """The rows of a stored model by place; more than the columns a model may have is an error."""
    rows = df.orderBy("pos").limit(MAX_COLUMNS + 2).collect()
    if not 0 < len(rows) <= MAX_COLUMNS + 1:
        raise ValueError(f"a stored model has 1 to {MAX_COLUMNS + 1} rows, this table {len(rows)} or more")
    return rows


@contextmanager
def held(df: DataFrame):
    """Keep a table that is read several times for the length of a block. Blocks that are lost
    with an executor are computed again from the source."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


# ---------------------------------------------------------------- linear model


@dataclass(frozen=True)
class LinearModel:
    target: str
    features: tuple[str, ...]
    intercept: float
    coef: tuple[float, ...]
    sigma: float
    n: int

    def column(self) -> Column:
        """The prediction as an expression of the feature columns."""
        out = F.lit(self.intercept)
        for name, b in zip(self.features, self.coef):
            out = out + F.col(name) * F.lit(b)
        return out

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        require(df, *self.features)
        return df.withColumn(name, self.column())

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(0, "(intercept)", self.intercept)] + [
            (i, f, b) for i, (f, b) in enumerate(zip(self.features, self.coef), start=1)
        ]
        return spark.createDataFrame(rows, "pos int, term string, estimate double").withColumns(
            {"target": F.lit(self.target), "sigma": F.lit(self.sigma), "n": F.lit(self.n).cast("long")}
        )

    @classmethod
    def from_frame(cls, df: DataFrame) -> LinearModel:
        rows = _stored_rows(df)
        return cls(
            rows[0]["target"],
            tuple(r["term"] for r in rows[1:]),
            rows[0]["estimate"],
            tuple(r["estimate"] for r in rows[1:]),
            rows[0]["sigma"],
            rows[0]["n"],
        )


@dataclass
class _Sums:
    """Count, sums and sums of products of shifted columns; they add and subtract."""

    n: int
    first: np.ndarray
    second: np.ndarray

    def __add__(self, other: _Sums) -> _Sums:
        return _Sums(self.n + other.n, self.first + other.first, self.second + other.second)

    def __sub__(self, other: _Sums) -> _Sums:
        return _Sums(self.n - other.n, self.first - other.first, self.second - other.second)

    def solve(self, target: str, features: Sequence[str], shift: Sequence[float]) -> LinearModel:
        n, p = self.n, len(features)
        if n <= p + 1:
            raise ValueError(f"{n} complete rows cannot carry {p} features")
        mean = self.first / n
        gram = self.second - n * np.outer(mean, mean)
        xx, xy, yy = gram[:p, :p], gram[:p, p], gram[p, p]
        scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
        beta = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-12)[0] / scale
        center = mean + np.array(shift)
        rss = max(float(yy - beta @ xy), 0.0)
        return LinearModel(
            target,
            tuple(features),
            float(center[p] - beta @ center[:p]),
            tuple(float(b) for b in beta),
            math.sqrt(rss / (n - p - 1)),
            int(n),
        )


def _linear_sums(df: DataFrame, names: Sequence[str], by: str | None) -> tuple[list[float], dict[object, _Sums]]:
    """Sums per value of ``by`` around the overall means: two aggregates, so that large means do
    not cost digits."""
    k = len(names)
    if k > MAX_COLUMNS + 1:
        raise ValueError(f"{k - 1} features; the solve on the driver is meant for at most {MAX_COLUMNS}")
    keep = [F.col(by)] if by else []
    rows = df.select(*keep, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    rows = rows.na.drop("any", subset=[f"v{i}" for i in range(k)])
    head = rows.agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(k)]).first()
    shift = [head[f"m{i}"] or 0.0 for i in range(k)]
    dev = [F.col(f"v{i}") - F.lit(m) for i, m in enumerate(shift)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    table = rows.groupBy(*keep).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(dev[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)],
        *[F.coalesce(F.sum(dev[i] * dev[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in pairs],
    )
    out = {}
    for r in table.limit(MAX_FOLDS + 1).collect():
        second = np.zeros((k, k))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"g{i}_{j}"]
        out[r[by] if by else None] = _Sums(r["n"], np.array([r[f"s{i}"] for i in range(k)]), second)
    if len(out) > MAX_FOLDS:
        raise ValueError(f"{by} has more than {MAX_FOLDS} values")
    return shift, out


def linear_fit(df: DataFrame, target: str, features: Sequence[str]) -> LinearModel:
    """Least squares with an intercept; rows with a missing value are left out.

    Features that are constant or repeat others get the least-norm solution.
    """
    require(df, target, *features)
    shift, sums = _linear_sums(df, [*features, target], None)
    return sums[None].solve(target, features, shift)


def linear_fit_without_folds(df: DataFrame, target: str, features: Sequence[str], fold: str = "fold") -> dict[object, LinearModel]:
    """For every fold the model fitted on the other folds, from one set of sums per fold."""
    require(df, target, fold, *features)
    shift, sums = _linear_sums(df, [*features, target], fold)
    whole = sum(list(sums.values())[1:], start=next(iter(sums.values())))
    return {f: (whole - s).solve(target, features, shift) for f, s in sorted(sums.items())}


def predict_held_out(df: DataFrame, models: dict[object, LinearModel], fold: str = "fold", name: str = "pred") -> DataFrame:
    """Every row scored by the model fitted without its fold."""
    out = F.lit(None).cast("double")
    for f, m in models.items():
        out = F.when(F.col(fold) == F.lit(f), m.column()).otherwise(out)
    return df.withColumn(name, out)


def residual_sigma(df: DataFrame, truth: str, estimate: str, n_features: int, name: str = "sigma") -> DataFrame:
    """sqrt(RSS / (n - p - 1)) as a one-row table."""
    require(df, truth, estimate)
    pairs = df.where(F.col(truth).isNotNull() & F.col(estimate).isNotNull())
    gap = F.col(truth).cast("double") - F.col(estimate).cast("double")
    return pairs.agg(
        F.sqrt(F.try_divide(F.sum(gap * gap), F.count(F.lit(1)) - F.lit(n_features + 1))).alias(name)
    )


# ---------------------------------------------------------- sums over partitions


#: Vectors that a task adds up, where the root of their number is not more.
FAN = 16


def sum_vectors(
    df: DataFrame, make: Callable[[], Callable], size: int, keys: int = 1, read: Callable | None = None
) -> np.ndarray:
    """Sums of fixed-length vectors computed from Arrow batches: ``keys`` of them, a row each.

    ``make()`` gives a function from a float matrix (rows x columns of ``df``), or from what ``read`` makes
    of a batch, to a matrix of ``keys`` x ``size``. Each task adds up its batches and emits a vector for each key. Tasks of their
    own add up to about the root of their number (but no fewer than FAN) each, key by key, and so on
    while a key has more than FAN vectors; the driver adds the last few. What reaches any one
    process is bounded by the size and the root of the number of tasks, not by the number of rows.
    The driver fetches one partition after the other, so the rows are read before a shuffle: all
    their tasks run at once, and only sums are left to be fetched.
    """
    fn = make()

    def part(batches):
        import numpy
        import pyarrow

        total = numpy.zeros((keys, size))
        for b in batches:
            if b.num_rows:
                m = read(b) if read else numpy.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                total += numpy.reshape(fn(m), (keys, size))
        rows = [total[k].tobytes() for k in range(keys)]
        yield pyarrow.RecordBatch.from_arrays([pyarrow.array(range(keys), pyarrow.int32()), pyarrow.array(rows, pyarrow.binary())], ["k", "v"])

    def merge(batches):
        import numpy
        import pyarrow

        totals: dict = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = numpy.frombuffer(v.as_buffer(), dtype="float64")
                totals[k] = totals[k] + x if k in totals else x
        rows = [v.tobytes() for v in totals.values()]
        yield pyarrow.RecordBatch.from_arrays([pyarrow.array(list(totals), pyarrow.int32()), pyarrow.array(rows, pyarrow.binary())], ["k", "v"])

    partials, left, place = df.mapInArrow(part, "k int, v binary"), df.rdd.getNumPartitions(), F.spark_partition_id()
    enough = 1
    while left > enough:
        width = -(-left // max(FAN, math.isqrt(left)))
        slots = partials.withColumn("slot", (F.pmod(place, F.lit(width)) * keys + F.col("k")).cast("int"))
        partials = slots.repartitionById(width * keys, "slot").select("k", "v").mapInArrow(merge, "k int, v binary")
        left, place = width, F.floor(F.spark_partition_id() / keys)  # a task of a level holds one key
        enough = FAN
    out = np.zeros((keys, size))
    for row in partials.toLocalIterator():
        out[row["k"]] += np.frombuffer(bytes(row["v"]), dtype="float64")
    return out


def _symmetric(upper: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = upper
    return out + np.triu(out, 1).T


# ------------------------------------------------------------ logistic smooth fit


@dataclass(frozen=True)
class SmoothModel:
    """Logit-link model of a share: basis columns, coefficients and their covariance."""

    target: str
    basis: tuple[Basis, ...]
    beta: np.ndarray = field(repr=False)
    cov: np.ndarray = field(repr=False)
    dispersion: float
    edf: float
    deviance: float
    n: int
    steps: int
    converged: bool = True

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """Response-scale prediction as a JVM expression; NULL when a predictor is missing.

        Columns per level of a label become one lookup of the coefficient by the row's level.
        """
        eta = F.lit(float(self.beta[0]))
        by_label: dict[tuple[str, str], list[tuple[object, float]]] = {}
        for b, v in zip(self.basis, self.beta[1:]):
            label = b.level_part
            if label is None:
                eta = eta + b.column * F.lit(float(v))
            else:
                rest = " * ".join(p.sql for p in b.parts if p is not label) or "1.0D"
                by_label.setdefault((label.column, rest), []).append((label.level, float(v)))
        for (label, rest), pairs in by_label.items():
            place = F.array_position(F.array(*[F.lit(k) for k, _ in pairs]), F.col(label)).cast("int")
            value = F.get(F.array(*[F.lit(v) for _, v in pairs]), place - 1)
            eta = eta + F.coalesce(value, F.lit(0.0)) * F.expr(rest)
        return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))

    def predict_with_se(self, df: DataFrame, level: float = 0.95) -> DataFrame:
        """Append ``pred, std_error, pred_lower, pred_upper`` in one step.

        The standard error is on the response scale (delta method); the interval is built on
        the link scale and mapped back, so it stays inside (0, 1). A quadratic form per row is
        a matrix product per Arrow batch.
        """
        if not 0 < level < 1:
            raise ValueError(f"a confidence level lies between 0 and 1, not at {level}")
        z = NormalDist().inv_cdf(0.5 + level / 2)
        packing = Packing.of(self.basis)
        score = F.pandas_udf(
            _scorer(packing.design(), self.beta, self.cov, z),
            "pred double, std_error double, pred_lower double, pred_upper double",
        )
        packed = F.struct(*packing.columns())
        out = df.withColumn("__score", score(packed))
        s = F.col("__score")
        return out.withColumns(
            {n: s.getField(n) for n in ("pred", "std_error", "pred_lower", "pred_upper")}
        ).drop("__score")

    def to_frame(self, spark: SparkSession) -> DataFrame:
        names = ["(intercept)", *[b.name for b in self.basis]]
        parts = ["[]", *[b.to_json() for b in self.basis]]
        blocks = [None, *[b.block for b in self.basis]]
        rows = [
            (i, names[i], parts[i], blocks[i], float(self.beta[i]), [float(v) for v in self.cov[i]])
            for i in range(len(names))
        ]
        schema = "pos int, term string, parts string, block string, estimate double, covariance array<double>"
        return spark.createDataFrame(rows, schema).withColumns(
            {
                "target": F.lit(self.target),
                "dispersion": F.lit(self.dispersion),
                "edf": F.lit(self.edf),
                "deviance": F.lit(self.deviance),
                "n": F.lit(self.n).cast("long"),
                "steps": F.lit(self.steps),
                "converged": F.lit(self.converged),
            }
        )

    @classmethod
    def from_frame(cls, df: DataFrame) -> SmoothModel:
        rows = _stored_rows(df)
        head = rows[0]
        return cls(
            head["target"],
            tuple(Basis.from_json(r["term"], r["parts"], r["block"]) for r in rows[1:]),
            np.array([r["estimate"] for r in rows]),
            np.array([r["covariance"] for r in rows]),
            head["dispersion"],
            head["edf"],
            head["deviance"],
            head["n"],
            head["steps"],
            head["converged"],
        )


def _scorer(design, beta: np.ndarray, cov: np.ndarray, z: float):
    beta, cov = np.array(beta), np.array(cov)

    def score(cols: pd.DataFrame) -> pd.DataFrame:
        import numpy
        import pandas

        m = cols.to_numpy(dtype="float64", na_value=numpy.nan)
        x = design(m)
        eta = x @ beta
        se = numpy.sqrt(numpy.maximum(((x @ cov) * x).sum(axis=1), 0.0))
        inv = lambda v: 1.0 / (1.0 + numpy.exp(-v))
        mu = inv(eta)
        out = pandas.DataFrame(
            {
                "pred": mu,
                "std_error": mu * (1.0 - mu) * se,
                "pred_lower": inv(eta - z * se),
                "pred_upper": inv(eta + z * se),
            }
        )
        return out.astype("Float64").where(pandas.DataFrame({c: ~numpy.isnan(mu) for c in out.columns}))

    return score


def penalty_diagonal(basis: Sequence[Basis], smoothing: dict[str, float] | float, select: float = 0.0) -> np.ndarray:
    """Ridge penalty per coefficient (intercept first).

    ``smoothing`` is one multiplier for every block or one per block name; ``select`` is the
    share of it put on the linear part of a smooth, so that a useless term can shrink to 0.
    """
    out = [0.0]
    for b in basis:
        if b.block is None:
            out.append(0.0)
            continue
        name, _, part = b.block.partition(":")
        lam = smoothing.get(name, 0.0) if isinstance(smoothing, dict) else smoothing
        out.append(lam * select if part == "linear" else lam)
    return np.array(out)


def _solve(gram: np.ndarray, right: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and the inverse of the penalised Gram matrix, on a unit diagonal for accuracy."""
    full = gram + np.diag(penalty)
    d = np.sqrt(np.where(np.diag(full) > 0, np.diag(full), 1.0))
    inverse = np.linalg.pinv(full / np.outer(d, d), rcond=1e-13, hermitian=True) / np.outer(d, d)
    return inverse @ right, inverse


def _working(design, beta: np.ndarray | None):
    """Sums for one reweighted least-squares step at ``beta`` (None: the usual start), from rows
    of the target and the packed columns."""
    beta = None if beta is None else np.array(beta)

    def step(m):
        import numpy

        y = m[:, 0]
        x = design(m[:, 1:])
        if beta is None:
            mu = (y + 0.5) / 2.0
            eta = numpy.log(mu / (1.0 - mu))
        else:
            eta = numpy.clip(x @ beta, -30.0, 30.0)
            mu = 1.0 / (1.0 + numpy.exp(-eta))
        w = mu * (1.0 - mu)
        z = eta + (y - mu) / w
        xw = x * w[:, None]
        safe = numpy.where(y > 0, y, 1.0)
        rest = numpy.where(y < 1, 1.0 - y, 1.0)
        deviance = 2.0 * (y * numpy.log(safe / mu) + (1.0 - y) * numpy.log(rest / (1.0 - mu))).sum()
        pearson = ((y - mu) ** 2 / w).sum()
        return numpy.concatenate([(xw.T @ x)[numpy.triu_indices(x.shape[1])], xw.T @ z, [deviance, pearson, len(m)]])

    return lambda: step


def smooth_fit(
    df: DataFrame,
    target: str,
    basis: Sequence[Basis],
    smoothing: dict[str, float] | float = 0.0,
    select: float = 0.0,
    quasi: bool = False,
    max_steps: int = 25,
    tolerance: float = 1e-9,
    must_converge: bool = True,
) -> SmoothModel:
    """Penalised logit fit of a share in [0, 1] by reweighted least squares.

    One pass over the rows per step; a pass returns the upper triangle of the (p + 1)^2 sums. With ``quasi`` the
    dispersion is estimated (Pearson chi-square / (n - edf)) and scales the covariance;
    otherwise it is 1. Rows with a missing value are left out.

    A step that makes the penalised deviance larger is halved. A fit that has not settled after
    ``max_steps`` raises ``NotConverged``, or with ``must_converge=False`` is returned with
    ``converged`` false.
    """
    require(df, target)
    packing = Packing.of(basis)
    design, size = packing.design(), _sums_of(len(basis) + 1)
    columns = df.select(F.col(target).cast("double").alias("y"), *packing.columns()).na.drop("any")
    with held(columns) as rows:
        return _reweighted(
            lambda beta: sum_vectors(rows, _working(design, beta), size)[0],
            target, basis, smoothing, select, quasi, max_steps, tolerance, must_converge,
        )


def _sums_of(p: int) -> int:
    """The numbers a reweighted step of ``p`` columns adds up."""
    if p > MAX_COLUMNS:
        raise ValueError(f"{p} columns; the solve on the driver is meant for at most {MAX_COLUMNS}")
    return p * (p + 1) // 2 + p + 3


def _reweighted(
    sums: Callable[[np.ndarray | None], np.ndarray], target: str, basis: Sequence[Basis], smoothing, select: float, quasi: bool,
    max_steps: int = 25, tolerance: float = 1e-9, must_converge: bool = True,
) -> SmoothModel:
    """The steps of ``smooth_fit``; ``sums`` gives those of a step at given coefficients (None: at the start)."""
    p = len(basis) + 1
    penalty = penalty_diagonal(basis, smoothing, select)
    beta, last, before, steps, converged = None, None, math.inf, 0, False
    half = p * (p + 1) // 2
    while True:
        total = sums(beta)
        gram, right = _symmetric(total[:half], p), total[half : half + p]
        deviance, pearson, n = total[half + p :]
        if n == 0:
            raise ValueError("no complete rows to fit on")
        new, inverse = _solve(gram, right, penalty)
        objective = deviance + (0.0 if beta is None else float(penalty @ beta**2))
        slack = tolerance * (abs(objective) + 0.1)
        converged = beta is not None and abs(before - objective) <= slack
        if converged or steps >= max_steps:
            break
        steps += 1
        if last is not None and objective > before + slack:
            beta = (beta + last) / 2.0
            continue
        before, last, beta = (objective if beta is not None else math.inf), beta, new
    if not converged and must_converge:
        raise NotConverged(f"no settled fit after {steps} steps; the data may be separable without a penalty")
    edf = float(np.trace(inverse @ gram))
    dispersion = float(pearson / max(n - edf, 1.0)) if quasi else 1.0
    return SmoothModel(
        target, tuple(basis), beta, inverse * dispersion, dispersion, edf, float(deviance), int(n), steps, bool(converged)
    )


def binomial_smooth_fit(df: DataFrame, target: str, basis: Sequence[Basis], smoothing=0.0, select: float = 0.0) -> SmoothModel:
    return smooth_fit(df, target, basis, smoothing, select, quasi=False)


def quasibinomial_smooth_fit(df: DataFrame, target: str, basis: Sequence[Basis], smoothing=0.0, select: float = 0.0) -> SmoothModel:
    return smooth_fit(df, target, basis, smoothing, select, quasi=True)


def default_grid(size: int = 20) -> list[float]:
    """Smoothing multipliers spread evenly on a log scale from 0.001 to 1,000."""
    return [10.0 ** (-3.0 + 6.0 * i / (size - 1)) for i in range(size)]


def fold_values(df: DataFrame, fold: str) -> list[float]:
    """The folds that occur, in order: 1 to MAX_FOLDS of them and none missing, else an error."""
    named = [r[0] for r in df.select(F.col(fold).cast("double")).distinct().limit(MAX_FOLDS + 1).collect()]
    if None in named or not 0 < len(named) <= MAX_FOLDS:
        raise ValueError(f"{fold} has to have 1 to {MAX_FOLDS} values and none missing")
    return sorted(named)


def _fold_rows(df: DataFrame, target: str, basis: Sequence[Basis], fold: str) -> DataFrame:
    """Fold, target and packed columns of the complete rows."""
    keep = [F.col(fold).cast("double").alias("f"), F.col(target).cast("double").alias("y")]
    return df.select(*keep, *Packing.of(basis).columns()).na.drop("any")


def _sums_by_fold(rows: DataFrame, named: Sequence[float], step: Callable, p: int) -> np.ndarray:
    """The sums of a reweighted step, a row per fold."""
    folds, one = len(named), p * (p + 1) // 2 + p + 3

    def by_fold():
        def fn(m):
            import numpy

            out = numpy.zeros((folds, one))
            for f, value in enumerate(named):
                mine = m[m[:, 0] == value]
                if len(mine):
                    out[f] = step(mine[:, 1:])
            return out

        return fn

    return sum_vectors(rows, by_fold, one, folds)


def _normal_equations(sums: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    half = p * (p + 1) // 2
    return _symmetric(sums[:half], p), sums[half : half + p]


def grid_search(
    df: DataFrame,
    target: str,
    basis: Sequence[Basis],
    fold: str = "fold",
    folds: int | None = None,
    grid: Sequence[float] | None = None,
    select: float = 0.0,
) -> DataFrame:
    """Cross-validated rmse of every smoothing multiplier.

    The folds are the values of ``fold`` in the rows; a missing one, or more than MAX_FOLDS, is an
    error, and so is one that is not 1 to ``folds`` where that is given.

    Candidates x folds would be hundreds of fits. Instead the Gram matrix of each fold is taken
    once, at the fit of all folds; leaving a fold out is a subtraction, a candidate is one
    solve on the driver, and one last pass scores every row with the candidates fitted
    without its fold. The data is read once per step of the first fit and twice more,
    whatever the size of the grid.
    """
    require(df, target, fold)
    grid = list(grid) if grid is not None else default_grid()
    p, c = len(basis) + 1, len(grid)
    named = fold_values(df, fold)
    if folds is not None and not set(named) <= set(range(1, folds + 1)):
        raise ValueError(f"{fold} has values other than 1 to {folds}")
    folds = len(named)
    base = smooth_fit(df, target, basis, 1.0, select)
    design = Packing.of(basis).design()
    with held(_fold_rows(df, target, basis, fold)) as rows:
        parts = _sums_by_fold(rows, named, _working(design, base.beta)(), p)
        whole = parts.sum(axis=0)
        betas = np.zeros((folds, p, c))
        for f in range(folds):
            gram, right = _normal_equations(whole - parts[f], p)
            for j, lam in enumerate(grid):
                betas[f, :, j] = _solve(gram, right, penalty_diagonal(basis, lam, select))[0]

        def score():
            def fn(m):
                import numpy

                out = numpy.zeros((folds, c + 1))
                for f, value in enumerate(named):
                    mine = m[m[:, 0] == value]
                    if len(mine):
                        x = design(mine[:, 2:])
                        mu = 1.0 / (1.0 + numpy.exp(-numpy.clip(x @ betas[f], -30.0, 30.0)))
                        out[f, :c] = ((mine[:, 1:2] - mu) ** 2).sum(axis=0)
                        out[f, c] = len(mine)
                return out

            return fn

        errors = sum_vectors(rows, score, c + 1, folds)
    used = errors[errors[:, c] > 0]
    rmse = np.sqrt(used[:, :c] / used[:, c:])
    err = rmse.std(axis=0, ddof=1) / math.sqrt(len(used)) if len(used) > 1 else np.full(c, np.nan)
    table = [(j + 1, float(grid[j]), float(rmse[:, j].mean()), int(len(used)), float(err[j])) for j in range(c)]
    return df.sparkSession.createDataFrame(
        table, "candidate int, smoothing double, rmse double, folds int, std_err double"
    )


# ------------------------------------------------ fits on a join that is not made

#: Rows of either side in a block, and in a block that is opened into a row for each pair.
BLOCK_ROWS = 1 << 14
OPEN_ROWS = 1 << 11
#: Pairs of rows a task weighs at a time, and pairs and rows meant for one task.
CELLS = 1 << 17
TASK_CELLS = 1 << 28
TASK_ROWS = 500_000
OPEN_CELLS = 1 << 23
#: Places at which sums over the right rows are taken in a stretch of the linear predictor, and its length. The
#: nearest poles of the logit's inverse are pi from the line, so an error of 6.4 ** -NODES is left.
NODES = 22
STRETCH = 2.0
#: Buckets a range of values is cut into while a quantile is looked for, and the share of all rows it may be off by.
BUCKETS = 4_096
QUANTILE_SHARE = 1e-4


def pair_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(keys, n_left, n_right) of every key of either side, stored, and the rows of ``left`` joined to ``right``,
    rows without a match kept."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    mine, theirs = count(left, "n_left"), count(right, "n_right")
    only = attach(theirs, mine, keys, "left_anti").withColumn("n_left", F.lit(0).cast("bigint"))
    both = attach(mine, theirs, keys).fillna(0, ["n_right"]).unionByName(only)
    counts = settle(both)
    total = counts.agg(F.sum(F.col("n_left") * F.greatest("n_right", F.lit(1)))).first()[0]
    return counts, total or 0


def _blocks(df: DataFrame, counts: DataFrame, n: str, keys: Sequence[str], name: str, size: int | None = None) -> DataFrame:
    """(keys, name): the other columns of a stored table's rows as arrays of about ``size`` rows of one key."""
    values = [c for c in df.columns if c not in keys]
    placed = attach(df.withColumn("__id", F.monotonically_increasing_id()), counts.select(*keys, n), keys, "inner")
    slot = F.pmod("__id", F.ceil(F.col(n) / (size or BLOCK_ROWS))).alias("__slot")
    return placed.groupBy(*keys, slot).agg(F.collect_list(F.struct(*values)).alias(name)).drop("__slot")


def _block_reader():
    """A function from a batch of two arrays of structs to pairs of matrices."""

    def read(batch):
        import numpy

        sides = []
        for column in batch.columns:
            m = numpy.column_stack([c.to_numpy(zero_copy_only=False) for c in column.flatten().flatten()])
            sides.append(numpy.split(m, numpy.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]))
        return list(zip(*sides))

    return read


@dataclass(frozen=True)
class _Sides:
    """The columns of a model on joined rows, each a column of a left design times one of a right design.

    ``which`` names the right column of every model column (0: the intercept); ``place`` puts the model columns
    that share one beside each other, and ``own`` is where those of each right column lie then.
    """

    left: Packing
    right: Packing
    which: np.ndarray
    place: np.ndarray
    own: tuple[slice, ...]

    @classmethod
    def of(cls, basis: Sequence[Basis], theirs: set[str]) -> _Sides:
        parts = [(tuple(q for q in b.parts if q.column not in theirs), tuple(q for q in b.parts if q.column in theirs)) for b in basis]
        kinds = list(dict.fromkeys([(), *[r for _, r in parts]]))
        which = np.array([0, *[kinds.index(r) for _, r in parts]])
        ends = np.cumsum([0, *np.bincount(which, minlength=len(kinds))])
        return cls(
            Packing.of([Basis("", a) for a, _ in parts]),
            Packing.of([Basis("", r) for r in kinds[1:]]),
            which,
            np.argsort(which, kind="stable"),
            tuple(slice(int(a), int(b)) for a, b in zip(ends, ends[1:])),
        )

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return [(k, j) for k in range(len(self.own)) for j in range(k, len(self.own))]

    def weights(self, x: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """What each right column is multiplied with in a left row's linear predictor (``beta`` and the columns of ``x``
        in their places). Added up number by number, so that equal rows have equal weights."""
        out = np.zeros((len(x), len(self.own)), order="F")
        for k, c in enumerate(self.own):
            for i in range(c.start, c.stop):
                out[:, k] += x[:, i] * beta[i]
        return out


def _sums_over_right(weights: np.ndarray, b: np.ndarray, products: np.ndarray, clip: float | None = 30.0) -> np.ndarray:
    """For every row of weights, sums over the rows of the right design ``b``, whose linear predictor with it is e: w times each
    product of two columns, w e - mu times each column, -log(mu), e, exp(-e) and exp(e). All pairs are weighed."""
    n, kinds = products.shape[1], b.shape[1]
    out = np.zeros((len(weights), n + kinds + 4))
    step = max(1, CELLS // max(1, min(len(weights), CELLS)))
    for to in range(0, len(b), step):
        right, both = b[to : to + step], products[to : to + step]
        rows = max(1, CELLS // len(right))
        for lo in range(0, len(weights), rows):
            eta = weights[lo : lo + rows] @ right.T
            if clip is not None:
                np.clip(eta, -clip, clip, out=eta)
            odds = np.exp(-eta)
            whole = 1.0 + odds
            mu = 1.0 / whole
            w = mu * (1.0 - mu)
            some = out[lo : lo + rows]
            some[:, :n] += w @ both
            some[:, n + kinds + 1] += eta.sum(axis=1)
            some[:, n + kinds + 2] += odds.sum(axis=1)
            some[:, n + kinds + 3] += np.divide(1.0, odds, out=odds).sum(axis=1)
            some[:, n + kinds] += np.log(whole, out=whole).sum(axis=1)
            w *= eta
            w -= mu
            some[:, n : n + kinds] += w @ right
    return out


def _sums_by_stretch(weights: np.ndarray, b: np.ndarray, products: np.ndarray) -> np.ndarray:
    """``_sums_over_right`` without weighing all pairs, where left rows share their weights of all right columns but the first.

    For such rows the sums depend on the first weight alone and are smooth in it. They are taken at NODES places
    of each stretch of its range, and the polynomial through these (Chebyshev) gives every row's, to rounding errors.
    Rows that are fewer than the places, or whose linear predictor may be clipped, are weighed pair by pair.
    """
    a, slopes = weights[:, 0], weights[:, 1:]
    mixed = np.zeros(len(a))
    for k in range(slopes.shape[1]):
        mixed += slopes[:, k] * math.sqrt(2.0 + k)
    _, first, group, times = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    often = times > NODES
    low, high = np.zeros(len(first)), np.zeros(len(first))
    for g in np.flatnonzero(often):
        part = b[:, 1:] @ slopes[first[g]]
        low[g], high[g] = part.min(), part.max()
    # One more than a stretch to either side is where the places may lie.
    fit = often[group] & (slopes == slopes[first[group]]).all(axis=1) & (a + low[group] > STRETCH - 30.0) & (a + high[group] < 30.0 - STRETCH)
    out = np.empty((len(a), products.shape[1] + b.shape[1] + 4))
    at = np.flatnonzero(fit)
    if len(at):
        piece = np.floor(a[at] / STRETCH)
        order = np.lexsort((piece, group[at]))
        at, piece = at[order], piece[order]
        new = np.flatnonzero(np.r_[True, (np.diff(piece) != 0) | (np.diff(group[at]) != 0)])
        sizes = np.diff(np.r_[new, len(at)])
        fit[at[np.repeat(sizes <= NODES, sizes)]] = False
        cells = [(lo, lo + size) for lo, size in zip(new, sizes) if size > NODES]
        if cells:
            angle = np.pi * (np.arange(NODES) + 0.5) / NODES
            middle = np.array([(piece[lo] + 0.5) * STRETCH for lo, _ in cells])
            places = np.repeat(weights[[at[lo] for lo, _ in cells]], NODES, axis=0)
            places[:, 0] = (middle[:, None] + np.cos(angle) * (STRETCH / 2.0)).ravel()
            values = _sums_over_right(places, b, products, None).reshape(len(cells), NODES, -1)
            turn = np.cos(np.outer(np.arange(NODES), angle)) * (2.0 / NODES)
            turn[0] /= 2.0
            for (lo, hi), center, value in zip(cells, middle, values):
                z = (a[at[lo:hi]] - center) / (STRETCH / 2.0)
                out[at[lo:hi]] = np.polynomial.chebyshev.chebvander(z, NODES - 1) @ (turn @ value)
    rest = np.flatnonzero(~fit)
    if len(rest):
        out[rest] = _sums_over_right(weights[rest], b, products)
    return out


def _joined_working(sides: _Sides, beta: np.ndarray | None):
    """``_working`` for all pairs of a row of the one and a row of the other matrix of every block.

    Sums over a left row's pairs are products of its columns with the sums over the right rows of their weights times
    the few products of right columns: no pair gets a row of model columns, and pairs are weighed only where left rows
    have no weights in common (``_sums_by_stretch``).
    """
    beta = None if beta is None else np.array(beta)[sides.place]
    left_design, right_design = sides.left.design(), sides.right.design()

    def step(blocks):
        import numpy

        p, kinds, own, pairs = len(sides.which), len(sides.own), sides.own, sides.pairs
        gram, right, rest = numpy.zeros((p, p)), numpy.zeros(p), numpy.zeros(3)
        for m, other in blocks:
            b = right_design(other)
            products = numpy.column_stack([b[:, k] * b[:, j] for k, j in pairs])
            y, x, n = m[:, 0], left_design(m[:, 1:])[:, sides.place], len(b)
            if beta is None:
                mu = (y + 0.5) / 2.0
                eta, w = numpy.log(mu / (1.0 - mu)), mu * (1.0 - mu)
                s, t = numpy.outer(w, products.sum(axis=0)), numpy.outer(w * eta + (y - mu), b.sum(axis=0))
                unlike = n * ((1.0 - y) * eta - numpy.log(mu)).sum()
                pearson = n * ((y - mu) ** 2 / w).sum()
            else:
                sums = _sums_by_stretch(sides.weights(x, beta), b, products)
                s, t = sums[:, : len(pairs)], sums[:, len(pairs) : -4] + numpy.outer(y, b.sum(axis=0))
                # -log(1 - mu) is e - log(mu), and (y - mu)^2 / w is y^2 exp(-e) + (1 - y)^2 exp(e) - 2 y (1 - y).
                unlike = (sums[:, -4] + (1.0 - y) * sums[:, -3]).sum()
                pearson = (y * y * sums[:, -2] + (1.0 - y) ** 2 * sums[:, -1] - 2.0 * n * y * (1.0 - y)).sum()
            # What is left of the deviance depends on the left row alone.
            safe, left = numpy.where(y > 0, y, 1.0), numpy.where(y < 1, 1.0 - y, 1.0)
            unlike += n * (y * numpy.log(safe) + (1.0 - y) * numpy.log(left)).sum()
            rest += (2.0 * unlike, pearson, len(y) * n)
            for k, mine in enumerate(own):
                later = x[:, mine.start :].copy()
                for j in range(k, kinds):
                    later[:, own[j].start - mine.start : own[j].stop - mine.start] *= s[:, pairs.index((k, j)), None]
                block = x[:, mine].T @ later
                gram[mine, mine.start :] += block
                gram[mine.stop :, mine] += block[:, mine.stop - mine.start :].T
                right[mine] += x[:, mine].T @ t[:, k]
        whole, equal = numpy.zeros((p, p)), numpy.zeros(p)
        whole[numpy.ix_(sides.place, sides.place)], equal[sides.place] = gram, right
        return numpy.concatenate([whole[numpy.triu_indices(p)], equal, rest])

    return lambda: step


def joined_smooth_fit(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    counts: DataFrame,
    target: str,
    basis: Sequence[Basis],
    smoothing: dict[str, float] | float = 0.0,
    select: float = 0.0,
    quasi: bool = False,
) -> SmoothModel:
    """``smooth_fit`` on every row of ``left`` with every row of ``right`` of equal keys, without making these rows.

    Both are stored tables, ``counts`` their ``pair_counts``; the target is on the left, and columns of
    ``right`` are taken from there. Rows of a key are put into blocks, and blocks of the two sides are paired, so that
    what is kept grows with the tables. A step's sums over the right rows are smooth in a left row's linear predictor, so its
    time grows with the tables too where many left rows share what is multiplied with columns of ``right`` (``_joined_working``).
    """
    sides = _Sides.of(basis, set(right.columns) - set(keys))
    size = _sums_of(len(basis) + 1)
    complete = lambda df, *cols: df.select(*keys, *cols).na.drop("any", subset=df.select(*cols).columns)
    a = _blocks(complete(left, F.col(target).cast("double").alias("y"), *sides.left.columns()), counts, "n_left", keys, "a")
    b = _blocks(complete(right, *sides.right.columns()), counts, "n_right", keys, "b")
    cells, rows = counts.agg(F.sum(F.col("n_left") * F.col("n_right")), F.sum("n_left")).first()
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-(cells or 0) // TASK_CELLS), -(-(rows or 0) // TASK_ROWS))
    with held(attach(a, b, keys, "inner").select("a", "b").repartition(int(tasks))) as blocks:
        return _reweighted(
            lambda beta: sum_vectors(blocks, _joined_working(sides, beta), size, read=_block_reader())[0],
            target, basis, smoothing, select, quasi,
        )


def joined_predict_with_se(
    model: SmoothModel, left: DataFrame, right: DataFrame, keys: Sequence[str], counts: DataFrame
) -> DataFrame:
    """(keys, pred, std_error) of every row of ``left`` with every row of ``right`` of equal keys, or without any.

    Both are stored tables, ``counts`` their ``pair_counts``. The variance of a row's linear predictor is a quadratic form in
    the few right columns, with coefficients of the left row; these are computed once for a left row, so that a pair costs their
    products and not one with the whole covariance. Blocks of rows are paired and opened where they lie.
    """
    keys = list(keys)
    sides = _Sides.of(model.basis, set(right.columns) - set(keys))
    a = _blocks(left.select(*keys, *sides.left.columns()), counts, "n_left", keys, "a", OPEN_ROWS)
    b = _blocks(right.select(*keys, *sides.right.columns()), counts, "n_right", keys, "b")
    cells = counts.agg(F.sum(F.col("n_left") * F.greatest("n_right", F.lit(1)))).first()[0] or 0
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-cells // OPEN_CELLS))
    blocks = attach(a, b, keys).select(*keys, "a", "b").repartition(int(tasks))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*keys).schema)
    return blocks.mapInArrow(_pair_scorer(sides, model.beta, model.cov, keys), f"{kinds}, pred double, std_error double")


def _pair_scorer(sides: _Sides, beta: np.ndarray, cov: np.ndarray, keys: list[str]):
    left_design, right_design = sides.left.design(), sides.right.design()
    beta, cov = np.array(beta)[sides.place], np.array(cov)[np.ix_(sides.place, sides.place)]

    def matrix(rows):
        import numpy

        return numpy.column_stack([c.to_numpy(zero_copy_only=False) for c in rows.flatten()])

    def score(batches):
        import numpy
        import pyarrow

        own, pairs = sides.own, sides.pairs
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                x = left_design(matrix(named["a"][i].values))[:, sides.place]
                if named["b"][i].is_valid:
                    b = right_design(matrix(named["b"][i].values))
                else:
                    b = numpy.full((1, len(own)), numpy.nan)
                weights = sides.weights(x, beta)
                products = numpy.column_stack([b[:, k] * b[:, j] * (1.0 if k == j else 2.0) for k, j in pairs])
                form = numpy.column_stack([((x[:, own[k]] @ cov[own[k], own[j]]) * x[:, own[j]]).sum(axis=1) for k, j in pairs])
                rows = max(1, CELLS // len(b))
                for lo in range(0, len(x), rows):
                    mu = 1.0 / (1.0 + numpy.exp(-(weights[lo : lo + rows] @ b.T).ravel()))
                    se = mu * (1.0 - mu) * numpy.sqrt(numpy.maximum((form[lo : lo + rows] @ products.T).ravel(), 0.0))
                    missing = numpy.isnan(mu)
                    out = [pyarrow.repeat(named[k][i], len(mu)) for k in keys]
                    out += [pyarrow.array(v, mask=missing) for v in (mu, se)]
                    yield pyarrow.RecordBatch.from_arrays(out, [*keys, "pred", "std_error"])

    return score


def weighted_smooths(df: DataFrame, names: Sequence[str], weight: str, n_knots: int = 5) -> dict[str, Smooth]:
    """``find_smooths`` where every row stands for ``weight`` rows, a whole number.

    A quantile's range is cut into BUCKETS whose weights are added up, and the bucket it falls into is the next
    range, until that holds one value or QUANTILE_SHARE of all rows, or is too narrow to show in a knot.
    """
    require(df, weight, *names)
    probs, each = [(i + 1) / (n_knots + 1) for i in range(n_knots)], range(len(names))
    columns = [F.col(weight).cast("double").alias("w"), *[F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)]]
    with held(df.select(*columns).where("w > 0")) as rows:
        w, v = F.col("w"), [F.col(f"v{i}") for i in each]
        known = [F.when(v[i].isNotNull(), w) for i in each]
        head = rows.agg(
            *[F.sum(known[i]).alias(f"n{i}") for i in each],
            *[F.try_divide(F.sum(w * v[i]), F.sum(known[i])).alias(f"m{i}") for i in each],
            *[F.min(v[i]).alias(f"a{i}") for i in each],
            *[F.max(v[i]).alias(f"b{i}") for i in each],
        ).first()
        for i, n in enumerate(names):
            if head[f"m{i}"] is None or head[f"a{i}"] == head[f"b{i}"]:
                raise ValueError(f"{n} does not vary, so no smooth can be built on it")
        spread = rows.agg(*[F.sum(w * (v[i] - F.lit(head[f"m{i}"])) ** 2).alias(f"s{i}") for i in each]).first()
        scale = [math.sqrt(spread[f"s{i}"] / max(head[f"n{i}"] - 1.0, 1.0)) for i in each]
        # Of each quantile: the column, the rank, the range (open below), and the weight up to the range.
        found = [
            [i, math.ceil(p * head[f"n{i}"] - 1e-9), float(np.nextafter(head[f"a{i}"], -np.inf)), head[f"b{i}"], 0.0]
            for i in each
            for p in probs
        ]
        left = found
        while left:
            asked = sorted({i for i, *_ in left})
            ranges = list(dict.fromkeys((asked.index(q[0]), q[2], q[3]) for q in left))
            edges = [np.append(np.linspace(low, high, BUCKETS + 1)[1:-1], high) for _, low, high in ranges]
            sums = sum_vectors(rows.select("w", *[v[i] for i in asked]), _bucket_weights(ranges, edges), BUCKETS * len(ranges))[0].reshape(-1, BUCKETS)
            more = []
            for q in left:
                at = ranges.index((asked.index(q[0]), q[2], q[3]))
                upto, edge = q[4] + np.cumsum(sums[at]), edges[at]
                b = min(int(np.searchsorted(upto, q[1])), BUCKETS - 1)
                if b:
                    q[2], q[4] = float(edge[b - 1]), upto[b - 1]
                q[3] = float(edge[b])
                if sums[at][b] > QUANTILE_SHARE * head[f"n{q[0]}"] and max(np.nextafter(q[2], np.inf), q[2] + 1e-9 * scale[q[0]]) < q[3]:
                    more.append(q)
            left = more
    out = {}
    for i, n in enumerate(names):
        m, s = head[f"m{i}"], scale[i]
        out[n] = Smooth(n, m, s, tuple(sorted({round((q[3] - m) / s, 6) for q in found if q[0] == i})))
    return out


def _bucket_weights(ranges: list[tuple[int, float, float]], edges: list[np.ndarray]):
    """Weights (the first column) by bucket, for one range of one of the other columns after the other."""

    def fn(m):
        import numpy

        out = numpy.zeros((len(ranges), len(edges[0])))
        for row, ((i, low, high), edge) in enumerate(zip(ranges, edges)):
            v = m[:, 1 + i]
            inside = (v > low) & (v <= high)
            out[row] = numpy.bincount(numpy.searchsorted(edge, v[inside]), m[inside, 0], len(edge))
        return out

    return lambda: fn


# ------------------------------------------------------------ out-of-fold scoring


@dataclass(frozen=True)
class FoldModels:
    """A logit-link model of a share for each fold, fitted on the rows of the other folds."""

    basis: tuple[Basis, ...]
    fold: str
    named: tuple[float, ...]
    betas: np.ndarray = field(repr=False)

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """Every row scored by the model that has not seen its fold; NULL where the fold is missing or
        was not fitted, or a predictor is missing."""
        require(df, self.fold)
        packing = Packing.of(self.basis)
        score = F.pandas_udf(_fold_scorer(packing.design(), self.named, self.betas), "double")
        packed = F.struct(F.col(self.fold).cast("double").alias("f"), *packing.columns())
        return df.withColumn(name, score(packed))


def _fold_scorer(design, named: Sequence[float], betas: np.ndarray):
    named, betas = tuple(named), np.array(betas)

    def score(cols: pd.DataFrame) -> pd.Series:
        import numpy
        import pandas

        m = cols.to_numpy(dtype="float64", na_value=numpy.nan)
        out = numpy.full(len(m), numpy.nan)
        for value, beta in zip(named, betas):
            mine = m[:, 0] == value
            out[mine] = 1.0 / (1.0 + numpy.exp(-(design(m[mine, 1:]) @ beta)))
        return pandas.Series(out).astype("Float64").mask(numpy.isnan(out))

    return score


def smooth_fit_without_folds(
    df: DataFrame,
    target: str,
    basis: Sequence[Basis],
    fold: str = "fold",
    smoothing: dict[str, float] | float = 0.0,
    select: float = 0.0,
) -> FoldModels:
    """For every fold the model of the other folds: one reweighted step from the fit of all of them.

    The sums of that step are taken once per fold; leaving a fold out is a subtraction and a solve on
    the driver. The rows are read once more than for the one fit, whatever the number of folds. The
    step leaves out terms of the second order in what a fold changes.
    """
    require(df, target, fold)
    named, p = fold_values(df, fold), len(basis) + 1
    if len(named) < 2:
        raise ValueError(f"{fold} has one value only; without it no rows are left")
    base = smooth_fit(df, target, basis, smoothing, select)
    penalty = penalty_diagonal(basis, smoothing, select)
    with held(_fold_rows(df, target, basis, fold)) as rows:
        parts = _sums_by_fold(rows, named, _working(Packing.of(basis).design(), base.beta)(), p)
    whole = parts.sum(axis=0)
    betas = np.array([_solve(*_normal_equations(whole - part, p), penalty)[0] for part in parts])
    return FoldModels(tuple(basis), fold, tuple(named), betas)


# ------------------------------------------------- random effects of many levels


@dataclass(frozen=True)
class LevelModel:
    """A model with one ridge-shrunk intercept for each level of a label, of any number: the fixed
    columns' coefficients (intercept first) here, the levels' effects in a stored table."""

    target: str
    level: str
    basis: tuple[Basis, ...]
    beta: np.ndarray = field(repr=False)
    effects: DataFrame = field(repr=False)
    logit: bool
    n: int
    steps: int

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """A level that was not fitted, or NULL, gets the population value."""
        rows = attach(df, self.effects, [self.level], "left")
        eta = F.lit(float(self.beta[0])) + F.coalesce("effect", F.lit(0.0))
        for b, v in zip(self.basis, self.beta[1:]):
            eta = eta + b.column * F.lit(float(v))
        return rows.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)) if self.logit else eta).drop("effect")


def level_effect_fit(
    df: DataFrame,
    target: str,
    basis: Sequence[Basis],
    level: str,
    penalty: float,
    logit: bool = True,
    max_steps: int = 25,
    tolerance: float = 1e-9,
) -> LevelModel:
    """Penalised fit of fixed columns and a random intercept per level, without a column per level.

    The normal equations are block-sparse: the levels' part is diagonal. A step adds up, per level and
    map-side combined, the sums of weights w, of w x and of w z; a level's effect is then eliminated
    (Schur complement), so that only sums of p x p products reach the driver, and the effects come
    back as a table by level. With ``logit`` the target is a share in [0, 1] and steps go on until
    the largest change of a linear predictor's part is below ``tolerance``; otherwise one step of
    least squares is the fit. Rows with a missing value are left out.
    """
    require(df, target, level)
    p = len(basis) + 1
    if p > MAX_LEVEL_COLUMNS:
        raise ValueError(f"{p} fixed columns; their products are columns of an aggregate, meant for at most {MAX_LEVEL_COLUMNS}")
    if penalty <= 0:
        raise ValueError("levels and the intercept can only be told apart with a penalty above 0")
    xs = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, p)]]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    columns = [F.col(level).alias("level"), F.col(target).cast("double").alias("y")]
    columns += [b.column.cast("double").alias(f"x{i}") for i, b in enumerate(basis, start=1)]
    beta, effects, steps = None, None, 0
    with held(df.select(*columns).na.drop("any")) as rows:
        while True:
            mu, eta = F.col("y"), F.col("y")
            now = rows
            if logit and beta is None:
                mu = (F.col("y") + 0.5) / 2.0
                eta = F.log(mu / (1.0 - mu))
            elif logit:
                now = now.join(effects, "level")
                eta = sum((F.lit(float(v)) * x for v, x in zip(beta, xs)), F.col("effect"))
                eta = F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))
                mu = 1.0 / (1.0 + F.exp(-eta))
            weight = mu * (1.0 - mu) if logit else F.lit(1.0)
            now = now.select("level", "y", *[x.alias(f"x{i}") for i, x in enumerate(xs) if i], mu.alias("mu"), eta.alias("eta"))
            now = now.withColumn("w", weight if not logit else F.col("mu") * (1.0 - F.col("mu")))
            wz = F.col("w") * F.col("eta") + (F.col("y") - F.col("mu"))
            sums = [F.sum(F.col("w") * xs[i] * xs[j]).alias(f"a{i}_{j}") for i, j in pairs]
            sums += [F.sum(wz * x).alias(f"t{i}") for i, x in enumerate(xs)]
            by_level = settle(now.groupBy("level").agg(F.count(F.lit(1)).alias("n"), *sums))
            # a0_i is the level's row of the mixed block, a0_0 + penalty its own.
            own = F.col("a0_0") + F.lit(float(penalty))
            total = by_level.agg(
                F.sum("n").alias("n"),
                *[F.sum(F.col(f"a{i}_{j}") - F.col(f"a0_{i}") * F.col(f"a0_{j}") / own).alias(f"a{i}_{j}") for i, j in pairs],
                *[F.sum(F.col(f"t{i}") - F.col(f"a0_{i}") * F.col("t0") / own).alias(f"t{i}") for i in range(p)],
            ).first()
            if not total["n"]:
                raise ValueError("no complete rows to fit on")
            gram = np.zeros((p, p))
            for i, j in pairs:
                gram[i, j] = gram[j, i] = total[f"a{i}_{j}"]
            new = _solve(gram, np.array([total[f"t{i}"] for i in range(p)]), np.zeros(p))[0]
            fixed = sum((F.col(f"a0_{i}") * F.lit(float(v)) for i, v in enumerate(new)), F.lit(0.0))
            found = settle(by_level.select("level", ((F.col("t0") - fixed) / own).alias("effect")))
            steps += 1
            moved = math.inf if beta is None else float(np.abs(new - beta).max())
            if beta is not None and moved <= tolerance:
                both = found.join(effects.withColumnRenamed("effect", "before"), "level")
                moved = both.agg(F.max(F.abs(F.col("effect") - F.col("before")))).first()[0]
            beta, effects = new, found
            if not logit or moved <= tolerance:
                break
            if steps >= max_steps:
                raise NotConverged(f"no settled fit after {steps} steps")
    table = effects.withColumnRenamed("level", level)
    return LevelModel(target, level, tuple(basis), beta, table, logit, int(total["n"]), steps)
