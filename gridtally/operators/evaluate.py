"""Regression metrics, correlation and straight-line fits, each as one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import require


def _pairs(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    require(df, truth, estimate)
    return df.where(F.col(truth).isNotNull() & F.col(estimate).isNotNull())


def _metric_columns(truth: str, estimate: str) -> list[Column]:
    t, e = F.col(truth).cast("double"), F.col(estimate).cast("double")
    r2 = F.try_divide(F.pow(F.covar_samp(t, e), F.lit(2.0)), F.var_samp(t) * F.var_samp(e))
    return [
        F.sqrt(F.avg((t - e) * (t - e))).alias("rmse"),
        r2.alias("rsq"),
        F.avg(F.abs(t - e)).alias("mae"),
    ]


def _metrics_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate")) for m in ("rmse", "rsq", "mae")
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def grouped_metrics(df: DataFrame, keys: Sequence[str], truth: str = "truth", estimate: str = "estimate") -> DataFrame:
    """rmse, rsq (squared Pearson) and mae per group, one row each; incomplete pairs go."""
    wide = _pairs(df, truth, estimate).groupBy(*keys).agg(*_metric_columns(truth, estimate))
    return _metrics_long(wide, keys)


def regression_metrics(df: DataFrame, truth: str = "truth", estimate: str = "estimate") -> DataFrame:
    return grouped_metrics(df, [], truth, estimate)


def resample_metrics(df: DataFrame, fold: str = "fold", truth: str = "truth", estimate: str = "estimate") -> DataFrame:
    """Mean and standard error of each metric across folds."""
    by_fold = grouped_metrics(df, [fold], truth, estimate)
    return by_fold.groupBy("metric").agg(
        F.avg("estimate").alias("mean"),
        F.count("estimate").alias("n"),
        (F.stddev_samp("estimate") / F.sqrt(F.count("estimate"))).alias("std_err"),
    )


def correlation_pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation with n, t and a 95 % interval (Fisher's z).

    All pairs of columns come out of one aggregate; a pair uses the rows complete for it.
    """
    require(df, *names)
    rows = []
    for i, (a, b) in enumerate(combinations(names, 2)):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        scale = F.stddev_samp(x) * F.stddev_samp(y)
        rows.append(
            F.struct(
                F.lit(a).alias("parameter1"),
                F.lit(b).alias("parameter2"),
                F.count(x).alias("n_obs"),
                F.try_divide(F.covar_samp(x, y), scale).alias("r"),
            )
        )
    long = df.agg(F.array(*rows).alias("__pairs")).select(F.inline("__pairs"))
    n, r = F.col("n_obs").cast("double"), F.col("r")
    z = F.when(F.abs(r) < 1.0, 0.5 * F.log((1.0 + r) / (1.0 - r)))
    half = F.when(n > 3, F.lit(1.959963984540054) / F.sqrt(n - 3.0))
    back = lambda v: (F.exp(2.0 * v) - 1.0) / (F.exp(2.0 * v) + 1.0)
    return long.select(
        "*",
        F.try_divide(r * F.sqrt(n - 2.0), F.sqrt(F.greatest(1.0 - r * r, F.lit(0.0)))).alias("t"),
        back(z - half).alias("ci_low"),
        back(z + half).alias("ci_high"),
    )


def group_linear_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line per group; NULL where x does not vary."""
    require(df, x, y, *keys)
    return df.groupBy(*keys).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
        F.regr_count(F.col(y), F.col(x)).alias("n"),
    )
