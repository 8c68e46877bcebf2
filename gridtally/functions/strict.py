"""Aggregates that give NULL as soon as one input is NULL (Spark's own skip it)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def strict(agg: Column, value: Column | str) -> Column:
    return F.when(F.count(col(value)) == F.count(F.lit(1)), agg)


def strict_mean(value: Column | str) -> Column:
    return strict(F.avg(col(value)), value)


def strict_sum(value: Column | str) -> Column:
    return strict(F.sum(col(value)), value)


def strict_sd(value: Column | str) -> Column:
    """Sample standard deviation; NULL for a single row."""
    return strict(F.stddev_samp(col(value)), value)


def strict_share(cond: Column, present: Column | str) -> Column:
    """Mean of an indicator; NULL when any ``present`` value is missing."""
    return strict(F.avg(F.when(cond, 1.0).otherwise(0.0)), present)
