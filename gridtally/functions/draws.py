"""Random draws keyed by row content.

No draw depends on partitioning, task order or retries: every one is a function of
(seed, key columns) alone, so a task that is run again gives the same numbers.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, unit_hash


def uniform_draw(*keys: Column | str, seed: int, word: int = 0) -> Column:
    """Uniform on the open interval (0, 1)."""
    return (unit_hash(*keys, seed=seed, word=word).cast("double") + 0.5) / float(2**32)


def draw_key(*keys: Column | str, seed: int, only: Column | None = None) -> Column:
    """60 bits of the md5 of the keys as text, whatever whole-number type they have: one digest a
    row, of which draws take their words by shifts. NULL for rows that are not in ``only``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return key if only is None else F.when(only, key)


def draw_normal(
    mean: Column | str, sd: Column | str | float, *keys: Column | str, seed: int, only: Column | None = None
) -> Column:
    """Normal draw by Box-Muller from the two halves of the row's key; NULL without a key."""
    key = draw_key(*keys, seed=seed, only=only)
    first, second = F.shiftright(key, 30), key.bitwiseAND(F.lit((1 << 30) - 1))
    radius = F.sqrt(F.log((first.cast("double") + 0.5) / float(1 << 30)) * -2.0)
    angle = F.cos((second.cast("double") + 0.5) / float(1 << 30) * (2.0 * math.pi))
    sd = F.lit(float(sd)) if isinstance(sd, (int, float)) else col(sd)
    return col(mean) + sd * radius * angle


def _beta_sampler():
    # Built here so that it travels by value: workers need numpy only.
    def sample(key: pa.Array, alpha: pa.Array, beta: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow

        mask = np.uint64(0xFFFFFFFFFFFFFFFF)

        def mix(x):
            x = x + np.uint64(0x9E3779B97F4A7C15) & mask
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) & mask
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) & mask
            return x ^ (x >> np.uint64(31))

        def uniform(keys, stream):
            bits = mix(keys ^ mix(np.full(keys.shape, stream, dtype=np.uint64)))
            return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(2**53)

        def gamma(keys, shape, lane):
            # Marsaglia-Tsang; each row draws from its own counter until it is accepted.
            boost = shape < 1.0
            d = np.where(boost, shape + 1.0, shape) - 1.0 / 3.0
            c = 1.0 / np.sqrt(9.0 * d)
            out = np.empty(shape.shape)
            todo = np.arange(shape.size)
            turn = 0
            while todo.size:
                k = keys[todo]
                base = lane + 8 * turn
                x = np.sqrt(-2.0 * np.log(uniform(k, base))) * np.cos(2.0 * np.pi * uniform(k, base + 1))
                v = (1.0 + c[todo] * x) ** 3
                safe = np.where(v > 0.0, v, 1.0)
                limit = 0.5 * x * x + d[todo] * (1.0 - v + np.log(safe))
                ok = (v > 0.0) & (np.log(uniform(k, base + 2)) < limit)
                out[todo[ok]] = d[todo[ok]] * v[ok]
                todo = todo[~ok]
                turn += 1
            power = np.where(boost, uniform(keys, lane + 3) ** (1.0 / np.where(boost, shape, 1.0)), 1.0)
            return out * power

        a = alpha.to_numpy(zero_copy_only=False)
        b = beta.to_numpy(zero_copy_only=False)
        keyed = key.is_valid().to_numpy(zero_copy_only=False)
        if not keyed.any() or len(a) == alpha.null_count:
            return pyarrow.nulls(len(a), pyarrow.float64())
        good = keyed & (a > 0.0) & (b > 0.0) & np.isfinite(a) & np.isfinite(b)
        result = np.zeros(a.shape)
        if good.any():
            with np.errstate(over="ignore"):
                k = key.fill_null(0).to_numpy(zero_copy_only=False)[good].astype(np.uint64)
                x = gamma(k, a[good], 0)
                y = gamma(k, b[good], 4)
            result[good] = x / (x + y)
        return pyarrow.array(result, mask=~good)

    return sample


def draw_beta(
    alpha: Column | str, beta: Column | str, *keys: Column | str, seed: int, only: Column | None = None
) -> Column:
    """Beta draw per row, keyed by (seed, keys); NULL when alpha or beta is missing or not positive,
    and for rows that are not in ``only``.

    The rejection step has no closed form, so it runs on Arrow batches with a counter-based
    generator per row.
    """
    udf = F.arrow_udf(_beta_sampler(), "double")
    return udf(draw_key(*keys, seed=seed, only=only), col(alpha).cast("double"), col(beta).cast("double"))
