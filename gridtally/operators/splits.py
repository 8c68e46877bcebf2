"""Train/test splits and folds decided by a hash of the row key.

A row's side depends on its key and the seed alone - not on partitions, order or retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unit_hash
from .columns import require
from .relate import exact_quantiles

TRAIN_SHARE = 0.75
FOLDS = 10
_SLOTS_BITS = 16


def random_split(df: DataFrame, key: Sequence[str], seed: int, share: float = TRAIN_SHARE) -> DataFrame:
    """Add ``split``: train for about ``share`` of the keys, else test. No shuffle."""
    require(df, *key)
    bucket = unit_hash(*key, seed=seed) % 100
    return df.withColumn("split", F.when(bucket < int(round(share * 100)), "train").otherwise("test"))


def group_split(df: DataFrame, group: str, seed: int, share: float = TRAIN_SHARE) -> DataFrame:
    """As ``random_split``, with all rows of one group on one side."""
    return random_split(df, [group], seed, share)


def kfold(df: DataFrame, key: Sequence[str], seed: int, folds: int = FOLDS) -> DataFrame:
    """Add ``fold``, 1 to ``folds``, from another word of the digest than splits are, so that folds
    do not depend on a split by the same key and seed. No shuffle."""
    require(df, *key)
    return df.withColumn("fold", (unit_hash(*key, seed=seed, word=1) % folds + 1).cast("int"))


def quantile_bins(df: DataFrame, value: str, bins: int = 4, name: str = "stratum") -> DataFrame:
    """Bin a numeric column (1 to ``bins``) at its exact quantiles, found from counts of distinct values."""
    require(df, value)
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    cuts = exact_quantiles(df.select(value), [], value, probs).select(F.array(*probs).alias("c"))
    above = F.size(F.filter(F.col("__cuts"), lambda c: F.col(value).cast("double") > c))
    return (
        df.withColumn("__cuts", cuts.scalar())
        .withColumn(name, F.when(F.col(value).isNotNull(), above + 1))
        .drop("__cuts")
    )


def stratified_split(
    df: DataFrame, key: Sequence[str], strata: str, seed: int, share: float = TRAIN_SHARE, bins: int = 4
) -> DataFrame:
    """Add ``stratum`` and ``split``: in each quantile bin exactly ``floor(share * n)`` rows
    train - those with the smallest (hash, key).

    Equal to numbering each bin by hash, without putting a bin in one task: counts per bin
    and hash slot show which slots lie wholly below the cut, and only the slot the cut falls
    into (about 1/65,536 of the bin) is numbered row by row.
    """
    require(df, strata, *key)
    binned = quantile_bins(df, strata, bins)
    h = unit_hash(*key, seed=seed)
    rows = binned.withColumn("__h", h).withColumn(
        "__slot", F.shiftright(F.col("__h"), 32 - _SLOTS_BITS).cast("int")
    )
    slots = rows.groupBy("stratum", "__slot").agg(F.count(F.lit(1)).alias("__c"))
    every = Window.partitionBy("stratum")
    upto = every.orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    want = F.floor(F.sum("__c").over(every) * F.lit(float(share)))
    cut = (
        slots.withColumn("__want", want)
        .withColumn("__to", F.sum("__c").over(upto))
        .where((F.col("__to") > F.col("__want")) & (F.col("__to") - F.col("__c") <= F.col("__want")))
        .select(
            F.col("stratum").alias("__bin"),
            F.col("__slot").alias("__edge"),
            (F.col("__want") - F.col("__to") + F.col("__c")).alias("__left"),
        )
    )
    # One row per bin: as small as the number of bins.
    marked = rows.join(F.broadcast(cut), F.col("stratum").eqNullSafe(F.col("__bin")), "left")
    # A bin with no cut (every row trains) gets an edge beyond the last slot.
    marked = marked.withColumn("__edge", F.coalesce("__edge", F.lit(1 << _SLOTS_BITS)))
    marked = marked.withColumn("__at", F.col("__slot") == F.col("__edge"))
    helper = ["__h", "__slot", "__bin", "__edge", "__left", "__at"]
    clear = marked.where(~F.col("__at")).withColumn(
        "split", F.when(F.col("__slot") < F.col("__edge"), "train").otherwise("test")
    )
    number = F.row_number().over(Window.partitionBy("stratum").orderBy("__h", *key))
    edge = marked.where(F.col("__at")).withColumn(
        "split", F.when(number <= F.col("__left"), "train").otherwise("test")
    )
    return clear.drop(*helper).unionByName(edge.drop(*helper))
