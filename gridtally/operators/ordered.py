"""Running values over ordered groups, safe for a group that holds much of the data.

A plain Spark window puts each group in one task. That is the best plan as long as groups
are small (one exchange, one sort for all running columns), so it is what ``ordered`` gives
when a counting pass finds no group above ``hot_rows``. Otherwise every larger group is cut
into ordered blocks of about ``hot_rows`` rows:

* cut points come from a hash sample of the order key, a pure function of the rows, and are
  stored (at most ``max_blocks`` per large group) so that every reader sees the same ones;
* block totals are pre-aggregated on the map side, and a window over those totals (at most
  ``max_blocks`` rows per group) gives each block its starting values;
* rows are shuffled by (keys, block) once, which serves both the join with the starting
  values and the window inside the block.

Results do not depend on which of the two plans ran, apart from the order in which doubles
are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col
from ..sources.shared import settle

HOT_ROWS = 5_000_000
MAX_BLOCKS = 1_000
_BLOCK = "__block"
_ALL = "__all"


@dataclass(frozen=True)
class Running:
    kind: str
    value: Column | None = None


def running_sum(c: Column | str) -> Running:
    """Sum from the start of the group; NULL from the first NULL on."""
    return Running("sum", col(c))


def running_mean(c: Column | str) -> Running:
    """Mean from the start of the group; NULL from the first NULL on."""
    return Running("mean", col(c))


def running_count() -> Running:
    """1 for the first row of the group, 2 for the next, ..."""
    return Running("count", F.lit(1))


def previous(c: Column | str) -> Running:
    """Value of the row before; NULL on the first."""
    return Running("previous", col(c))


def dense_position() -> Running:
    """Rank without gaps by the order key."""
    return Running("dense", F.lit(1))


def group_sum(c: Column | str) -> Running:
    """Sum over the whole group; NULL when any value is."""
    return Running("total", col(c))


def group_count() -> Running:
    return Running("size", F.lit(1))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the right side's keys are dropped."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(other[f"__r_{k}"])
        cond = part if cond is None else cond & part
    return left.join(other, cond, how).drop(*[f"__r_{k}" for k in keys])


class Ordered:
    """A DataFrame with group keys and a row order inside each group."""

    def __init__(self, frame: DataFrame, keys: Sequence[str], order: Sequence[str], blocked: bool):
        self._frame = frame
        self.keys = list(keys)
        self.order = list(order)
        self.blocked = blocked

    @property
    def frame(self) -> DataFrame:
        return self._frame.drop(_BLOCK, _ALL)

    def then(self, fn) -> Ordered:
        """Apply a row-wise change (it must keep keys and order columns)."""
        return Ordered(fn(self._frame), self.keys, self.order, self.blocked)

    def running(self, **specs: Running) -> Ordered:
        done = self._blocked_columns(specs) if self.blocked else self._plain_columns(specs)
        return Ordered(done, self.keys, self.order, self.blocked)

    def _plain_columns(self, specs: dict[str, Running]) -> DataFrame:
        base = Window.partitionBy(*self.keys)
        sort = base.orderBy(*self.order)
        run = sort.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out: dict[str, Column] = {}
        for name, spec in specs.items():
            v = spec.value
            if spec.kind in ("sum", "mean"):
                agg = F.sum(v) if spec.kind == "sum" else F.avg(v)
                out[name] = F.when(~F.max(v.isNull()).over(run), agg.over(run))
            elif spec.kind == "count":
                out[name] = F.count(F.lit(1)).over(run)
            elif spec.kind == "dense":
                out[name] = F.dense_rank().over(sort).cast("bigint")
            elif spec.kind == "previous":
                out[name] = F.lag(v, 1).over(sort)
            elif spec.kind == "total":
                out[name] = F.when(~F.max(v.isNull()).over(base), F.sum(v).over(base))
            elif spec.kind == "size":
                out[name] = F.count(v).over(base)
        return self._frame.withColumns(out)

    def _blocked_columns(self, specs: dict[str, Running]) -> DataFrame:
        place = F.struct(*self.order)
        block_keys = [*self.keys, _BLOCK]
        totals = [F.count(F.lit(1)).alias("__blk_n")]
        for i, spec in enumerate(specs.values()):
            v = spec.value
            if spec.kind in ("sum", "mean", "total"):
                totals += [F.sum(v).alias(f"__blk_s{i}"), F.max(v.isNull()).alias(f"__blk_b{i}")]
            elif spec.kind == "previous":
                totals.append(F.max_by(F.struct(v.alias("v")), place).alias(f"__blk_l{i}"))
            elif spec.kind == "dense":
                totals.append(F.count_distinct(place).alias(f"__blk_d{i}"))
        blocks = self._frame.groupBy(*block_keys).agg(*totals)

        every = Window.partitionBy(*self.keys)
        seq = every.orderBy(_BLOCK)
        before = seq.rowsBetween(Window.unboundedPreceding, -1)
        starts = [F.coalesce(F.sum("__blk_n").over(before), F.lit(0)).alias("__blk_n")]
        for i, spec in enumerate(specs.values()):
            if spec.kind in ("sum", "mean"):
                starts += [
                    F.sum(f"__blk_s{i}").over(before).alias(f"__blk_s{i}"),
                    F.coalesce(F.max(f"__blk_b{i}").over(before), F.lit(False)).alias(f"__blk_b{i}"),
                ]
            elif spec.kind == "total":
                starts += [
                    F.sum(f"__blk_s{i}").over(every).alias(f"__blk_s{i}"),
                    F.max(f"__blk_b{i}").over(every).alias(f"__blk_b{i}"),
                ]
            elif spec.kind == "size":
                starts.append(F.sum("__blk_n").over(every).alias(f"__blk_s{i}"))
            elif spec.kind == "previous":
                starts.append(F.lag(f"__blk_l{i}", 1).over(seq).alias(f"__blk_l{i}"))
            elif spec.kind == "dense":
                starts.append(F.coalesce(F.sum(f"__blk_d{i}").over(before), F.lit(0)).alias(f"__blk_d{i}"))
        rows = attach(self._frame, blocks.select(*block_keys, *starts), block_keys, "inner")

        local = Window.partitionBy(*block_keys).orderBy(*self.order)
        run = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out: dict[str, Column] = {}
        for i, (name, spec) in enumerate(specs.items()):
            v = spec.value
            number = F.row_number().over(local)
            if spec.kind in ("sum", "mean"):
                ok = ~(F.col(f"__blk_b{i}") | F.max(v.isNull()).over(run))
                total = F.sum(v).over(run) + F.coalesce(F.col(f"__blk_s{i}"), F.lit(0))
                if spec.kind == "mean":
                    total = total.cast("double") / (F.col("__blk_n") + number)
                out[name] = F.when(ok, total)
            elif spec.kind == "count":
                out[name] = F.col("__blk_n") + number
            elif spec.kind == "dense":
                out[name] = F.col(f"__blk_d{i}") + F.dense_rank().over(local)
            elif spec.kind == "previous":
                out[name] = F.when(number == 1, F.col(f"__blk_l{i}.v")).otherwise(F.lag(v, 1).over(local))
            elif spec.kind == "total":
                out[name] = F.when(~F.col(f"__blk_b{i}"), F.col(f"__blk_s{i}"))
            elif spec.kind == "size":
                out[name] = F.col(f"__blk_s{i}")
        helper = [c for c in rows.columns if c not in self._frame.columns]
        return rows.withColumns(out).drop(*helper)


def _cut_points(df: DataFrame, hot: DataFrame, keys: list[str], order: list[str], hot_rows: int, max_blocks: int) -> DataFrame:
    """One row per hot group: the sorted order-key values at which its blocks start."""
    blocks = F.least(F.lit(max_blocks), F.ceil(F.col("__n") / hot_rows))
    stride = F.greatest(F.lit(1), F.floor(F.col("__n") / (blocks * 32)))
    sample = attach(df.select(*keys, *order), hot, keys, "inner").where(
        F.pmod(F.xxhash64(*order), stride) == 0
    )
    group = Window.partitionBy(*keys)
    number = F.row_number().over(group.orderBy(*order))
    size = F.count(F.lit(1)).over(group)
    slot = F.floor((number - 1) * blocks / size)
    return (
        sample.withColumn("__slot", slot)
        .groupBy(*keys, "__slot")
        .agg(F.min(F.struct(*order)).alias("__cut"))
        .where(F.col("__slot") > 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("__cut")).alias("__cuts"))
    )


def _block_of(place: Column, cuts: Column, max_blocks: int) -> Column:
    """How many of the sorted cut points are at or before a row's place, by halving: an array of a
    thousand takes ten comparisons."""
    steps = [1 << k for k in reversed(range(max_blocks.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda found, step: F.when(F.get(cuts, found + step - 1) <= place, found + step).otherwise(found),
    )


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot_rows: int = HOT_ROWS,
    max_blocks: int = MAX_BLOCKS,
) -> Ordered:
    """Group ``df`` by ``keys`` with rows in ``order`` (ascending; the order must be unique
    inside a group for repeatable running values).

    Runs one counting pass over the key columns to choose the plan.
    """
    keys, order = list(keys), list(order)
    if not keys:
        df, keys = df.withColumn(_ALL, F.lit(0)), [_ALL]
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    if not hot.limit(1).count():
        return Ordered(df, keys, order, blocked=False)
    cuts = settle(_cut_points(df, settle(hot), keys, order, hot_rows, max_blocks))
    rows = attach(df, cuts, keys, "left")
    place = F.struct(*order)
    block = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(_block_of(place, F.col("__cuts"), max_blocks))
    return Ordered(rows.withColumn(_BLOCK, block).drop("__cuts"), keys, order, blocked=True)
