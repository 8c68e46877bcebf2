"""A bitmap of ids as a small table, to leave rows out before a shuffle.

The table has at most SLOTS rows of 64 bits whatever the number of ids, which is the proven bound
for its broadcast. A row whose bit is not set has none of the ids; one whose bit is set may have, so
an exact join follows. With very many ids most bits are set and the bitmap saves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 18


def _place(id_: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_).cast("long")), F.lit(64 * SLOTS))


def bitmap(ids: DataFrame, id_: str) -> DataFrame:
    """(slot, bits) of the non-null ids."""
    place = _place(id_)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    rows = ids.where(F.col(id_).isNotNull()).select(F.floor(place / 64).cast("int").alias("slot"), bit.alias("bit"))
    return rows.groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def marked(rows: DataFrame, id_: str, table: DataFrame, name: str) -> DataFrame:
    """Add the column ``name``: whether the bitmap may have the row's id."""
    place = _place(id_)
    rows = rows.withColumns({name + "_slot": F.floor(place / 64).cast("int"), name + "_bit": F.pmod(place, F.lit(64)).cast("int")})
    table = table.select(F.col("slot").alias(name + "_slot"), F.col("bits").alias(name + "_bits"))
    out = rows.join(F.broadcast(table), name + "_slot", "left")
    hit = F.call_function("shiftright", F.col(name + "_bits"), F.col(name + "_bit")).bitwiseAND(F.lit(1)) == 1
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop(name + "_slot", name + "_bit", name + "_bits")
