"""Exact top-k inner products by a Voronoi join.

Rows are grouped by their nearest pivot. A cell's summary (pivot, radius, rows) bounds the score of
any of its rows with a query from both sides: q.c - |q| r <= q.x <= q.c + |q| r. The lower bounds of
enough rows give a score that the k-th best certainly reaches; a query is sent only to cells whose
upper bound reaches it. Cells and their queries are cut into blocks by hash, each pair of blocks is
solved by one matrix product, and the best of all blocks are ranked.

Components are whole numbers floor(scale * x). Products are exact: in doubles where every sum stays
below 2^53, in 64-bit integers beyond; a score that could pass 2^63 raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle
from .words import groups

PIVOTS = 64
#: Rows of which the pivots are taken: those of the least hashes.
PIVOT_SAMPLE = 1024
DATA_BLOCK = 16_384
QUERY_BLOCK = 2_048
#: Different vector lengths that may occur.
MAX_LENGTHS = 64


def _points(rows: DataFrame, id_: str, vector: str, scale: int) -> DataFrame:
    """(row, id, v) of the rows that take part."""
    value = F.col(vector).cast("array<double>")
    fine = F.col(id_).isNotNull() & value.isNotNull() & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(2**52) / scale))
    )
    infinite = F.exists(value, lambda x: F.abs(x) == F.lit(float("inf")))
    large = F.exists(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) >= F.lit(float(2**52) / scale)))
    checked = F.when(
        F.coalesce(large & ~infinite, F.lit(False)), F.raise_error(F.lit("a component is too large to be a whole number exactly"))
    ).otherwise(F.transform(value, lambda x: F.floor(x * scale).cast("bigint")))
    kept = rows.where(F.col(id_).isNotNull() & value.isNotNull())
    kept = kept.where(fine | F.coalesce(large & ~infinite, F.lit(False)))
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_).cast("bigint").alias("id"), checked.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


class Cells:
    """Pivots by vector length; the cell number of a vector is its place in the list of all pivots.
    A length without a pivot has the zero vector."""

    def __init__(self, vectors: list[list[int]], lengths: list[int]):
        seen: dict[int, list[tuple[int, ...]]] = {n: [] for n in lengths}
        for v in vectors:
            own = seen[len(v)]
            if len(own) < PIVOTS and tuple(v) not in own:
                own.append(tuple(v))
        self.first, self.pivots, at = {}, {}, 0
        for n in lengths:
            self.first[n] = at
            self.pivots[n] = np.array(seen[n] or [(0,) * n], np.float64).reshape(-1, n)
            at += len(self.pivots[n])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell number and distance, rounded up, of every row of x."""
        n = x.shape[1]
        y, p = x.astype(np.float64), self.pivots[n]
        far = (p**2).sum(axis=1) - 2.0 * (y @ p.T)
        best = far.argmin(axis=1)
        distance = np.sqrt(((y - p[best]) ** 2).sum(axis=1))
        return self.first[n] + best, distance * (1 + 1e-9) + 1e-9


def _assign(points: DataFrame, cells) -> DataFrame:
    def run(batches):
        for batch in batches:
            length = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(length).tolist():
                part = batch.filter(pa.array(length == n)) if len(np.unique(length)) > 1 else batch
                cell, far = cells.value.nearest(_matrix(part.column("v")).reshape(part.num_rows, n))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(cell), n), pa.int32()), pa.array(cell, pa.int32()), pa.array(far)],
                    names=["row", "id", "v", "length", "cell", "far"],
                )

    return points.mapInArrow(run, "row bigint, id bigint, v array<bigint>, length int, cell int, far double")


def needed_cells(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """For each query (row) and cell whether the cell may hold one of the k best rows other than the
    query's own row."""
    y = q.astype(np.float64)
    middle, reach = y @ pivots.T, np.sqrt((y**2).sum(axis=1))[:, None] * radius
    slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
    low, high = middle - reach - slack, middle + reach + slack
    order = np.argsort(-low, axis=1)
    enough = np.cumsum(rows[order], axis=1) >= k + 1
    at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(rows) - 1)
    floor = np.take_along_axis(low, order, 1)[np.arange(len(y)), at]
    floor = np.where(enough.any(axis=1), floor, -np.inf)
    return (high >= floor[:, None]) & (rows > 0)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("a score may not fit 64 bits")
    return q @ x.T


def _solve(batches, k: int):
    for rows in groups(batches, "cell", "block", "part"):
        is_query = rows.column("is_query").to_numpy()
        row, id_, v = rows.column("row").to_numpy(), rows.column("id").to_numpy(), _matrix(rows.column("v"))
        v = v.reshape(rows.num_rows, -1)
        ask, data = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(ask) or not len(data):
            continue
        data = data[np.lexsort((row[data], id_[data]))]
        score = _product(v[ask], v[data])
        out: list[list[np.ndarray]] = [[], [], []]
        for n, one in enumerate(ask.tolist()):
            s = score[n]
            other = np.flatnonzero(row[data] != row[one]) if (row[data] == row[one]).any() else np.arange(len(data))
            if len(other) > k:
                edge = np.partition(s[other], len(other) - k)[len(other) - k]
                above, equal = other[s[other] > edge], other[s[other] == edge]
                other = np.concatenate([above, equal[: k - len(above)]])  # rows stand by id
            out[0].append(np.full(len(other), one))
            out[1].append(data[other])
            out[2].append(s[other])
        one, other, s = (np.concatenate(x) for x in out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (row[one], id_[one], row[other], id_[other], s)],
            names=["query_row", "query_id", "row", "vec_id", "score"],
        )


def top_k(rows: DataFrame, is_query, id_: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the ``k`` best rows of every query by inner product.

    ``is_query`` is a condition on the id. Candidates are all rows but the query's own; ties go to
    the smaller id. Rows whose id or vector is null, or whose vector holds a null, NaN or infinite
    component, take no part; only vectors of equal length meet. A repeated id is a row of its own:
    it is found, and asks, once per row. Fewer than ``k`` rows are all returned.
    """
    spark = rows.sparkSession
    points = settle(_points(rows, id_, vector, scale))
    lengths = sorted(r[0] for r in points.select(F.size("v")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors have more than {MAX_LENGTHS} lengths")
    sampled = [r[0] for r in points.orderBy(F.xxhash64("row"), "row").limit(PIVOT_SAMPLE).select("v").collect()]
    cells = spark.sparkContext.broadcast(Cells(sampled, lengths))
    points = settle(_assign(points, cells))
    pivots = sum(len(p) for p in cells.value.pivots.values())
    count, radius = np.zeros(pivots, np.int64), np.zeros(pivots)
    for r in points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        count[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    blocks = np.maximum(1, -(-count // DATA_BLOCK))

    def ask(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            for n in np.unique(length).tolist():
                part = batch.filter(pa.array(length == n))
                at = cells.value.first[n]
                p = cells.value.pivots[n]
                own = slice(at, at + len(p))
                need = needed_cells(_matrix(part.column("v")).reshape(part.num_rows, n), p, radius[own], count[own], k)
                got = [(np.flatnonzero(x) + at).tolist() for x in need]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("row", "id", "v")), pa.array(got, pa.list_(pa.int32()))], names=["row", "id", "v", "cells"]
                )

    asked = settle(
        points.where(is_query(F.col("id"))).select("row", "id", "v", "length").mapInArrow(
            ask, "row bigint, id bigint, v array<bigint>, cells array<int>"
        )
    )
    sent = asked.select("row", "id", "v", F.explode("cells").alias("cell"))
    askers = np.zeros(pivots, np.int64)
    for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        askers[r["cell"]] = r["n"]
    parts = -(-askers // QUERY_BLOCK)
    number = lambda x: F.element_at(F.array(*[F.lit(int(n)) for n in x]) if len(x) else F.array(F.lit(0)), F.col("cell") + 1)
    hashed = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    queries = sent.withColumns(
        {"part": hashed(number(parts)), "block": F.explode(F.sequence(F.lit(0), number(blocks).cast("int") - 1)), "is_query": F.lit(True)}
    )
    data = points.where(number(parts) > 0).select("row", "id", "v", "cell").withColumns(
        {"block": hashed(number(blocks)), "part": F.explode(F.sequence(F.lit(0), number(parts).cast("int") - 1)), "is_query": F.lit(False)}
    )
    met = queries.select("cell", "block", "part", "is_query", "row", "id", "v").unionByName(data)
    met = met.repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part")
    best = met.mapInArrow(lambda it: _solve(it, k), "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
