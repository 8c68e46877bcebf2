"""Whitening of vectors by incremental eigendecomposition.

1.  Every component becomes a whole number floor(scale * c). The fit list holds each distinct vector
    once; its length and per-dimension sums are exact.
2.  Each task follows the largest eigenpairs of the scatter of its rows: a row is a centred rank-one
    update, whose eigenvalues are the roots of a secular equation, with components of no weight and
    equal eigenvalues deflated. LANES spectra are kept side by side, so that numpy solves the
    equations of many rows at a time.
3.  Spectra are combined by successive rank-one updates (the eigenvectors of one, and the difference
    of the means): the lanes of a task first, then tasks in levels of FAN.
4.  A distributed Rayleigh-Ritz refinement makes the leading eigenvectors exact: V Q is summed over
    the fit list, the small problem is solved, and while residuals are left they widen the basis. It
    ends when the residuals are rounding errors, at the latest when the basis is the whole space.

The sums that reach the driver have the size of a vector times that of the basis, whatever the number
of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle

#: Eigenpairs that each spectrum follows.
TRACKED = 16
#: Spectra side by side in a task, and the least number of rows of a task's first batch for each.
LANES = 128
LANE_ROWS = 16
#: Updates after which the columns of a basis are made orthogonal again.
CLEAN = 128
#: Spectra that one task combines.
FAN = 32
#: Different vector lengths that may occur.
MAX_LENGTHS = 64
#: Weights and gaps below this share of the largest are deflated.
TINY = 1e-14
#: Relative change at which a root is taken, and the rounds after which it is in any case: the vectors
#: are orthogonal whatever the roots, and the refinement makes them exact.
CLOSE = 1e-8
ROUNDS = 12
#: Components have to be whole numbers exactly.
LARGEST = 1 << 52

SPECTRUM = "n bigint, mean array<double>, values array<double>, vectors array<double>"


def secular_roots(d: np.ndarray, z: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_i^2 / (d_i - x) in every lane (column), as steps above the ``d`` left of them,
    and the differences d_i - d_j by (j, i, lane). ``d`` falls down a column; only the first entries
    are active, and each has one root, between it and the one before it (the first: up to the sum of
    z^2 more). Differences with an entry that is not active are infinite.

    The sums over the poles on either side are replaced by simple fractions of equal value and slope,
    which gives a quadratic; a step out of the known bracket is halved.
    """
    k = len(d)
    weight = np.where(active, z * z, 0.0)
    delta = np.where(active[None] & active[:, None], d[None] - d[:, None], np.inf)
    gap = np.empty_like(d)
    gap[0] = weight.sum(axis=0)
    gap[1:] = d[:-1] - d[1:]
    gap = np.where(active, gap, 1.0)
    low, high, t = np.zeros_like(d), gap.copy(), gap / 2
    right = np.tri(k, k, -1)[:, :, None]  # by (j, i): poles i before j
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(ROUNDS):
            w = 1.0 / (delta - t[:, None])
            slope = w * w * weight
            w *= weight
            psi, psi_slope = w.sum(axis=1), slope.sum(axis=1)
            w *= right
            slope *= right
            phi, phi_slope = w.sum(axis=1), slope.sum(axis=1)
            psi, psi_slope = psi - phi, psi_slope - phi_slope
            f = 1.0 + psi + phi
            low, high = np.where(f < 0, t, low), np.where(f >= 0, t, high)
            q, s = psi_slope * t * t, phi_slope * (gap - t) ** 2
            c = 1.0 + psi + psi_slope * t + phi - phi_slope * (gap - t)
            b = c * gap + q + s
            root = np.sqrt(np.maximum(b * b - 4.0 * c * q * gap, 0.0))
            new = np.where(b > 0, 2.0 * q * gap / (b + root), (b - root) / (2.0 * c))
            # A root that is met to rounding errors may fall just out of its bracket.
            slack = 1e-6 * np.minimum(new, gap - new)
            near = (new > 0) & (new < gap) & (new >= low - slack) & (new <= high + slack)
            new = np.where(near, new, (low + high) / 2)
            moved = np.abs(new - t) > CLOSE * np.minimum(new, gap - new)
            t = np.where(active, new, t)
            if not (moved & active).any():
                break
    return np.where(active, t, 0.0), delta


def _equal_values(d: np.ndarray, z: np.ndarray, basis: np.ndarray, scale: np.ndarray) -> None:
    """Where neighbouring eigenvalues are equal, a rotation leaves one of the two without weight."""
    for i in np.flatnonzero((d[:-1] - d[1:] <= TINY * scale).any(axis=1)).tolist():
        tied = np.flatnonzero((d[i] - d[i + 1] <= TINY * scale) & (z[i] != 0) & (z[i + 1] != 0))
        if len(tied):
            a, b = z[i, tied], z[i + 1, tied]
            h = np.hypot(a, b)
            x, y = basis[tied, :, i], basis[tied, :, i + 1]
            basis[tied, :, i] = (b / h)[:, None] * x - (a / h)[:, None] * y
            basis[tied, :, i + 1] = (a / h)[:, None] * x + (b / h)[:, None] * y
            z[i, tied], z[i + 1, tied] = 0.0, h


def rank_one(values: np.ndarray, vectors: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenpairs of U diag(values) U' + c c' for every lane: values (lane, r) that fall,
    vectors (lane, d, r), updates (lane, d). A lane whose update is 0 stays as it is."""
    lanes, dim, r = vectors.shape
    transposed = vectors.transpose(0, 2, 1)
    p = transposed @ c[:, :, None]
    rest = c[:, :, None] - vectors @ p
    if r < dim:
        again = transposed @ rest
        p, rest = p + again, (rest - vectors @ again)[:, :, 0]
        beyond = np.sqrt((rest**2).sum(axis=1))
        beyond = np.where(beyond > TINY * np.sqrt((c**2).sum(axis=1)), beyond, 0.0)
        outer = rest / np.where(beyond > 0, beyond, 1.0)[:, None]
        outer[beyond == 0] = 0.0
        basis = np.concatenate([vectors, outer[:, :, None]], axis=2)
        d, z = np.concatenate([values.T, np.zeros((1, lanes))]), np.concatenate([p[:, :, 0].T, beyond[None]])
    else:
        basis, d, z = vectors.copy(), values.T.copy(), p[:, :, 0].T.copy()
    k = len(d)
    norm = (z**2).sum(axis=0)
    z[np.abs(z) <= TINY * np.sqrt(norm)] = 0.0
    _equal_values(d, z, basis, np.maximum(d[0], norm))
    active = z != 0
    first = np.argsort(~active, axis=0, kind="stable")
    d, z, active = (np.take_along_axis(x, first, 0) for x in (d, z, active))
    step, delta = secular_roots(d, z, active)
    new = d + step
    # The weights for which the computed roots are exact keep the vectors orthogonal.
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        above = step[:, None] - delta  # by (j, i): root j less pole i
        ratio = above / -delta
        own = np.arange(k)
        ratio[own, own] = above[own, own]
        ratio[np.isinf(delta) | ~active[:, None]] = 1.0
        exact = np.where(active, np.sqrt(np.maximum(ratio.prod(axis=0), 0.0)) * np.sign(z), 0.0)
        turn = exact / above
        turn[~np.isfinite(turn)] = 0.0
        size = np.sqrt((turn**2).sum(axis=1))
        kept = ~active | (size == 0)
        turn /= np.where(size > 0, size, 1.0)[:, None]
    turn = np.where(kept[:, None], np.eye(k)[:, :, None], turn)
    # Columns by falling root, rows back in the order of the basis.
    last = np.argsort(-new, axis=0, kind="stable")[:r]
    turn = np.take_along_axis(turn, last[:, None], 0)
    back = np.argsort(first, axis=0, kind="stable")
    turn = np.take_along_axis(turn, back[None], 1)
    return np.take_along_axis(new, last, 0).T, basis @ turn.transpose(2, 1, 0)


@dataclass
class Spectra:
    """Lanes of (rows, mean, leading eigenvalues of the scatter, their vectors)."""

    n: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(lanes: int, dim: int, tracked: int = TRACKED) -> Spectra:
        r = min(tracked, dim)
        return Spectra(np.zeros(lanes), np.zeros((lanes, dim)), np.zeros((lanes, r)), np.repeat(np.eye(dim, r)[None], lanes, axis=0))

    def update(self, c: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, c)

    def clean(self) -> None:
        q, r = np.linalg.qr(self.vectors)
        self.vectors = q * np.where(np.diagonal(r, axis1=1, axis2=2) < 0, -1.0, 1.0)[:, None, :]

    def add(self, x: np.ndarray, there: np.ndarray) -> None:
        """One row for every lane that has one."""
        off = np.where(there[:, None], x - self.mean, 0.0)
        after = self.n + there
        self.update(off * np.sqrt(self.n / np.maximum(after, 1))[:, None])
        self.mean = self.mean + off / np.maximum(after, 1)[:, None]
        self.n = after

    def half(self) -> Spectra:
        """The first half of the lanes, each combined with one of the second half."""
        m = len(self.n) // 2
        part = lambda lo, hi: Spectra(self.n[lo:hi], self.mean[lo:hi], self.values[lo:hi], self.vectors[lo:hi])
        one, two, odd = part(0, m), part(m, 2 * m), part(2 * m, len(self.n))
        total = np.maximum(one.n + two.n, 1)
        off = two.mean - one.mean
        for j in range(two.values.shape[1]):
            one.update(two.vectors[:, :, j] * np.sqrt(np.maximum(two.values[:, j], 0.0))[:, None])
        one.update(off * np.sqrt(one.n * two.n / total)[:, None])
        one.mean = one.mean + off * (two.n / total)[:, None]
        one.n = one.n + two.n
        one.clean()
        return Spectra(*(np.concatenate([a, b]) for a, b in zip(vars(one).values(), vars(odd).values())))

    def one(self) -> Spectra:
        out = self
        while len(out.n) > 1:
            out = out.half()
        return out

    def rows(self) -> pa.RecordBatch:
        doubles = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.n.astype(np.int64)),
                *[pa.array([r.ravel() for r in x], doubles) for x in (self.mean, self.values, self.vectors)],
            ],
            names=["n", "mean", "values", "vectors"],
        )

    @staticmethod
    def read(rows: pa.Table | pa.RecordBatch) -> Spectra:
        n = rows.column("n").to_numpy().astype(float)
        mean, values, vectors = (np.array(rows.column(c).to_pylist(), float) for c in ("mean", "values", "vectors"))
        return Spectra(n, mean, values, vectors.reshape(len(n), mean.shape[1], values.shape[1]))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _spectrum(batches, dim: int, tracked: int):
    """The spectrum of a task's rows, as one row."""
    held = None
    since = 0
    for batch in batches:
        x = _matrix(batch.column("x")).astype(float)
        if not len(x):
            continue
        if held is None:
            held = Spectra.empty(int(np.clip(len(x) // LANE_ROWS, 1, LANES)), dim, tracked)
        lanes = len(held.n)
        steps = -(-len(x) // lanes)
        padded = np.zeros((steps * lanes, dim))
        padded[: len(x)] = x
        there = (np.arange(steps * lanes) < len(x)).reshape(steps, lanes)
        for step, row in enumerate(padded.reshape(steps, lanes, dim)):
            held.add(row, there[step])
            since += 1
            if since % CLEAN == 0:
                held.clean()
    if held is not None:
        yield held.one().rows()


def _combined(batches):
    """One spectrum of all the spectra of a task, two at a time."""
    held = None
    for batch in batches:
        if batch.num_rows:
            new = Spectra.read(batch).one()
            if held is not None:
                new = Spectra(*(np.concatenate([a, b]) for a, b in zip(vars(held).values(), vars(new).values()))).one()
            held = new
    if held is not None:
        yield held.rows()


def leading_basis(fit: DataFrame, dim: int, tracked: int = TRACKED) -> np.ndarray:
    """Approximate leading eigenvectors of the scatter of ``x`` (columns), by rank-one updates in the
    tasks and over their spectra. At most FAN spectra reach the driver."""
    spectra = settle(fit.select("x").mapInArrow(lambda it: _spectrum(it, dim, tracked), SPECTRUM))
    while (count := spectra.count()) > FAN:
        spectra = settle(spectra.repartition(-(-count // FAN)).mapInArrow(_combined, SPECTRUM))
    return Spectra.read(spectra.toArrow()).one().vectors[0]


def _summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all tasks of the arrays that ``make(batches)`` gives for each."""

    def run(batches):
        total = make(batches)
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["place", "part"])

    parts = rows.mapInArrow(run, "place bigint, part double")
    got = parts.groupBy("place").agg(F.sum("part").alias("total")).toArrow()
    out = np.zeros(size)
    out[got.column("place").to_numpy()] = got.column("total").to_numpy()
    return out


def ritz(fit: DataFrame, mean: np.ndarray, n: int, basis: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the covariance (divisor n) and unit eigenvectors (columns).

    Each pass over the rows multiplies the new columns of the basis; residuals become the next ones.
    """
    dim = len(mean)
    sent = fit.sparkSession.sparkContext.broadcast

    def times(columns: np.ndarray) -> np.ndarray:
        shared = sent((mean, columns))

        def make(batches):
            centre, q = shared.value
            total = None
            for batch in batches:
                if batch.num_rows:
                    y = _matrix(batch.column("x")) - centre
                    part = y.T @ (y @ q)
                    total = part if total is None else total + part
            return total

        out = _summed(fit.select("x"), make, dim * columns.shape[1]).reshape(dim, -1) / n
        shared.destroy()
        return out

    q = np.linalg.qr(basis)[0]
    v = times(q)
    while True:
        small = q.T @ v
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        rest = v @ turn - vectors * values
        top = max(float(values[0]), 0.0)
        if q.shape[1] == dim or np.abs(rest[:, :k]).max() <= 4 * np.finfo(float).eps * top:
            return values[:k], vectors[:, :k]
        rest = rest - q @ (q.T @ rest)
        rest = rest - q @ (q.T @ rest)
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        more = left[:, (size > np.finfo(float).eps * top) & (np.arange(len(size)) < dim - q.shape[1])]
        more = more - q @ (q.T @ more)
        if not more.shape[1]:
            return values[:k], vectors[:, :k]
        more = np.linalg.qr(more)[0]
        q, v = np.concatenate([q, more], axis=1), np.concatenate([v, times(more)], axis=1)


@dataclass
class Whitening:
    """A fitted model for vectors of one length. ``n`` and ``sums`` are exact whole numbers; ``values``
    fall; a component without variance has no whitened values."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        return self.values > 1e-12 * max(self.trace, 0.0)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components (rows by components); NaN where a component has no variance."""
        off = x - np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = off @ self.vectors / np.sqrt(np.where(self.usable, self.values, np.nan))
        return out

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S)^2, exactly."""
        most = int(np.abs(x).max(initial=0)) + 1
        sums = np.array(self.sums, object)
        small = most * most * max(1, x.shape[1]) < 1 << 62 and most * (max(map(abs, self.sums), default=0) + 1) * max(1, x.shape[1]) < 1 << 62
        y = x if small else x.astype(object)
        squares, products = (y * y).sum(axis=1), (y * (sums.astype(np.int64) if small else sums)).sum(axis=1)
        last = sum(s * s for s in self.sums)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + last for a, b in zip(squares.tolist(), products.tolist())]


def points_of(rows: DataFrame, vector: str, scale: int, keep: list[str]) -> DataFrame:
    """(keep..., x) of the rows that take part."""
    value = F.col(vector).cast("array<double>")
    limit = float(LARGEST / scale)
    finite = value.isNotNull() & F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    large = F.exists(value, lambda c: F.abs(c) >= F.lit(limit))
    x = F.when(large, F.raise_error(F.lit("a component is too large to be a whole number exactly"))).otherwise(
        F.transform(value, lambda c: F.floor(c * scale).cast("bigint"))
    )
    return rows.where(F.coalesce(finite, F.lit(False))).select(*[F.col(f"`{c}`") for c in keep], x.alias("x"))


def _moments(fit: DataFrame) -> tuple[int, list[int], list[int]]:
    """Rows, sums and sums of squares by dimension, exactly."""

    def run(batches):
        n, sums, squares = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                big = (int(np.abs(x).max(initial=0)) + 1) ** 2 * len(x) >= 1 << 62
                x = x.astype(object) if big else x
                s, q = x.sum(axis=0).tolist(), (x * x).sum(axis=0).tolist()
                n += batch.num_rows
                sums = s if sums is None else [a + b for a, b in zip(sums, s)]
                squares = q if squares is None else [a + b for a, b in zip(squares, q)]
        if n:
            whole = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array(sums, whole), pa.array(squares, whole)],
                names=["place", "n", "s", "q"],
            )

    parts = fit.select("x").mapInArrow(run, "place int, n bigint, s decimal(38,0), q decimal(38,0)")
    got = parts.groupBy("place").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()
    got = sorted(tuple(r) for r in got)
    return (got[0][1] if got else 0), [int(r[2]) for r in got], [int(r[3]) for r in got]


def fit_list(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Each distinct whole-number vector once, stored."""
    return settle(points_of(rows, vector, scale, []).distinct())


def fit_whitening(fit: DataFrame, dim: int, components: int = 4, tracked: int = TRACKED) -> Whitening:
    """The model of the vectors of length ``dim`` in a fit list."""
    own = fit.where(F.size("x") == dim)
    n, sums, squares = _moments(own)
    # trace = sum over dimensions of (n Q - S^2) / n^2, exactly until the division.
    trace = sum(n * q - s * s for s, q in zip(sums, squares)) / (n * n)
    k = min(components, dim)
    if trace <= 0:
        return Whitening(n, sums, np.zeros(k), np.eye(dim, k), 0.0)
    mean = np.array([s / n for s in sums])
    values, vectors = ritz(own, mean, n, leading_basis(own, dim, max(tracked, k)), k)
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    model = Whitening(n, sums, values, vectors * np.where(sign == 0, 1.0, sign), trace)
    good = np.flatnonzero(model.usable)
    shared = own.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                w = shared.value.apply(_matrix(batch.column("x")))[:, good]
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                total = w.T @ w if total is None else total + w.T @ w
        return total

    m = len(good) + 1
    products = _summed(own.select("x"), make, m * m).reshape(m, m) / n
    covariance = products[1:, 1:] - np.outer(products[0, 1:], products[0, 1:])
    model.identity_error = float(np.abs(covariance - np.eye(m - 1)).max())
    return model


def whiten(
    rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256, tracked: int = TRACKED
) -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error): a row for each
    vector that takes part and each of the first ``components`` principal components of x = floor(scale
    * vector), numbered by falling eigenvalue.

    The covariance is that of the distinct x, each once, with their number ``n`` as divisor.
    ``whitened`` is the projection of x less the mean on the unit eigenvector, over the root of the
    eigenvalue; ``explained`` is the eigenvalue's share of the trace; ``deviation`` the sum over
    dimensions of (n x - S)^2 with S the sums, exactly; ``identity_error`` the largest entry of the
    whitened components' covariance less the identity.

    Null vectors and vectors with null, NaN or infinite entries have no rows; a null id stays null;
    repeated rows each have theirs. Vectors of different length are fitted apart (MAX_LENGTHS at most);
    an empty vector has no components, a shorter one than ``components`` as many as entries. A
    component without variance, as of a single distinct vector, has null values. An entry of 2^52 /
    ``scale`` or more raises an error. An empty table gives none.
    """
    spark = rows.sparkSession
    fit = fit_list(rows, vector, scale)
    lengths = sorted(r[0] for r in fit.select(F.size("x")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors have more than {MAX_LENGTHS} lengths")
    models = spark.sparkContext.broadcast({d: fit_whitening(fit, d, components, tracked) for d in lengths if d})
    id_type = rows.schema[id_].dataType.simpleString()

    def run(batches):
        for batch in batches:
            length = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(length).tolist():
                if not dim:
                    continue
                part = batch.filter(pa.array(length == dim))
                model = models.value[dim]
                x = _matrix(part.column("x"))
                k = len(model.values)
                at = np.repeat(np.arange(len(x)), k)
                white = model.apply(x).ravel()
                share = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
                deviation = pa.array(model.deviation(x), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(at), model.n), pa.int64()),
                        deviation.take(pa.array(at)),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(np.tile(share, len(x)), mask=np.isnan(np.tile(share, len(x)))),
                        pa.array([model.identity_error] * len(at), pa.float64()),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    points = points_of(rows.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{vector}`").alias("vector")), "vector", scale, ["id"])
    schema = f"id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return points.mapInArrow(run, schema).withColumnRenamed("id", id_)
