"""Whitening by an incremental eigendecomposition.

Each task keeps a running mean and the eigenpairs of the scatter around it. Vectors enter as centred rank-one updates:
with the scatter as U diag(D) U', adding r v v' leaves the roots of the secular equation 1 + r sum z_i^2 / (D_i - t) = 0
as new eigenvalues, z = U'v. Parts of z that vanish and equal eigenvalues are deflated first, the roots are found between
their poles by rational steps inside brackets, and z is recomputed from the roots, which keeps the new vectors
orthogonal. A block of more vectors than dimensions is first turned to as many rows with the same scatter (the
triangular factor of the centred block), and the shift of the mean is one more update, so that a task makes about d
updates for ``BLOCK`` vectors. The spectra of tasks are combined ``FAN`` at a time, in rounds: every eigenpair of one
is a rank-one update of the other, and so is the difference of their means.

A last pass over all vectors projects the exactly centred vectors on the combined basis (Rayleigh-Ritz); the eigenpairs
of that small matrix turn the basis into the components. Sums of the integers are exact: they are decimals. What passes
the driver are d sums and d x d matrices, whatever the number of rows.

Defined results: rows whose vector is null, or holds null or non-finite entries or entries of 2^43 or more in size, take no
part; nor do vectors of another length than the most frequent one (of equally frequent ones the longest), and empty ones.
A null id stays null, repeated rows count each. Components whose eigenvalue is zero but for rounding are left out, so
that fewer rows than dimensions, constant entries or a single row give fewer components or none. ``deviation`` is null
where it exceeds a long. Other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Vectors that are turned to one triangle before they enter.
BLOCK = 4_096
#: Spectra that one task combines.
FAN = 16

_EPS = np.finfo(float).eps


def _roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum weights / (poles - t), one above each of the ascending poles: the index of the pole that is
    nearest to each root, and the root's distance from it."""
    k = len(poles)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    middle = (ends - poles) / 2
    gaps = poles[None, :] - poles[:, None]  # [root, pole]
    value = 1 + (weights / (gaps - middle[:, None])).sum(axis=1)
    upper = (value < 0) & (np.arange(k) < k - 1)
    origin = np.arange(k) + upper
    distance = poles[None, :] - poles[origin][:, None]
    span = ends - poles
    low, high = np.where(upper, -span / 2, 0.0), np.where(upper, 0.0, np.where(np.arange(k) < k - 1, span / 2, span))
    # The last root may lie anywhere up to the sum of the weights.
    at = (low + high) / 2
    left = np.arange(k)[None, :] <= np.arange(k)[:, None]
    far = np.append(np.arange(1, k), k - 1)
    rows = np.arange(k)
    for _ in range(80):
        ratio = weights / (distance - at[:, None])
        slope = ratio / (distance - at[:, None])
        psi, phi = np.where(left, ratio, 0).sum(axis=1), np.where(left, 0, ratio).sum(axis=1)
        f = 1 + psi + phi
        small = np.abs(f) <= _EPS * k * (1 + np.abs(psi) + np.abs(phi))
        low, high = np.where(f < 0, at, low), np.where(f > 0, at, high)
        if small.all():
            break
        # Match value and slope of either part by one pole and a constant, and solve the quadratic that remains.
        dpsi, dphi = np.where(left, slope, 0).sum(axis=1), np.where(left, 0, slope).sum(axis=1)
        near, next_ = distance[rows, rows] - at, distance[rows, far] - at
        a, b = dpsi * near**2, dphi * next_**2
        c = f - near * dpsi - np.where(rows < k - 1, next_ * dphi, 0)
        with np.errstate(all="ignore"):
            # c + a / (near - h) + b / (next_ - h) = 0 for the step h
            p = c * (near + next_) + a + b
            q = near * next_ * f
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            step = np.where(p >= 0, 2 * q / (p + root), (p - root) / (2 * c))
            last = near + a / c  # a single pole
            step = np.where(rows < k - 1, step, last)
            new = at + step
        inside = (new > low) & (new < high) & np.isfinite(new)
        new = np.where(inside, new, (low + high) / 2)
        new = np.where(small, at, new)
        if (new == at).all():
            break
        at = new
    at = np.where(at == 0, np.where(upper, -np.finfo(float).tiny, np.finfo(float).tiny), at)
    return origin, at


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of vectors diag(values) vectors' + v v'."""
    z = vectors.T @ v
    rho = float(z @ z)
    if rho == 0 or not np.isfinite(rho):
        return values, vectors
    z = z / np.sqrt(rho)
    tolerance = 8 * _EPS * max(float(np.abs(values).max()), rho)
    values, vectors, z = values.copy(), vectors.copy(), z.copy()
    # Deflation: no part in the update, or an eigenvalue (nearly) equal to the one before; a rotation moves its part there.
    active: list[int] = []
    for i in range(len(values)):
        if rho * abs(z[i]) <= tolerance:
            continue
        if active:
            j = active[-1]
            length = np.hypot(z[i], z[j])
            c, s = z[i] / length, z[j] / length
            if abs((values[i] - values[j]) * c * s) <= tolerance:
                gap = values[i] - values[j]
                z[i], z[j] = length, 0.0
                vectors[:, [j, i]] = np.column_stack([c * vectors[:, j] - s * vectors[:, i], s * vectors[:, j] + c * vectors[:, i]])
                values[j], values[i] = values[j] + gap * s * s, values[i] - gap * s * s
                active[-1] = i
                continue
        active.append(i)
    if not active:
        return values, vectors
    live = np.array(active)
    order = np.argsort(values[live], kind="stable")
    live = live[order]
    poles, part = values[live], z[live]
    origin, offset = _roots(poles, rho * part**2)
    # [pole, root]: pole - root, without cancellation.
    apart = (poles[:, None] - poles[origin][None, :]) - offset[None, :]
    # The update whose exact eigenvalues are these roots.
    k = len(live)
    between = poles[:, None] - poles[None, :]
    np.fill_diagonal(between, 1.0)
    with np.errstate(all="ignore"):
        log = np.log(np.abs(apart)).sum(axis=1) - np.log(np.abs(between)).sum(axis=1)
    again = np.sqrt(np.exp(log - log.max())) * np.where(part < 0, -1.0, 1.0)
    turn = again[:, None] / apart
    turn /= np.sqrt((turn**2).sum(axis=0))[None, :]
    values[live] = poles[origin] + offset
    vectors[:, live] = vectors[:, live] @ turn if k > 1 else vectors[:, live]
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number of vectors, their mean, and eigenpairs of the scatter around it."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def _enter(self, rows: np.ndarray, n: int, mean: np.ndarray) -> None:
        """Take in n vectors with this mean, whose scatter is the sum of the rows' rank-one products."""
        for row in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)
        total = self.n + n
        if self.n and n:
            self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(self.n * (n / total)) * (mean - self.mean))
        self.mean = self.mean + (mean - self.mean) * (n / total)
        self.n = total

    def add(self, x: np.ndarray) -> None:
        """Take in a block of vectors."""
        mean = x.mean(axis=0)
        centred = x - mean
        self._enter(np.linalg.qr(centred, mode="r") if len(x) > x.shape[1] else centred, len(x), mean)

    def combine(self, other: Spectrum) -> None:
        live = other.values > 0
        self._enter((other.vectors[:, live] * np.sqrt(other.values[live])).T, other.n, other.mean)


def prepare(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and the integers x of every vector that takes part."""
    parts = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("vec is not null and size(vec) > 0")
    usable = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**43)))
    steps = F.transform("vec", lambda c: F.floor(c * float(SCALE)).cast("long") + SHIFT)
    kept = parts.where(F.coalesce(usable, F.lit(False))).select("id", steps.alias("x")).withColumn("d", F.size("x"))
    common = kept.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).select(F.col("d").alias("common"))
    return kept.join(F.broadcast(common), kept["d"] == common["common"]).select("id", "x")  # one row


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_SPECTRUM = "node long, n long, mean array<double>, vals array<double>, vecs array<double>"


def _written(node: int, s: Spectrum) -> pa.RecordBatch:
    doubles = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([node], pa.int64()), pa.array([s.n], pa.int64()), *(pa.array([a.ravel().tolist()], doubles) for a in (s.mean, s.values, s.vectors))], ["node", "n", "mean", "vals", "vecs"]
    )


def _read(row: dict) -> Spectrum:
    d = len(row["mean"])
    return Spectrum(row["n"], np.array(row["mean"]), np.array(row["vals"]), np.array(row["vecs"]).reshape(d, d))


def spectrum(points: DataFrame, block: int = BLOCK, fan: int = FAN) -> Spectrum | None:
    """The spectrum of all vectors x, from those of the tasks."""

    def each(batches):
        own, held, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x")).astype(float)
            own = own or Spectrum.empty(x.shape[1])
            held.append(x)
            size += len(x)
            if size >= block:
                own.add(np.concatenate(held))
                held, size = [], 0
        if held:
            own.add(np.concatenate(held))
        if own is not None:
            yield _written(TaskContext.get().partitionId(), own)

    def several(key, rows):
        first, *others = [_read(r) for r in sorted(rows.to_pylist(), key=lambda r: r["node"])]
        for other in others:
            first.combine(other)
        yield_ = _written(key[0].as_py(), first)
        return pa.Table.from_batches([yield_])

    found = materialize(points.select("x").mapInArrow(each, _SPECTRUM), "whiten-spectra")
    top = found.agg(F.max("node")).first()[0]
    while top:
        found = materialize(found.withColumn("node", F.floor(F.col("node") / fan).cast("long")).groupBy("node").applyInArrow(several, _SPECTRUM), "whiten-spectra")
        top //= fan
    last = found.first()
    return _read(last.asDict()) if last else None


def totals(points: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sums of their entries."""

    def each(batches):
        n, low, high = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                n += len(x)
                # Sums of the halves cannot overflow within a task.
                part = ((x & 0xFFFFFFFF).sum(axis=0).astype(object), (x >> 32).sum(axis=0).astype(object))
                low, high = part if low is None else (low + part[0], high + part[1])
        if n:
            sums = [Decimal(int(a) + (int(b) << 32)) for a, b in zip(low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array(sums, pa.decimal128(38, 0))], ["i", "n", "s"])

    sums = points.select("x").mapInArrow(each, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = {r["i"]: (r["n"], int(r["s"])) for r in sums}
    return (out[0][0], [out[i][1] for i in range(len(out))]) if out else (0, [])


class Centre:
    """Vectors minus S / n, from integers that are close to them."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.share = np.array([float(Fraction(s % n, n)) for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.share

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n x - S)^2, exact; None beyond a long."""
        near = x - self.base
        largest = (int(np.abs(near).max()) + 1) * self.n if near.size else 0
        if largest**2 * max(x.shape[1], 1) < 1 << 63:
            y = near * self.n - self.rest
            return (y * y).sum(axis=1).tolist()
        sums = [sum((v * self.n - r) ** 2 for v, r in zip(row, self.rest.tolist())) for row in near.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def _products(points: DataFrame, project) -> np.ndarray:
    """Sum over all vectors of p p' and of p, p = project(x): a symmetric matrix, and the sums as its last column."""

    def each(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                p = project(_matrix(batch.column("x")))
                p = np.column_stack([p, np.ones(len(p))])
                total = p.T @ p if total is None else total + p.T @ p
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    rows = points.select("x").mapInArrow(each, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    d = max((r["i"] for r in rows), default=-1) + 1
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


@dataclass
class Whitening:
    """Centre, components (columns), their eigenvalues and shares of the trace, and how far the result is from white."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.components / np.sqrt(self.values)


def fit(points: DataFrame, k: int = COMPONENTS, block: int = BLOCK, fan: int = FAN) -> Whitening | None:
    """The whitening of ``prepare``'s rows; None without any component."""
    n, sums = totals(points)
    if not n:
        return None
    centre, found = Centre(n, sums), spectrum(points, block, fan)
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]
    ritz = _products(points, lambda x: centre(x) @ basis)[:-1, :-1] / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    real = values > max(values[0], 0) * len(values) * 16 * _EPS
    count = min(k, int(real.sum()))
    if not count:
        return None
    components = (basis @ turn)[:, :count]
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(count)])
    out = Whitening(centre, components * signs, values[:count], values[:count] / np.trace(ritz), 0.0)
    seen = _products(points, out)
    mean = seen[:-1, -1] / n
    out.identity_error = float(np.abs(seen[:-1, :-1] / n - np.outer(mean, mean) - np.eye(count)).max())
    return out


def whitened(points: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, one row per vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return points.sparkSession.createDataFrame([], schema)
    k = len(model.values)

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("x"))
                m = len(x)
                ids = part.column("id").take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(model.centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.centre.n)), deviation,
                    pa.array(model(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return points.select("id", "x").mapInArrow(each, schema)


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """``whitened`` over all usable vectors of a table with vec_id and embedding."""
    points = materialize(prepare(vectors), "whiten-points")
    return whitened(points, fit(points, k))
