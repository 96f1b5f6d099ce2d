"""Embedding whitening by incremental eigendecomposition.

Each task keeps the spectrum (values and vectors) of the scatter of the rows
that it has seen. A centred row v changes a scatter S into S + v v'; in the
basis of the spectrum that is a diagonal matrix plus z z', whose eigenvalues
are the roots of the secular equation 1 + sum z_i^2 / (d_i - x) = 0, one
between each two neighbours of d. Entries of z that are nothing, and equal
values of d after a reflection, are deflated: their pairs stay as they are.
Vectors follow from the roots by Loewner's formula, which keeps them
orthogonal. A batch of more rows than dimensions is first turned into its
triangular factor, as many rows as dimensions with the same scatter, so a row
costs no more than its share of that factor.

Two spectra are combined by the same updates: one for every pair of the
second, one for the distance of the means. Tasks' spectra are combined sixteen
at a time, over tasks. The final basis is refined by a Rayleigh-Ritz step: a
pass over the rows gives the exact covariance in that basis, a matrix of
dimension x dimension that is diagonalised, and so the components.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

# Fixed values of the contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100000
COMPONENTS = 8

FAN_IN = 16                    # spectra or matrices that one task combines
BATCH_CELLS = 1 << 20          # entries of a batch of rows
MOST = 1 << 62                 # magnitudes below this are added and multiplied as 64-bit integers
EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(roots, differences d_i - root_j) of 1 + sum z_i^2 / (d_i - x); ``d`` rises strictly, no ``z`` is 0."""
    k, square = len(d), z * z
    upper = np.append(d[1:], d[-1] + square.sum())
    gap = upper - d
    at_mid = 1 + (square[:, None] / (d[:, None] - (d + gap / 2))).sum(0)
    left = at_mid >= 0                       # the root is nearer to the pole below; that pole is the origin
    left[-1] = True
    origin = np.where(left, d, upper)
    pole = d[:, None] - origin
    lo, hi = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    hi[-1] = gap[-1]
    x = (lo + hi) / 2
    below = np.arange(k)[:, None] <= np.arange(k)
    with np.errstate(all="ignore"):
        for _ in range(200):
            away = pole - x
            term = square[:, None] / away
            slope = term / away
            f = 1 + term.sum(0)
            small = np.abs(f) <= EPS * k * (1 + np.abs(term).sum(0))
            lo, hi = np.where(f < 0, x, lo), np.where(f > 0, x, hi)
            if small.all() or np.all(hi - lo <= EPS * np.abs(x)):
                break
            one, two = np.diagonal(away), np.append(np.diagonal(away, -1), 0.0)
            rise_one, rise = (slope * below).sum(0), slope.sum(0)
            # Both sums are matched by one pole each; the root of that is the next guess.
            a = (one + two) * f - one * two * rise
            b = one * two * f
            c = f - one * rise_one - two * (rise - rise_one)
            root = np.sqrt(a * a - 4 * b * c)
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            move[-1] = one[-1] + rise[-1] * one[-1] ** 2 / (f[-1] - rise[-1] * one[-1])
            guess = x + move
            x = np.where(small, x, np.where((guess > lo) & (guess < hi), guess, (lo + hi) / 2))
    return origin + x, pole - x


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of q diag(d) q' + v v'; ``d`` rises."""
    z = q.T @ v
    size = float(np.sqrt(z @ z))
    least = 8 * EPS * max(float(d[-1]), size * size)
    if size * size <= least * EPS:
        return d, q
    q = q.copy()
    ends = np.append(np.flatnonzero(np.diff(d) > least) + 1, len(d))
    begin = 0
    for end in ends.tolist():
        if end - begin > 1:                  # equal values: a reflection leaves one entry of z
            w = z[begin:end].copy()
            far = float(np.sqrt(w @ w))
            z[begin:end] = 0
            if far > 0:
                z[end - 1] = -far if w[-1] > 0 else far
                w[-1] -= z[end - 1]
                w /= np.sqrt(w @ w)
                q[:, begin:end] -= 2 * np.outer(q[:, begin:end] @ w, w)
        begin = end
    live = np.abs(z) * size > least
    if not live.any():
        return d, q
    dk, zk = d[live], z[live]
    roots, away = secular_roots(dk, zk)
    # Entries of z for which the computed roots are exact, by Loewner's formula.
    k = len(dk)
    i, j = np.arange(k)[:, None], np.arange(k)
    others = np.where(j < i, dk - dk[:, None], np.append(dk[1:], 0.0) - dk[:, None])
    others[:, -1] = np.where(i[:, 0] > j[-1], others[:, -1], 1.0)
    exact = np.sqrt(np.abs(np.prod(-away / others, axis=1))) * np.sign(zk)
    u = exact[:, None] / away
    u /= np.sqrt((u * u).sum(0))
    values = d.copy()
    values[live] = roots
    q[:, live] = q[:, live] @ u
    order = np.argsort(values, kind="stable")
    return values[order], q[:, order]


@dataclass
class Spectrum:
    """Of the rows seen: how many, their exact sums, and values and vectors of their centred scatter."""

    n: int
    sums: list[int]
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, [0] * dim, np.zeros(dim), np.eye(dim))

    def _shift(self, n: int, sums: list[int]) -> None:
        """Take in ``n`` rows with these sums, whose own scatter was added: what is left is the distance of the means."""
        if self.n:
            apart = np.array([float(b * self.n - a * n) for a, b in zip(self.sums, sums, strict=True)]) / (float(n) * self.n)
            self._update(apart * np.sqrt(float(n) * self.n / (n + self.n)))
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]

    def _update(self, v: np.ndarray) -> None:
        self.values, self.basis = rank_one(self.values, self.basis, v)

    def add_rows(self, x: np.ndarray) -> None:
        n, sums = len(x), exact_sums(x)
        away = centred(x, n, sums)
        for v in np.linalg.qr(away, mode="r") if n > x.shape[1] else away:
            self._update(v)
        self._shift(n, sums)

    def add(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self._update(np.sqrt(value) * vector)
        self._shift(other.n, other.sums)


def exact_sums(x: np.ndarray) -> list[int]:
    high, low = (x >> 24).sum(0), (x & ((1 << 24) - 1)).sum(0)
    return [(a << 24) + b for a, b in zip(high.tolist(), low.tolist(), strict=True)]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where they suffice, else Python's."""
    if not x.size or n * max(int(x.max()), -int(x.min())) + max(map(abs, sums)) < MOST:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)^2 of each row; null where a long does not hold it."""
    away = _scaled(x, n, sums)
    about = (away.astype(np.float64) ** 2).sum(1)
    if (about < MOST).all():
        return (away * away).sum(1).tolist()
    exact = [sum(v * v for v in map(int, row)) for row in away]
    return [v if v < 1 << 63 else None for v in exact]


def integer_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x) of the vectors that take part."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    cells = vectors.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(all="ignore"):
        scaled = np.floor(SCALE * cells)
        whole = (np.abs(scaled) < MOST).all(1)          # false for nulls, NaN and infinities too
    return places[whole], scaled[whole].astype(np.int64) + SHIFT


def _batches(batches, dim: int, ids: bool):
    """(ids, x) of rows that take part, in batches of bounded size."""
    step = max(4 * dim, BATCH_CELLS // dim)
    held, many = [], 0
    for b in batches:
        places, x = integer_rows(b.column("v"), dim)
        who = b.column("id").take(pa.array(places)) if ids else None
        if ids:
            for at in range(0, len(x), step):
                yield who.slice(at, step), x[at:at + step]
            continue
        for at in range(0, len(x), step):
            held.append(x[at:at + step])
            many += len(held[-1])
            if many >= step:
                yield None, np.concatenate(held)
                held, many = [], 0
    if many:
        yield None, np.concatenate(held)


STATE = "part int, state binary"


def _state(part: int, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "state"])


def _fold(rows: DataFrame, run, merge, purpose: str):
    """One state out of all rows: ``run`` makes one of a task's batches, and states merge ``FAN_IN`` at a time, in order."""
    def scan(batches):
        yield _state(TaskContext.get().partitionId(), run(batches))

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        states = [pickle.loads(x) for x in table.column("state").to_pylist()]
        total = states[0]
        for more in states[1:]:
            total = merge(total, more)
        return pa.Table.from_batches([_state(table.column("part")[0].as_py() // FAN_IN, total)])

    states = stash(rows.mapInArrow(scan, STATE), purpose)
    parts = (states.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        states = stash(states.withColumn("to", F.expr(f"part div {FAN_IN}")).groupBy("to")
                       .applyInArrow(lambda t: combine(t.drop_columns(["to"])), STATE), purpose)
        parts = -(-parts // FAN_IN)
    found = states.first()
    return pickle.loads(found["state"]) if found else run(iter(()))


def _rows(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    return vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v"))


@dataclass
class Model:
    """Exact count and sums, all eigenvalues of the covariance, falling, and their unit vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    def scales(self, k: int) -> np.ndarray:
        """1 / sqrt(e) of the first components; NaN where there is no variance."""
        e = self.values[:k]
        real = e > self.dim * EPS * max(float(self.values[0]), 0.0) if len(self.values) else e > 0
        return np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), np.nan)


def _dimension(rows: DataFrame) -> int:
    """The most frequent length of a vector, the largest of equals; 0 without vectors."""
    top = (rows.where("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("d")).count()
           .agg(F.max(F.struct("count", "d")).alias("m")).first()["m"])
    return top["d"] if top else 0


def _spectrum(dim: int):
    def run(batches) -> Spectrum:
        state = Spectrum.empty(dim)
        for _, x in _batches(batches, dim, False):
            state.add_rows(x)
        return state
    return run


def _merge(a: Spectrum, b: Spectrum) -> Spectrum:
    if not a.n:
        return b
    a.add(b)
    return a


def fit(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> Model:
    """Count, sums and spectrum of all vectors that take part; see ``whiten`` for those that do not."""
    rows = _rows(vectors, id_column, vector)
    dim = _dimension(rows)
    if not dim:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)))
    found = _fold(rows, _spectrum(dim), _merge, "spectra")
    if not found.n:
        return Model(0, found.sums, np.zeros(dim), np.eye(dim))
    basis = np.linalg.qr(found.basis)[0]
    n, sums = found.n, found.sums

    def project(batches) -> np.ndarray:
        total = np.zeros((dim, dim))
        for _, x in _batches(batches, dim, False):
            y = centred(x, n, sums) @ basis
            total += y.T @ y
        return total

    inside = _fold(rows, project, np.add, "ritz") / n
    values, turn = np.linalg.eigh((inside + inside.T) / 2)
    return Model(n, sums, values[::-1].copy(), (basis @ turn)[:, ::-1].copy())


def identity_error(vectors: DataFrame, model: Model, k: int, id_column: str = "vec_id", vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened components' covariance minus the identity, measured over all vectors."""
    scales = model.scales(k)
    real = np.isfinite(scales)
    if not model.n or not real.any():
        return None
    n, sums, dim, turn = model.n, model.sums, model.dim, (model.vectors[:, :k] * scales)[:, real]

    many = int(real.sum())

    def measure(batches) -> np.ndarray:
        total = np.zeros((many + 1, many + 1))
        for _, x in _batches(batches, dim, False):
            y = np.concatenate([centred(x, n, sums) @ turn, np.ones((len(x), 1))], axis=1)
            total += y.T @ y
        return total

    total = _fold(_rows(vectors, id_column, vector), measure, np.add, "identity") / n
    mean = total[:-1, -1]
    return float(np.abs(total[:-1, :-1] - np.outer(mean, mean) - np.eye(many)).max())


def whiten(vectors: DataFrame, model: Model | None = None, k: int = COMPONENTS, id_column: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``id_column``, component, n, deviation, whitened, explained, identity_error of every vector and component up to ``k``.

    Left out are vectors that are null or empty, hold a null or a value that
    is not finite or does not fit a long after scaling, or have another
    length than the table's most frequent one (the largest of equals). A
    component without variance has null for ``whitened``; ``explained`` is null
    where no component has any. Vectors of fewer than ``k`` dimensions have as
    many components as dimensions. Repeated rows and null ids are rows like
    any other. A table without vectors gives no row. Other columns are not read.
    """
    model = model or fit(vectors, id_column, vector)
    k = min(k, model.dim)
    n, sums, dim = model.n, model.sums, model.dim
    error = identity_error(vectors, model, k, id_column, vector)
    scales, turn = model.scales(k), model.vectors[:, :k]
    trace = float(model.values.sum())
    explained = [float(e) / trace if trace > 0 else None for e in model.values[:k]]

    def scan(batches):
        for who, x in _batches(batches, dim, True) if n else ():
            m = len(x)
            y = (centred(x, n, sums) @ turn) * scales
            row = pa.array(np.repeat(np.arange(m), k))
            yield from pa.table({
                id_column: who.take(row),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, n, np.int64)),
                "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(row),
                "whitened": pa.array(y.ravel(), mask=np.isnan(y.ravel())),
                "explained": pa.array(explained * m, pa.float64()),
                "identity_error": pa.array([error] * (m * k), pa.float64())}).to_batches(max_chunksize=1 << 16)

    rows = _rows(vectors, id_column, vector)
    return rows.mapInArrow(scan, f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, component int, n bigint, deviation bigint, "
                                 "whitened double, explained double, identity_error double")
