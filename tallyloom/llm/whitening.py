"""Embedding whitening by spectrum slicing (operator 13).

Vectors become integers (256 times, rounded down).  The distinct ones are the fit list, of
which Spark takes the number and the sums (exact), then, centred, the covariance: each
task adds up its rows, and the tasks' matrices are added up in levels, ``FAN_IN`` to one, so
that the driver is sent ``FAN_IN`` matrices of dim x dim at most, whatever the data.

The leading components come from the covariance by slicing its spectrum.  The
factors L D L' of the matrix less a shift have as many positive pivots as there are eigenvalues above the
shift (Sylvester), so counts at shifts bisect until an interval holds the eigenvalue of one
number alone.  Rayleigh quotient iteration from there converges cubically; counts on
both sides of what it finds certify the number, and where they don't, bisection goes on.
Eigenvalues that no shift separates are one cluster, in which each vector is sought at right angles to
those found before.

Rows are then projected where they lie; nothing but the distinct vectors is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

SCALE = 256
COMPONENTS = 4
#: Matrices that are added to one at a time.
FAN_IN = 16
_EPS = np.finfo(float).eps
#: (1 + sqrt(17)) / 8: least size of a pivot of one row against the largest entry, which bounds the growth of what is left.
_PIVOT = (1 + math.sqrt(17)) / 8
_LONG = (1 << 63) - 1


# --------------------------------------------------------------------------- the spectrum of one matrix


def positive_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are above zero: positive pivots of its L D L' factors, pivots of one or two rows."""
    a, above = matrix.astype(float).copy(), 0
    small = _EPS * max(1e-300, float(np.abs(a).max(initial=0.0)))
    while n := len(a):
        diagonal = np.abs(np.diag(a))
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(off.argmax()), n)
        if max(diagonal[k], off[i, j]) <= small:  # what is left is zero
            break
        if diagonal[k] >= _PIVOT * off[i, j]:
            above += bool(a[k, k] > 0)
            rest = np.delete(np.arange(n), k)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, k], a[rest, k] / a[k, k])
        else:
            block = a[np.ix_((i, j), (i, j))]
            above += int((np.linalg.eigvalsh(block) > 0).sum())
            rest = np.delete(np.arange(n), (i, j))
            side = a[np.ix_(rest, (i, j))]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return above


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    return positive_pivots(matrix - shift * np.eye(len(matrix)))


def _rayleigh(matrix: np.ndarray, shift: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray, float]:
    """An eigenvalue near the shift, its unit vector at right angles to those found, and the norm of what is left over."""
    n, scale = len(matrix), max(1e-300, float(np.abs(matrix).max()))
    known = np.array(found).reshape(-1, n)
    v = np.random.default_rng(seed).standard_normal(n)
    rho = shift
    for step in range(30):
        v = v - known.T @ (known @ v)
        v /= np.linalg.norm(v)
        if step >= 2:  # two steps of inverse iteration come first
            rho = float(v @ matrix @ v)
        left = float(np.linalg.norm(matrix @ v - rho * v))
        if step >= 2 and left <= 4 * n * _EPS * scale:
            break
        try:
            v = np.linalg.solve(matrix - rho * np.eye(n), v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            v = np.linalg.solve(matrix - (rho + 8 * _EPS * scale) * np.eye(n), v)
        v /= np.abs(v).max()
    rho = float(v @ matrix @ v) / float(v @ v)
    v = v - known.T @ (known @ v)
    v /= np.linalg.norm(v)
    return rho, v, float(np.linalg.norm(matrix @ v - rho * v))


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    n = len(matrix)
    if not matrix.any():
        return np.zeros(min(k, n)), np.eye(n)[: min(k, n)]
    reach = np.abs(matrix).sum(1) - np.abs(np.diag(matrix))
    low0, high0 = float((np.diag(matrix) - reach).min(initial=0.0)), float((np.diag(matrix) + reach).max(initial=0.0))
    width = max(high0 - low0, 1e-300)
    low0, high0 = low0 - width * 1e-6, high0 + width * 1e-6
    least = 64 * n * _EPS * width
    counts = {low0: n, high0: 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = eigenvalues_above(matrix, shift)
        return counts[shift]

    values, vectors = [], []
    for number in range(1, min(k, n) + 1):
        low = max(x for x, c in counts.items() if c >= number)
        high = min(x for x, c in counts.items() if c < number)
        while True:
            alone = counts[low] == number and counts[high] == number - 1
            if alone or high - low <= least:
                rho, v, left = _rayleigh(matrix, (low + high) / 2, vectors, number)
                slack = max(left, least)
                inside = low - slack <= rho <= high + slack
                if high - low <= least or (inside and count(rho - slack) >= number and count(rho + slack) < number):
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        values.append(rho)
        vectors.append(v)
    # inside a cluster the quotients may come in any order
    order = sorted(range(len(values)), key=lambda i: -values[i])
    return np.array([values[i] for i in order]), np.array([vectors[i] for i in order]).reshape(-1, n)


# --------------------------------------------------------------------------- the fit over all vectors


@dataclass(frozen=True)
class Fit:
    """Of the vectors of one length: how many distinct ones, their sums, and the leading components."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def scaled(self) -> np.ndarray:
        """Each component over the root of its eigenvalue; NaN where the vectors don't vary along it."""
        flat = self.values <= len(self.sums) * 64 * _EPS * max(self.trace, 0.0)
        return self.vectors / np.sqrt(np.where(flat, np.nan, self.values))[:, None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; None where a long can't hold it."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) <= _LONG:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v <= _LONG else None for v in (d * d).sum(1).tolist()]


def _usable():
    """Entries that are there and finite, all of them; an empty vector has none to fault."""
    return F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False)))


def _rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, x``: the integer vectors, eight bytes an entry."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                flat = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                # what a long can't hold is the largest or least one, as in a cast
                x = np.clip(np.floor(SCALE * flat.astype(float)), -(2.0**63), 2.0**63 - 1024).astype("<i8").reshape(len(at), dim)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "dim", "x"])

    given = vectors.where(_usable()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return given.mapInArrow(run, "vec_id long, dim int, x binary")


def _by_dim(batch: pa.RecordBatch, dim: str = "dim", x: str = "x"):
    dims = batch.column(batch.schema.get_field_index(dim)).to_numpy()
    column = batch.column(batch.schema.get_field_index(x))
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), "<i8").reshape(len(at), d)


def _matrices(sums: dict[int, np.ndarray]):
    rows = [(d, m.astype("<f8").tobytes()) for d, m in sums.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["dim", "matrix"])


def _add_up(parts: DataFrame, name: str) -> dict[int, np.ndarray]:
    """The sum of the matrices of each length, in levels of ``FAN_IN``."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(raw, "<f8")
                sums[d] = sums[d] + m if d in sums else m
        yield _matrices(sums)

    level = materialize(parts.withColumn("slot", F.spark_partition_id()), name)
    while True:
        slots = level.agg(F.countDistinct("slot")).first()[0]
        if slots <= FAN_IN:
            break
        # the numbers of the tasks needn't be dense
        dealt = level.repartition(-(-slots // FAN_IN), F.pmod("slot", F.lit(-(-slots // FAN_IN))))
        further = materialize(dealt.select("dim", "matrix").mapInArrow(add, "dim int, matrix binary").withColumn("slot", F.spark_partition_id()), name)
        discard(level)
        level = further
    out: dict[int, np.ndarray] = {}
    for r in level.select("dim", "matrix").collect():
        m = np.frombuffer(bytes(r[1]), "<f8")
        out[r[0]] = out[r[0]] + m if r[0] in out else m
    discard(level)
    return out


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vectors over rows ``dim, x``, which are distinct."""

    def totals(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for d, at, x in _by_dim(batch):
                safe = not x.size or len(x) * max(-int(x.min()), int(x.max())) <= _LONG
                mine = x.sum(0).tolist() if safe else x.astype(object).sum(0).tolist()
                n, s = sums.get(d, (0, [0] * d))
                sums[d] = (n + len(at), [a + b for a, b in zip(s, mine, strict=True)])
        rows = [(d, -1, str(n)) for d, (n, _) in sums.items()] + [(d, i, str(v)) for d, (_, s) in sums.items() for i, v in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))], ["dim", "i", "v"])

    exact = distinct.mapInArrow(totals, "dim int, i int, v string").groupBy("dim", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    counted: dict[int, dict[int, int]] = {}
    for r in exact.collect():  # a row for each dimension
        counted.setdefault(r[0], {})[r[1]] = int(r[2])
    known = {d: (c[-1], tuple(c[i] for i in range(d))) for d, c in counted.items()}
    means = {d: np.array([s / n for s in sums]) for d, (n, sums) in known.items()}

    def scatter(scaled: dict[int, np.ndarray] | None):
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for d, _, x in _by_dim(batch):
                    c = x - means[d]
                    if scaled is not None:
                        c = c @ scaled[d].T
                    m = (c.T @ c).ravel()
                    sums[d] = sums[d] + m if d in sums else m
            yield _matrices(sums)

        return run

    rows = distinct.select("dim", "x")
    found: dict[int, Fit] = {}
    for d, m in _add_up(rows.mapInArrow(scatter(None), "dim int, matrix binary"), "scatter").items():
        n, sums = known[d]
        v = m.reshape(d, d) / n
        v = (v + v.T) / 2
        values, vectors = leading(v, components)
        found[d] = Fit(n, sums, values, vectors, float(np.trace(v)), None)
    scaled = {d: f.scaled[~np.isnan(f.scaled).any(1)] if d else f.scaled for d, f in found.items()}
    for d, m in _add_up(rows.mapInArrow(scatter(scaled), "dim int, matrix binary"), "whitened-scatter").items():
        k = len(scaled[d])
        if k:
            error = float(np.abs(m.reshape(k, k) / known[d][0] - np.eye(k)).max())
            found[d] = Fit(*(getattr(found[d], a) for a in ("n", "sums", "values", "vectors", "trace")), error)
    return found


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    A null vector, or one with a null, NaN or infinite entry, gives no rows; neither does an
    empty one, which has no components.  Vectors of different lengths are fitted apart.  A repeated vector
    counts once in the fit and gives rows each time; rows that repeat a vec_id give their own
    rows, a null vec_id stays null.  Components are ``min(components, dim)``; ties among eigenvalues are
    any orthonormal basis, the same for all rows.  Along a component without variance (one distinct
    vector, or fewer than dimensions) ``whitened`` is null, and it takes no part in ``identity_error``, which is
    null where none has variance; ``explained`` is null where there is no variance at all.
    ``deviation`` is null where a long can't hold it.  A long vector makes a large matrix, which the driver
    holds ``FAN_IN`` times.  An empty table gives no rows.  Other columns, whatever their names, are left out."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = _rows(vectors.select("vec_id", "embedding"))
    distinct = materialize(rows.where("dim > 0").select("dim", "x").distinct(), "distinct-integer-vectors")
    fits = fit(distinct, components)
    discard(distinct)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for d, at, x in _by_dim(batch):
                if d not in fits:  # an empty vector
                    continue
                f, k = fits[d], len(fits[d].values)
                told = (f.centred(x) @ f.scaled.T).ravel()
                share = f.values / f.trace if f.trace > 0 else np.full(k, np.nan)
                repeat = lambda values: np.repeat(np.array(values, object), k).tolist()
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(len(told), f.n), pa.int64()),
                    pa.array(repeat(f.deviations(x)), pa.int64()), pa.array(told, pa.float64(), mask=np.isnan(told)), pa.array(np.tile(share, len(at)), pa.float64(), mask=np.tile(np.isnan(share), len(at))),
                    pa.array([f.identity_error] * len(told), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
