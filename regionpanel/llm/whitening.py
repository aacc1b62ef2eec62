"""Embedding whitening: principal components to unit variance.

1. **Malformed rows go**: a null vector, one with null or non-finite entries
   (1e150 and more count as infinite), an empty one, and one whose length is not the most frequent length (ties:
   the longer).  The rest is the fit list.
2. **Integers.**  An entry c becomes x = floor(64 c) + 1,000,000.  Sums of x are
   taken as exact integers, one partial row per task.
3. **Distributed centred covariance.**  A second pass centres each vector by the
   mean S / n before it is multiplied; a task adds up its own d x d matrix and
   sends it out row by row, so a reducer adds one matrix row from each task and
   the driver gets d x d numbers whatever the data.  The order of the additions
   is fixed (by task), so the same layout gives the same digits.
4. **Eigenvectors** of that d x d matrix on the driver: Householder reflections
   to tridiagonal form, bisection on Sturm counts for the leading eigenvalues,
   inverse iteration for their vectors with reorthogonalisation inside clusters
   of close eigenvalues, and the reflections backwards.
5. **Broadcast projection**: components (d x k numbers) go to the tasks; each
   vector is centred, projected and divided by sqrt(e).  One more pass takes the
   mean and the centred covariance of the result the same way; its largest
   deviation from the identity is reported with every row.

Bounds: d is the length of one vector; d * d doubles fit the driver and a task.
A component whose eigenvalue is zero to working precision has no direction of
its own: its whitened value is null and it takes no part in the error.  Fewer
dimensions than ``components`` give that many components.  Null ids and
repeated rows stay rows of their own.  An empty table, or one without a valid
vector, gives an empty result.  Extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: entries from here on count as infinite: their squares are no doubles
LARGEST = 1e150
#: eigenvalues closer than this share of the largest are one cluster
CLUSTER = 1e-3
_EPS = float(np.finfo(np.float64).eps)


# ------------------------------------------------------------------ symmetric eigenproblem

def tridiagonal(matrix: np.ndarray):
    """Householder: (diagonal, off-diagonal, reflections) with Q' A Q tridiagonal."""
    a = np.array(matrix, np.float64)
    n = len(a)
    reflections = []
    for j in range(n - 2):
        x = a[j + 1:, j]
        size = np.abs(x).max()
        if size == 0 or not np.any(x[1:]):
            continue
        v = x / size
        norm = np.sqrt(v @ v)
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.sqrt(v @ v)
        # (I - 2 v v') A (I - 2 v v') on the trailing block, as a symmetric rank-two update
        block = a[j + 1:, j + 1:]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = a[j + 1:, j] - 2 * v * (v @ a[j + 1:, j])
        a[j + 1:, j] = a[j, j + 1:] = column
        reflections.append((j + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def back(reflections, vectors: np.ndarray) -> np.ndarray:
    """Vectors of the tridiagonal matrix as vectors of the original one."""
    out = vectors.copy()
    for at, v in reversed(reflections):
        out[at:] -= 2 * np.outer(v, v @ out[at:])
    return out


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each shift: negative pivots of the shifted matrix."""
    tiny = _EPS * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), 1e-290)
    pivot = diagonal[0] - shifts
    count = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its bracket cannot shrink."""
    n = len(diagonal)
    radius = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    lo = np.full(k, (diagonal - radius).min())
    hi = np.full(k, (diagonal + radius).max())
    pad = _EPS * max(np.abs(lo).max(), np.abs(hi).max()) * 4 + 1e-300
    lo, hi = lo - pad, hi + pad
    rank = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    while True:
        middle = lo + (hi - lo) / 2
        open_ = (middle > lo) & (middle < hi)
        if not open_.any():
            return middle
        above = sturm_counts(diagonal, off, middle) > rank
        hi = np.where(open_ & above, middle, hi)
        lo = np.where(open_ & ~above, middle, lo)


def _solve_shifted(diagonal, off, shift, right, tiny):
    """(T - shift) z = right by elimination with row exchanges; a zero pivot counts as ``tiny``."""
    n = len(diagonal)
    d, u, uu, z = diagonal - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    low = off.copy()
    for i in range(n - 1):
        if abs(d[i]) >= abs(low[i]):
            if abs(d[i]) < tiny:
                d[i] = tiny
            f = low[i] / d[i]
            d[i + 1] -= f * u[i]
            z[i + 1] -= f * z[i]
        else:
            f = d[i] / low[i]
            d[i], d[i + 1], u[i] = low[i], u[i] - f * d[i + 1], d[i + 1]
            uu[i], u[i + 1] = u[i + 1], -f * u[i + 1]
            z[i], z[i + 1] = z[i + 1], z[i] - f * z[i + 1]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    z[-1] /= d[-1]
    for i in range(n - 2, -1, -1):
        z[i] = (z[i] - u[i] * z[i + 1] - (uu[i] * z[i + 2] if i + 2 < n else 0.0)) / d[i]
    return z


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit vectors (columns) of the tridiagonal matrix for its falling ``values``."""
    n = len(diagonal)
    size = max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), 1e-290)
    rng = np.random.default_rng(7)
    out = np.zeros((n, len(values)))
    first, shift = 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * size:
            first = j
        # equal values are solved at shifts a few units apart, or all would find one vector
        shift = value if j == first else min(value, shift - 10 * _EPS * size)
        z = rng.standard_normal(n)
        for _ in range(rounds):
            z /= np.abs(z).max()
            z = _solve_shifted(diagonal, off, shift, z, _EPS * size)
            z /= np.abs(z).max()
            for _ in range(2):
                z -= out[:, first:j] @ (out[:, first:j].T @ z)
        out[:, j] = z / np.sqrt(z @ z)
    return out


def leading_components(matrix: np.ndarray, k: int):
    """(values, vectors): the ``k`` leading eigenvalues and unit eigenvectors (columns) of a symmetric matrix."""
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, k)
    return values, back(reflections, inverse_iteration(diagonal, off, values))


# ------------------------------------------------------------------ passes over the vectors

def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, d) doubles of a batch of equally long vectors."""
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _grid(batch: pa.RecordBatch) -> np.ndarray:
    return np.floor(SCALE * _vectors(batch)) + SHIFT  # whole doubles: exact below 2 ** 53


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers of any size."""
    return x.astype(np.int64) if np.abs(x).max(initial=0) < 2 ** 53 else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _partial(values_of, encode):
    """What ``values_of`` gives for a batch, added up over a task: one row for each part of the sum."""
    def run(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = values_of(batch.slice(at, 4096))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()),
                                              "task": pa.array(np.full(len(total), TaskContext.get().partitionId()), pa.int32()),
                                              "body": pa.array([encode(x) for x in total], pa.binary())})
    return run


def _added(encode, decode):
    """Rows sorted by (i, task): the sum for each i."""
    def run(batches):
        at, total = None, None
        row = lambda: pa.RecordBatch.from_pydict({"i": pa.array([at], pa.int32()), "body": pa.array([encode(total)], pa.binary())})
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if i != at and at is not None:
                    yield row()
                at, total = (i, decode(body)) if i != at else (i, total + decode(body))
        if at is not None:
            yield row()
    return run


def _summed(vectors: DataFrame, values_of, encode, decode, parts: int) -> list:
    """The sum of ``values_of`` over all rows, its parts added by at most ``parts`` reducers."""
    rows = (vectors.mapInArrow(_partial(values_of, encode), "i int, task int, body binary")
            .repartition(min(parts, partitions(vectors.sparkSession)), "i").sortWithinPartitions("i", "task")
            .mapInArrow(_added(encode, decode), "i int, body binary").collect())
    return [decode(r.body) for r in sorted(rows)]


def integer_sums(vectors: DataFrame) -> list[int]:
    """Number of vectors, then the sum of each dimension's integers, exact."""
    def values(batch):
        x = _whole(_grid(batch)).astype(object)
        return np.append(np.array([len(x)], object), x.sum(0))
    return _summed(vectors, values, lambda v: str(v).encode(), lambda b: int(b), 64)


def value_sums(vectors: DataFrame, values_of) -> np.ndarray:
    return np.array(_summed(vectors, lambda batch: values_of(batch).sum(0), lambda v: np.float64(v).tobytes(),
                            lambda b: float(np.frombuffer(b)[0]), 64))


def product_sums(vectors: DataFrame, values_of) -> np.ndarray:
    """Sum of the outer products of ``values_of(batch)`` with itself over all rows; reducers add matrix rows."""
    def values(batch):
        y = values_of(batch)
        return y.T @ y
    return np.array(_summed(vectors, values, lambda row: row.tobytes(), lambda b: np.frombuffer(b).copy(), 1 << 30))


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector of doubles) of the rows that hold a whole finite vector of the usual length."""
    v = F.col("vector")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    kept = (table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
            .where(v.isNotNull() & (F.size(v) > 0) & finite))
    lengths = kept.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return kept.where(F.size("vector") == (lengths[0].d if lengths else 0))


OUT = ("component int, n long, deviation long, whitened double, explained double, eigenvalue double, identity_error double")


def _deviations(grid: np.ndarray, n: int, sums: list[int]) -> list:
    """Sum over dimensions of (n x - S)^2, exact; null where past a long."""
    x = _whole(grid)
    reach = max(n * abs(int(x.max())), n * abs(int(x.min())), max(map(abs, sums)))
    if reach < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        if y.shape[1] * int(max(abs(int(y.max())), abs(int(y.min())))) ** 2 < 1 << 63:
            return (y * y).sum(1).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (y * y).sum(1)]


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per valid vector and component: id, component, n, deviation, whitened, explained, eigenvalue, identity_error."""
    spark = table.sparkSession
    schema = f"`{id_col}` {table.schema[id_col].dataType.simpleString()}, {OUT}"
    vectors = valid_vectors(table, id_col, vector_col)
    got = integer_sums(vectors)
    if not got:
        return spark.createDataFrame([], schema)
    n, sums = got[0], got[1:]
    d = len(sums)
    k = min(components, d)
    mean = np.array([s / n for s in sums])

    fit = spark.sparkContext.broadcast({"mean": mean})
    cov = product_sums(vectors, lambda batch: _grid(batch) - fit.value["mean"]) / n
    cov = (cov + cov.T) / 2
    trace = float(np.trace(cov))
    values, axes = leading_components(cov, k)
    usable = values > d * 8 * _EPS * trace
    factor = np.where(usable, axes / np.sqrt(np.where(usable, values, 1.0)), 0.0)

    plan = spark.sparkContext.broadcast({"mean": mean, "factor": factor})
    white = lambda batch: (_grid(batch) - plan.value["mean"]) @ plan.value["factor"]
    centre = value_sums(vectors, white) / n
    middle = spark.sparkContext.broadcast(centre)
    check = product_sums(vectors, lambda batch: white(batch) - middle.value) / n
    error = float(np.abs(check - np.eye(k))[np.ix_(usable, usable)].max(initial=0.0))
    explained = [float(v) / trace if u else 0.0 for v, u in zip(values, usable)]
    facts = spark.sparkContext.broadcast({"n": n, "sums": sums, "values": values.tolist(), "explained": explained, "usable": usable, "error": error})

    def project(batches):
        own = facts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = part.num_rows
                w = white(part)
                deviation = _deviations(_grid(part), own["n"], own["sums"])
                repeat = lambda x, kind: pa.array(np.tile(x, rows), kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), repeat(np.arange(1, k + 1), pa.int32()),
                     repeat(np.full(k, own["n"]), pa.int64()), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                     pa.array(w.ravel(), pa.float64(), mask=np.tile(~own["usable"], rows)), repeat(own["explained"], pa.float64()),
                     repeat(own["values"], pa.float64()), repeat(np.full(k, own["error"]), pa.float64())],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "eigenvalue", "identity_error"])

    return vectors.mapInArrow(project, schema)
