"""Embedding whitening: leading covariance eigenvectors by LOBPCG, then projection.

Components become integers, floor(scale * x). The fit list is each distinct vector
once; mean, covariance, eigenvectors all belong to it. A step of LOBPCG orthonormalises
the block of iterates, their residuals and the directions before, multiplies it with
the covariance, and takes the best iterates from the small projected problem
(Rayleigh-Ritz). Only the product is distributed: each task centres its rows, adds
up rows' * (rows @ block), and partial sums meet in two levels, ordered by task, so
that equal partitions give equal sums. The product's own images of the new iterates
certify their residuals. Steps go on until the residuals are as small as rounding
allows; if that is not reached in ``max_steps``, it raises.

Nothing of the table's size reaches the driver: a block is dim x 3 block columns.

Defined results: rows take no part whose vector is null, empty, or holds null or
non-finite entries; nor do those of another length than the vector of the smallest id
has (nulls last). A component whose floor lies beyond ``LIMIT`` counts as the limit.
Null and repeated ids keep their rows. Components without variance (an eigenvalue of
at most 1e-12 of the trace) are left out, so equal vectors alone, or one vector, give
no rows. A deviation beyond a long is null. Other columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import scratch
from docloom.llm import common

LIMIT = 1 << 24
EPS = np.finfo(float).eps


def integers(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x of the rows whose vector is sound; x = floor(scale * component)."""
    v = vectors[vec_col].cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * scale))).cast("int"))
    return vectors.where(v.isNotNull() & sound).select(vectors[id_col].cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


# ------------------------------------------------------------ distributed sums


def _summed(df: DataFrame, dim: int, of, kind: pa.DataType = pa.float64()) -> np.ndarray:
    """The sum over all rows of df (one column x) of of(matrix of rows), an array of any
    shape of bounded size. Each task gives one partial sum; these meet in about the
    square root of the number of tasks, and those on the driver."""
    schema = pa.schema([("task", pa.int64()), ("total", pa.list_(kind))])

    def local(batches):
        from pyspark import TaskContext

        total = None
        for b in common.slices(batches, 4096):
            part = of(_matrix(b["x"], dim)).ravel()
            total = part if total is None else total + part
        if total is not None:
            yield common.record(schema, task=[TaskContext.get().partitionId()], total=pa.array([total], pa.list_(kind)))

    def merge(batches):
        rows = [(b["task"][i].as_py(), b["total"][i].values.to_numpy()) for b in batches for i in range(b.num_rows)]
        if rows:
            rows.sort(key=lambda r: r[0])
            yield common.record(schema, task=[rows[0][0]], total=pa.array([np.add.reduce([v for _, v in rows])], pa.list_(kind)))

    with common.small_batches(df.sparkSession):
        groups = max(1, math.isqrt(df.rdd.getNumPartitions()))
        partial = common.map_arrow(df, local, schema).repartition(groups, F.col("task") % groups)
        found = sorted(common.map_arrow(partial, merge, schema).collect(), key=lambda r: r["task"])
    return np.add.reduce([np.array(r["total"]) for r in found])


def _orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, the first block's span kept first;
    columns that add nothing but rounding are left out. Twice, for full orthogonality."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        for column in block.T:
            size = np.linalg.norm(column)
            if not size:
                continue
            v = column / size
            for _ in range(3):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10:
                v = v / left
                v = v - basis @ (basis.T @ v)
                basis = np.hstack([basis, (v / np.linalg.norm(v))[:, None]])
    return basis


@dataclass
class Eigen:
    values: np.ndarray
    vectors: np.ndarray  # columns
    residuals: np.ndarray
    steps: int


def lobpcg(product, dim: int, wanted: int = 4, guard: int = 8, max_steps: int = 500, seed: int = 5) -> Eigen:
    """The largest eigenpairs of a symmetric matrix that is known by its product with
    blocks of columns only. ``guard`` more columns than wanted are iterated, so that
    near eigenvalues beyond the wanted ones do not slow these down."""
    width = min(dim, wanted + guard)
    wanted = min(wanted, dim)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    residual = direction = np.zeros((dim, 0))
    least, since = np.inf, 0
    for step in range(1, max_steps + 1):
        basis = _orthonormal(x, residual, direction)
        image = product(basis)
        small = basis.T @ image
        values, c = np.linalg.eigh((small + small.T) / 2)
        values, c = values[::-1][:width], c[:, ::-1][:, :width]
        k = x.shape[1]
        new = basis @ c
        residual = image @ c - new * values
        direction = basis[:, k:] @ c[k:]
        x = new
        size = np.linalg.norm(residual[:, :wanted], axis=0)
        top = max(float(values[0]), 0.0)
        floor = 8 * EPS * math.sqrt(dim) * top
        worst = float(size.max())
        since, least = (0, worst) if worst < least / 2 else (since + 1, min(least, worst))
        if worst <= floor or (worst <= 1e-11 * top and since >= 2):
            return Eigen(values[:wanted], x[:, :wanted], size, step)
    raise RuntimeError(f"the residuals of {worst:g} are above {floor:g} after {max_steps} steps")


# --------------------------------------------------------------------- whitening


@dataclass
class Whitening:
    n: int
    sums: list[int]
    trace: float
    eigen: Eigen
    scale: np.ndarray  # dim x components: unit eigenvectors over the roots of their eigenvalues
    identity_error: float
    rows: DataFrame  # vec_id, x of all sound rows
    dim: int


def fit(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> Whitening | None:
    """None where no row has a sound vector."""
    rows = scratch.saved(integers(vectors, scale, id_col, vec_col), "integers")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(1).collect()
    if not first:
        return None
    dim = len(first[0]["x"])
    rows = rows.where(F.size("x") == dim)
    distinct = scratch.saved(rows.select("x").distinct(), "distinct")
    exact = _summed(distinct, dim, lambda x: np.concatenate([[len(x)], x.astype(np.int64).sum(axis=0)]), pa.int64())
    n, sums = int(exact[0]), [int(v) for v in exact[1:]]
    mean = np.array([s / n for s in sums])
    trace = float(_summed(distinct, dim, lambda x: ((x - mean) ** 2).sum(axis=0)).sum()) / n

    def product(block: np.ndarray) -> np.ndarray:
        def of(x):
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(distinct, dim, of).reshape(block.shape) / n

    if trace == 0:
        eigen = Eigen(np.zeros(0), np.zeros((dim, 0)), np.zeros(0), 0)
    else:
        eigen = lobpcg(product, dim, components)
        good = eigen.values > 1e-12 * trace
        eigen = Eigen(eigen.values[good], eigen.vectors[:, good], eigen.residuals[good], eigen.steps)
    by = eigen.vectors / np.sqrt(eigen.values)
    k = by.shape[1]
    error = 0.0
    if k:
        middle = _summed(distinct, dim, lambda x: ((x - mean) @ by).sum(axis=0)) / n

        def spread(x):
            y = (x - mean) @ by - middle
            return y.T @ y

        error = float(np.abs(_summed(distinct, dim, spread).reshape(k, k) / n - np.eye(k)).max())
    return Whitening(n, sums, trace, eigen, by, error, rows, dim)


OUT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2, exactly; null beyond a long. In longs where all sums must fit."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if x.shape[1] * most**2 < 1 << 63:
        return ((n * x.astype(np.int64) - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def transform(w: Whitening) -> DataFrame:
    """A row for each sound row and component, in one pass without a shuffle."""
    n, sums, dim, by, error = w.n, w.sums, w.dim, w.scale, w.identity_error
    k, mean, explained = by.shape[1], np.array([s / w.n for s in w.sums]), w.eigen.values / w.trace if w.trace else w.eigen.values

    def run(batches):
        for b in common.slices(batches, 4096):
            if not k:
                continue
            x = _matrix(b["x"], dim)
            each = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(_deviations(x, n, sums), pa.int64())
            yield common.record(
                OUT, vec_id=b["vec_id"].take(pa.array(each)), component=np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), n=np.full(len(each), n), deviation=deviation.take(pa.array(each)),
                whitened=((x - mean) @ by).ravel(), explained=np.tile(explained, len(x)), identity_error=np.full(len(each), error),
            )

    return common.map_arrow(w.rows, run, OUT)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    w = fit(common.table(spark, sf_dir, "embeddings"))
    return transform(w) if w else spark.createDataFrame([], common._spark_schema(OUT))
