"""Whitening of embeddings by the eigenvectors of their covariance, found by cyclic Jacobi rotations.

Components become integers x = floor(64 c) + 1,000,000. Each distinct x vector counts once. One
pass gives the exact sums, a second the exact scatter about the nearest integers to the means:
vectors are centred before anything is multiplied, so the offset costs no digits, and the rest of
the mean, less than a half, is taken off in whole numbers. Tasks send d x d integers, summed in
two levels, and the driver gets one matrix whatever the number of rows. It turns the covariance
by symmetric Jacobi rotations until the off-diagonals vanish beside their diagonals, which gives
small eigenvalues as accurately as large ones. The whitening matrix, d x 16 doubles, is
broadcast. A third pass measures the covariance of what was whitened.

Rows whose vector is null or holds null or non-finite components are left out. Shorter vectors have
c = 0 in the components that they lack, also those without any. Null and repeated ids and repeated rows are
whitened like any other row. Extra columns are ignored, whatever their names. Integers that would
exceed a long are its nearest end. A component without variance can't be whitened and has no rows, so a table of
one distinct vector, like an empty one, gives none. Tied eigenvalues are numbered as the rotations leave them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, read

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
_LONG = (1 << 63) - 1
#: Partial sums meet in so many groups first.
_GROUPS = 256
_ROWS = 4096


def quantised(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each component; null where the vector takes no part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.least(F.floor(c.cast("double") * scale), F.lit(_LONG - offset)) + offset))


def _matrix(batch: pa.RecordBatch, dim: int, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _less(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre in whole numbers: longs where they surely fit, Python's integers elsewhere."""
    most = max([int(x.max(initial=0)), -int(x.min(initial=0)), *map(abs, centre)])
    if most < 1 << 61:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def _times(a: np.ndarray, n: int) -> np.ndarray:
    most = int(np.abs(a).max(initial=0)) if a.dtype != object else 1 << 63
    return a * n if most * abs(n) < 1 << 62 else a.astype(object) * n


def scatter(y: np.ndarray) -> np.ndarray:
    """The exact integer matrix of sums of products of columns."""
    most = int(np.abs(y).max(initial=0)) if y.dtype != object else 1 << 63
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if most * most < 1 << 41:
        for at in range(0, len(y), _ROWS):  # such sums are whole numbers below 2**53, so doubles hold them exactly
            part = y[at : at + _ROWS].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
        return total
    wide = y.astype(object)
    return total + wide.T @ wide


def tree_sum(partials: DataFrame, number: Callable) -> dict[int, list]:
    """Sums of the `sums` lists of each i over all partials (i, part, sums as texts), in two levels."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = [number(v) for v in rows["sums"].iloc[0]]
        for sums in rows["sums"].iloc[1:]:
            total = [t + number(v) for t, v in zip(total, sums, strict=True)]
        return pd.DataFrame({"i": [rows["i"].iloc[0]], "part": [-1], "sums": [[repr(t) for t in total]]})

    schema = "i int, part int, sums array<string>"
    halfway = partials.groupBy("i", F.col("part") % _GROUPS).applyInPandas(add, schema)
    return {r["i"]: [number(v) for v in r["sums"]] for r in halfway.groupBy("i").applyInPandas(add, schema).collect()}


def _partials(fit: DataFrame, dim: int, start: Callable, step: Callable) -> DataFrame:
    """One row (i, part, sums) for each row i of what `step` adds up over the x matrices of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = start(), TaskContext.get().partitionId()
        for batch in batches:
            total = total + step(_matrix(batch, dim))
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(len(total)), pa.int32()), "part": pa.array([part] * len(total), pa.int32()),
            "sums": pa.array([[repr(v) for v in row] for row in total.tolist()], pa.list_(pa.string()))})

    return fit.mapInArrow(run, "i int, part int, sums array<string>")


def _meets(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d numbers in rounds of disjoint pairs: each round the circle turns by one."""
    circle, out = list(range(d + d % 2)), []
    for _ in range(len(circle) - 1):
        half = len(circle) // 2
        pairs = [(min(p, q), max(p, q)) for p, q in zip(circle[:half], circle[:half - 1 : -1], strict=True) if max(p, q) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        circle = [circle[0], circle[-1], *circle[1:-1]]
    return out


def jacobi(matrix: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Sweeps over all pairs until every off-diagonal is nothing beside the geometric mean of its
    two diagonals. The largest entry of each vector is positive.
    """
    a, d = np.array(matrix, np.float64), len(matrix)
    q, tiny, rounds = np.eye(d), np.finfo(np.float64).eps, _meets(d)
    for _ in range(most_sweeps):
        turned = False
        for p, r in rounds:
            off, one, two = a[p, r], a[p, p], a[r, r]
            big = np.abs(off) > tiny * np.sqrt(np.abs(one)) * np.sqrt(np.abs(two))
            if not big.any():
                continue
            turned = True
            p, r, off, one, two = p[big], r[big], off[big], one[big], two[big]
            with np.errstate(over="ignore"):
                theta = (two - one) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(1.0, theta))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            a[p], a[r] = c[:, None] * a[p] - s[:, None] * a[r], s[:, None] * a[p] + c[:, None] * a[r]
            a[:, p], a[:, r] = c * a[:, p] - s * a[:, r], s * a[:, p] + c * a[:, r]
            q[:, p], q[:, r] = c * q[:, p] - s * q[:, r], s * q[:, p] + c * q[:, r]
            a[p, p], a[r, r], a[p, r], a[r, p] = one - t * off, two + t * off, 0, 0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    q = q[:, order]
    q *= np.where(q[np.abs(q).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return np.diag(a)[order].copy(), q


def whiten(vectors: DataFrame, id_col: str, vec_col: str, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    scratch = Scratch(spark, "whitening")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vec_col), scale, offset).alias("x")).where("x is not null")
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dim:
        return spark.createDataFrame([], schema)
    lack = F.array_repeat(F.lit(offset).cast("long"), dim - F.size("x"))
    rows = scratch.save(rows.select("vec_id", F.concat("x", lack).alias("x")), "rows")
    fit = scratch.save(rows.select("x").distinct(), "fit")

    (n, *sums), = tree_sum(_partials(fit, dim, lambda: np.zeros((1, dim + 1), object), lambda x: np.array([[len(x), *x.astype(object).sum(axis=0)]], object)), int).values()
    centre = [round(Fraction(s, n)) for s in sums]
    products = tree_sum(_partials(fit, dim, lambda: np.zeros((dim, dim), object), lambda x: scatter(_less(x, centre))), int)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    covariance = np.array([[(n * products[i][j] - rest[i] * rest[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    values, axes = jacobi(covariance)
    trace = float(np.trace(covariance))
    k = int(np.count_nonzero(values[:components] > dim * np.finfo(np.float64).eps * trace))
    if not k:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(axes[:, :k] / np.sqrt(values[:k]))  # dim x 16 doubles at most

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n (x - S/n) in whole numbers, and its projections."""
        apart = _times(_less(x, centre), n)
        apart = apart - np.array(rest, object if apart.dtype == object or max(map(abs, rest)) >> 61 else np.int64)
        return apart, (apart / n).astype(np.float64) @ sent.value

    def square(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([np.ones(len(x)), project(x)[1]])
        return w.T @ w

    seen = tree_sum(_partials(fit, dim, lambda: np.zeros((k + 1, k + 1)), square), float)
    seen = np.array([seen[i] for i in range(k + 1)]) / n
    error = float(np.abs(seen[1:, 1:] - np.outer(seen[0, 1:], seen[0, 1:]) - np.eye(k)).max())
    explained = values[:k] / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                apart, w = project(_matrix(batch, dim))
                most = int(np.abs(apart).max(initial=0)) if apart.dtype != object else 1 << 63
                if most * most * dim < 1 << 62:
                    deviation = (apart * apart).sum(axis=1)
                else:
                    deviation = np.array([min(sum(int(v) ** 2 for v in row), _LONG) for row in apart], np.int64)
                m = len(w)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, n, np.int64)), "deviation": pa.array(np.repeat(deviation, k)), "whitened": pa.array(w.ravel()),
                    "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * k, error))})

    return rows.mapInArrow(run, schema)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
