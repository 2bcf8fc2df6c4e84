"""Whitening of vectors by principal directions, to double precision.

The fit list holds each distinct vector once.  Its rows, less the exact mean, go through blockwise QR:
every task keeps one triangle, triangles are stacked and factored again in rounds of fixed fan-in, so
the covariance is never formed and nothing grows with the rows.  The last triangle (dimension by
dimension) is solved by Householder bidiagonalisation, dqds and twisted factorisations
(:mod:`bidiagonal`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.bidiagonal import principal_directions
from evalspark.llm.common import written
from evalspark.llm.vectors import is_finite, list_matrix

FAN_IN = 32
RANK_CUT = 1e-12  # singular values below this share of the largest are rounding, not directions
_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def integer_rows(table: DataFrame, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, x array<long>): floor(scale * c) + shift of every entry.  Vectors that are null or
    empty or hold null or non-finite entries are left out; entries of 2**43 and more are held there."""
    most = float(1 << 43)
    x = F.transform(F.col(vec_col).cast("array<double>"),
                    lambda c: F.floor(F.least(F.greatest(c * F.lit(scale), F.lit(-most)), F.lit(most))).cast("long") + F.lit(shift))
    return table.where(is_finite(vec_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vec_col).alias("dim"), x.alias("x"))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, with the subtraction made in integers."""
    return (x * n - sums) / float(n)


def _triangle(rows: np.ndarray, dim: int) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r


def _block_triangles(dim: int, n: int, sums: np.ndarray):
    """One triangle for all rows of a task, folded in batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                rows = _centred(list_matrix(batch.column("x"), dim, "i8"), n, sums)
                r = _triangle(rows if r is None else np.vstack([r, rows]), dim)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])
    return run


def _stacked(dim: int):
    """The triangles of one group of at most a few times FAN_IN as one."""
    def run(pdf):
        rows = np.frombuffer(b"".join(pdf["r"].sort_values()), "<f8").reshape(-1, dim)
        pdf = pdf.iloc[:1].copy()
        pdf["r"] = [_triangle(rows, dim).tobytes()]
        return pdf[["r"]]
    return run


def _reduced(triangles: DataFrame, dim: int) -> np.ndarray:
    """Rounds of stacking until one triangle is left: dimension by dimension, whatever the rows."""
    triangles = written(triangles, "triangles")
    count = triangles.count()
    while count > 1:
        groups = -(-count // FAN_IN)
        dealt = triangles.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
        triangles = written(dealt.groupBy("g").applyInPandas(_stacked(dim), "r binary"), "triangles")
        count = triangles.count()
    return np.frombuffer(bytes(triangles.first().r), "<f8").reshape(dim, dim)


def _column_sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            total += list_matrix(batch.column("x"), dim, "i8").sum(0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim), pa.int32()), pa.array(np.r_[n, total], pa.int64())], names=["at", "v"])
    return run


def _moments(dim: int, n: int, sums: np.ndarray, turn: np.ndarray):
    """Sums and cross products of a task's whitened rows."""
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for batch in batches:
            w = _centred(list_matrix(batch.column("x"), dim, "i8"), n, sums) @ turn
            total += np.r_[(w.T @ w).ravel(), w.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "v"])
    return run


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exact; None beyond the range of a long."""
    d = x * n - sums
    if not d.size or float(np.abs(d).max()) ** 2 * x.shape[1] < 2.0 ** 62:
        return (d * d).sum(1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


def _whitened(dim: int, n: int, sums: np.ndarray, turn: np.ndarray, explained: np.ndarray, error: float):
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                m = batch.num_rows
                x = list_matrix(batch.column("x"), dim, "i8")
                w = _centred(x, n, sums) @ turn
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, n), pa.int64()), pa.array([v for v in _deviations(x, n, sums) for _ in range(k)], pa.int64()),
                     pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def _one_dimension(rows: DataFrame, dim: int, components: int) -> DataFrame:
    spark = rows.sparkSession
    fit = written(rows.select("x").distinct(), "whitening-fit")
    sums = {r.at: r.v for r in fit.mapInArrow(_column_sums(dim), "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).collect()}  # dim + 1 rows
    n, total = sums[-1], np.array([sums[i] for i in range(dim)], np.int64)
    r = _reduced(fit.mapInArrow(_block_triangles(dim, n, total), "r binary"), dim)
    values, directions = principal_directions(r, components)
    real = values > RANK_CUT * max(values.max(initial=0.0), 1e-300)
    values, directions = values[real], directions[:, real]
    if not len(values):
        return spark.createDataFrame([], _OUT)
    turn = directions * (np.sqrt(n) / values)
    k = len(values)
    sums2 = {r.at: r.v for r in fit.mapInArrow(_moments(dim, n, total, turn), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    cross = np.array([sums2[i] for i in range(k * k)]).reshape(k, k) / n
    mean = np.array([sums2[k * k + i] for i in range(k)]) / n
    error = float(np.abs(cross - np.outer(mean, mean) - np.eye(k)).max())
    explained = values ** 2 / float((r * r).sum())
    return rows.mapInArrow(_whitened(dim, n, total, turn, explained, error), _OUT)


def whiten(table: DataFrame, components: int = 16, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out.  ``n`` counts
    the distinct vectors; ``deviation`` is null where it exceeds a long.  Components whose variance is
    nil (rank below ``components``; one distinct vector) have no row.  Vectors of different lengths
    are whitened apart, each length by its own fit.  Repeated rows and ids come back as often as they
    occur, null ids as null; an empty table gives no rows; other columns are ignored.
    """
    rows = written(integer_rows(table, scale, shift, id_col, vec_col), "whitening-rows")
    parts = [_one_dimension(rows.where(F.col("dim") == r.dim).drop("dim"), r.dim, components)
             for r in rows.select("dim").distinct().orderBy("dim").collect()]  # one row per length of vectors
    out = parts[0] if parts else table.sparkSession.createDataFrame([], _OUT)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
