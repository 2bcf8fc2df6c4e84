"""Exact top-k inner products by norm buckets.

Vectors are grouped by length (geometric buckets), each bucket in blocks of bounded size.  A first
pass over the block of the longest vectors gives every query a score that its k-th best result cannot
fall below.  For each bucket that score is a local cosine threshold: above one, the bucket holds
nothing for the query; high ones prune by the query's strongest coordinate (how far a vector with such
a cosine can be from it there), low ones by length alone.  What is left is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import written

BLOCK, QUERIES = 1024, 2048
EXACT = float(1 << 52)  # products of integers below this are exact in a double
COORDINATE_FROM = 0.3  # local cosine threshold from which coordinates prune better than lengths


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f8")


def _scores(q: np.ndarray, v: np.ndarray, longest: float) -> np.ndarray:
    """Exact products; beyond a double's integers in Python's, held to the range of a long."""
    if longest < EXACT:
        return q @ v.T
    exact = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in v], object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1)


def _best(scores, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best, the smaller id first among equals, without the query's own id."""
    at = np.flatnonzero(ids != own)
    s = scores[at]
    if len(at) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k] if s.dtype != object else sorted(s)[len(s) - k]
        some = np.flatnonzero(s >= cut)
        at, s = at[some], s[some]
    order = sorted(range(len(at)), key=lambda i: (-s[i], ids[at[i]]))[:k]
    return [(int(ids[at[i]]), int(s[i])) for i in order]


def _tile(q_ids, q, q_norm, floor, ids, v, norm, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of what a block may add to the queries' results."""
    order = np.argsort(-norm, kind="stable")
    ids, v, norm = ids[order], v[order], norm[order]
    top = float(norm[0])
    slack = 1 - 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_norm * top > 0, floor / (q_norm * top), np.where(floor > 0, np.inf, -np.inf)) * slack
    live = local <= 1
    longest = float(q_norm.max(initial=0.0)) * top
    by_coordinate = live & (local >= COORDINATE_FROM)
    by_length = np.flatnonzero(live & ~by_coordinate)
    if len(by_length):
        scores = _scores(q[by_length], v, longest)
        for row, i in enumerate(by_length.tolist()):
            # Lengths descend: only the first vectors are long enough to reach the floor.
            need = floor[i] * slack / q_norm[i] if floor[i] > 0 else -np.inf
            n = int(np.searchsorted(-norm, -need, "right"))
            for x, s in _best(scores[row, :n], ids[:n], int(q_ids[i]), k):
                yield int(q_ids[i]), x, s
    some = np.flatnonzero(by_coordinate)
    if len(some):
        unit = v / np.where(norm > 0, norm, 1)[:, None]
        for i in some.tolist():
            # A unit vector with cosine t or more to the query lies within this of it in the focus coordinate.
            with np.errstate(divide="ignore"):
                t = np.minimum(1.0, floor[i] * slack / (q_norm[i] * np.where(norm > 0, norm, np.inf)))
            at = int(np.argmax(np.abs(q[i])))
            f = float(q[i, at] / q_norm[i])
            x = unit[:, at]
            # cosine <= f x + sqrt((1 - f^2)(1 - x^2)): both vectors split into the coordinate and the rest
            reach = f * x + np.sqrt(max(0.0, 1 - f * f) * np.maximum(0.0, 1 - x * x))
            keep = np.flatnonzero((reach >= t - 1e-9) & (q_norm[i] * norm >= floor[i] * slack))
            if len(keep):
                scores = _scores(q[i:i + 1], v[keep], longest)[0]
                for y, s in _best(scores, ids[keep], int(q_ids[i]), k):
                    yield int(q_ids[i]), y, s


def _tile_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                q = _vector(b"".join(r["q_vecs"])).reshape(-1, dim)
                v = _vector(b"".join(r["vecs"])).reshape(-1, dim)
                q_norm, norm = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
                floor = np.asarray([-np.inf if x is None else x for x in r["floors"]], float)
                out = list(_tile(np.asarray(r["q_ids"]), q, q_norm, floor, np.asarray(r["ids"]), v, norm, k))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = [np.asarray(x, "<f8") for x in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array([len(x) for x in vecs], pa.int32()),
             pa.array([float(np.sqrt((x * x).sum())) for x in vecs], pa.float64()), pa.array([x.tobytes() for x in vecs], pa.binary())],
            names=["vec_id", "dim", "norm", "vec"])


def integer_vectors(table: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, norm, vec): floor(scale * x) of the vectors whose components are all finite."""
    # floor gives a long, which would wrap; keep doubles beyond its range as they are.
    wide = F.transform(F.col(vec_col).cast("array<double>"), lambda c: F.when(F.abs(c) < 1e15, F.floor(c * scale).cast("double")).otherwise(c * scale))
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad & (F.size(vec_col) > 0))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), wide.alias("v")).mapInArrow(
        _packed, "vec_id long, dim int, norm double, vec binary")


def _blocks(rows: DataFrame, keys: list[str], most: int, suffix: Column) -> DataFrame:
    """Rows dealt into blocks of about ``most`` inside each group of ``keys``."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    dealt = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("vec_id", suffix), F.ceil(F.col("_n") / most)).cast("int"))
    return dealt.drop("_n")


def search(table: DataFrame, is_query: Column, k: int = 5, lanes: int | None = None, scale: float = 256.0, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    ``is_query`` is a condition on ``vec_id``; candidates are all rows but those with the query's id.
    Ties go to the smaller vec_id.  Null, empty and non-finite vectors and null ids take no part;
    vectors of different dimensions are not compared; equal rows are candidates as often as they
    occur; an empty table gives an empty result; other columns are ignored.  Rows that share a query's id
    are one query, whose answers are ranked together.  ``lanes`` is the number of tasks that a
    dimension's blocks are dealt to (by default, one for 64 blocks and 16 at least).
    """
    rows = written(integer_vectors(table, scale, id_col, vec_col), "vectors")
    lanes = lanes or max(16, -(-rows.count() // (64 * BLOCK)))
    rows = rows.withColumn("bucket", F.floor(F.log2(F.greatest(F.col("norm"), F.lit(1e-300))) * 4).cast("int"))
    packed = F.collect_list(F.struct("vec_id", "vec"))
    blocks = (_blocks(rows, ["dim", "bucket"], BLOCK, F.lit(7)).groupBy("dim", "bucket", "part")
              .agg(packed.alias("b"), F.max("norm").alias("top"))
              .select("dim", "bucket", "part", "top", F.col("b.vec_id").alias("ids"), F.col("b.vec").alias("vecs")))
    asked = _blocks(rows.where(is_query), ["dim"], QUERIES, F.lit(8)).withColumnRenamed("part", "chunk")

    def tiles(queries: DataFrame, some: DataFrame) -> DataFrame:
        """Each chunk of queries against each block: both dealt out over lanes."""
        chunks = queries.groupBy("dim", "chunk").agg(F.collect_list(F.struct("vec_id", "vec", "floor")).alias("q"),
                                                     F.min(F.coalesce(F.col("floor"), F.lit(float("-inf"))) / F.greatest("norm", F.lit(1e-300))).alias("least"))
        chunks = chunks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        dealt = some.withColumn("lane", F.pmod(F.xxhash64("bucket", "part"), F.lit(lanes)).cast("int"))
        # A block whose longest vector is too short for every query of the chunk is left out whole.
        met = chunks.join(dealt, ["dim", "lane"]).where(F.col("top") * (1 + 1e-9) >= F.col("least"))
        return met.select("dim", F.col("q.vec_id").alias("q_ids"), F.col("q.vec").alias("q_vecs"), F.col("q.floor").alias("floors"), "ids", "vecs") \
            .mapInArrow(_tile_rows(k), "query_id long, vec_id long, score long")

    # The block of the longest vectors of each dimension: one row per dimension.
    longest = blocks.groupBy("dim").agg(F.max_by(F.struct("bucket", "part"), F.struct(F.size("ids") > k, F.col("bucket"), F.col("part"))).alias("m")).select("dim", "m.*")
    start = tiles(asked.withColumn("floor", F.lit(None).cast("double")), blocks.join(longest, ["dim", "bucket", "part"], "left_semi"))
    floors = (start.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
              .withColumnRenamed("query_id", "vec_id"))
    found = tiles(asked.join(floors, "vec_id", "left"), blocks)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# DuckDB text of the registered query.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
