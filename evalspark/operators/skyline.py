"""Non-dominated rows for any number of objectives.

1. Rows shrink to distinct objective vectors.
2. A grid of at most ``CELLS`` cells is laid over the objectives' ranges.  A cell that another occupied
   cell exceeds in every coordinate holds only dominated vectors and goes as a whole; the occupied cells
   are counted in one partial aggregation.
3. Each partition keeps its own front.
4. Survivors meet only those that may dominate them: a survivor of cell c goes to the tiles of the live
   cells that c reaches or exceeds in every coordinate.  Tiles of full cells are parted by rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CELLS = 4096
TILE_ROWS = 20_000


def _dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of x some row of ``by`` reaches in every objective and exceeds in one."""
    out = np.zeros(len(x), bool)
    step = max(1, 4_000_000 // max(1, len(by) * x.shape[1]))
    for a in range(0, len(x), step):
        block = x[a:a + step, None, :]
        out[a:a + step] = ((by[None] >= block).all(2) & (by[None] > block).any(2)).any(1)
    return out


def front(x: np.ndarray) -> np.ndarray:
    """Row numbers of the non-dominated rows.  In order of falling sums (ties: falling vectors) no row is
    dominated by a later one."""
    order = np.lexsort([*(-x[:, i] for i in range(x.shape[1] - 1, -1, -1)), -x.sum(1)])
    kept = np.zeros((0, x.shape[1]))
    rows: list[np.ndarray] = []
    for a in range(0, len(order), 256):
        some = order[a:a + 256]
        some = some[~_dominated(x[some], kept)]
        some = some[~_dominated(x[some], x[some])]
        kept = np.vstack([kept, x[some]])
        rows.append(some)
    return np.concatenate(rows) if rows else order


def _local_fronts(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, len(columns) + 1))
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in [*columns, "_cell"]])
            kept = np.vstack([kept, rows])
            kept = kept[front(kept[:, :-1])]
        yield pa.RecordBatch.from_arrays([*(pa.array(kept[:, i]) for i in range(len(columns))), pa.array(kept[:, -1].astype(np.int64))],
                                         names=[*columns, "_cell"])
    return run


def _tile_fronts(columns: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["_mine"]]
        return mine[~_dominated(mine[columns].to_numpy(float), pdf[columns].to_numpy(float))][columns]
    return run


def _coordinates(code: np.ndarray, side: int, dims: int) -> np.ndarray:
    return (code[:, None] // side ** np.arange(dims)) % side


def skyline(df: DataFrame, objectives: list[str]) -> DataFrame:
    """Rows that no other row reaches in all objectives and exceeds in one (all maximised; equal rows stay
    together).  Rows with a NULL or NaN objective cannot be compared and are left out."""
    ensure_checkpoint_dir(df.sparkSession)
    spark = df.sparkSession
    names = [f"_o{i}" for i in range(len(objectives))]
    sound = F.lit(True)
    for c in objectives:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(sound)
    points = rows.select(*[F.col(c).cast("double").alias(n) for c, n in zip(objectives, names)]).distinct()
    dims = min(len(names), 12)  # 2 ** 12 cells: further objectives do not cut the grid
    side = max(2, int(round(CELLS ** (1 / dims) - 0.5)))
    ends = points.agg(*[F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias(n) for n in names[:dims]])
    box = ends.select(F.struct(*names[:dims])).scalar()
    cell = F.lit(0).cast("long")
    for k, n in enumerate(names[:dims]):
        lo, hi = box[n]["lo"], box[n]["hi"]
        at = F.when(hi > lo, F.least(F.floor((F.col(n) - lo) / (hi - lo) * side), F.lit(side - 1))).otherwise(0)
        cell = cell + at.cast("long") * side ** k
    points = points.withColumn("_cell", cell)
    occupied = np.array(sorted(r._cell for r in points.select("_cell").distinct().collect()), np.int64)  # at most CELLS rows
    if not len(occupied):
        return rows
    at = _coordinates(occupied, side, dims)
    live = np.array([not (at > at[i]).all(1).any() for i in range(len(at))])
    cells = spark.createDataFrame(pd.DataFrame({"_cell": occupied[live]}))
    local = (points.join(F.broadcast(cells), "_cell", "left_semi").select(*names, "_cell")
             .mapInArrow(_local_fronts(names), ", ".join(f"{n} double" for n in names) + ", _cell long").checkpoint())
    sizes = {r._cell: r["count"] for r in local.groupBy("_cell").count().collect()}  # at most CELLS rows
    codes = np.array(sorted(sizes), np.int64)
    at = _coordinates(codes, side, dims)
    # Which survivors' cells may hold a dominating vector of which cell's.
    reach = pd.DataFrame([(int(codes[k]), [int(c) for c in codes[(at <= at[k]).all(1)]]) for k in range(len(codes))], columns=["_cell", "_to"])
    parts = pd.DataFrame([(int(c), -(-sizes[int(c)] // TILE_ROWS)) for c in codes], columns=["_tile", "_parts"])
    reach_df, parts_df = spark.createDataFrame(reach, "_cell long, _to array<long>"), spark.createDataFrame(parts, "_tile long, _parts long")
    own = F.pmod(F.xxhash64(*names), F.col("_parts"))
    met = (local.join(F.broadcast(reach_df), "_cell").withColumn("_tile", F.explode("_to")).drop("_to")
           .join(F.broadcast(parts_df), "_tile").withColumn("_own", own)
           .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
           .withColumn("_mine", (F.col("_tile") == F.col("_cell")) & (F.col("_part") == F.col("_own"))))
    best = (met.select("_tile", "_part", "_mine", *names).groupBy("_tile", "_part")
            .applyInPandas(_tile_fronts(names), ", ".join(f"{n} double" for n in names)))
    on = F.lit(True)
    for c, n in zip(objectives, names):
        on = on & (F.col(c).cast("double") == F.col(n))
    return rows.join(best, on, "left_semi")
