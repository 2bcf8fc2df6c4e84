"""Samplers and splitters with exact sizes.

Every random draw is a pure function of ``(seed, row key)``: rows are ordered
by ``md5(seed ':' key)`` (then the key), so a sample is reproducible, does not
depend on partitioning, and survives recomputation after a lost executor.

* fixed-size random samples use ``orderBy(..).limit(n)`` (TakeOrderedAndProject:
  a top-n per partition, then a merge of n rows per partition);
* quotas per stratum / class use the skew-safe group rank of
  :mod:`evalspark.operators.ordinal` (a hot stratum is spread over many range
  partitions, never sorted inside one window task);
* systematic samples, splits and downsampling use the global ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import with_group_rank, with_ordinal


def draw_key(seed: int, key) -> Column:
    """The pseudo-random order of a row: md5 of ``seed:key`` (hex text)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """SA1: exactly min(n, N) rows without replacement."""
    return df.orderBy(draw_key(seed, key), F.col(key)).limit(n)


def stratified_sample(df: DataFrame, n: int, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """SA2: per stratum ``min(len, max(1, int(n·len/N)))`` rows."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_len"))
    total = df.agg(F.count("*")).scalar()  # scalar subquery
    quota = sizes.select(stratum, F.least(F.col("_len"), F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_len") / total))).alias("_q"))
    r = with_group_rank(df.withColumn("_h", draw_key(seed, key)), [stratum], ["_h", key], "_r")
    return r.join(quota, stratum).where(F.col("_r") < F.col("_q")).drop("_h", "_r", "_q")


def systematic_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """SA3: interval = max(1, N // n); rows at positions 0, interval, 2·interval, … — first n."""
    o = with_ordinal(df, order, "_o")
    iv = F.greatest(F.lit(1), F.floor(df.agg(F.count("*")).scalar() / n))
    return o.where((F.col("_o") % iv == 0) & (F.floor(F.col("_o") / iv) < n)).drop("_o")


def balanced_sample(df: DataFrame, n: int, cls: str, key: str, seed: int = 42) -> DataFrame:
    """SA4: ``n // n_classes`` rows per class, capped by the class size.  NULL counts as a class
    when counting classes but selects no rows (pandas ``== NaN`` is never true)."""
    n_classes = df.agg(F.count_distinct(cls) + F.max(F.col(cls).isNull().cast("int"))).scalar()
    r = with_group_rank(df.where(F.col(cls).isNotNull()).withColumn("_h", draw_key(seed, key)), [cls], ["_h", key], "_r")
    return r.where(F.col("_r") < F.floor(F.lit(n) / n_classes)).drop("_h", "_r")


def sample_dataset(df: DataFrame, n: int, strategy: str = "random", *, key: str, seed: int = 42,
                   stratify_column: str | None = None, balance_column: str | None = None,
                   order: list[str] | None = None) -> DataFrame:
    """SA5: strategy dispatch."""
    if strategy == "random":
        return random_sample(df, n, key, seed)
    if strategy == "stratified":
        if not stratify_column:
            raise ValueError("stratify_column is required for stratified sampling")
        return stratified_sample(df, n, stratify_column, key, seed)
    if strategy == "systematic":
        return systematic_sample(df, n, order or [key])
    if strategy == "balanced":
        if not balance_column:
            raise ValueError("balance_column is required for balanced sampling")
        return balanced_sample(df, n, balance_column, key, seed)
    raise ValueError(f"Unsupported sampling strategy: {strategy}")


def train_test_split(df: DataFrame, key: str, train_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """SA6: shuffle by (seed, key); the first ``int(N·ratio)`` rows are 'train', the rest 'test'.
    Returns the frame with a ``split`` column (filter it for either side)."""
    if not 0.0 < train_ratio < 1.0:
        raise ValueError("train_ratio must be between 0.0 and 1.0")
    o = with_ordinal(df.withColumn("_h", draw_key(seed, key)), ["_h", key], "_o")
    cut = F.floor(df.agg(F.count("*")).scalar() * F.lit(train_ratio))
    return o.withColumn("split", F.when(F.col("_o") < cut, "train").otherwise("test")).drop("_h", "_o")


def ordered_split(df: DataFrame, order: list[str], val_fraction: float = 0.2, min_rows: int = 10) -> DataFrame:
    """SA7: head ``int(N·(1−v))`` rows train, tail validation (caller's order); N < min_rows ⇒ every
    row is on both sides (``split`` = 'both')."""
    o = with_ordinal(df, order, "_o")
    total = df.agg(F.count("*")).scalar()
    cut = F.floor(total * F.lit(1.0 - val_fraction))
    lab = F.when(total < min_rows, "both").when(F.col("_o") < cut, "train").otherwise("validation")
    return o.withColumn("split", lab).drop("_o")


def downsample(df: DataFrame, order: list[str], max_points: int = 1000) -> DataFrame:
    """SA9: every ``N // max_points``-th row plus the first and the last; N ≤ max ⇒ all rows."""
    o = with_ordinal(df, order, "_o")
    total = df.agg(F.count("*")).scalar()
    step = F.floor(total / max_points)
    keep = (total <= max_points) | (F.col("_o") % step == 0) | (F.col("_o") == total - 1)
    return o.where(keep).drop("_o")
