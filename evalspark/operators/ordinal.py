"""Global and per-group ordinals without a single-partition window.

The frame is range-partitioned on the order key and sorted inside each partition; every row's
partition and place in it become *data columns* of a reliable checkpoint (:func:`placed`).  Row counts
per partition, start offsets, group starts and carries are all derived from that one stored copy, so
they cannot disagree: neither sampled range bounds, nor adaptive coalescing, nor a recomputed task can
give two readings of the order.  The offset table has one row per partition.

A hot group is spread over many range partitions (the group key comes first in the order), never
sorted inside one window task.  Percentiles work on value counts: one row per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def placed(df: DataFrame, order: list, num_partitions: int | None = None) -> DataFrame:
    """The rows in order, with their range partition ``_pid`` and place in it ``_pos`` as stored columns."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = [_col(c) for c in order]
    s = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    return (s.sortWithinPartitions(*cols)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)))
             .checkpoint())


def _offsets(s: DataFrame, weight: Column) -> DataFrame:
    """(_pid, _off): the weight of all earlier partitions; a window over one row per partition."""
    sums = s.groupBy("_pid").agg(F.sum(weight).alias("_n"))
    return sums.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))


def _numbered(df: DataFrame, order: list, name: str, num_partitions: int | None = None) -> DataFrame:
    """``with_ordinal`` that keeps the partition column ``_pid``."""
    s = placed(df, order, num_partitions)
    offsets = _offsets(s, F.lit(1))
    return (s.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_pos")).drop("_pos", "_off"))


def with_ordinal(df: DataFrame, order: list, name: str = "ordinal", num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the order; rows that tie get some order among them."""
    return _numbered(df, order, name, num_partitions).drop("_pid")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which a NULL equals a NULL; the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(r[f"_k{i}"]) for i, k in enumerate(keys)]
    return left.join(r, on).drop(*[f"_k{i}" for i in range(len(keys))])


def with_group_rank(df: DataFrame, group: list[str], order: list, name: str = "rank",
                    count_name: str | None = None) -> DataFrame:
    """0-based rank inside each group (and optionally the group size), skew-safe.

    The global ordinal is taken on (group, order); a group's first position and size come from one row
    per (range partition, group) — a window over those rows spans at most the partitions the group
    covers — and are joined back on (partition, group), so even a hot group's rows stay spread over
    its range partitions."""
    o = _numbered(df, [*group, *order], "_gord")
    pg = o.groupBy("_pid", *group).agg(F.min("_gord").alias("_pmin"), F.count("*").alias("_pc"))
    wg = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    cols = [F.min("_pmin").over(wg).alias("_gstart")]
    if count_name:
        cols.append(F.sum("_pc").over(wg).alias(count_name))
    starts = pg.select("_pid", *group, *cols)
    return _same(o, starts, ["_pid", *group]).withColumn(name, F.col("_gord") - F.col("_gstart")).drop("_gord", "_gstart", "_pid")


def value_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, _c, _lo, _n): of each distinct non-NULL value its count, the number of smaller
    values in its group, and the group's size.  Rows are combined to value counts before they are
    ordered, so a frequent value is one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    s = placed(counts, [*group, value])
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    run = (s.withColumn("_before", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
            .join(F.broadcast(_offsets(s, F.col("_c"))), "_pid").withColumn("_at", F.col("_before") + F.col("_off")))
    if not group:
        return run.select(value, "_c", F.col("_at").alias("_lo"), s.agg(F.sum("_c")).scalar().alias("_n"))
    starts = run.groupBy(*group).agg(F.min("_at").alias("_gstart"), F.sum("_c").alias("_n"))
    return _same(run.drop("_n"), starts, group).select(*group, value, "_c", (F.col("_at") - F.col("_gstart")).alias("_lo"), "_n")


def _at_rank(rank: Column, value: str) -> Column:
    """The value that holds a 0-based rank, as an aggregate."""
    return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_lo") + F.col("_c")), F.col(value)))


def order_statistic(df: DataFrame, group: list[str], value: str, tiebreak: str, qs: dict[str, float]) -> DataFrame:
    """Per group, for each named q: the value at 0-based index ``int(q·n)`` of the ascending
    sorted values (capped at n−1) — the reference's non-interpolated percentile.  ``tiebreak`` has no
    bearing on a value and is kept for callers."""
    r = value_ranks(df, group, value)
    picks = [_at_rank(F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), value).alias(name) for name, q in qs.items()]
    return r.groupBy(*group).agg(*picks)


def with_group_prefix_max(df: DataFrame, group: list[str], order: list, value: str, name: str = "prefix_max",
                          exclusive: bool = False, rank_name: str | None = None) -> DataFrame:
    """Running max of ``value`` inside each group along ``order``, skew-safe.

    Every stored range partition is scanned on its own (a window over one partition and group).  A
    group that spans several partitions receives the max of its rows in the earlier partitions: one
    row per (partition, group) is aggregated, and a window over those rows gives the carry."""
    o = _numbered(df, [*group, *order], "_po")
    pg = o.groupBy("_pid", *group).agg(F.max(value).alias("_pm"), F.min("_po").alias("_pmin"))
    carry = pg.select("_pid", *group, F.max("_pm").over(
        Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        F.min("_pmin").over(Window.partitionBy(*group)).alias("_gstart"))
    frame = Window.partitionBy("_pid", *group).orderBy("_po").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    j = _same(o.withColumn("_in", F.max(value).over(frame)), carry, ["_pid", *group])
    if rank_name:
        j = j.withColumn(rank_name, F.col("_po") - F.col("_gstart"))
    return j.withColumn(name, F.greatest(F.col("_in"), F.col("_carry"))).drop("_po", "_pid", "_in", "_carry", "_gstart")


def with_prefix_max(df: DataFrame, order: list, value: str, name: str = "prefix_max", exclusive: bool = True) -> DataFrame:
    """Running max of ``value`` along a total order, distributed: stored range partitions are scanned
    independently and carry the max of all earlier partitions (one row per partition, broadcast)."""
    o = _numbered(df, order, "_po")
    pmax = o.groupBy("_pid").agg(F.max(value).alias("_pm"))
    carry = pmax.select("_pid", F.max("_pm").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    frame = Window.partitionBy("_pid").orderBy("_po").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    j = o.withColumn("_in", F.max(value).over(frame)).join(F.broadcast(carry), "_pid")
    best = F.greatest(F.col("_in"), F.col("_carry"))  # greatest skips NULLs
    return j.withColumn(name, best).drop("_po", "_pid", "_in", "_carry")


def exact_percentiles(df: DataFrame, group: list[str], value: str, qs: dict[str, float],
                      extra_aggs: list | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation (position q·(n−1), as numpy / ``percentile``) per
    group, from value counts: NULLs dropped, one row per distinct value is ordered, and one partial
    aggregation picks the two neighbouring ranks.  ``extra_aggs`` (over the non-NULL values) are
    computed from the rows in an aggregation of their own."""
    r = value_ranks(df, group, value)
    aggs = []
    for name, q in qs.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        aggs += [_at_rank(F.floor(pos), value).alias(f"_{name}_lo"), _at_rank(F.ceil(pos), value).alias(f"_{name}_hi"),
                 F.max(pos - F.floor(pos)).alias(f"_{name}_f")]
    g = r.groupBy(*group).agg(*aggs)
    out = g.select(*group, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for n in qs])
    if not extra_aggs:
        return out
    more = df.where(F.col(value).isNotNull()).select(*group, value).groupBy(*group).agg(*extra_aggs)
    names = [c for c in more.columns if c not in group]
    if not group:
        one = out.select(F.struct(*qs)).scalar()
        return more.select(*names, *[one[q].alias(q) for q in qs])
    return _same(more, out, group).select(*group, *names, *qs)


def mode_value(df: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    """Most frequent non-NULL value (smallest on ties) per group: a distributed count per value,
    then a partial ``min_by`` over (−count, value) — no value map in one task."""
    group = group or []
    counts = df.where(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count("*").alias("_c"))
    pick = F.min_by(F.col(col), F.struct(-F.col("_c"), F.col(col))).alias(col)
    return counts.groupBy(*group).agg(pick) if group else counts.agg(pick)
