"""Ordinals, ranks and percentiles over many rows: exact under any partition count and coalescing."""

import os

import pytest
from pyspark.sql import functions as F

from evalspark.operators.ordinal import (exact_percentiles, order_statistic, with_group_prefix_max, with_group_rank,
                                         with_ordinal)

N = 1_000_000


# Partition counts and coalescing; EVALSPARK_LONG_TESTS=1 runs all six pairs.
SETTINGS = [(16, "true"), (200, "false"), (400, "true")]
if os.environ.get("EVALSPARK_LONG_TESTS"):
    SETTINGS += [(16, "false"), (200, "true"), (400, "false")]


@pytest.fixture(params=SETTINGS,
                ids=lambda p: f"{p[0]}-{p[1]}")
def shuffle(spark, request):
    parts, coalesce = request.param
    keys = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": coalesce}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield parts
    for k, v in before.items():
        spark.conf.set(k, v)


def frame(spark, n):
    """One group holds a third of the rows; a payload column and ties in the value."""
    i = F.col("id")
    return spark.range(n).select(
        ((i * 7919) % n).alias("key"), F.when(i % 3 == 0, 0).otherwise(i % 7).alias("g"), (i % 50).cast("double").alias("v"),
        F.md5(i.cast("string")).alias("payload"))


def test_ordinal_is_a_permutation(spark, shuffle):
    o = with_ordinal(frame(spark, N), ["key"]).select("ordinal", "key", "payload")
    r = o.agg(F.count("*"), F.countDistinct("ordinal"), F.min("ordinal"), F.max("ordinal"),
              F.count_if(F.col("ordinal") != F.col("key")), F.countDistinct("payload")).first()
    assert tuple(r) == (N, N, 0, N - 1, 0, N)


def test_ranks_and_running_max(spark, shuffle):
    n = 60_000
    r = with_group_rank(frame(spark, n), ["g"], ["key"], "r", "n")
    for row in r.groupBy("g").agg(F.count("*").alias("c"), F.countDistinct("r").alias("d"), F.min("r").alias("lo"),
                                  F.max("r").alias("hi"), F.max("n").alias("n"), F.countDistinct("payload").alias("p")).collect():
        assert row.c == row.d == row.n == row.p and row.lo == 0 and row.hi == row.c - 1
    m = with_group_prefix_max(frame(spark, n), ["g"], ["key"], "key", "best", rank_name="r")
    assert m.count() == n and m.where("best <> key").count() == 0


def test_percentiles_from_value_counts(spark, shuffle):
    df = frame(spark, 30_000)
    got = {r.g: (r.a, r.b) for r in exact_percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.95}).collect()}
    exp = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).collect()}
    assert got == exp
    pick = {r.g: r.p for r in order_statistic(df, ["g"], "v", "key", {"p": 0.95}).collect()}
    values = {r.g: sorted(r.v) for r in df.groupBy("g").agg(F.collect_list("v").alias("v")).collect()}
    assert pick == {g: v[min(int(0.95 * len(v)), len(v) - 1)] for g, v in values.items()}


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 5)], "g string, v int")
    got = sorted(((r.g or "", r.v, r.rank) for r in with_group_rank(df, ["g"], ["v"]).collect()))
    assert got == [("", 1, 0), ("", 3, 1), ("a", 2, 0), ("a", 5, 1)]
