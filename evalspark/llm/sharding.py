"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows stand in ``blocks`` source blocks.  How many rows of each block go to each shard is drawn
exactly, as a uniform permutation of all rows would have it: a multivariate hypergeometric table with
the blocks' sizes and the shards' sizes as margins, drawn for groups of blocks, then inside each.  Each
block is then permuted by itself and cut by its row of the table, the pieces are exchanged, and each
shard is permuted again.  All of it is DataFrame expressions; draws are functions of the seed, so a
lost task repeats them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import ROWS_A_TASK, group_positions, spread, text_rows, written


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) that is a function of the key."""
    bits = F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 53))


def _chance(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(k + 1) / P(k) of the hypergeometric law."""
    return ((marked - k) * (drawn - k)) / ((k + 1) * (total - marked - drawn + k + 1))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` out of ``total``, by inversion of the law at ``u``.

    The law is summed over all its support within 12 standard deviations (and 24 items) of its mode;
    what lies beyond is under the resolution of a double.
    """
    t, m, d = (c.cast("double") for c in (total, marked, drawn))
    low, high = F.greatest(F.lit(0.0), d + m - t), F.least(m, d)
    mode = F.floor((d + 1) * (m + 1) / (t + 2)).cast("double")
    share = m / F.greatest(t, F.lit(1.0))
    sd = F.sqrt(F.greatest(F.lit(0.0), d * share * (1 - share) * (t - d) / F.greatest(t - 1, F.lit(1.0))))
    reach = F.ceil(sd * 12).cast("double") + 24
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)

    def with_span(span: Column) -> Column:
        # Chances relative to the first value's, kept in range by the span's width.
        values = F.sequence(span["first"].cast("long"), span["last"].cast("long"))
        step = lambda acc, k: F.struct(
            (acc["p"] * _chance(k.cast("double"), t, m, d)).alias("p"), (acc["sum"] + acc["p"]).alias("sum"))
        zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        whole = F.aggregate(values, zero, step, lambda acc: acc["sum"])

        def pick(goal: Column) -> Column:
            walk = lambda acc, k: F.struct(
                (acc["p"] * _chance(k.cast("double"), t, m, d)).alias("p"), (acc["sum"] + acc["p"]).alias("sum"),
                (acc["below"] + F.when(acc["sum"] + acc["p"] < goal, 1).otherwise(0)).alias("below"))
            start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).alias("below"))
            return F.aggregate(values, start, walk, lambda acc: acc["below"])

        below = F.element_at(F.transform(F.array(whole * u), pick), 1)
        return F.least(span["first"] + below, span["last"]).cast("long")

    return F.element_at(F.transform(F.array(F.struct(first.alias("first"), last.alias("last"))), with_span), 1)


def _split(counts: Column, rows: Column, all_rows: Column, shards: int, *key: Column) -> Column:
    """How a part with ``rows`` of ``all_rows`` rows divides over the shards, given the counts of all."""
    start = F.struct(all_rows.cast("long").alias("total"), rows.cast("long").alias("drawn"),
                     F.array().cast("array<long>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        have = F.element_at(counts, s + 1)
        state = F.struct(acc["total"].alias("total"), acc["drawn"].alias("drawn"), acc["out"].alias("out"), have.alias("have"),
                         hypergeometric(acc["total"], have, acc["drawn"], _uniform(*key, s)).alias("x"))
        return F.element_at(F.transform(F.array(state), lambda z: F.struct(
            (z["total"] - z["have"]).alias("total"), (z["drawn"] - z["x"]).alias("drawn"),
            F.array_append(z["out"], z["x"]).alias("out"))), 1)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step, lambda acc: acc["out"])


def _deal(counts: Column, sizes: Column, shards: int, *key: Column) -> Column:
    """Rows for each shard of every part, drawn part by part from what the earlier parts left."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(counts.alias("left"), total.alias("total"), F.array().cast("array<array<long>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        size = F.element_at(sizes, i + 1)
        drawn = _split(acc["left"], size, acc["total"], shards, *key, i)
        return F.element_at(F.transform(F.array(drawn), lambda x: F.struct(
            F.zip_with(acc["left"], x, lambda c, y: c - y).alias("left"), (acc["total"] - size).alias("total"),
            F.array_append(acc["out"], x).alias("out"))), 1)

    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), start, step, lambda acc: acc["out"])


def communication_matrix(sizes: DataFrame, shards: int, fan: int, seed: int = 0) -> DataFrame:
    """(block int, counts array<long>): rows of each of the ``fan * fan`` blocks for each shard.

    ``sizes`` is one row: ``sizes`` array<long> with a number of rows for each block.  The table is
    drawn for groups of ``fan`` blocks first, then inside each group, one task for each.
    """
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    total = F.aggregate("sizes", zero, add)
    counts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                         lambda s: F.floor(total / shards).cast("long") + F.when(s < total % shards, 1).otherwise(0))
    groups = F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda g: F.slice("sizes", g * fan + 1, F.lit(fan)))
    top = sizes.select(groups.alias("groups"), counts.alias("counts"))
    sums = F.transform("groups", lambda g: F.aggregate(g, zero, add))
    top = top.select(F.arrays_zip(F.col("groups").alias("sizes"), _deal(F.col("counts"), sums, shards, F.lit(seed)).alias("counts")).alias("parts"))
    parts = top.select(F.posexplode("parts").alias("part", "p")).select("part", "p.sizes", "p.counts").repartition(fan, "part")
    inner = parts.select("part", F.posexplode(_deal(F.col("counts"), F.col("sizes"), shards, F.lit(seed), F.col("part"))).alias("i", "counts"))
    return inner.select((F.col("part") * fan + F.col("i")).cast("int").alias("block"), "counts")


def shuffle_into_shards(docs: DataFrame, shards: int = 16, fan: int | None = None, chunks: int | None = None, seed: int = 0,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot.

    Law ``rows``: the shards' row counts differ by at most one.  Null texts are empty; null ids and
    repeated rows are rows like any other; an empty table gives an empty result; other columns are
    ignored.  ``fan * fan`` source blocks and ``chunks`` parts per shard set how finely the two
    permutations are dealt out over tasks; by default a part has about a million rows.
    """
    rows = text_rows(docs, id_col, text_col).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    key = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    rows = written(rows, "shard-rows")
    n_rows = rows.count()
    fan = fan or max(16, math.isqrt(n_rows // ROWS_A_TASK) + 1)
    chunks = chunks or spread(n_rows // shards)
    blocks = fan * fan
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*key, F.lit(seed + 1)), F.lit(blocks)).cast("int"))
    have = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # One entry per block, in order: bounded by fan * fan.
    every = docs.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(have, "block", "left")
    sizes = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0).cast("long")).alias("n")))),
                                  lambda x: x["n"]).alias("sizes"))
    matrix = communication_matrix(sizes, shards, fan, seed).select(
        "block", F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(
            F.slice("counts", F.lit(1), s), F.lit(0).cast("long"), lambda a, x: a + x)).alias("ends"))
    in_block = Window.partitionBy("block").orderBy(F.xxhash64(*key, F.lit(seed + 2)), *key)
    permuted = rows.withColumn("_at", F.row_number().over(in_block) - 1)
    dealt = permuted.join(F.broadcast(matrix), "block").withColumn(
        "shard", F.size(F.filter("ends", lambda e: e <= F.col("_at"))).cast("int"))
    placed = group_positions(dealt.select("doc_id", "size", "text_crc32", "shard"), ["shard"], key, "slot", chunks)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")
