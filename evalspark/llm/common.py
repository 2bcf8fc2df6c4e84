"""Helpers shared by the operators: table access, written intermediates, distributed positions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table, as Spark's Parquet reader gives it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SCOPES: list[list[str]] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made inside when it ends.  What is still needed must be written
    elsewhere by then (``written`` with a path of its own)."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()  # scopes are nested, so this is the last one
        for folder in made:
            delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder (or to ``path``) and read it back."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The written result of ``make()``; the intermediate tables that it made on the way are deleted."""
    path = scratch_dir(spark, name)
    with scratch_scope(spark):
        return written(make(), name, path)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string not null): the two columns the text operators read.  A null text
    is empty.  Other columns, whatever their names, are left out here and cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


ROWS_A_TASK = 1_000_000


def spread(rows: int, least: int = 64) -> int:
    """A number of parts for ``rows`` narrow rows: about a million in each, ``least`` parts at least."""
    return max(least, -(-rows // ROWS_A_TASK))


def group_positions(df: DataFrame, group: list[str], order: list[Column], name: str, chunks: int = 64) -> DataFrame:
    """Add a gapless 0-based position inside each group without holding a group in one task.

    A group's rows are dealt into ``chunks`` sub-groups by a hash of the order key; the position is
    the sub-group's start plus the row's number in it.  The start offsets have one row per (group,
    sub-group), so with a bounded number of groups they are bounded too.  ``order`` must identify a
    row; rows that tie in it are equal, so either may come first.
    """
    d = df.withColumn("_sub", F.pmod(F.xxhash64(*order, F.lit(977)), F.lit(chunks)).cast("int"))
    counts = d.groupBy(*group, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_sub").orderBy(F.xxhash64(*order, F.lit(978)), *order)
    numbered = d.withColumn("_rn", F.row_number().over(inside) - 1)
    return (numbered.join(starts, [*group, "_sub"])
            .withColumn(name, (F.col("_start") + F.col("_rn")).cast("long"))
            .drop("_sub", "_start", "_rn"))
