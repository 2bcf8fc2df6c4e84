"""Parquet tables in day folders: idempotent batches, and retention that touches one day at most.

Layout: ``path/date=D/batch=B``.  A batch overwrites its own (day, batch) folders only, so a replay after a
failure leaves every row once.  Retention drops whole days by folder and rewrites the one day that the
cutoff falls into; both steps may be repeated.
"""

from __future__ import annotations

import datetime as dt

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def write_batch(df: DataFrame, path: str, batch_id: int, ts: str = "timestamp", rows: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append ``df`` as one batch, into the days of ``ts``.  Rows are rebalanced by day, so a day has few
    files and a large day several tasks.  ``rows`` makes the stored rows (it keeps ``ts``) after the shuffle,
    which then carries the narrower input."""
    dealt = df.withColumn("date", F.to_date(ts)).hint("rebalance", "date")
    stored = dealt if rows is None else rows(dealt).withColumn("date", F.to_date(ts))
    (stored.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path))


def batch_sink(path: str, ts: str = "timestamp"):
    """foreachBatch sink for :func:`write_batch`."""
    def write(df: DataFrame, batch_id: int) -> None:
        write_batch(df, path, batch_id, ts)
    return write


def days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days that have a folder, from the listing alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(dt.date.fromisoformat(n[5:]) for n in names if n.startswith("date=") and n[5:6].isdigit())


def retain(spark: SparkSession, path: str, cutoff: dt.datetime, ts: str = "timestamp") -> DataFrame:
    """Delete rows with ``ts`` before ``cutoff``: (date, action, rows_before, rows_after) of each day touched.

    Days before the cutoff's are dropped as folders; of the cutoff's own day the kept rows are written aside
    and then replace that day alone (no other day is read or written).  Row counts come from the files'
    footers.  Rows without a time lie in no day folder that is touched and stay."""
    schema = "date date, action string, rows_before long, rows_after long"
    old = [d for d in days(spark, path) if d < cutoff.date()]
    edge = [d for d in days(spark, path) if d == cutoff.date()]
    done = []
    # basePath keeps the partition columns when only some folders are read.
    read = spark.read.option("basePath", path)
    if edge:
        day = read.parquet(f"{path}/date={edge[0]}")
        kept = day.where(F.col(ts) >= F.expr(f"TIMESTAMP_NTZ'{cutoff:%Y-%m-%d %H:%M:%S.%f}'"))
        aside = scratch_path(spark, f"retained/{path.rstrip('/').rsplit('/', 1)[-1]}-{edge[0]}")
        before = day.count()
        kept.write.mode("overwrite").parquet(aside)
        rest = spark.read.schema(day.schema).parquet(aside)
        after = rest.count()
        if after < before:
            # One batch number holds the day's remainder; the day's other batches go.
            _drop(spark, [f"{path}/date={edge[0]}"]) if not after else _replace_day(rest, path, day)
            done.append((edge[0], "rewritten", before, after))
    if old:
        gone = read.parquet(*[f"{path}/date={d}" for d in old]).groupBy("date").count().collect()  # one row per day dropped
        _drop(spark, [f"{path}/date={d}" for d in old])
        done += [(r.date, "dropped", r["count"], 0) for r in gone]
    return spark.createDataFrame(sorted(done), schema)


def _replace_day(rest: DataFrame, path: str, day: DataFrame) -> None:
    """Write each (day, batch) folder anew; batches of which nothing is left are dropped."""
    spark = rest.sparkSession
    left = {r.batch for r in rest.select("batch").distinct().collect()}
    had = {(r.date, r.batch) for r in day.select("date", "batch").distinct().collect()}
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)
    _drop(spark, [f"{path}/date={d}/batch={b}" for d, b in had if b not in left])


def _drop(spark: SparkSession, folders: list[str]) -> None:
    for f in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    spark.catalog.clearCache()
