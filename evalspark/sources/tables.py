"""Driver tables (one parquet file each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
# Tables whose rows carry text or vectors: per-row work (tokenising, n-grams, regexes) is CPU-heavy.
TEXT_TABLES = {"documents", "pages", "benchmark", "conversations", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    Parquet splits only at row-group boundaries, so a table written as one row group is read by one
    task.  Where that hurts (a bench on small files), the session setting ``evalspark.text.partitions``
    spreads the text tables over so many partitions before per-row work; it is unset by default.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get("evalspark.text.partitions", None)
    return df.repartition(int(spread)) if spread and name in TEXT_TABLES else df
