"""Exact deduplication as a stateful stream.

Rows become (digest, points, id, locator) and go, batch by batch, through a streaming aggregation
whose state lies in RocksDB on disk and never expires: for every digest the number of rows and the
best row so far (most code points, then smallest id).  A digest that was hit more than once is
trusted only after the full normalised texts were compared; texts that share a digest but differ get
groups of their own.  DataFrame operations only; copies are combined inside each task before any
shuffle, so a group of any size stays spread.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import scratch_dir, scratch_scope, settled, written

SPACE = " \t\n\x0b\x0c\r"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: do not set disk space aside for each one's logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    # Stores of a stream that has ended give back their memory and disk soon.
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normal(text: Column) -> Column:
    """The text without space and 0x09-0x0D."""
    return F.translate(text, SPACE, "")


def _better() -> Column:
    """Smallest for the row that stays: most code points, then smallest id (null ids last), then place."""
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"),
                    F.col("file").alias("file"), F.col("row").alias("row"))


def _keyed(norm: Column, key: Column) -> list[Column]:
    """Columns of the landing table."""
    return [F.col("doc_id"), F.length("text").cast("long").alias("points"), F.col("file"), key.cast("string").alias("digest"),
            F.sha2(norm, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")]


def _stream_groups(rows: DataFrame, folder: str, trigger_bytes: int) -> DataFrame:
    """(digest, n, best) of all rows of the table ``folder``, by a stream over its files."""
    spark = rows.sparkSession
    out, state = scratch_dir(spark, "dedup-groups"), scratch_dir(spark, "dedup-state")
    groups = (spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", trigger_bytes).parquet(folder)
              .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(_better()).alias("best")))
    # A batch writes the groups it touched; a repeated batch overwrites its own folder.
    spark.createDataFrame([], groups.schema).write.parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _settings(spark, STATE_STORE):
        query = (groups.writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", state).trigger(availableNow=True).start())
        query.awaitTermination()
    seen = spark.read.schema(groups.schema).option("basePath", out).parquet(out)
    # Counts only grow and the best only improves, so the last state of a group is its extreme.
    return seen.groupBy("digest").agg(F.max("n").alias("n"), F.min("best").alias("best"))


def find_copies(docs: DataFrame, digest: Callable[[Column], Column] | None = None, trigger_bytes: int = 256 << 20,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without space and 0x09-0x0D; null counts as empty, so null,
    empty and blank texts form one group.  Of a group stays the row with the most code points, then
    the smallest id, then (rows without an id, or equal rows) the first place in the input.  Rows
    without an id take part; their id stays null.  An empty table gives an empty result; other columns
    are ignored.  ``digest`` maps the normalised text to the state's key (SHA-256 by default);
    ``trigger_bytes`` bounds the key rows read by one micro-batch.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.input_file_name().alias("file"))
    norm = normal(F.col("text"))
    key = digest(norm) if digest else F.sha2(norm, 256)
    keyed = raw.select(*_keyed(norm, key))
    folder = scratch_dir(spark, "dedup-keys")
    keyed.write.parquet(folder)
    rows = spark.read.schema(keyed.schema).parquet(folder)
    out = scratch_dir(spark, "dedup-state-out")
    with scratch_scope(spark):  # the stream's state and batches are not read again
        groups = written(_stream_groups(rows, folder, trigger_bytes), "", out)

    # Full bytes of every hit: rows of digests seen more than once, spread by id, combined in each task.
    hits = groups.where("n > 1").select("digest")
    texts = raw.select("doc_id", key.cast("string").alias("digest"), norm.alias("norm"))
    hit_texts = texts.join(hits, "digest", "left_semi").repartition("doc_id", "digest")
    compared = hit_texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    mixed = written(compared.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-mixed")

    result = rows.join(groups, "digest")
    if not mixed.isEmpty():
        # Digests of several texts: their rows are read again with their texts and grouped by those, byte by byte.
        apart = written(raw.select(*_keyed(norm, key), norm.alias("norm")).join(mixed, "digest", "left_semi"), "dedup-apart")
        by_text = apart.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(_better()).alias("best"))
        result = (rows.join(mixed, "digest", "left_anti").join(groups, "digest")
                  .unionByName(apart.join(by_text, ["digest", "norm"]).drop("norm")))
    return result.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                         (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, digest: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``find_copies`` drops.  Rows with equal id and equal normalised text
    (null ids count as equal here) cannot be told apart and stay or go together."""
    def stays() -> DataFrame:
        return find_copies(docs, digest, id_col=id_col, text_col=text_col).where("kept").select("doc_id", "text_sha256").distinct()

    kept = settled(docs.sparkSession, "dedup-stays", stays).alias("_stays")
    own = docs.alias("_own")  # qualified, so that no column of the caller's can clash
    text = F.coalesce(F.col(f"_own.`{text_col}`").cast("string"), F.lit(""))
    same = (F.col(f"_own.`{id_col}`").cast("long").eqNullSafe(F.col("_stays.doc_id"))
            & (F.sha2(normal(text), 256) == F.col("_stays.text_sha256")))
    return own.join(kept, same, "left_semi")
