"""Structured Streaming jobs.

Every job reads a file landing zone with ``readStream`` (explicit schema),
bounds its state with a watermark, writes to a checkpointed sink, and can be
driven to completion with ``trigger(availableNow=True)`` for batch-equality
tests.  Sinks are Parquet (append) or ``foreachBatch`` merges keyed by
micro-batch id, so a replayed batch after a failure overwrites its own output
instead of duplicating it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.logs import LEVELS, admissions, severity_rank
from ..session import scratch_path
from ..sources import day_table


def _ckpt(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-checkpoints/{name}")


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_available(writer, timeout_s: int = 600) -> None:
    q = writer.trigger(availableNow=True).start()
    finished = q.awaitTermination(timeout_s)
    if not finished:
        q.stop()
        raise TimeoutError(f"stream {q.id} did not finish within {timeout_s}s")
    if q.exception() is not None:
        raise q.exception()


def run_in_waves(waves: Iterable[Callable[[], None]], writer: Callable[[], object]) -> None:
    """Land each wave of files, then run the stream over what is new.  Every run goes on from the
    checkpoint of the one before: state, watermark and files already read are kept."""
    for land in waves:
        land()
        run_available(writer())


# ------------------------------------------------------------------ ST1 ingest + ST8 retention
def ingest_logs(logs: DataFrame, sink: str, checkpoint: str, min_level: str = "INFO"):
    """Severity-filtered ingest into a Parquet sink partitioned by day."""
    out = (logs.where(severity_rank("level") >= F.lit(LEVELS.index(min_level)))
               .withColumn("date", F.to_date("timestamp")))
    return (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
               .partitionBy("date").outputMode("append"))


def ingest_day_table(logs: DataFrame, path: str, checkpoint: str, min_level: str = "INFO"):
    """Severity-filtered ingest into a day table (a folder per day and micro-batch), which retention may
    change in place: unlike the file sink it keeps no list of its files."""
    out = logs.where(severity_rank("level") >= F.lit(LEVELS.index(min_level)))
    return out.writeStream.foreachBatch(day_table.batch_sink(path)).option("checkpointLocation", checkpoint)


def retain_days(spark: SparkSession, path: str, now: str, days: int) -> DataFrame:
    """ST8: drop what is older than ``now − days``: whole days go by folder, one day is rewritten.
    Returns the days touched."""
    return day_table.retain(spark, path, dt.datetime.fromisoformat(now) - dt.timedelta(days=days))


# ------------------------------------------------------------------ ST2 correlation
JOIN_PARTITIONS = 24  # state partitions of a join, or two per core where there are more cores


@contextmanager
def join_state(spark: SparkSession):
    """Settings under which a stream with a join is started; the session's own come back afterwards.

    A partition of the join keeps four state stores, and every micro-batch opens and commits each of them with files
    of its own, however few rows they hold.  So their number follows the cores, not the shuffle partitions of the
    session, which grow with the input.  Only the last state stays in memory: the one before holds a whole wave."""
    want = {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                                    max(JOIN_PARTITIONS, 2 * spark.sparkContext.defaultParallelism))),
            "spark.sql.streaming.maxBatchesToRetainInMemory": "1"}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def correlate_stream(requests: DataFrame, responses: DataFrame, delay: str = "1 hour", max_gap: str = "1 hour") -> DataFrame:
    """Stream-stream full outer join of requests with their responses.

    Watermarks on both sides and a time range (a response follows its request by ``max_gap`` at most)
    bound the join state.  ``kind`` is 'matched', 'unanswered' (a request whose range the watermark has
    passed) or 'orphan' (a response without a request in its range)."""
    q = requests.withColumn("req_ts", F.col("req_ts").cast("timestamp")).withWatermark("req_ts", delay).alias("q")
    s = responses.withColumn("resp_ts", F.col("resp_ts").cast("timestamp")).withWatermark("resp_ts", delay).alias("s")
    cond = ((F.col("q.request_id") == F.col("s.resp_id"))
            & (F.col("s.resp_ts") >= F.col("q.req_ts"))
            & (F.col("s.resp_ts") <= F.col("q.req_ts") + F.expr(f"INTERVAL {max_gap}")))
    kind = (F.when(F.col("s.resp_id").isNull(), "unanswered").when(F.col("q.request_id").isNull(), "orphan").otherwise("matched"))
    return q.join(s, cond, "fullOuter").select(F.coalesce("q.request_id", "s.resp_id").alias("request_id"), "q.req_ts", "q.prompt",
                                               "s.response", "s.resp_ts", kind.alias("kind"))


def correlation_sink(path: str):
    """foreachBatch sink: one write per micro-batch, dealt into a folder per kind, under the batch's own
    id.  A replayed batch overwrites itself, and matched rows and orphans appear together or not at all."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")
    return write


def read_correlated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def late_responses(landed: DataFrame, correlated: DataFrame, closed: Column) -> DataFrame:
    """Responses that came in behind the watermark, which the join never saw: landed before ``closed``
    (a time that the watermark has passed), but in no output.  With them no response is lost."""
    seen = correlated.where(F.col("kind") != "unanswered").select(F.col("request_id").alias("resp_id"), "resp_ts")
    old = landed.withColumn("resp_ts", F.col("resp_ts").cast("timestamp")).where(F.col("resp_ts") < closed)
    return (old.join(seen, ["resp_id", "resp_ts"], "left_anti")
            .select(F.col("resp_id").alias("request_id"), F.lit(None).cast("timestamp").alias("req_ts"), F.lit(None).cast("string").alias("prompt"),
                    "response", "resp_ts", F.lit("late").alias("kind")))


# ------------------------------------------------------------------ ST3 / ST4 / ST6 aggregates
def running_counts(logs: DataFrame) -> DataFrame:
    """ST3: running counts per (level, category); the per-level and per-category totals are
    sums over this small table."""
    return logs.groupBy("level", "category").count()


def windowed_usage(pl: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """ST4: per event-time window: requests, Σ tokens, mean truthy latency, error rate."""
    w = (pl.withColumn("_et", F.col("timestamp").cast("timestamp")).withWatermark("_et", delay)
           .groupBy(F.window("_et", window).alias("w")))
    return w.agg(F.count("*").alias("requests"),
                 F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"),
                 F.avg(F.when(F.col("latency") != 0, F.col("latency"))).alias("avg_latency"),
                 (F.count_if(F.coalesce(F.col("error"), F.lit("")) != "") / F.count("*")).alias("error_rate")) \
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests", "tokens", "avg_latency", "error_rate")


def progress(events: DataFrame, job: str, score: str, ts: str, prog: str) -> DataFrame:
    """ST6: best score so far and the latest progress per job (update mode)."""
    return events.groupBy(job).agg(F.max(score).alias("best_score"), F.max_by(prog, ts).alias("progress"),
                                   F.count("*").alias("steps"))


def upsert_batches(path: str, keys: list[str]):
    """foreachBatch sink for update-mode aggregates: every micro-batch is written under its own
    batch id (a replay overwrites itself); readers keep the row of the highest batch per key."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def read_upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    d = spark.read.parquet(path)
    cols = [c for c in d.columns if c not in keys and c not in ("_batch", "batch")]
    g = d.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch")).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


# ------------------------------------------------------------------ ST4 slices, panes, sessions
def usage_slices(pl: DataFrame, width: str = "15 minutes", delay: str = "2 hours") -> DataFrame:
    """Mergeable usage per slice of event time: counts, sums and a quantile sketch of truthy latencies.
    A row enters one slice only, however many panes will show it."""
    lat = F.when(F.col("latency") != 0, F.col("latency"))
    w = (pl.withColumn("_et", F.col("timestamp").cast("timestamp")).withWatermark("_et", delay).groupBy(F.window("_et", width).alias("w")))
    return w.agg(F.count("*").alias("requests"), F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"),
                 F.sum(lat).alias("latency_sum"), F.count(lat).alias("latency_n"),
                 F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"), F.kll_sketch_agg_double(lat).alias("sketch")) \
        .select(F.col("w.start").alias("slice_start"), "requests", "tokens", "latency_sum", "latency_n", "errors", "sketch")


def sliding_usage(slices: DataFrame, panes: int, width: str = "15 minutes", qs: dict[str, float] | None = None) -> DataFrame:
    """Sliding windows of ``panes`` slices, one starting at every slice: each slice row (not each
    request) is copied to the windows that hold it, and sums and sketches are merged."""
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(panes - 1)), lambda k: F.col("slice_start") - k * F.expr(f"INTERVAL {width}")))
    w = slices.withColumn("window_start", starts).groupBy("window_start").agg(
        F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), (F.sum("latency_sum") / F.sum("latency_n")).alias("avg_latency"),
        (F.sum("errors") / F.sum("requests")).alias("error_rate"), F.sum("latency_n").alias("_n"), F.kll_merge_agg_double("sketch").alias("_s"))
    quantiles = [F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_s", F.lit(float(q)))).alias(n) for n, q in (qs or {}).items()]
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests", "tokens", "avg_latency", "error_rate", *quantiles)


def session_usage(pl: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Usage per session of activity: a session ends when its key is silent for ``gap``; it is written once
    (append mode), when the watermark has passed its end, and then leaves the state."""
    g = (pl.withColumn("_et", F.col("timestamp").cast("timestamp")).withWatermark("_et", delay)
         .groupBy("session_id", F.session_window("_et", gap).alias("w")))
    return g.agg(F.count("*").alias("requests"), F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"),
                 F.avg(F.when(F.col("latency") != 0, F.col("latency"))).alias("avg_latency")) \
        .select("session_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"),
                "requests", "tokens", "avg_latency")


# ------------------------------------------------------------------ ST5 limiter
LIMIT_BUCKETS = 1024  # groups of clients; a stream keeps its number, as its state is kept by them
NO_ID = -(1 << 63)  # stands for a null id inside the state


def _limiter(limit: int, window_us: int):
    def fn(key, pdfs, state):
        """State: waiting events (client, time, id) that the watermark has not passed, and the last admitted
        times of each client.  Without a column of clients all events are the key's."""
        clients, times, ids, held, kept = ([*(x or [])] for x in state.get) if state.exists else ([], [], [], [], [])
        if state.hasTimedOut:
            state.remove()
        else:
            for pdf in pdfs:
                clients += pdf["_client"].tolist() if "_client" in pdf else [key[0]] * len(pdf)
                times += pdf["_t"].tolist()
                ids += pdf["event_id"].tolist()
        # Nothing at or before the watermark can still come in, so that part of the order is final.
        passed = state.getCurrentWatermarkMs() * 1000
        c, t, i = (np.array(x, np.int64) for x in (clients, times, ids))
        ready, waiting = np.flatnonzero(t <= passed), np.flatnonzero(t > passed)
        ready = ready[np.lexsort((i[ready], t[ready], c[ready]))]
        admitted: dict[int, list[int]] = {}
        for who, at in zip(held, kept):
            admitted.setdefault(who, []).append(at)
        ok: list[bool] = []
        edges = [0, *(np.flatnonzero(np.diff(c[ready])) + 1).tolist(), len(ready)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo < hi:
                who = int(c[ready[lo]])
                allowed, admitted[who] = admissions(t[ready[lo:hi]].tolist(), limit, window_us, admitted.get(who))
                ok += allowed
        # Older admissions no longer count.
        still = [(who, at) for who, all_of in admitted.items() for at in all_of if at + window_us > passed]
        if len(waiting) or still:
            state.update((c[waiting].tolist(), t[waiting].tolist(), i[waiting].tolist(), [x for x, _ in still], [x for _, x in still]))
            due = int(t[waiting].min()) if len(waiting) else max(x for _, x in still) + window_us
            state.setTimeoutTimestamp(max(due // 1000, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        if len(ready):
            who, what = (pd.Series(x[ready], dtype="Int64") for x in (c, i))
            yield pd.DataFrame({"user_id": who.mask(pd.Series(key[0] < 0, who.index)), "event_id": what.mask(what == NO_ID), "allowed": ok})
    return fn


def rate_limit_stream(events: DataFrame, limit: int, window_s: float, delay: str = "1 hour") -> DataFrame:
    """ST5: per-client sliding-window limiter in event time.

    Events wait in the state until the watermark passes them and are then decided in (time, id) order,
    so the decisions are those of the batch limiter however events are split over micro-batches, as long
    as they come in within ``delay``.  Timeouts decide the waiting events of clients that fall
    silent; admissions leave the state once they are a window old.  Clients share ``LIMIT_BUCKETS``
    groups by a hash (those without an id have one of their own), so the number of calls and timeouts of a
    micro-batch does not follow the number of clients."""
    client = F.col("user_id")
    bucket = F.when(client.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(client), F.lit(LIMIT_BUCKETS)).cast("int"))
    src = (events.withColumn("_et", F.col("ts").cast("timestamp")).withWatermark("_et", delay)
           .select(bucket.alias("_bucket"), F.coalesce(client, F.lit(0)).cast("long").alias("_client"),
                   F.coalesce("event_id", F.lit(NO_ID)).alias("event_id"), "_et", F.unix_micros("_et").alias("_t")))  # integer microseconds
    return src.groupBy("_bucket").applyInPandasWithState(
        _limiter(limit, int(round(window_s * 1e6))), "user_id long, event_id long, allowed boolean",
        "clients array<long>, times array<long>, ids array<long>, held array<long>, kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ ST7 dedup
def dedup_stream(events: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """ST7: idempotent ingest — duplicates of a key arriving within the watermark delay are dropped."""
    e = events.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", delay)
    return e.dropDuplicatesWithinWatermark([key]).drop("_et")
