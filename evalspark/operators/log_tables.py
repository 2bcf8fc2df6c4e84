"""LG6 / LG7: typed event tables and the generic log, written together.

A record becomes one stored row that holds its typed form and its generic log form side by side, so one
pass writes both and they cannot disagree.  The typed tables and the generic log are column-pruned
views of it.  Batches are idempotent and days are folders (:mod:`evalspark.sources.day_table`).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import day_table

KINDS = ("llm_requests", "optimization_steps", "evaluation_results")
_GENERIC = ("timestamp", "level", "category", "message", "metadata", "session_id", "duration_ms")


def merged(base: Column, extra: dict[str, Column]) -> Column:
    """A string map with further entries; an entry of the same key is replaced."""
    keys = [F.lit(k) for k in extra]
    more = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_concat(F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*keys)), more)


def _both(df: DataFrame, typed: dict[str, Column], category: str, message: Column, metadata: Column, session: Column) -> DataFrame:
    log = {"timestamp": F.col("timestamp"), "level": F.lit("INFO"), "category": F.lit(category), "message": message, "metadata": metadata,
           "session_id": session, "duration_ms": F.col("duration_ms")}
    return df.select("timestamp", F.struct(*[v.alias(k) for k, v in typed.items()]).alias("typed"),
                     F.struct(*[log[k].alias(k) for k in _GENERIC]).alias("log"))


def request_rows(df: DataFrame) -> DataFrame:
    """From (timestamp, session_id, prompt, model, response, metrics, duration_ms): tokens used and cost
    are lifted out of the metrics; the log's metadata are the metrics and both lengths."""
    m = F.col("metrics")
    typed = {c: F.col(c) for c in ("timestamp", "session_id", "prompt", "model", "response", "metrics", "duration_ms")}
    typed |= {"tokens_used": m["tokens_used"].cast("long"), "cost": m["cost"].cast("double")}
    size = {"prompt_length": F.length("prompt"), "response_length": F.length(F.coalesce("response", F.lit("")))}
    return _both(df, typed, "llm_request", F.concat(F.lit("LLM request to "), "model"), merged(m, size), F.col("session_id"))


def step_rows(df: DataFrame) -> DataFrame:
    """From (timestamp, session_id, step, metrics, parameters, duration_ms): the score is lifted out; the
    log's metadata are the metrics, the step and the parameters as JSON."""
    m, p = F.col("metrics"), F.coalesce("parameters", F.create_map().cast("map<string,string>"))
    typed = {c: F.col(c) for c in ("timestamp", "session_id", "step", "metrics", "duration_ms")}
    typed |= {"parameters": p, "score": m["score"].cast("double")}
    meta = merged(m, {"step": F.col("step"), "parameters": F.to_json(p)})
    return _both(df, typed, "optimization", F.concat(F.lit("Optimization step "), F.col("step").cast("string")), meta, F.col("session_id"))


def result_rows(df: DataFrame) -> DataFrame:
    """From (timestamp, run_id, result, dataset_name, model_name, duration_ms): the score is lifted out of
    the result; the log's metadata are the result, the dataset and the model."""
    r = F.col("result")
    typed = {c: F.col(c) for c in ("timestamp", "run_id", "result", "dataset_name", "model_name", "duration_ms")}
    typed |= {"score": r["score"].cast("double")}
    meta = merged(r, {"dataset": F.col("dataset_name"), "model": F.col("model_name")})
    return _both(df, typed, "evaluation", F.concat(F.lit("Evaluation completed for run "), F.col("run_id").cast("string")), meta,
                 F.lit(None).cast("string"))


ROWS = dict(zip(KINDS, (request_rows, step_rows, result_rows)))


def dual_write(df: DataFrame, kind: str, root: str, batch_id: int) -> None:
    """Project records of a kind and write typed and generic form in one pass, as one batch."""
    day_table.write_batch(df, f"{root}/{kind}", batch_id, rows=ROWS[kind])


def read_typed(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{kind}").select("typed.*")


def read_log(spark: SparkSession, root: str, kinds=KINDS) -> DataFrame:
    """The generic log of all kinds."""
    return reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(f"{root}/{k}").select("log.*") for k in kinds])


def rotate(spark: SparkSession, root: str, now: dt.datetime, days: int, tables=KINDS) -> DataFrame:
    """LG7: delete what is older than ``now - days`` in every table; one row per table and day touched."""
    cutoff = now - dt.timedelta(days=days)
    parts = [day_table.retain(spark, f"{root}/{t}", cutoff).withColumn("table", F.lit(t)) for t in tables]
    return reduce(lambda a, b: a.unionByName(b), parts)
