"""Operator inputs derived from the driver tables (Spark side).

Each function mirrors one named relation of the fixture bindings; the SQL
twin lives in :mod:`evalspark.plans.bindings_sql`.  Everything is a lazy,
row-local projection or a partitioned window over the scanned tables, so the
inputs grow with the data and add no shuffle beyond the windows named here.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

# Fixed "now" of the fixtures: event timestamps span 2024-01-01 .. 2024-01-30.
NOW = _dt.datetime(2024, 1, 31, 0, 0, 0)
SPLIT_WS_ASCII_NBSP = r"[\s\x{00A0}]+"


def ts_lit(s: str):
    return F.expr(f"TIMESTAMP_NTZ'{s}'")


def eval_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Prediction/reference pairs of whole texts: every 7th token dropped from the reference,
    every 5th an exact (lower-cased, double-spaced) copy, every 11th prediction empty."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    tok = F.filter(F.split("text", SPLIT_WS_ASCII_NBSP), lambda w: w != "")
    did = F.col("doc_id")
    t = docs.select("doc_id", "lang", tok.alias("tok"))
    ref_drop = F.array_join(F.filter("tok", lambda w, i: ((i + 1 + did) % 7) != 0), " ")
    return t.select(
        F.col("doc_id").alias("pair_id"), "lang",
        F.when(did % 11 == 10, F.lit("")).otherwise(F.array_join("tok", " ")).alias("pred"),
        F.when(did % 5 == 0, F.lower(F.array_join("tok", "  "))).otherwise(ref_drop).alias("ref"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    """User turn (context) followed directly by an assistant turn (response).

    "Next turn" is the next rank inside the conversation: ranks come from the skew-safe group
    rank and the successor is an equi-join on (conversation, rank + 1), so a very long
    conversation is never sorted inside one window task."""
    from ..operators.ordinal import with_group_rank
    c = with_group_rank(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"),
                        ["conv_id"], ["turn"], "_r")
    nxt = c.select("conv_id", (F.col("_r") - 1).alias("_r"), F.col("text").alias("response"), F.col("role").alias("nrole"))
    return (c.where(F.col("role") == "user").join(nxt.where(F.col("nrole") == "assistant"), ["conv_id", "_r"])
             .select("conv_id", "turn", F.col("text").alias("context"), "response"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("group_id"), F.col("turn").alias("idx"),
        (F.col("conv_id") % 5).alias("fold"), F.col("text").alias("response"))


def nulled_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 10 < 6, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


def prompt_logs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        eid.alias("request_id"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("prompt "), F.col("event_type"), F.lit(" "), F.col("props")).alias("prompt"),
        F.when(eid % 9 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("response to "), eid.cast("string"))).alias("response"),
        F.when(eid % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("model-"), (uid % 4).cast("string"))).alias("model"),
        F.when(eid % 17 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("latency"),
        F.when(eid % 19 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), uid.cast("string"))).alias("session_id"),
        k.alias("input_tokens"), (k * 2).alias("output_tokens"), (k * F.lit(0.001)).alias("cost"),
        F.when(F.col("event_type") == "error",
               F.when(eid % 2 == 0, F.concat(F.lit("Timeout: after "), uid.cast("string")))
                .otherwise(F.lit("RateLimit"))).alias("error"),
        uid.alias("user_id"))


def logs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    et = F.col("event_type")
    level = (F.when(et == "error", "ERROR").when(et == "signup", "WARNING").when(et == "view", "DEBUG")
              .when(et == "purchase", "CRITICAL").otherwise("INFO"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), level.alias("level"),
        et.alias("category"),
        F.concat(F.lit("Event "), et, F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.col("props").alias("metadata"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("value").alias("duration_ms"), "user_id")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.col("c_name").alias("title"),
        F.concat(F.lit("Segment: "), F.col("c_mktsegment"), F.lit(" for "), F.col("c_name")).alias("content"),
        F.col("c_mktsegment").alias("model_type"),
        F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), (F.col("c_nationkey") % 5).cast("string")),
                F.concat(F.lit("k"), (k % 3).cast("string"))).alias("tags"),
        F.col("c_nationkey").alias("created_by"),
        (ts_lit("2024-01-01 00:00:00") + F.make_dt_interval(days=(k % 60).cast("int"))).alias("created_at"),
        F.when(k % 10 == 0, ts_lit("2024-03-01 00:00:00")).alias("deleted_at"))


def prompt_variants(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("prompt_id"), F.col("o_orderpriority").alias("strategy"),
        F.when(k % 8 == 0, F.lit(None).cast("double")).when(k % 8 == 1, F.lit(0.0))
         .otherwise((k % 101) / F.lit(100.0)).alias("performance_score"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 12 == 0, ts_lit("2024-03-01 00:00:00")).alias("deleted_at"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    return o.select(
        k.alias("job_id"), F.col("o_custkey").alias("prompt_id"), (F.col("o_custkey") % 20).alias("batch_id"),
        F.when(st == "F", "completed").when(st == "O", "running").otherwise("failed").alias("status"),
        (k % 100).alias("progress"), F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 48).cast("int"))).alias("completed_at"))


eval_runs = sessions

METRICS = ("exact_match", "bleu", "rouge")


def eval_results(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation facts: one row per (lineitem, metric).  The three metrics are an
    in-row ``explode`` (no join, no shuffle)."""
    li = table(spark, d, "lineitem")
    m = F.col("metric")
    score = (F.when(m == "exact_match", ((F.col("l_orderkey") % 3) == 0).cast("double"))
              .when(m == "bleu", (F.col("l_partkey") % 100) / F.lit(100.0))
              .otherwise((F.col("l_quantity") * 2) / F.lit(100.0)))
    return (li.select(
        F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("variant_id"),
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("sample_index"),
        F.col("l_linestatus").alias("strategy"), (F.col("l_returnflag") != "R").alias("success"),
        (F.col("l_quantity") * 40).alias("latency_ms"), "l_orderkey", "l_partkey", "l_quantity",
        F.explode(F.array(*[F.lit(x) for x in METRICS])).alias("metric"))
        .select("run_id", "variant_id", "case_id", "sample_index", "strategy", "success", "latency_ms",
                "metric", score.alias("score")))


def opt_history(spark: SparkSession, d: str) -> DataFrame:
    """Optimisation history per run (= user): 0-based iteration in (ts, event_id) order and the
    running best score — both from the skew-safe group rank / grouped prefix max."""
    from ..operators.ordinal import with_group_prefix_max
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("current_score"))
    b = with_group_prefix_max(e, ["run_id"], ["ts", "event_id"], "current_score", "best_score", rank_name="iteration")
    return b.select("run_id", "iteration", "current_score", "best_score")


def variants(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    did = F.col("doc_id")
    return doc.select(
        did.alias("id"), F.col("text").alias("content"),
        F.when(did % 3 == 0, "ape").when(did % 3 == 1, "stable").otherwise("custom").alias("strategy"),
        ((F.col("n_chars") % 101) / F.lit(100.0)).alias("quality_score"),
        ((did % 97) / F.lit(96.0)).alias("diversity_score"), F.col("source").alias("base_prompt"),
        ((did % 10) * F.lit(0.1)).alias("generation_time"))


def judge_raw(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    k = F.col("doc_id") % 5
    resp = (F.when(k == 0, "Score: 7.5 of 10").when(k == 1, "-3").when(k == 2, "no idea")
             .when(k == 3, '{"score": 0.8}').otherwise("12"))
    return lab.select(F.col("doc_id").alias("id"), resp.alias("response"))


# Fixed values of the fixture templates (prompt templates used with the benchmark table).
TEMPLATES = [
    (1, "Answer this: {input}"),
    (2, "Answer this: [INPUT]"),
    (3, "Answer this:"),
    (4, "Hi {{ name:string }}, rate {{item}}"),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id int, template string")


def with_templates(df: DataFrame) -> DataFrame:
    """Every row once per prompt template: an in-row explode of the literal template list
    (prompts × cases without a join)."""
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("template_id"), F.lit(s).alias("template")) for i, s in TEMPLATES]))
    return df.select("*", t.alias("_tpl")).select(*df.columns, "_tpl.template_id", "_tpl.template")
