"""Log-analytics queries (LG*) over the ``logs`` and ``prompt_logs`` bindings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.common import r6
from ..operators import log_tables as LT
from ..operators import logs as L
from ..sources import bindings as B
from ..sources import day_table
from ..sources import io as IO
from ..sources.tables import table
from .registry import query

NOW = "2024-01-31 00:00:00"
LOGS, PL = ("logs",), ("prompt_logs",)
LG1_FILTERS = {"level": "ERROR", "start_time": "2024-01-05 00:00:00", "end_time": "2024-01-20 12:00:00",
               "message_contains": "USER 1"}


@query("lg1_query_logs", uses=LOGS, sql="""
SELECT id, "timestamp", level, category, message, session_id, duration_ms, user_id FROM logs
WHERE level = 'ERROR' AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-20 12:00:00'
  AND message ILIKE '%USER 1%'
ORDER BY "timestamp" DESC, id DESC LIMIT 50 OFFSET 5""")
def lg1(spark, d):
    q = L.query_logs(B.logs(spark, d), LG1_FILTERS, limit=50, offset=5)
    return q.select("id", "timestamp", "level", "category", "message", "session_id", "duration_ms", "user_id")


@query("lg2_search_logs", uses=LOGS, sql="""
SELECT id, message FROM logs WHERE message ILIKE '%BY USER 12%' ORDER BY "timestamp" DESC, id DESC""")
def lg2(spark, d):
    return L.search_logs(B.logs(spark, d), "BY USER 12").select("id", "message")


@query("lg3_category_range", uses=LOGS, sql="""
SELECT id, category, "timestamp" FROM logs WHERE category = 'click' AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00'
  AND "timestamp" <= TIMESTAMP '2024-01-10 00:00:00' ORDER BY "timestamp" DESC, id DESC""")
def lg3(spark, d):
    f = {"category": "click", "start_time": "2024-01-05 00:00:00", "end_time": "2024-01-10 00:00:00"}
    return L.query_logs(B.logs(spark, d), f).select("id", "category", "timestamp")


@query("lg3_session_logs", uses=LOGS, sql="""
SELECT id, session_id, level FROM logs WHERE session_id = 's7' ORDER BY "timestamp" DESC, id DESC""")
def lg3_session(spark, d):
    return L.query_logs(B.logs(spark, d), {"session_id": "s7"}).select("id", "session_id", "level")


@query("lg4_log_statistics", uses=LOGS, sql="""
SELECT CASE WHEN GROUPING(level) = 0 THEN 'level' WHEN GROUPING(category) = 0 THEN 'category' ELSE 'total' END AS kind,
  coalesce(level, category, '*') AS key, count(*) AS count
FROM logs WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
GROUP BY GROUPING SETS ((level), (category), ())""")
def lg4(spark, d):
    return L.log_statistics(B.logs(spark, d), "2024-01-03 00:00:00", "2024-01-25 00:00:00")


@query("lg5_severity_threshold", uses=LOGS, sql="""
SELECT level, count(*) AS n FROM logs
WHERE coalesce(CASE upper(level) WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 END, 1) >= 2
GROUP BY level""")
def lg5(spark, d):
    return L.at_least(B.logs(spark, d), "WARNING").groupBy("level").agg(F.count("*").alias("n"))


@query("lg6_dual_write", uses=PL, sql="""
SELECT request_id, 'INFO' AS level, 'llm_request' AS category, concat('LLM request to ', model) AS message,
  length(prompt) AS prompt_length, length(coalesce(response, '')) AS response_length,
  coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS tokens_used, round(cost, 6) AS cost,
  round(latency * 1000.0, 6) AS duration_ms FROM prompt_logs""")
def lg6(spark, d):
    pl = B.prompt_logs(spark, d)
    return pl.select("request_id", F.lit("INFO").alias("level"), F.lit("llm_request").alias("category"),
                     F.concat(F.lit("LLM request to "), F.col("model")).alias("message"),
                     F.length("prompt").alias("prompt_length"),
                     F.length(F.coalesce("response", F.lit(""))).alias("response_length"),
                     (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens_used"),
                     r6("cost", "cost"), r6(F.col("latency") * 1000.0, "duration_ms"))


def _records(spark, d):
    """Requests, optimisation steps and evaluation results with their string maps."""
    pl = B.prompt_logs(spark, d)
    used = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    metrics = F.create_map(F.lit("tokens_used"), used.cast("string"), F.lit("cost"), F.format_string("%.3f", "cost"), F.lit("prompt_length"), F.lit("0"))
    req = pl.select("request_id", "timestamp", "session_id", "prompt", "model", "response", metrics.alias("metrics"), (F.col("latency") * 1000.0).alias("duration_ms"))
    e = table(spark, d, "events")
    steps = e.select(F.col("ts").alias("timestamp"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("step"),
                     F.create_map(F.lit("score"), F.format_string("%.4f", "value")).alias("metrics"),
                     F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("type"), F.col("event_type"))).alias("parameters"), F.col("value").alias("duration_ms"))
    runs = B.eval_runs(spark, d)
    at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(days=(F.col("job_id") % 30).cast("int"), hours=(F.col("job_id") % 24).cast("int"))
    results = runs.select(at.alias("timestamp"), F.col("job_id").alias("run_id"),
                          F.create_map(F.lit("score"), F.format_string("%.2f", F.col("progress") / 100.0), F.lit("status"), F.col("status")).alias("result"),
                          F.concat(F.lit("set-"), F.col("batch_id").cast("string")).alias("dataset_name"), F.lit("model-1").alias("model_name"),
                          (F.col("progress") * 10.0).alias("duration_ms"))
    return {"llm_requests": req, "optimization_steps": steps, "evaluation_results": results}


def _dual_written(spark, d, *kinds):
    """Records of the kinds (default: all), each as two batches of which the second is written twice (a replay)."""
    root = IO.new_scratch(spark, "dual-write")
    records = _records(spark, d)
    for kind in kinds or LT.KINDS:
        df = records[kind]
        half = F.dayofmonth("timestamp") <= 15
        LT.dual_write(df.where(half), kind, root, 0)
        for _ in range(2):
            LT.dual_write(df.where(~half), kind, root, 1)
    return root


@query("lg6_typed_requests", uses=PL, sql="""
SELECT "timestamp", model, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS tokens_used, round(cost, 3) AS cost, round(latency * 1000.0, 6) AS duration_ms
FROM prompt_logs""")
def lg6_requests(spark, d):
    t = LT.read_typed(spark, _dual_written(spark, d, "llm_requests"), "llm_requests")
    return t.select("timestamp", "model", "tokens_used", F.round("cost", 3).alias("cost"), r6("duration_ms", "duration_ms"))


@query("lg6_typed_steps", sql="""
SELECT step, session_id, CAST(printf('%.4f', value) AS DOUBLE) AS score, has_parameters FROM (
  SELECT event_id AS step, concat('s', user_id) AS session_id, value, event_id % 3 <> 0 AS has_parameters FROM events) t""")
def lg6_steps(spark, d):
    t = LT.read_typed(spark, _dual_written(spark, d, "optimization_steps"), "optimization_steps")
    return t.select("step", "session_id", "score", (F.size("parameters") > 0).alias("has_parameters"))


@query("lg6_typed_results", uses=("eval_runs",), sql="""
SELECT job_id AS run_id, CAST(printf('%.2f', progress / 100.0::DOUBLE) AS DOUBLE) AS score, concat('set-', batch_id) AS dataset_name, status FROM eval_runs""")
def lg6_results(spark, d):
    t = LT.read_typed(spark, _dual_written(spark, d, "evaluation_results"), "evaluation_results")
    return t.select("run_id", "score", "dataset_name", F.col("result")["status"].alias("status"))


@query("lg6_generic_log", uses=("prompt_logs", "eval_runs"), sql="""
SELECT category, message, session_id, array_to_string(list_sort(m), ';') AS metadata FROM (
  SELECT 'llm_request' AS category, concat('LLM request to ', model) AS message, session_id,
    ['tokens_used=' || (coalesce(input_tokens, 0) + coalesce(output_tokens, 0)), 'cost=' || printf('%.3f', cost), 'prompt_length=' || length(prompt),
     'response_length=' || length(coalesce(response, ''))] AS m FROM prompt_logs
  UNION ALL SELECT 'optimization', concat('Optimization step ', event_id), concat('s', user_id),
    ['score=' || printf('%.4f', value), 'step=' || event_id, 'parameters=' || CASE WHEN event_id % 3 <> 0 THEN concat('{"type":"', event_type, '"}') ELSE '{}' END] FROM events
  UNION ALL SELECT 'evaluation', concat('Evaluation completed for run ', job_id), NULL,
    ['score=' || printf('%.2f', progress / 100.0::DOUBLE), 'status=' || status, 'dataset=set-' || batch_id, 'model=model-1'] FROM eval_runs) t""")
def lg6_log(spark, d):
    log = LT.read_log(spark, _dual_written(spark, d))
    entries = F.sort_array(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return log.select("category", "message", "session_id", F.array_join(entries, ";").alias("metadata"))


_CUT = "TIMESTAMP '2024-01-20 13:30:00'"


@query("lg7_retention", uses=("logs", "prompt_logs"), sql="""
SELECT 'logs' AS tbl, count_if("timestamp" < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY) AS deleted,
  count_if("timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY) AS kept FROM logs
UNION ALL
SELECT 'prompt_logs', count_if("timestamp" < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY),
  count_if("timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY) FROM prompt_logs""")
def lg7(spark, d):
    out = None
    for name, df in (("logs", B.logs(spark, d)), ("prompt_logs", B.prompt_logs(spark, d))):
        kept, deleted = L.retention(df, NOW, 10)
        row = kept.agg(F.lit(name).alias("tbl"), deleted.agg(F.count("*")).scalar().alias("deleted"), F.count("*").alias("kept"))
        out = row if out is None else out.unionByName(row)
    return out


@query("lg7_rotate_tables", uses=("logs", "prompt_logs", "eval_runs"), sql=f"""
WITH t AS (SELECT 'logs' AS tbl, "timestamp" AS ts FROM logs UNION ALL SELECT 'llm_requests', "timestamp" FROM prompt_logs
  UNION ALL SELECT 'optimization_steps', ts FROM events UNION ALL SELECT 'evaluation_results', TIMESTAMP '2024-01-01' + to_days(CAST(job_id % 30 AS INTEGER)) + to_hours(CAST(job_id % 24 AS INTEGER)) FROM eval_runs),
g AS (SELECT tbl, CAST(ts AS DATE) AS day, count(*) AS before, count(*) FILTER (WHERE ts >= {_CUT}) AS after FROM t GROUP BY ALL)
SELECT tbl, CAST(sum(before - after) AS BIGINT) AS deleted, CAST(sum(after) AS BIGINT) AS kept,
  count(*) FILTER (WHERE after = 0 AND day < DATE '2024-01-20') AS days_dropped, count(*) FILTER (WHERE day = DATE '2024-01-20' AND after < before) AS days_rewritten
FROM g GROUP BY tbl""")
def lg7_rotate(spark, d):
    """Four tables in day folders; the cutoff lies inside a day, which alone is rewritten."""
    root = _dual_written(spark, d)
    day_table.write_batch(B.logs(spark, d), f"{root}/logs", 0)
    tables = ("logs", *LT.KINDS)
    acts = LT.rotate(spark, root, dt.datetime(2024, 1, 30, 13, 30), 10, tables)
    kept = None
    for t in tables:
        row = spark.read.parquet(f"{root}/{t}").agg(F.lit(t).alias("table"), F.count("*").alias("kept"))
        kept = row if kept is None else kept.unionByName(row)
    g = acts.groupBy("table").agg(F.sum(F.col("rows_before") - F.col("rows_after")).alias("deleted"),
                                  F.count_if(F.col("action") == "dropped").alias("days_dropped"), F.count_if(F.col("action") == "rewritten").alias("days_rewritten"))
    zero = F.lit(0).cast("long")
    return kept.join(g, "table", "left").select(F.col("table").alias("tbl"), F.coalesce("deleted", zero).alias("deleted"), "kept",
                                                F.coalesce("days_dropped", zero).alias("days_dropped"), F.coalesce("days_rewritten", zero).alias("days_rewritten"))


USAGE_SQL = """SELECT count(*) AS total_requests, count(DISTINCT nullif(session_id, '')) AS unique_sessions,
  CAST(coalesce(sum(nullif(input_tokens, 0)), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(nullif(output_tokens, 0)), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(nullif(input_tokens, 0)), 0) + coalesce(sum(nullif(output_tokens, 0)), 0) AS BIGINT) AS total_tokens,
  round(coalesce(avg(nullif(latency, 0)), 0.0), 6) AS avg_latency,
  round(count_if(nullif(error, '') IS NULL) / count(*), 6) AS success_rate FROM prompt_logs"""


@query("lg8_usage_statistics", uses=PL, sql=USAGE_SQL)
def lg8(spark, d):
    u = L.usage_statistics(B.prompt_logs(spark, d))
    return u.select("total_requests", "unique_sessions", "input_tokens", "output_tokens", "total_tokens",
                    r6("avg_latency", "avg_latency"), r6("success_rate", "success_rate"))


def _perf_sql(group: str | None, where: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    join = f"USING ({group})" if group else "ON TRUE"
    return f"""WITH src AS (SELECT * FROM prompt_logs {where}),
l AS (SELECT {g}nullif(latency, 0) AS lat, row_number() OVER ({part}ORDER BY nullif(latency, 0), request_id) - 1 AS r,
      count(*) OVER ({part.strip()}) AS n FROM src WHERE nullif(latency, 0) IS NOT NULL),
p AS (SELECT {g}max(CASE WHEN r = least(floor(n * 0.95), n - 1) THEN lat END) AS p95,
      max(CASE WHEN r = least(floor(n * 0.99), n - 1) THEN lat END) AS p99 FROM l {gb}),
b AS (SELECT {g}count(*) AS n, coalesce(avg(nullif(latency, 0)), 0.0) AS avg_latency,
      (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 6e7 AS span,
      count_if(nullif(error, '') IS NOT NULL) / count(*) AS error_rate FROM src {gb})
SELECT {g}round(avg_latency, 6) AS avg_latency, round(coalesce(p95, 0.0), 6) AS p95_latency, round(coalesce(p99, 0.0), 6) AS p99_latency,
  round(CASE WHEN n > 1 AND span > 0 THEN n / span ELSE 0.0 END, 6) AS throughput, round(error_rate, 6) AS error_rate
FROM b LEFT JOIN p {join}"""


def _perf(df, group=None):
    p = L.performance_metrics(df, group)
    return p.select(*(group or []), *[r6(c, c) for c in ("avg_latency", "p95_latency", "p99_latency", "throughput", "error_rate")])


@query("lg9_performance_metrics", uses=PL, sql=_perf_sql(None))
def lg9(spark, d):
    return _perf(B.prompt_logs(spark, d))


@query("lg9_performance_by_model", uses=PL, sql=_perf_sql("model"))
def lg9_model(spark, d):
    return _perf(B.prompt_logs(spark, d), ["model"])


@query("lg10_model_breakdown", uses=PL, sql="""
SELECT model, count(*) AS request_count,
  CAST(coalesce(sum(nullif(input_tokens, 0)), 0) + coalesce(sum(nullif(output_tokens, 0)), 0) AS BIGINT) AS total_tokens,
  round(coalesce(sum(nullif(cost, 0)), 0.0), 6) AS total_cost, round(coalesce(avg(nullif(latency, 0)), 0.0), 6) AS avg_latency
FROM prompt_logs WHERE nullif(model, '') IS NOT NULL GROUP BY model""")
def lg10(spark, d):
    m = L.model_breakdown(B.prompt_logs(spark, d))
    return m.select("model", "request_count", "total_tokens", r6("total_cost", "total_cost"), r6("avg_latency", "avg_latency"))


@query("lg11_cost_analysis", uses=PL, sql="""
SELECT round(coalesce(sum(nullif(cost, 0)), 0.0), 6) AS total_cost,
  round(coalesce(sum(nullif(cost, 0)), 0.0) / count(*), 6) AS avg_cost_per_request FROM prompt_logs""")
def lg11(spark, d):
    tot, _ = L.cost_analysis(B.prompt_logs(spark, d))
    return tot.select(r6("total_cost", "total_cost"), r6("avg_cost_per_request", "avg_cost_per_request"))


@query("lg11_cost_by_model", uses=PL, sql="""
SELECT model, round(sum(cost), 6) AS cost FROM prompt_logs WHERE nullif(model, '') IS NOT NULL AND nullif(cost, 0) IS NOT NULL GROUP BY model""")
def lg11_model(spark, d):
    _, bm = L.cost_analysis(B.prompt_logs(spark, d))
    return bm.select("model", r6("cost", "cost"))


@query("lg12_error_analysis", uses=PL, sql="""
SELECT split_part(error, ':', 1) AS error_type, count(*) AS count FROM prompt_logs WHERE nullif(error, '') IS NOT NULL GROUP BY 1""")
def lg12(spark, d):
    return L.error_analysis(B.prompt_logs(spark, d))


@query("lg13_analytics_bundle", uses=PL, sql=f"""
WITH r AS (SELECT * FROM prompt_logs WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR
           AND "timestamp" <= TIMESTAMP '2024-01-31 00:00:00'),
u AS (SELECT count(*) AS total_requests, count(DISTINCT nullif(session_id, '')) AS unique_sessions,
      CAST(coalesce(sum(nullif(input_tokens, 0)), 0) + coalesce(sum(nullif(output_tokens, 0)), 0) AS BIGINT) AS total_tokens,
      round(count_if(nullif(error, '') IS NULL) / count(*), 6) AS success_rate,
      round(coalesce(sum(nullif(cost, 0)), 0.0), 6) AS total_cost, count_if(nullif(error, '') IS NOT NULL) AS error_count,
      count(DISTINCT nullif(model, '')) AS n_models FROM r)
SELECT * FROM u""")
def lg13(spark, d):
    pl = B.prompt_logs(spark, d)
    now = F.expr(f"TIMESTAMP_NTZ'{NOW}'")
    r = pl.where((F.col("timestamp") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("timestamp") <= now))
    from ..functions.common import truthy_num, truthy_str
    return r.agg(
        F.count("*").alias("total_requests"), F.count_distinct(truthy_str("session_id")).alias("unique_sessions"),
        (F.coalesce(F.sum(truthy_num("input_tokens")), F.lit(0)) + F.coalesce(F.sum(truthy_num("output_tokens")), F.lit(0)))
        .alias("total_tokens"),
        r6(F.count_if(truthy_str("error").isNull()) / F.count("*"), "success_rate"),
        r6(F.coalesce(F.sum(truthy_num("cost")), F.lit(0.0)), "total_cost"),
        F.count_if(truthy_str("error").isNotNull()).alias("error_count"),
        F.count_distinct(truthy_str("model")).alias("n_models"))


RECENT_SQL = """WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR AND "timestamp" <= TIMESTAMP '2024-01-31 00:00:00'"""


def _recent(spark, d):
    """The bundle's range: the last 24 hours."""
    now = F.expr(f"TIMESTAMP_NTZ'{NOW}'")
    return B.prompt_logs(spark, d).where((F.col("timestamp") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("timestamp") <= now))


@query("lg13_bundle_performance", uses=PL, sql=_perf_sql(None, RECENT_SQL))
def lg13_performance(spark, d):
    return _perf(_recent(spark, d))


@query("lg13_bundle_models", uses=PL, sql=f"""
SELECT model, count(*) AS request_count,
  CAST(coalesce(sum(nullif(input_tokens, 0)), 0) + coalesce(sum(nullif(output_tokens, 0)), 0) AS BIGINT) AS total_tokens,
  round(coalesce(sum(nullif(cost, 0)), 0.0), 6) AS total_cost, round(coalesce(avg(nullif(latency, 0)), 0.0), 6) AS avg_latency
FROM prompt_logs {RECENT_SQL} AND nullif(model, '') IS NOT NULL GROUP BY model""")
def lg13_models(spark, d):
    m = L.model_breakdown(_recent(spark, d))
    return m.select("model", "request_count", "total_tokens", r6("total_cost", "total_cost"), r6("avg_latency", "avg_latency"))


@query("lg13_bundle_cost", uses=PL, sql=f"""
SELECT model, round(sum(cost), 6) AS cost FROM prompt_logs {RECENT_SQL}
AND nullif(model, '') IS NOT NULL AND nullif(cost, 0) IS NOT NULL GROUP BY model""")
def lg13_cost(spark, d):
    return L.cost_analysis(_recent(spark, d))[1].select("model", r6("cost", "cost"))


@query("lg13_bundle_errors", uses=PL, sql=f"""
SELECT split_part(error, ':', 1) AS error_type, count(*) AS count FROM prompt_logs {RECENT_SQL} AND nullif(error, '') IS NOT NULL GROUP BY 1""")
def lg13_errors(spark, d):
    return L.error_analysis(_recent(spark, d))


def _req_resp(spark, d):
    pl = B.prompt_logs(spark, d)
    req = pl.where(F.col("request_id") % 10 != 3).select("request_id", "timestamp", "prompt")
    resp = pl.where(F.col("request_id") % 7 != 0).select(
        "request_id", (F.col("timestamp") + F.expr("INTERVAL 2 SECONDS")).alias("timestamp"), "response", "latency", "error")
    return req, resp


@query("lg14_correlate", uses=PL, sql="""
WITH q AS (SELECT request_id, "timestamp", prompt FROM prompt_logs WHERE request_id % 10 <> 3),
s AS (SELECT request_id, "timestamp" + INTERVAL 2 SECOND AS "timestamp", response, latency, error FROM prompt_logs WHERE request_id % 7 <> 0)
SELECT coalesce(q.request_id, s.request_id) AS request_id, coalesce(q."timestamp", s."timestamp") AS "timestamp",
  coalesce(q.prompt, '') AS prompt, s.response, s.latency, s.error, q.request_id IS NULL AS orphan_response
FROM q FULL OUTER JOIN s ON q.request_id = s.request_id""")
def lg14(spark, d):
    req, resp = _req_resp(spark, d)
    return L.correlate(req, resp)


@query("lg15_upsert_latest", uses=PL, sql="""
SELECT request_id % 1000 AS log_key, arg_max(request_id, request_id) AS request_id, arg_max(model, request_id) AS model,
  round(arg_max(latency, request_id), 6) AS latency FROM prompt_logs GROUP BY 1""")
def lg15(spark, d):
    pl = B.prompt_logs(spark, d).select((F.col("request_id") % 1000).alias("log_key"), "request_id", "model", "latency")
    u = L.upsert_latest(pl, "log_key", "request_id")
    return u.select("log_key", "request_id", "model", r6("latency", "latency"))


@query("lg16_run_tracking", sql="""
SELECT user_id AS run_id, min(ts) AS start_time, max(ts) AS end_time,
  round(arg_max_null(CASE WHEN event_type = 'purchase' THEN value END, ts), 6) AS results, count(*) AS n_events,
  CASE WHEN arg_max_null(CASE WHEN event_type = 'purchase' THEN value END, ts) IS NOT NULL THEN 'completed' ELSE 'running' END AS status
FROM events GROUP BY user_id""")
def lg16(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts",
                                         F.when(F.col("event_type") == "purchase", F.col("value")).alias("results"))
    t = L.run_tracking(e, "run_id", "ts", "results")
    return t.select("run_id", "start_time", "end_time", r6("results", "results"), "n_events", "status")


@query("lg17_slow_requests", uses=PL, sql="SELECT request_id, latency FROM prompt_logs WHERE latency > 100.0")
def lg17(spark, d):
    return L.slow_requests(B.prompt_logs(spark, d), "latency", 100.0).select("request_id", "latency")


@query("lg18_cache_statistics", uses=PL, sql="""
WITH c AS (SELECT md5(prompt) AS k, count(*) AS access_count, max("timestamp") AS last_access FROM prompt_logs GROUP BY 1)
SELECT count(*) AS total_entries, round(avg(access_count), 6) AS avg_access_count, max(last_access) AS newest_entry FROM c""")
def lg18(spark, d):
    pl = B.prompt_logs(spark, d)
    c = pl.groupBy(F.md5("prompt").alias("k")).agg(F.count("*").alias("access_count"), F.max("timestamp").alias("last_access"))
    return c.agg(F.count("*").alias("total_entries"), r6(F.avg("access_count"), "avg_access_count"),
                 F.max("last_access").alias("newest_entry"))


LG19_PARAMS = {"temperature": 0.7, "max_tokens": 256}


@query("lg19_cache_key", sql="""
SELECT doc_id, md5(text) || md5('{"max_tokens": 256, "temperature": 0.7}') AS cache_key FROM documents""")
def lg19(spark, d):
    return table(spark, d, "documents").select("doc_id", L.cache_key("text", LG19_PARAMS).alias("cache_key"))


@query("lg20_rate_limit", sql="""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(user_id, k, event_id, ts, acc, allowed) AS (
  SELECT user_id, k, event_id, ts, [t], true FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, ts, CASE WHEN len(w) < 5 THEN list_append(w, t) ELSE w END, len(w) < 5
  FROM (SELECT e.user_id, e.k, e.event_id, e.ts, e.t, list_filter(r.acc, lambda a: a > e.t - 3600000000) AS w
        FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) x)
SELECT user_id, event_id, ts, allowed FROM r""")
def lg20(spark, d):
    """Sliding-window limiter (5 accepted events per user per hour); order-dependent fold, rows only."""
    e = table(spark, d, "events")
    return L.rate_limit(e, "user_id", "ts", "event_id", limit=5, window_s=3600.0)
