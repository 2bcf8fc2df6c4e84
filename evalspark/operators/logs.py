"""Log analytics over request logs and generic logs (batch).

Filters are plain predicates, so Catalyst pushes them into the Parquet scan
(and prunes ``date`` partitions when the sink is partitioned by day).  The
analytics bundle is one aggregation pass plus two small ``groupBy``s.
Python truthiness (0, 0.0 and '' count as missing) is spelled with
``nullif``-style expressions.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import truthy_num, truthy_str
from .ordinal import order_statistic, with_group_prefix_max

# Severity order of the structured logger; unknown levels rank as INFO.
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]


def _ts(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, dt.datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S")
    return F.expr(f"TIMESTAMP_NTZ'{v}'")


def like_escape_free(q: str) -> str:
    """``%q%`` as SQLite builds it: ``%`` and ``_`` inside q stay wildcards."""
    return f"%{q}%"


def log_filter(filters: dict, ts: str = "timestamp", message: str = "message") -> Column:
    """LG1 predicate: equality on level/category/session_id/user_id, inclusive time range,
    case-insensitive ``message LIKE %q%``; unknown keys are ignored."""
    conds = []
    for k in ("level", "category", "session_id", "user_id"):
        if k in filters:
            conds.append(F.col(k) == F.lit(filters[k]))
    if "start_time" in filters:
        conds.append(F.col(ts) >= _ts(filters["start_time"]))
    if "end_time" in filters:
        conds.append(F.col(ts) <= _ts(filters["end_time"]))
    if "message_contains" in filters:
        conds.append(F.col(message).ilike(like_escape_free(filters["message_contains"])))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def query_logs(logs: DataFrame, filters: dict | None = None, limit: int | None = None, offset: int = 0,
               ts: str = "timestamp", key: str = "id") -> DataFrame:
    """LG1–LG3: filtered, newest first (id breaks ties); ``limit`` / ``offset`` ask for one page."""
    out = logs.where(log_filter(filters or {}, ts)).orderBy(F.col(ts).desc(), F.col(key).desc())
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def search_logs(logs: DataFrame, q: str, limit: int | None = None) -> DataFrame:
    return query_logs(logs, {"message_contains": q}, limit)


def log_statistics(logs: DataFrame, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """LG4: counts by level, by category and in total in one scan (GROUPING SETS)."""
    src = logs
    if start is not None and end is not None:
        src = src.where(F.col(ts).between(_ts(start), _ts(end)))
    g = src.groupingSets([["level"], ["category"], []], "level", "category").agg(
        F.grouping("level").alias("_gl"), F.grouping("category").alias("_gc"), F.count("*").alias("count"))
    kind = F.when(F.col("_gl") == 0, "level").when(F.col("_gc") == 0, "category").otherwise("total")
    return g.select(kind.alias("kind"), F.coalesce("level", "category", F.lit("*")).alias("key"), "count")


def severity_rank(level) -> Column:
    m = F.create_map(*[x for i, lv in enumerate(LEVELS) for x in (F.lit(lv), F.lit(i))])
    return F.coalesce(F.element_at(m, F.upper(F.col(level) if isinstance(level, str) else level)), F.lit(1))


def at_least(logs: DataFrame, min_level: str = "WARNING", level: str = "level") -> DataFrame:
    """LG5: keep rows whose severity is at or above ``min_level``."""
    return logs.where(severity_rank(level) >= F.lit(LEVELS.index(min_level.upper())))


def retention(df: DataFrame, now, days: int, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """LG7: (kept rows, deleted rows) for a cutoff of ``now − days``; rows with ts < cutoff go."""
    cutoff = _ts(now) - F.make_dt_interval(days=F.lit(days))
    return df.where(F.col(ts) >= cutoff), df.where(F.col(ts) < cutoff)


def usage_statistics(pl: DataFrame) -> DataFrame:
    """LG8: requests, distinct truthy sessions, token sums, mean of truthy latency, success rate."""
    it = F.coalesce(F.sum(truthy_num("input_tokens")), F.lit(0))
    ot = F.coalesce(F.sum(truthy_num("output_tokens")), F.lit(0))
    return pl.agg(
        F.count("*").alias("total_requests"),
        F.count_distinct(truthy_str("session_id")).alias("unique_sessions"),
        it.alias("input_tokens"), ot.alias("output_tokens"), (it + ot).alias("total_tokens"),
        F.coalesce(F.avg(truthy_num("latency")), F.lit(0.0)).alias("avg_latency"),
        (F.count_if(truthy_str("error").isNull()) / F.count("*")).alias("success_rate"))


def performance_metrics(pl: DataFrame, group: list[str] | None = None, key: str = "request_id",
                        ts: str = "timestamp") -> DataFrame:
    """LG9: mean / p95 / p99 of truthy latency with p = sorted[int(q·n)] (no interpolation),
    throughput = n / minutes(first..last) (0 if n ≤ 1 or span 0), error rate."""
    group = group or []
    lat = pl.select(*group, key, truthy_num("latency").alias("_lat"))
    pct = order_statistic(lat, group, "_lat", key, {"p95_latency": 0.95, "p99_latency": 0.99})
    span_min = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 6e7
    base = pl.groupBy(*group).agg(
        F.count("*").alias("_n"), F.coalesce(F.avg(truthy_num("latency")), F.lit(0.0)).alias("avg_latency"),
        span_min.alias("_span"), (F.count_if(truthy_str("error").isNotNull()) / F.count("*")).alias("error_rate"))
    thr = F.when((F.col("_n") > 1) & (F.col("_span") > 0), F.col("_n") / F.col("_span")).otherwise(F.lit(0.0))
    j = base.join(pct, group, "left") if group else base.crossJoin(pct)
    return j.select(*group, "avg_latency", F.coalesce("p95_latency", F.lit(0.0)).alias("p95_latency"),
                    F.coalesce("p99_latency", F.lit(0.0)).alias("p99_latency"), thr.alias("throughput"), "error_rate")


def model_breakdown(pl: DataFrame) -> DataFrame:
    """LG10: per truthy model: requests, Σ truthy tokens, Σ truthy cost, mean truthy latency."""
    return pl.where(truthy_str("model").isNotNull()).groupBy("model").agg(
        F.count("*").alias("request_count"),
        (F.coalesce(F.sum(truthy_num("input_tokens")), F.lit(0)) + F.coalesce(F.sum(truthy_num("output_tokens")), F.lit(0)))
        .alias("total_tokens"),
        F.coalesce(F.sum(truthy_num("cost")), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.avg(truthy_num("latency")), F.lit(0.0)).alias("avg_latency"))


def cost_analysis(pl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LG11: (totals row, cost by model); the per-request mean divides by *all* requests."""
    tot = pl.agg(F.coalesce(F.sum(truthy_num("cost")), F.lit(0.0)).alias("total_cost"), F.count("*").alias("_n"))
    tot = tot.select("total_cost", F.when(F.col("_n") > 0, F.col("total_cost") / F.col("_n")).otherwise(0.0)
                     .alias("avg_cost_per_request"))
    by_model = (pl.where(truthy_str("model").isNotNull() & truthy_num("cost").isNotNull())
                .groupBy("model").agg(F.sum("cost").alias("cost")))
    return tot, by_model


def error_type(err) -> Column:
    return F.substring_index(F.col(err) if isinstance(err, str) else err, ":", 1)


def error_analysis(pl: DataFrame) -> DataFrame:
    """LG12: count per error type (text before the first ':')."""
    return (pl.where(truthy_str("error").isNotNull()).groupBy(error_type("error").alias("error_type"))
              .agg(F.count("*").alias("count")))


def correlate(requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """LG14: a response updates its request row; an unmatched response becomes a new row with an
    empty prompt.  Full outer join on the id + coalesce (no lost prompts)."""
    r = requests.alias("q")
    s = responses.alias("s")
    j = r.join(s, key, "full_outer")
    return j.select(key, F.coalesce(F.col("q.timestamp"), F.col("s.timestamp")).alias("timestamp"),
                    F.coalesce(F.col("q.prompt"), F.lit("")).alias("prompt"), F.col("s.response").alias("response"),
                    F.col("s.latency").alias("latency"), F.col("s.error").alias("error"),
                    F.col("q.request_id").isNull().alias("orphan_response"))


def upsert_latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """LG15: last write wins per key.  ``max_by`` over a struct keeps the aggregation
    partial (map-side), so a hot key is combined before the shuffle."""
    others = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def run_tracking(events: DataFrame, run: str, ts: str, result: str) -> DataFrame:
    """LG16: the first event starts the run; the latest sets end time, results and status
    ('completed' when it carries results, else 'running')."""
    g = events.groupBy(run).agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"),
                                F.max_by(result, ts).alias("results"), F.count("*").alias("n_events"))
    return g.withColumn("status", F.when(F.col("results").isNotNull(), "completed").otherwise("running"))


def slow_requests(df: DataFrame, duration_s: str, threshold_s: float = 1.0) -> DataFrame:
    """LG17: requests slower than the threshold."""
    return df.where(F.col(duration_s) > threshold_s)


def cache_key(prompt, params: dict | None = None) -> Column:
    """LG19: md5(prompt) + md5(sorted-key JSON of the parameters)."""
    import json
    p = json.dumps(params or {}, sort_keys=True)
    import hashlib
    return F.concat(F.md5(F.col(prompt) if isinstance(prompt, str) else prompt),
                    F.lit(hashlib.md5(p.encode()).hexdigest()))


# ----------------------------------------------------------------------------- LG20
def admissions(times, limit: int, window_us: int, accepted: list | None = None) -> tuple[list[bool], list]:
    """Which of the ascending ``times`` are admitted, and the last ``limit`` admitted times.

    An event is admitted unless the ``limit``-th latest admitted one lies less than a window back."""
    kept = list(accepted or [])
    out = []
    for t in times:
        ok = len(kept) < limit or kept[-limit] <= t - window_us
        out.append(ok)
        if ok:
            kept.append(t)
    return out, kept[-limit:]


def _admit_segments(keys: list[str], limit: int, window_us: int):
    """Rows come sorted by segment and time; a segment may span several Arrow batches."""
    def run(batches):
        open_key, kept = None, []
        for pdf in batches:
            parts = []
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                ok, kept = admissions(part["_t"].tolist(), limit, window_us, kept if key == open_key else None)
                open_key = key
                parts.extend(ok)
            yield pdf.drop(columns=["_t", "_segment"]).assign(allowed=parts)
    return run


def rate_limit(events: DataFrame, client: str, ts: str, seq: str, limit: int, window_s: float) -> DataFrame:
    """LG20: sliding-window limiter per client: an event is allowed when fewer than ``limit``
    *accepted* events fall in (t − window, t].  Rejected events do not count, so this is an
    order-dependent fold.  A pause of a window or more leaves nothing to remember, so a client's events
    are cut at such pauses (found with running maxima over stored range partitions) and the segments
    are folded in parallel; a batch carries only the last ``limit`` admitted times."""
    window_us = int(round(window_s * 1e6))
    t = F.unix_micros(F.col(ts).cast("timestamp"))  # integer microseconds: exact comparisons
    src = events.select(client, seq, ts, t.alias("_t"))
    before = with_group_prefix_max(src, [client], [ts, seq], "_t", "_before", exclusive=True)
    fresh = before.withColumn("_start", F.when(F.col("_before").isNull() | (F.col("_t") - F.col("_before") >= window_us), F.col("_t")))
    cut = with_group_prefix_max(fresh.drop("_before"), [client], [ts, seq], "_start", "_segment").drop("_start")
    dealt = (cut.select(client, seq, ts, "_t", "_segment").repartition(client, "_segment")
             .sortWithinPartitions(client, "_segment", ts, seq))
    types = dict(events.dtypes)
    schema = f"{client} {types[client]}, {seq} {types[seq]}, {ts} {types[ts]}, allowed boolean"
    return dealt.mapInPandas(_admit_segments([client, "_segment"], limit, window_us), schema)
