"""Registry queries (RG*) over the prompts / prompt_variants / sessions bindings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.common import r6
from ..operators import registry as G
from ..sources import bindings as B
from ..sources.tables import table
from .registry import query

REG = ("prompts", "prompt_variants", "sessions")
LIVE_V = "(SELECT * FROM prompt_variants WHERE deleted_at IS NULL)"


@query("rg1_search_prompts", uses=("prompts", "prompt_variants"), sql=f"""
WITH best AS (SELECT prompt_id, max(performance_score) AS best_score FROM {LIVE_V} GROUP BY prompt_id)
SELECT id, title, model_type FROM prompts
WHERE deleted_at IS NULL AND (title ILIKE '%00001%' OR content ILIKE '%00001%') AND list_contains(tags, 'k1')
  AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-02-15 00:00:00'
  AND id IN (SELECT prompt_id FROM best WHERE best_score >= 0.5)""")
def rg1(spark, d):
    best = G.variant_rollup(B.prompt_variants(spark, d))
    r = G.search_prompts(B.prompts(spark, d), best, query="00001", tags=["k1"],
                         date_from=dt.datetime(2024, 1, 5), date_to=dt.datetime(2024, 2, 15), min_score=0.5)
    return r.select("id", "title", "model_type")


@query("rg2_list_prompts", uses=REG, sql=f"""
WITH vr AS (SELECT prompt_id AS id, count(*) AS variant_count, max(performance_score) AS best_score FROM {LIVE_V} GROUP BY prompt_id),
sr AS (SELECT prompt_id AS id, count(*) AS session_count FROM sessions GROUP BY prompt_id)
SELECT p.id, p.title, coalesce(vr.variant_count, 0) AS n_variants, coalesce(sr.session_count, 0) AS n_sessions,
  round(vr.best_score, 6) AS best_score
FROM prompts p LEFT JOIN vr USING (id) LEFT JOIN sr USING (id) WHERE p.deleted_at IS NULL
ORDER BY p.created_at DESC, p.id DESC LIMIT 50 OFFSET 20""")
def rg2(spark, d):
    r = G.list_prompts(B.prompts(spark, d), B.prompt_variants(spark, d), B.sessions(spark, d),
                       "no_such_field", True, 20, 50)
    return r.select("id", "title", "n_variants", "n_sessions", r6("best_score", "best_score"))


@query("rg3_variants_best", uses=("prompt_variants",), sql=f"""
SELECT id, prompt_id, round(performance_score, 6) AS performance_score,
  coalesce(performance_score = max(CASE WHEN performance_score <> 0 THEN performance_score END) OVER (PARTITION BY prompt_id), false) AS is_best
FROM {LIVE_V} t""")
def rg3(spark, d):
    v = G.flag_best_variants(G.live(B.prompt_variants(spark, d)))
    return v.select("id", "prompt_id", r6("performance_score", "performance_score"), "is_best")


@query("rg3_variants_sorted_page", uses=("prompt_variants",), sql=f"""
SELECT id, prompt_id FROM {LIVE_V} t ORDER BY performance_score DESC NULLS LAST, id LIMIT 40""")
def rg3_sorted(spark, d):
    v = G.live(B.prompt_variants(spark, d))
    return v.orderBy(F.col("performance_score").desc_nulls_last(), "id").limit(40).select("id", "prompt_id")


@query("rg4_prompt_stats", uses=REG, sql=f"""
SELECT (SELECT count(*) FROM prompts WHERE deleted_at IS NULL) AS total_prompts,
  (SELECT count(*) FROM {LIVE_V} v JOIN prompts p ON v.prompt_id = p.id WHERE p.deleted_at IS NULL) AS total_variants,
  (SELECT count(*) FROM sessions s JOIN prompts p ON s.prompt_id = p.id WHERE p.deleted_at IS NULL) AS total_sessions,
  (SELECT round(avg(performance_score), 3) FROM {LIVE_V} v) AS avg_score,
  (SELECT round(max(performance_score), 3) FROM {LIVE_V} v) AS max_score""")
def rg4(spark, d):
    p = G.live(B.prompts(spark, d)).select("id")
    v = G.live(B.prompt_variants(spark, d))
    s = B.sessions(spark, d)
    a = p.agg(F.count("*").alias("total_prompts"))
    b = v.join(p.withColumnRenamed("id", "prompt_id"), "prompt_id").agg(F.count("*").alias("total_variants"))
    c = s.join(p.withColumnRenamed("id", "prompt_id"), "prompt_id").agg(F.count("*").alias("total_sessions"))
    e = v.agg(F.round(F.avg("performance_score"), 3).alias("avg_score"), F.round(F.max("performance_score"), 3).alias("max_score"))
    # one-row sides
    return a.crossJoin(b).crossJoin(c).crossJoin(e)


@query("rg5_recent_activity", uses=("prompts",), sql="""
SELECT count(*) AS recent_prompts FROM prompts WHERE deleted_at IS NULL
  AND created_at >= TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '2024-02-15 00:00:00'""")
def rg5(spark, d):
    asof = F.expr("TIMESTAMP_NTZ'2024-02-15 00:00:00'")
    p = G.live(B.prompts(spark, d))
    return p.where((F.col("created_at") >= asof - F.expr("INTERVAL 30 DAYS")) & (F.col("created_at") <= asof)) \
        .agg(F.count("*").alias("recent_prompts"))


@query("rg6_top_tags", uses=("prompts",), sql="""
SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM prompts WHERE deleted_at IS NULL) t
GROUP BY tag ORDER BY count DESC, tag LIMIT 10""")
def rg6(spark, d):
    return G.top_tags(B.prompts(spark, d), 10)


@query("rg7_model_distribution", uses=("prompts",), sql="""
SELECT model_type, count(*) AS count FROM prompts WHERE deleted_at IS NULL GROUP BY model_type""")
def rg7(spark, d):
    return G.live(B.prompts(spark, d)).groupBy("model_type").agg(F.count("*").alias("count"))


@query("rg8_soft_delete", uses=REG, sql="""
WITH req AS (SELECT id FROM prompts WHERE id % 7 = 0),
active AS (SELECT DISTINCT prompt_id AS id FROM sessions WHERE status IN ('running', 'pending')),
del AS (SELECT id FROM req WHERE id NOT IN (SELECT id FROM active)),
p AS (SELECT id, CASE WHEN id IN (SELECT id FROM del) AND deleted_at IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE deleted_at END AS deleted_at FROM prompts),
v AS (SELECT id, CASE WHEN prompt_id IN (SELECT id FROM del) AND deleted_at IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE deleted_at END AS deleted_at FROM prompt_variants)
SELECT 'prompts' AS tbl, count_if(deleted_at IS NOT NULL) AS n_deleted, count(*) AS n FROM p
UNION ALL SELECT 'prompt_variants', count_if(deleted_at IS NOT NULL), count(*) FROM v""")
def rg8(spark, d):
    p0 = B.prompts(spark, d)
    ids = p0.where(F.col("id") % 7 == 0).select("id")
    p, v = G.soft_delete(p0, B.prompt_variants(spark, d), B.sessions(spark, d), ids,
                         dt.datetime(2024, 2, 1))
    a = p.agg(F.lit("prompts").alias("tbl"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"), F.count("*").alias("n"))
    b = v.agg(F.lit("prompt_variants").alias("tbl"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"), F.count("*").alias("n"))
    return a.unionByName(b)


@query("rg9_active_prompts", uses=("prompts",), sql="""
SELECT id, created_at FROM prompts WHERE deleted_at IS NULL AND created_by = 3 ORDER BY created_at DESC, id DESC""")
def rg9(spark, d):
    p = G.live(B.prompts(spark, d)).where(F.col("created_by") == 3)
    return p.orderBy(F.col("created_at").desc(), F.col("id").desc()).select("id", "created_at")


@query("rg10_update_prompts", uses=("prompts",), sql="""
SELECT id, CASE WHEN id % 5 = 0 THEN concat(title, ' v2') ELSE title END AS title,
  CASE WHEN id % 5 = 0 THEN created_at + INTERVAL 1 DAY END AS updated_at FROM prompts""")
def rg10(spark, d):
    p = B.prompts(spark, d).select("id", "title", "created_at")
    changes = p.where(F.col("id") % 5 == 0).select(
        "id", F.concat("title", F.lit(" v2")).alias("title"), "created_at",
        (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    return G.apply_updates(p, changes).select("id", "title", "updated_at")


@query("rg11_list_eval_runs", uses=("eval_runs",), sql="""
SELECT job_id, status, started_at FROM eval_runs WHERE status = 'completed' AND batch_id = 3
  AND started_at >= TIMESTAMP '1993-01-01' AND started_at <= TIMESTAMP '1997-12-31'
ORDER BY started_at DESC, job_id DESC LIMIT 25 OFFSET 5""")
def rg11(spark, d):
    r = B.eval_runs(spark, d).where((F.col("status") == "completed") & (F.col("batch_id") == 3)
                                   & F.col("started_at").between(dt.datetime(1993, 1, 1), dt.datetime(1997, 12, 31)))
    return G.page(r, "started_at", ["started_at", "completed_at", "status"], "started_at", True, 5, 25, "job_id") \
        .select("job_id", "status", "started_at")


@query("rg12_list_datasets", sql="""
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 25 OFFSET 10""")
def rg12(spark, d):
    p = table(spark, d, "part")
    return G.page(p, "p_retailprice", ["p_retailprice", "p_name", "p_size"], "p_name", True, 10, 25, "p_partkey") \
        .select("p_partkey", "p_name", "p_retailprice")


@query("rg13_optimization_history", uses=("sessions",), sql="""
WITH h AS (SELECT s.job_id, s.status, CASE WHEN length(d.text) > 100 THEN concat(substr(d.text, 1, 97), '...') ELSE d.text END AS prompt
           FROM sessions s JOIN documents d ON d.doc_id = s.prompt_id WHERE s.status IN ('completed', 'failed'))
SELECT job_id, status, prompt, (SELECT count(*) FROM h) AS total FROM h ORDER BY job_id DESC LIMIT 20 OFFSET 40""")
def rg13(spark, d):
    s = B.sessions(spark, d).where(F.col("status").isin("completed", "failed"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("prompt_id"), "text")
    h = s.join(docs, "prompt_id").select("job_id", "status", G.shorten("text").alias("prompt"))
    total = h.agg(F.count("*").alias("total"))
    return G.page(h, "job_id", ["job_id"], "job_id", True, 40, 20, "job_id").crossJoin(total)


@query("rg14_top_variants_per_prompt", uses=("prompt_variants",), sql=f"""
SELECT prompt_id, id FROM (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY performance_score DESC NULLS LAST, id) AS rn
  FROM {LIVE_V} t) x WHERE rn <= 10""")
def rg14(spark, d):
    v = G.live(B.prompt_variants(spark, d))
    return G.top_n_per_group(v, "prompt_id", [F.col("performance_score").desc_nulls_last(), F.col("id")], 10) \
        .select("prompt_id", "id")


@query("rg15_batch_status", uses=("sessions",), sql="""
WITH g AS (SELECT batch_id, count(*) AS total_jobs, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed,
  count_if(status = 'running') AS running, count_if(status IN ('running', 'queued')) AS active,
  count_if(status = 'running' AND progress > 0) AS wp, avg(CASE WHEN status = 'running' AND progress > 0 THEN progress END) AS ap
  FROM sessions GROUP BY batch_id)
SELECT batch_id, CASE WHEN completed = total_jobs THEN 'completed' WHEN failed = total_jobs THEN 'failed' WHEN active > 0 THEN 'running' ELSE 'partial' END AS batch_status,
  round(CASE WHEN wp > 0 THEN (completed * 100 + running * ap) / total_jobs WHEN completed > 0 THEN completed / total_jobs * 100 ELSE 0.0 END, 2) AS overall_progress,
  total_jobs, completed, failed, running FROM g""")
def rg15(spark, d):
    return G.batch_status(B.sessions(spark, d))


@query("rg16_recent_completion_time", uses=("sessions",), sql="""
SELECT round(avg(epoch(completed_at) - epoch(started_at)), 6) AS avg_completion_s, count(*) AS n FROM
  (SELECT * FROM sessions WHERE status = 'completed' ORDER BY completed_at DESC, job_id DESC LIMIT 10) t""")
def rg16(spark, d):
    s = B.sessions(spark, d).where(F.col("status") == "completed") \
        .orderBy(F.col("completed_at").desc(), F.col("job_id").desc()).limit(10)
    secs = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return s.agg(r6(F.avg(secs), "avg_completion_s"), F.count("*").alias("n"))


@query("rg17_filtered_results", uses=("prompts", "prompt_variants"), sql=f"""
SELECT v.id, p.title, v.strategy, round(v.performance_score, 6) AS score
FROM {LIVE_V} v JOIN prompts p ON v.prompt_id = p.id
WHERE contains(lower(p.title), '#0000001') OR contains(lower(v.strategy), 'urgent')""")
def rg17(spark, d):
    v = G.live(B.prompt_variants(spark, d))
    p = B.prompts(spark, d).select(F.col("id").alias("prompt_id"), "title")
    j = v.join(p, "prompt_id").select("id", "title", "strategy", F.struct(F.col("performance_score").alias("score")).alias("metrics"))
    f = j.where(F.lower("title").contains("#0000001") | F.lower("strategy").contains("urgent"))
    return f.orderBy(F.col("metrics.score").desc_nulls_last()).select("id", "title", "strategy", r6("metrics.score", "score"))


@query("rg18_prompt_with_variants", uses=("prompts", "prompt_variants"), sql=f"""
SELECT p.id, v.id AS variant_id, coalesce(n.n, 0) AS n_variants
FROM prompts p LEFT JOIN {LIVE_V} v ON v.prompt_id = p.id
LEFT JOIN (SELECT prompt_id, count(*) AS n FROM {LIVE_V} w GROUP BY prompt_id) n ON n.prompt_id = p.id""")
def rg18(spark, d):
    """One row per prompt and variant (a prompt without variants has one row), so no prompt's variants
    are held in one array."""
    p = B.prompts(spark, d).select("id")
    v = G.live(B.prompt_variants(spark, d)).select(F.col("prompt_id").alias("id"), F.col("id").alias("variant_id"))
    n = v.groupBy("id").agg(F.count("*").alias("n_variants"))
    return p.join(v, "id", "left").join(n, "id", "left").select("id", "variant_id", F.coalesce("n_variants", F.lit(0)).alias("n_variants"))
