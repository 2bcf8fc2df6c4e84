"""Evaluation roll-up queries (EV*) over ``eval_results`` (prompt = variant_id, case = lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import r6
from ..operators import pair_metrics as pm
from ..operators import rollups as R
from ..sources import bindings as B
from .q_metrics import RQ_SQL
from .registry import query

ER = ("eval_results",)
P = "variant_id"
CASE = ["case_id", "sample_index"]


def _facts(spark, d):
    return B.eval_results(spark, d)


def _cases(spark, d):
    return R.case_table(_facts(spark, d), P, CASE, "success", "latency_ms")


CASES_SQL = """_cases AS (SELECT variant_id, case_id, sample_index, bool_and(success) AS success, first(latency_ms) AS latency_ms
  FROM eval_results GROUP BY variant_id, case_id, sample_index)"""
MEANS_SQL = """_means AS (SELECT variant_id, metric, coalesce(avg(CASE WHEN success AND score IS NOT NULL THEN score END), 0.0) AS mean_score
  FROM eval_results GROUP BY variant_id, metric)"""
SUCC_SQL = """_succ AS (SELECT variant_id, count(*) AS total_cases, count_if(success) AS successful_cases,
  count_if(NOT success) AS failed_cases, count_if(success) / count(*) AS success_rate FROM _cases GROUP BY variant_id)"""
LAT_SQL = """_lat AS (SELECT variant_id, count(latency_ms) AS n, avg(latency_ms) AS mean, min(latency_ms) AS min, max(latency_ms) AS max,
  quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99,
  coalesce(stddev_samp(latency_ms), 0.0) AS std FROM _cases WHERE success GROUP BY variant_id)"""


@query("ev2_metric_means", uses=ER, sql=f"WITH {MEANS_SQL} SELECT variant_id, metric, round(mean_score, 6) AS mean_score FROM _means")
def ev2(spark, d):
    return R.metric_means(_facts(spark, d), P).select(P, "metric", r6("mean_score", "mean_score"))


@query("ev3_success_rate", uses=ER, sql=f"""WITH {CASES_SQL}, {SUCC_SQL}
SELECT variant_id, total_cases, successful_cases, failed_cases, round(success_rate, 6) AS success_rate FROM _succ""")
def ev3(spark, d):
    s = R.success_stats(_cases(spark, d), P)
    return s.select(P, "total_cases", "successful_cases", "failed_cases", r6("success_rate", "success_rate"))


_LAT_COLS = ("mean", "min", "max", "p50", "p95", "p99", "std")


@query("ev4_latency_stats", uses=ER, sql=f"""WITH {CASES_SQL}, {LAT_SQL}
SELECT variant_id, n, {', '.join(f'round({c}, 6) AS {c}' for c in _LAT_COLS)} FROM _lat""")
def ev4(spark, d):
    s = R.latency_stats(_cases(spark, d), [P], "latency_ms")
    return s.select(P, "n", *[r6(c, c) for c in _LAT_COLS])


@query("ev5_latency_score", uses=ER, sql=f"""WITH {CASES_SQL}
SELECT count(*) AS n, round(avg(latency_ms / 1000.0), 6) AS mean, round(quantile_cont(latency_ms / 1000.0, 0.5), 6) AS median,
  round(quantile_cont(latency_ms / 1000.0, 0.95), 6) AS p95, round(quantile_cont(latency_ms / 1000.0, 0.99), 6) AS p99,
  round(coalesce(stddev_samp(latency_ms / 1000.0), 0.0), 6) AS std, round(min(latency_ms / 1000.0), 6) AS min,
  round(max(latency_ms / 1000.0), 6) AS max FROM _cases""")
def ev5(spark, d):
    c = _cases(spark, d).withColumn("latency_s", F.col("latency_ms") / 1000.0)
    s = R.latency_stats(c, [], "latency_s", success=None)
    return s.select("n", r6("mean", "mean"), r6("p50", "median"), r6("p95", "p95"), r6("p99", "p99"),
                    r6("std", "std"), r6("min", "min"), r6("max", "max"))


@query("ev6_metric_summary", uses=ER, sql=f"""WITH {MEANS_SQL}
SELECT metric, round(avg(mean_score), 6) AS mean, round(min(mean_score), 6) AS min, round(max(mean_score), 6) AS max,
  round(coalesce(stddev_samp(mean_score), 0.0), 6) AS std, count(*) AS count FROM _means GROUP BY metric""")
def ev6(spark, d):
    s = R.metric_summary(R.metric_means(_facts(spark, d), P))
    return s.select("metric", *[r6(c, c) for c in ("mean", "min", "max", "std")], "count")


@query("ev6_suite_overview", uses=ER, sql=f"""WITH {CASES_SQL}, {MEANS_SQL}, {SUCC_SQL}, {LAT_SQL},
_ps AS (SELECT variant_id, sum(mean_score) AS score_sum FROM _means GROUP BY variant_id)
SELECT (SELECT count(*) FROM _succ) AS total_prompts,
  (SELECT CAST(sum(total_cases) AS BIGINT) FROM _succ) AS total_test_cases,
  (SELECT CAST(sum(successful_cases) AS BIGINT) FROM _succ) AS total_successful_cases,
  (SELECT round(avg(success_rate), 6) FROM _succ) AS success_rate_mean,
  (SELECT round(min(success_rate), 6) FROM _succ) AS success_rate_min,
  (SELECT round(max(success_rate), 6) FROM _succ) AS success_rate_max,
  (SELECT round(avg(mean), 6) FROM _lat) AS latency_mean,
  (SELECT round(min(mean), 6) FROM _lat) AS latency_min,
  (SELECT round(max(mean), 6) FROM _lat) AS latency_max,
  (SELECT first(variant_id ORDER BY score_sum DESC, variant_id) FROM _ps) AS best_prompt,
  (SELECT first(variant_id ORDER BY score_sum ASC, variant_id) FROM _ps) AS worst_prompt""")
def ev6_overview(spark, d):
    facts, cases = _facts(spark, d), _cases(spark, d)
    succ = R.success_stats(cases, P)
    lat = R.latency_stats(cases, [P], "latency_ms")
    ps = R.prompt_scores(R.metric_means(facts, P), P)
    a = succ.agg(F.count("*").alias("total_prompts"), F.sum("total_cases").alias("total_test_cases"),
                 F.sum("successful_cases").alias("total_successful_cases"),
                 r6(F.avg("success_rate"), "success_rate_mean"), r6(F.min("success_rate"), "success_rate_min"),
                 r6(F.max("success_rate"), "success_rate_max"))
    b = lat.agg(r6(F.avg("mean"), "latency_mean"), r6(F.min("mean"), "latency_min"), r6(F.max("mean"), "latency_max"))
    c = R.best_and_worst(ps, P)
    # Each side is one row: the cross joins are 1 × 1.
    return a.crossJoin(b).crossJoin(c)


@query("ev7_evaluation_summary", uses=ER, sql=f"""WITH {CASES_SQL}, {MEANS_SQL}, {SUCC_SQL},
_ps AS (SELECT variant_id, sum(mean_score) AS score_sum FROM _means GROUP BY variant_id)
SELECT count(*) AS total_prompts, CAST(sum(total_cases) AS BIGINT) AS total_test_cases,
  CAST(sum(successful_cases) AS BIGINT) AS total_successful_cases,
  round(CASE WHEN sum(total_cases) > 0 THEN sum(successful_cases) / sum(total_cases) ELSE 0 END, 6) AS overall_success_rate,
  (SELECT first(variant_id ORDER BY score_sum DESC, variant_id) FROM _ps) AS best_prompt,
  (SELECT first(variant_id ORDER BY score_sum ASC, variant_id) FROM _ps) AS worst_prompt FROM _succ""")
def ev7(spark, d):
    facts, cases = _facts(spark, d), _cases(spark, d)
    succ = R.success_stats(cases, P)
    a = succ.agg(F.count("*").alias("total_prompts"), F.sum("total_cases").alias("total_test_cases"),
                 F.sum("successful_cases").alias("total_successful_cases"),
                 r6(F.when(F.sum("total_cases") > 0, F.sum("successful_cases") / F.sum("total_cases")).otherwise(0.0),
                    "overall_success_rate"))
    return a.crossJoin(R.best_and_worst(R.prompt_scores(R.metric_means(facts, P), P), P))


@query("ev8_recommendations", uses=ER, sql=f"""WITH {CASES_SQL}, {MEANS_SQL}, {SUCC_SQL}, {LAT_SQL},
_pm AS (SELECT metric, avg(mean_score) AS m, var_samp(mean_score) AS var, count(*) AS n FROM _means GROUP BY metric),
_hv AS (SELECT string_agg(metric, ', ' ORDER BY metric) AS ms FROM _pm WHERE n > 1 AND var > 0.1),
_f AS (
  SELECT 'low_success' AS rule, '{R.REC_LOW_SUCCESS}' AS message FROM _succ HAVING avg(success_rate) < 0.7
  UNION ALL SELECT 'low_metric', replace('{R.REC_LOW_METRIC}', '{{metric}}', metric) FROM _pm WHERE m < 0.5
  UNION ALL SELECT 'high_latency', '{R.REC_HIGH_LATENCY}' FROM _lat HAVING avg(mean) > 5.0
  UNION ALL SELECT 'high_variance', replace('{R.REC_HIGH_VARIANCE}', '{{metrics}}', ms) FROM _hv
    WHERE ms IS NOT NULL AND (SELECT count(*) FROM _succ) > 1)
SELECT * FROM _f UNION ALL SELECT 'all_good', '{R.REC_ALL_GOOD}' WHERE (SELECT count(*) FROM _f) = 0""")
def ev8(spark, d):
    facts, cases = _facts(spark, d), _cases(spark, d)
    return R.recommendations(R.success_stats(cases, P), R.metric_means(facts, P),
                             R.latency_stats(cases, [P], "latency_ms"), P)


def _run_summary(spark, d):
    """Per (run, variant): summed metric means, success rate and mean latency (one scan)."""
    return R.run_prompt_summary(_facts(spark, d), "run_id", P, CASE, list(B.METRICS), latency="latency_ms")


@query("ev9_pairwise_winner", uses=ER, sql="""
WITH _m AS (SELECT run_id, variant_id, metric, coalesce(avg(CASE WHEN success THEN score END), 0.0) AS mean_score
            FROM eval_results GROUP BY run_id, variant_id, metric),
_ps AS (SELECT run_id, variant_id, sum(mean_score) AS score_sum FROM _m GROUP BY run_id, variant_id),
_c AS (SELECT run_id, variant_id, case_id, sample_index, bool_and(success) AS success, first(latency_ms) AS latency_ms
       FROM eval_results GROUP BY run_id, variant_id, case_id, sample_index),
_cs AS (SELECT run_id, variant_id, count_if(success) / count(*) AS success_rate,
               coalesce(avg(CASE WHEN success THEN latency_ms END), 0.0) AS latency_mean FROM _c GROUP BY run_id, variant_id),
s AS (SELECT * FROM _ps JOIN _cs USING (run_id, variant_id)),
ctrl AS (SELECT s.* FROM s JOIN (SELECT run_id, min(variant_id) AS v FROM s GROUP BY run_id) c ON s.run_id = c.run_id AND s.variant_id = c.v)
SELECT run_id, prompt_a, prompt_b,
  CASE WHEN abs(d) < 0.01 THEN 'tie' WHEN d > 0 THEN 'A' ELSE 'B' END AS winner,
  round(CASE WHEN abs(d) < 0.01 THEN 0.5 ELSE least(0.95, 0.5 + abs(d) / 2) END, 6) AS confidence,
  round(d, 6) + 0.0 AS metric_difference, success_rate_difference + 0.0 AS success_rate_difference, latency_difference + 0.0 AS latency_difference
FROM (SELECT a.run_id, a.variant_id AS prompt_a, b.variant_id AS prompt_b, round(a.score_sum - b.score_sum, 9) AS d,
        round(a.success_rate - b.success_rate, 6) AS success_rate_difference, round(a.latency_mean - b.latency_mean, 6) AS latency_difference
      FROM s a JOIN ctrl b ON a.run_id = b.run_id WHERE a.variant_id <> b.variant_id) t""")
def ev9(spark, d):
    s = _run_summary(spark, d)
    c = R.compare_to_control(s, "run_id", P)
    w, conf, diff = R.winner(F.col("a_score_sum"), F.col("b_score_sum"))
    return c.select("run_id", F.col(f"a_{P}").alias("prompt_a"), F.col(f"b_{P}").alias("prompt_b"), w.alias("winner"),
                    r6(conf, "confidence"), r6(diff, "metric_difference"),
                    r6(F.col("a_success_rate") - F.col("b_success_rate"), "success_rate_difference"),
                    r6(F.col("a_latency_mean") - F.col("b_latency_mean"), "latency_difference"))


@query("ev12_progress", uses=("eval_runs",), sql="""
WITH g AS (SELECT batch_id, count(*) AS total, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed,
  epoch(max(completed_at)) - epoch(min(started_at)) AS elapsed_s FROM eval_runs GROUP BY batch_id)
SELECT batch_id, total, completed, failed, round((completed + failed) / total, 6) AS progress_rate, round(elapsed_s, 6) AS elapsed_s,
  round(CASE WHEN completed + failed > 0 THEN elapsed_s / ((completed + failed) / total) * (1 - (completed + failed) / total) END, 6) AS eta_s
FROM g""")
def ev12(spark, d):
    r = B.eval_runs(spark, d)
    g = r.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        (F.unix_micros(F.max("completed_at").cast("timestamp")) - F.unix_micros(F.min("started_at").cast("timestamp")))
        .alias("_el"))
    rate = (F.col("completed") + F.col("failed")) / F.col("total")
    el = F.col("_el") / 1e6
    return g.select("batch_id", "total", "completed", "failed", r6(rate, "progress_rate"), r6(el, "elapsed_s"),
                    r6(F.when(F.col("completed") + F.col("failed") > 0, el / rate * (1 - rate)), "eta_s"))


@query("ev13_run_summary", uses=ER, sql="""
WITH c AS (SELECT run_id, case_id, sample_index, bool_and(success) AS success FROM eval_results GROUP BY run_id, case_id, sample_index),
cs AS (SELECT run_id, count_if(success) AS completed, count_if(NOT success) AS failed FROM c GROUP BY run_id),
m AS (SELECT run_id, metric, avg(score) AS s FROM eval_results WHERE success GROUP BY run_id, metric),
ms AS (SELECT run_id, avg(CASE WHEN metric = 'exact_match' THEN s END) AS exact_match, avg(CASE WHEN metric = 'bleu' THEN s END) AS bleu,
  avg(CASE WHEN metric = 'rouge' THEN s END) AS rouge, avg(s) AS average_score FROM m GROUP BY run_id)
SELECT run_id, completed, failed, round(exact_match, 6) AS exact_match, round(bleu, 6) AS bleu, round(rouge, 6) AS rouge,
  round(coalesce(average_score, 0.0), 6) AS average_score FROM cs LEFT JOIN ms USING (run_id)""")
def ev13(spark, d):
    facts = _facts(spark, d)
    cases = R.case_table(facts, "run_id", CASE, "success", "latency_ms")
    cs = cases.groupBy("run_id").agg(F.count_if("success").alias("completed"), F.count_if(~F.col("success")).alias("failed"))
    m = facts.where("success").groupBy("run_id", "metric").agg(F.avg("score").alias("s"))
    ms = m.groupBy("run_id").agg(*[F.avg(F.when(F.col("metric") == k, F.col("s"))).alias(k) for k in B.METRICS],
                                 F.avg("s").alias("average_score"))
    out = cs.join(ms, "run_id", "left")
    return out.select("run_id", "completed", "failed", *[r6(k, k) for k in B.METRICS],
                      r6(F.coalesce("average_score", F.lit(0.0)), "average_score"))


@query("ev14_report", uses=ER, sql="""
WITH c AS (SELECT run_id, case_id, sample_index, bool_and(success) AS success, first(latency_ms) AS latency_ms FROM eval_results
           GROUP BY run_id, case_id, sample_index),
r AS (SELECT run_id, count(*) AS total_examples, count_if(success) AS completed, count_if(NOT success) AS failed,
      sum(latency_ms) / 1000.0 AS execution_time FROM c GROUP BY run_id),
s AS (SELECT run_id, avg(score) AS average_score FROM eval_results WHERE success GROUP BY run_id)
SELECT count(*) AS total_runs, CAST(sum(total_examples) AS BIGINT) AS total_examples, CAST(sum(completed) AS BIGINT) AS total_completed,
  CAST(sum(failed) AS BIGINT) AS total_failed, round(avg(coalesce(average_score, 0.0)), 6) AS average_score,
  round(avg(execution_time), 6) AS avg_time, round(min(execution_time), 6) AS min_time, round(max(execution_time), 6) AS max_time
FROM r LEFT JOIN s USING (run_id)""")
def ev14(spark, d):
    facts = _facts(spark, d)
    cases = R.case_table(facts, "run_id", CASE, "success", "latency_ms")
    r = cases.groupBy("run_id").agg(F.count("*").alias("total_examples"), F.count_if("success").alias("completed"),
                                    F.count_if(~F.col("success")).alias("failed"),
                                    (F.sum("latency_ms") / 1000.0).alias("execution_time"))
    s = facts.where("success").groupBy("run_id").agg(F.avg("score").alias("average_score"))
    j = r.join(s, "run_id", "left")
    return j.agg(F.count("*").alias("total_runs"), F.sum("total_examples").alias("total_examples"),
                 F.sum("completed").alias("total_completed"), F.sum("failed").alias("total_failed"),
                 r6(F.avg(F.coalesce("average_score", F.lit(0.0))), "average_score"),
                 r6(F.avg("execution_time"), "avg_time"), r6(F.min("execution_time"), "min_time"),
                 r6(F.max("execution_time"), "max_time"))


WEIGHTS = {"exact_match": 2.0, "bleu": 0.5}


@query("ev15_weighted_aggregate", uses=ER, sql=f"""WITH {MEANS_SQL},
w AS (SELECT variant_id, sum(CASE metric WHEN 'exact_match' THEN 2.0 WHEN 'bleu' THEN 0.5 ELSE 1.0 END * mean_score) AS ws,
  sum(CASE metric WHEN 'exact_match' THEN 2.0 WHEN 'bleu' THEN 0.5 ELSE 1.0 END) AS w FROM _means GROUP BY variant_id)
SELECT variant_id, round(CASE WHEN w > 0 THEN ws / w ELSE 0.0 END, 6) AS weighted_score FROM w""")
def ev15(spark, d):
    return R.weighted_aggregate(R.metric_means(_facts(spark, d), P), WEIGHTS, P).select(
        P, r6("weighted_score", "weighted_score"))


@query("ev16_confidence_interval", uses=ER, sql="""
SELECT metric, count(score) AS n, round(avg(score), 6) AS mean,
  round(CASE WHEN count(score) < 2 THEN 0.0 ELSE greatest(0.0, avg(score) - 1.96 * stddev_samp(score) / sqrt(count(score))) END, 6) AS ci_low,
  round(CASE WHEN count(score) < 2 THEN 1.0 ELSE least(1.0, avg(score) + 1.96 * stddev_samp(score) / sqrt(count(score))) END, 6) AS ci_high
FROM eval_results GROUP BY metric""")
def ev16(spark, d):
    c = R.metric_confidence(_facts(spark, d), ["metric"])
    return c.select("metric", "n", *[r6(x, x) for x in ("mean", "ci_low", "ci_high")])


@query("ev17_compare_runs", uses=ER, sql="""
WITH m AS (SELECT run_id, metric, avg(score) AS mean, var_samp(score) AS var, count(score) AS n FROM eval_results GROUP BY run_id, metric),
b AS (SELECT m.* FROM m WHERE run_id = (SELECT min(run_id) FROM eval_results)),
j AS (SELECT a.run_id, a.metric, a.mean AS mean_a, b.mean AS mean_b, a.var AS va, a.n AS na, b.var AS vb, b.n AS nb
      FROM m a JOIN b ON a.metric = b.metric WHERE a.run_id <> b.run_id)
SELECT run_id, metric, round(mean_a, 6) AS value_run, round(mean_b, 6) AS value_baseline, round(mean_a - mean_b, 6) + 0.0 AS difference,
  CASE WHEN mean_a > mean_b THEN 'run' WHEN mean_a < mean_b THEN 'baseline' ELSE 'tie' END AS better,
  round((mean_a - mean_b) / sqrt(va / na + vb / nb), 6) AS t_stat,
  round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 6) AS df
FROM j""")
def ev17(spark, d):
    return _compared(spark, d).select("run_id", "metric", *[r6(c, c) for c in ("value_run", "value_baseline", "difference")],
                                      "better", r6("t_stat", "t_stat"), r6("df", "df"))


@query("ev17_significance")
def ev17_significance(spark, d):
    """Two-sided Welch p-values and their flag at 5 % (no SQL: DuckDB has no Student distribution)."""
    from ..operators.history import t_two_sided_p
    c = _compared(spark, d).withColumn("p", t_two_sided_p(F.col("t_stat"), F.col("df")))
    return c.select("run_id", "metric", r6("p", "p_value"), (F.col("p") < 0.05).alias("significant"))


@query("ev17_best_run", uses=ER, sql="""
SELECT metric, arg_max(run_id, struct_pack(a := mean, b := -run_id)) AS best_run, max(mean) AS best_mean
FROM (SELECT run_id, metric, round(avg(score), 6) AS mean FROM eval_results GROUP BY run_id, metric) t GROUP BY metric""")
def ev17_best(spark, d):
    """The run with the highest mean of each metric, the smaller id first among equals."""
    m = _facts(spark, d).groupBy("run_id", "metric").agg(F.round(F.avg("score"), 6).alias("mean"))
    return m.groupBy("metric").agg(F.max_by("run_id", F.struct(F.col("mean"), -F.col("run_id"))).alias("best_run"), F.max("mean").alias("best_mean"))


def _compared(spark, d):
    """Every run against the run with the smallest id, by metric."""
    facts = _facts(spark, d)
    m = facts.groupBy("run_id", "metric").agg(F.avg("score").alias("mean"), F.var_samp("score").alias("var"),
                                             F.count("score").alias("n"))
    base = facts.agg(F.min("run_id")).scalar()
    b = m.where(F.col("run_id") == base).select("metric", F.col("mean").alias("mean_b"), F.col("var").alias("vb"), F.col("n").alias("nb"),
                                                F.col("run_id").alias("_b"))
    j = m.join(b, "metric").where(F.col("run_id") != F.col("_b"))
    t, df = R.welch(F.col("mean"), F.col("var"), F.col("n"), F.col("mean_b"), F.col("vb"), F.col("nb"))
    better = F.when(F.col("mean") > F.col("mean_b"), "run").when(F.col("mean") < F.col("mean_b"), "baseline").otherwise("tie")
    return j.select("run_id", "metric", F.col("mean").alias("value_run"), F.col("mean_b").alias("value_baseline"),
                    (F.col("mean") - F.col("mean_b")).alias("difference"), better.alias("better"), t.alias("t_stat"), df.alias("df"))


@query("ev18_result_summary", uses=ER, sql="""
SELECT CASE WHEN GROUPING(metric) = 0 THEN 'metric' WHEN GROUPING(variant_id) = 0 THEN 'prompt' ELSE 'overall' END AS grain,
  metric, CAST(variant_id AS VARCHAR) AS variant_id, count(*) AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0.0), 6) AS std,
  round(min(score), 6) AS min, round(max(score), 6) AS max, count_if(NOT success) AS error_count
FROM eval_results GROUP BY GROUPING SETS ((), (metric), (variant_id))""")
def ev18(spark, d):
    facts = _facts(spark, d)
    g = facts.groupingSets([[], ["metric"], [P]], "metric", P).agg(
        F.grouping("metric").alias("_gm"), F.grouping(P).alias("_gp"), F.count("*").alias("n"),
        r6(F.avg("score"), "mean"), r6(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), "std"),
        r6(F.min("score"), "min"), r6(F.max("score"), "max"), F.count_if(~F.col("success")).alias("error_count"))
    grain = F.when(F.col("_gm") == 0, "metric").when(F.col("_gp") == 0, "prompt").otherwise("overall")
    return g.select(grain.alias("grain"), "metric", F.col(P).cast("string").alias(P), "n", "mean", "std", "min", "max", "error_count")


@query("ev19_quick_test", uses=ER, sql=f"""WITH {MEANS_SQL}
SELECT variant_id, round(avg(mean_score), 6) AS overall_score FROM _means GROUP BY variant_id""")
def ev19(spark, d):
    ps = R.prompt_scores(R.metric_means(_facts(spark, d), P), P)
    return ps.select(P, r6("overall", "overall_score"))


@query("ev20_dashboard", uses=ER, sql="""
WITH v AS (SELECT run_id, variant_id, avg(CASE WHEN metric = 'exact_match' THEN score END) AS accuracy,
  avg(latency_ms) AS latency, count(*) * 0.001 AS cost, bool_and(success) AS completed FROM eval_results GROUP BY run_id, variant_id),
v2 AS (SELECT *, accuracy - avg(accuracy) OVER (PARTITION BY run_id) AS improvement FROM v)
SELECT count(*) AS n_results, first(variant_id ORDER BY accuracy DESC, run_id, variant_id) FILTER (WHERE completed) AS best_variant,
  round(avg(improvement) FILTER (WHERE completed), 6) AS avg_improvement, round(avg(latency) FILTER (WHERE completed), 6) AS avg_latency,
  round(sum(cost) FILTER (WHERE completed), 6) AS total_cost, round(100.0 * count_if(completed) / count(*), 6) AS success_pct FROM v2""")
def ev20(spark, d):
    facts = _facts(spark, d)
    v = facts.groupBy("run_id", P).agg(F.avg(F.when(F.col("metric") == "exact_match", F.col("score"))).alias("accuracy"),
                                       F.avg("latency_ms").alias("latency"), (F.count("*") * 0.001).alias("cost"),
                                       F.bool_and("success").alias("completed"))
    run_mean = v.groupBy("run_id").agg(F.avg("accuracy").alias("_ra"))  # partial aggregate, joined back
    v = v.join(run_mean, "run_id").withColumn("improvement", F.col("accuracy") - F.col("_ra")).drop("_ra")
    c = F.col("completed")
    return v.agg(F.count("*").alias("n_results"),
                 F.max_by(F.when(c, F.col(P)), F.when(c, F.struct(F.col("accuracy"), -F.col("run_id"), -F.col(P))))
                 .alias("best_variant"),
                 r6(F.avg(F.when(c, F.col("improvement"))), "avg_improvement"),
                 r6(F.avg(F.when(c, F.col("latency"))), "avg_latency"), r6(F.sum(F.when(c, F.col("cost"))), "total_cost"),
                 r6(100.0 * F.count_if(c) / F.count("*"), "success_pct"))


@query("ev21_score_variants", uses=("eval_pairs",), sql=f"""
SELECT lang AS variant, count(*) AS n_cases, round(avg({RQ_SQL}), 6) AS variant_score
FROM eval_pairs GROUP BY lang""")
def ev21(spark, d):
    ep = B.eval_pairs(spark, d)
    return ep.groupBy(F.col("lang").alias("variant")).agg(
        F.count("*").alias("n_cases"), r6(F.avg(pm.response_quality("pred", "ref")), "variant_score"))


def _ev1_sql():
    from .q_corpus import FORMATTED_SQL
    from .q_metrics import _rq_sql
    from . import sqlfrag as S
    em = f"CAST(array_to_string({S.toks('text')}, ' ') = array_to_string({S.toks('expected')}, ' ') AS DOUBLE)"
    jac = S.jaccard(S.toks("text"), S.toks("expected"))
    rq = _rq_sql("text", "expected")
    return f"""WITH {FORMATTED_SQL},
g AS (SELECT f.template_id, f.item_id, b.text AS expected, array_to_string({S.split_ws('f.prompt')}[1:5], ' ') AS text,
             len({S.split_ws('f.prompt')}) > 0 AS success FROM f JOIN benchmark b USING (item_id))
SELECT template_id, item_id, success, CASE WHEN success THEN NULL ELSE 'empty prompt' END AS error, m.metric, round(m.score, 6) AS score
FROM g, LATERAL (SELECT * FROM (VALUES ('exact_match', {em}), ('jaccard', {jac}), ('response_quality', {rq})) v(metric, score)) m"""


@query("ev1_evaluation_facts", uses=("templates",), sql=_ev1_sql())
def ev1(spark, d):
    """Prompts × cases: every template formatted with every benchmark input, run through the
    user's model (mapInPandas), scored per metric against the case text; failures kept."""
    from pyspark.sql.functions import broadcast
    from ..operators.udf import generate_batch
    from ..sources.tables import table
    from .udf_fixtures import EchoModel
    bench = table(spark, d, "benchmark")
    cases = B.with_templates(bench).select(
        (F.col("template_id") * 1000000 + F.col("item_id")).alias("case_key"), "template_id", "item_id",
        pm.format_prompt("template", "text").alias("prompt"), F.col("text").alias("expected"))
    out = generate_batch(cases, "prompt", "case_key", EchoModel).join(cases.drop("prompt"), "case_key")
    scored = out.select("template_id", "item_id", (F.col("finish_reason") != "error").alias("success"), "error",
                        F.explode(F.array(
                            F.struct(F.lit("exact_match").alias("metric"), pm.exact_match("text", "expected").alias("score")),
                            F.struct(F.lit("jaccard").alias("metric"), pm.token_jaccard("text", "expected").alias("score")),
                            F.struct(F.lit("response_quality").alias("metric"), pm.response_quality("text", "expected").alias("score")))).alias("m"))
    return scored.select("template_id", "item_id", "success", "error", "m.metric", r6("m.score", "score"))
