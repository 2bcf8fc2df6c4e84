"""History / trend / statistics queries (HS*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import r6
from ..operators import history as H
from ..sources import bindings as B
from ..sources.tables import table
from .registry import query

OH = ("opt_history",)
RUN, IT = "run_id", "iteration"


def _ma_sql():
    cases = []
    for w in range(1, 6):
        lo, hi = w // 2, w - 1 - w // 2
        cases.append(f"WHEN {w} THEN CASE WHEN count(best_score) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING) = {w} "
                     f"THEN avg(best_score) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING) END")
    return "CASE w " + " ".join(cases) + " END"


@query("hs1_moving_average", uses=OH, sql=f"""
WITH n AS (SELECT run_id, count(*) AS n FROM opt_history GROUP BY run_id),
h AS (SELECT o.*, least(5, n // 4) AS w FROM opt_history o JOIN n USING (run_id) WHERE n > 5)
SELECT run_id, iteration, round({_ma_sql()}, 6) AS moving_avg, w AS "window" FROM h""")
def hs1(spark, d):
    m = H.centred_moving_average(B.opt_history(spark, d), RUN, IT, "best_score")
    return m.select(RUN, IT, r6("moving_avg", "moving_avg"), "window")


@query("hs2_step_diff", uses=OH, sql="""
SELECT run_id, iteration, round(best_score - lag(best_score) OVER (PARTITION BY run_id ORDER BY iteration), 6) AS diff FROM opt_history""")
def hs2(spark, d):
    return H.step_diff(B.opt_history(spark, d), RUN, IT, "best_score").select(RUN, IT, r6("diff", "diff"))


@query("hs3_convergence_index", uses=OH, sql="""
WITH n AS (SELECT run_id, count(*) AS n, least(10, count(*) // 4) AS w FROM opt_history GROUP BY run_id HAVING count(*) > 10),
r AS (SELECT a.run_id, a.iteration AS t, (a.best_score - b.best_score) / n.w AS r FROM opt_history a JOIN n USING (run_id)
      JOIN opt_history b ON b.run_id = a.run_id AND b.iteration = a.iteration - n.w),
th AS (SELECT run_id, stddev_samp(r) * 0.1 AS thr FROM r GROUP BY run_id),
h AS (SELECT r.run_id, min(t) AS converged_idx FROM r JOIN th USING (run_id) WHERE abs(r) < thr GROUP BY r.run_id)
SELECT n.run_id, CAST(n.w AS INTEGER) AS "window", coalesce(h.converged_idx, -1) AS converged_idx FROM n LEFT JOIN h USING (run_id)""")
def hs3(spark, d):
    """``converged_idx`` = −1 when the series never converges."""
    c = H.convergence_index(B.opt_history(spark, d), RUN, IT, "best_score")
    return c.select(RUN, "window", F.coalesce("converged_idx", F.lit(-1)).cast("long").alias("converged_idx"))


@query("hs4_patience_convergence", uses=OH, sql="""
WITH n AS (SELECT run_id, count(*) AS n FROM opt_history GROUP BY run_id),
d AS (SELECT run_id, current_score - lag(current_score) OVER (PARTITION BY run_id ORDER BY iteration) AS diff FROM opt_history),
m AS (SELECT run_id, coalesce(min(diff) >= 0, true) AS mono FROM d GROUP BY run_id),
g AS (SELECT o.run_id, n.n, max(CASE WHEN iteration >= n.n - 10 THEN current_score END) AS rmax,
  min(CASE WHEN iteration >= n.n - 10 THEN current_score END) AS rmin, max(current_score) AS total_improvement,
  avg(current_score) AS average_improvement, CASE WHEN count(current_score) < 2 THEN 0.0 ELSE var_pop(current_score) END AS v
  FROM opt_history o JOIN n USING (run_id) GROUP BY o.run_id, n.n)
SELECT run_id, CASE WHEN n > 10 AND rmax - rmin < 0.001 THEN 'converged' ELSE 'completed' END AS status,
  CAST(CASE WHEN n > 10 AND rmax - rmin < 0.001 THEN n - 10 ELSE -1 END AS BIGINT) AS convergence_step,
  round(total_improvement, 6) AS total_improvement, round(average_improvement, 9) AS average_improvement,
  round(v, 6) AS improvement_variance, mono AS monotonic_improvement FROM g JOIN m USING (run_id)""")
def hs4(spark, d):
    p = H.patience_convergence(B.opt_history(spark, d), RUN, IT, "current_score")
    return p.select(
        RUN, "status", "convergence_step", r6("total_improvement", "total_improvement"),
        F.round("average_improvement", 9).alias("average_improvement"),
        r6("improvement_variance", "improvement_variance"), "monotonic_improvement")


@query("hs5_early_stop", uses=OH, sql="""
WITH f AS (SELECT run_id, iteration, count(*) OVER w AS c, max(best_score) OVER w - min(best_score) OVER w AS rng FROM opt_history
           WINDOW w AS (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
s AS (SELECT run_id, min(iteration) AS stop_step FROM f WHERE c = 5 AND rng < 0.01 GROUP BY run_id)
SELECT r.run_id, s.stop_step FROM (SELECT DISTINCT run_id FROM opt_history) r LEFT JOIN s USING (run_id)""")
def hs5(spark, d):
    return H.early_stop_step(B.opt_history(spark, d), RUN, IT, "best_score", 5, 0.01)


@query("hs6_history_report", uses=OH, sql="""
SELECT run_id, round(arg_min(best_score, iteration), 6) AS initial_score, round(arg_max(best_score, iteration), 6) AS final_score,
  count(*) AS iterations, round(arg_max(best_score, iteration) - arg_min(best_score, iteration), 6) AS improvement
FROM opt_history GROUP BY run_id""")
def hs6(spark, d):
    r = H.history_report(B.opt_history(spark, d), RUN, IT, "best_score")
    return r.select(RUN, r6("initial_score", "initial_score"), r6("final_score", "final_score"), "iterations",
                    r6("improvement", "improvement"))


@query("hs7_best_step", uses=OH, sql="""
SELECT run_id, first(iteration ORDER BY current_score DESC, iteration) AS best_step, round(max(current_score), 6) AS best_score,
  round(arg_min(current_score, iteration), 6) AS baseline_score, round(max(current_score) - arg_min(current_score, iteration), 6) AS improvement
FROM opt_history GROUP BY run_id""")
def hs7(spark, d):
    b = H.best_step(B.opt_history(spark, d), RUN, IT, "current_score")
    return b.select(RUN, "best_step", r6("best_score", "best_score"), r6("baseline_score", "baseline_score"),
                    r6("improvement", "improvement"))


@query("hs8_numeric_summary", uses=("eval_runs",), sql="""
SELECT 'progress' AS column, round(avg(progress), 6) AS mean, round(stddev_samp(progress), 6) AS std,
  CAST(min(progress) AS DOUBLE) AS min, CAST(max(progress) AS DOUBLE) AS max FROM eval_runs
UNION ALL SELECT 'batch_id', round(avg(batch_id), 6), round(stddev_samp(batch_id), 6), CAST(min(batch_id) AS DOUBLE), CAST(max(batch_id) AS DOUBLE) FROM eval_runs""")
def hs8(spark, d):
    s = H.numeric_summary(B.eval_runs(spark, d), ["progress", "batch_id"])
    return s.select("column", *[r6(c, c) for c in ("mean", "std", "min", "max")])


@query("hs8_experiment_overview", uses=("eval_runs",), sql="""
SELECT count(*) AS experiments, max(progress) AS best_progress, round(count_if(status = 'completed') / count(*), 6) AS completion_rate FROM eval_runs""")
def hs8b(spark, d):
    r = B.eval_runs(spark, d)
    return r.agg(F.count("*").alias("experiments"), F.max("progress").alias("best_progress"),
                 r6(F.count_if(F.col("status") == "completed") / F.count("*"), "completion_rate"))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("hs9_group_summary", sql="SELECT l_returnflag, " + ", ".join(
    f"round(avg({c}), 3) AS {c}_mean, round(stddev_samp({c}), 3) AS {c}_std, count({c}) AS {c}_count" for c in _LI)
    + " FROM lineitem GROUP BY l_returnflag")
def hs9(spark, d):
    return H.group_summary(table(spark, d, "lineitem"), "l_returnflag", _LI)


@query("hs10_distribution_summary", sql="""
WITH m AS (SELECT avg(l_extendedprice) AS mu FROM lineitem),
c AS (SELECT count(l_extendedprice) AS count, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.5) AS median,
  stddev_pop(l_extendedprice) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.75) AS q75,
  avg(pow(l_extendedprice - mu, 2)) AS m2, avg(pow(l_extendedprice - mu, 3)) AS m3, avg(pow(l_extendedprice - mu, 4)) AS m4 FROM lineitem, m)
SELECT count, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max,
  round(q25, 6) AS q25, round(q75, 6) AS q75, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / pow(m2, 2) - 3, 6) AS kurtosis FROM c""")
def hs10(spark, d):
    s = H.distribution_summary(table(spark, d, "lineitem"), "l_extendedprice")
    return s.select("count", *[r6(c, c) for c in ("mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis")])


@query("hs11_trend", sql="""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS x FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, count(*) AS n, regr_slope(value, x) AS slope, regr_r2(value, x) AS r2, regr_sxx(value, x) AS sxx, regr_syy(value, x) AS syy
      FROM r GROUP BY user_id),
s AS (SELECT *, sqrt((1 - r2) * syy / ((n - 2) * sxx)) AS se FROM g)
SELECT user_id, n, round(slope, 6) AS slope, round(r2, 6) AS r_squared, round(se, 6) AS std_err, round(slope - 1.96 * se, 6) AS ci_low,
  round(slope + 1.96 * se, 6) AS ci_high, round(CASE WHEN se > 0 THEN slope / se END, 6) AS t_stat FROM s""")
def hs11(spark, d):
    t = H.linear_trend(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", with_p=False)
    return t.select("user_id", "n", *[r6(c, c) for c in ("slope", "r_squared", "std_err", "ci_low", "ci_high", "t_stat")])


@query("hs11_trend_direction")
def hs11p(spark, d):
    """Trend with p-value and direction (the Student-t tail runs in an Arrow UDF on one row per series)."""
    t = H.linear_trend(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", with_p=True)
    return t.select("user_id", "n", r6("slope", "slope"), r6("p_value", "p_value"), "trend_direction")


@query("hs12_iqr_outliers", sql="""
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, b
WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)""")
def hs12(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return H.iqr_outliers(li, "l_extendedprice")


@query("hs12_variant_outliers", uses=("variants",), sql="""
WITH b AS (SELECT quantile_cont(generation_time * quality_score, 0.25) AS q1, quantile_cont(generation_time * quality_score, 0.75) AS q3 FROM variants)
SELECT id FROM variants, b WHERE generation_time * quality_score < q1 - 1.5 * (q3 - q1) OR generation_time * quality_score > q3 + 1.5 * (q3 - q1)""")
def hs12v(spark, d):
    v = B.variants(spark, d).select("id", (F.col("generation_time") * F.col("quality_score")).alias("x"))
    return H.iqr_outliers(v, "x").select("id")


@query("hs13_zscore_outliers", sql="""
WITH b AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, b WHERE abs((l_extendedprice - m) / s) > 3""")
def hs13(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return H.zscore_outliers(li, "l_extendedprice")


@query("hs14_correlation_matrix", sql=" UNION ALL ".join(
    (f"SELECT '{a}' AS col_a, '{b}' AS col_b, 1.0 AS corr" if a == b else
     f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem")
    for a in _LI for b in _LI))
def hs14(spark, d):
    return H.correlation_matrix(table(spark, d, "lineitem"), _LI).select("col_a", "col_b", r6("corr", "corr"))


@query("hs15_length_quality_corr", uses=("variants",), sql="SELECT round(corr(length(content), quality_score), 6) AS length_quality_correlation FROM variants")
def hs15(spark, d):
    return B.variants(spark, d).agg(r6(F.corr(F.length("content"), F.col("quality_score")), "length_quality_correlation"))


@query("hs16_quality_histogram", uses=("variants",), sql="""
WITH b AS (SELECT CAST(quality_score >= 0.2 AS INTEGER) + CAST(quality_score >= 0.4 AS INTEGER) + CAST(quality_score >= 0.6000000000000001 AS INTEGER)
  + CAST(quality_score >= 0.8 AS INTEGER) AS bin FROM variants WHERE quality_score BETWEEN 0 AND 1),
e AS (SELECT * FROM (VALUES (0, 0.0, 0.2), (1, 0.2, 0.4), (2, 0.4, 0.6000000000000001), (3, 0.6000000000000001, 0.8), (4, 0.8, 1.0)) t(bin, lo, hi))
SELECT e.bin, e.lo, e.hi, count(b.bin) AS count FROM e LEFT JOIN b USING (bin) GROUP BY e.bin, e.lo, e.hi""")
def hs16(spark, d):
    return H.histogram_unit(B.variants(spark, d), "quality_score", 5)


@query("hs17_auto_histogram", sql="""
WITH s AS (SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx,
  quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
w AS (SELECT *, 2 * (q3 - q1) * pow(n, -1.0 / 3) AS fd, (mx - mn) / (log2(n) + 1) AS st FROM s),
k AS (SELECT *, CAST(greatest(1, ceil((mx - mn) / CASE WHEN fd > 0 THEN least(fd, st) ELSE st END)) AS INTEGER) AS k FROM w)
SELECT CAST(least(floor((l_extendedprice - mn) / (mx - mn) * k), k - 1) AS INTEGER) AS bin, k AS n_bins, count(*) AS count
FROM lineitem, k GROUP BY 1, 2""")
def hs17(spark, d):
    return H.auto_histogram(table(spark, d, "lineitem"), "l_extendedprice")


@query("hs18_box_plot", sql="""
WITH q AS (SELECT l_returnflag, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
  quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS max FROM lineitem GROUP BY l_returnflag),
w AS (SELECT l.l_returnflag, min(l_quantity) AS whisker_low, max(l_quantity) AS whisker_high FROM lineitem l JOIN q USING (l_returnflag)
  WHERE l_quantity >= q1 - 1.5 * (q3 - q1) AND l_quantity <= q3 + 1.5 * (q3 - q1) GROUP BY l.l_returnflag)
SELECT q.*, w.whisker_low, w.whisker_high FROM q LEFT JOIN w USING (l_returnflag)""")
def hs18(spark, d):
    return H.box_plot(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")


@query("hs19_timeline", uses=("prompt_logs",), sql="""
WITH l AS (UNPIVOT (SELECT "timestamp", latency, cost FROM prompt_logs) ON latency, cost INTO NAME metric VALUE value)
SELECT date_trunc('day', "timestamp") AS bucket, metric, round(avg(value), 6) AS value, count(value) AS n FROM l GROUP BY 1, 2""")
def hs19(spark, d):
    t = H.timeline(B.prompt_logs(spark, d), "timestamp", ["latency", "cost"], "day")
    return t.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "metric", r6("value", "value"), "n")


@query("hs20_parameter_sensitivity", sql="""
SELECT p_brand AS param, first(p_size ORDER BY p_retailprice DESC, p_partkey) AS best_value, round(max(p_retailprice), 6) AS best_score, count(*) AS n
FROM part GROUP BY p_brand""")
def hs20(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("param"), F.col("p_size").alias("value"),
                                       F.col("p_retailprice").alias("score"), "p_partkey")
    s = H.parameter_sensitivity(p, "param", "value", "score", "p_partkey")
    return s.select("param", "best_value", r6("best_score", "best_score"), "n")


def _ablation_input(spark, d):
    """One row per nation: average supplier balance (scaled); ALGERIA plays the baseline."""
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg((F.avg("s_acctbal") / 10000.0).alias("score"))
    return j.select(F.when(F.col("n_name") == "ALGERIA", "baseline").otherwise(F.col("n_name")).alias("component"), "score")


@query("hs21_ablation", sql="""
WITH a AS (SELECT CASE WHEN n_name = 'ALGERIA' THEN 'baseline' ELSE n_name END AS component, avg(s_acctbal) / 10000.0 AS score
           FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
b AS (SELECT coalesce(max(CASE WHEN component = 'baseline' THEN score END), max(score)) AS b, max(CAST(component = 'baseline' AS INTEGER)) AS has FROM a),
i AS (SELECT component, b - score AS importance FROM a, b WHERE has = 0 OR component <> 'baseline'),
o AS (SELECT *, row_number() OVER (ORDER BY importance DESC, component) - 1 AS rank FROM i)
SELECT component, round(importance, 6) AS importance, rank, round(sum(importance) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING), 6) AS cumulative_importance FROM o""")
def hs21(spark, d):
    a = H.ablation(_ablation_input(spark, d), "component", "score")
    return a.select("component", r6("importance", "importance"), "rank", r6("cumulative_importance", "cumulative_importance"))


@query("hs22_variant_metric_matrix", uses=("eval_results",), sql="""
SELECT variant_id, round(avg(CASE WHEN metric = 'exact_match' THEN score END), 6) AS exact_match,
  round(avg(CASE WHEN metric = 'bleu' THEN score END), 6) AS bleu, round(avg(CASE WHEN metric = 'rouge' THEN score END), 6) AS rouge
FROM eval_results GROUP BY variant_id""")
def hs22(spark, d):
    m = H.variant_metric_matrix(B.eval_results(spark, d), "variant_id", "metric", "score", list(B.METRICS))
    return m.select("variant_id", *[r6(c, c) for c in B.METRICS])


@query("hs23_benchmark_summary", uses=("variants",), sql="""
WITH g AS (SELECT base_prompt, avg(quality_score) AS mean, quantile_cont(quality_score, 0.5) AS median, coalesce(stddev_samp(quality_score), 0.0) AS std,
  max(quality_score) - min(quality_score) AS range, max(quality_score) AS best, min(quality_score) AS worst,
  count_if(quality_score >= 0.85) AS n_above, count(*) AS n FROM variants GROUP BY base_prompt)
SELECT base_prompt, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(range, 6) AS range,
  round(best, 6) AS best, round(worst, 6) AS worst, n_above, n, row_number() OVER (ORDER BY mean DESC, base_prompt) - 1 AS rank FROM g""")
def hs23(spark, d):
    s = H.benchmark_summary(B.variants(spark, d), "base_prompt", "quality_score", "id")
    return s.select("base_prompt", *[r6(c, c) for c in ("mean", "median", "std", "range", "best", "worst")], "n_above", "n", "rank")


@query("hs24_strategy_benchmark", uses=("eval_results",), sql="""
SELECT strategy, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, round(avg(score), 6) AS mean_quality,
  round(var_pop(score), 6) AS quality_variance, round(avg(latency_ms), 6) AS time_per_variant, count(*) AS n,
  avg(CAST(success AS DOUBLE)) < 0.8 AS low_success, var_pop(score) > 0.1 AS high_variance,
  round(avg(score) * avg(CAST(success AS DOUBLE)), 6) AS efficiency FROM eval_results GROUP BY strategy""")
def hs24(spark, d):
    s = H.strategy_benchmark(B.eval_results(spark, d), "strategy", "score", "success", "latency_ms")
    return s.select("strategy", *[r6(c, c) for c in ("success_rate", "mean_quality", "quality_variance", "time_per_variant")],
                    "n", "low_success", "high_variance", r6("efficiency", "efficiency"))


@query("hs25_latest_per_user", sql="""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t
WHERE rn <= 10""")
def hs25(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return H.latest_per_key(e, "user_id", "ts", 10, "event_id").select("user_id", "event_id")
