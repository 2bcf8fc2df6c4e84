"""History, trend and distribution statistics.

Per-series rolling computations avoid ``Window.partitionBy(series)`` (which
sorts a whole series inside one task).  A series has a dense 0-based index
and is cut into blocks of ``BLOCK`` positions; a row goes to its own block,
and the few rows near a border also to the neighbour whose frames reach them
(halos).  Frames are then computed in place by a window over (series,
block): the shuffle carries the input once plus the halos, and a hot series
spreads over as many tasks as it has blocks.  Frame widths that depend on the
series length come from a per-series count (one row per series) joined back.

Global statistics are single ``agg`` passes (moments, exact percentiles,
``corr``, ``regr_*``) with partial aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordinal import exact_percentiles, with_group_rank, with_ordinal


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series_lengths(df: DataFrame, series: str, idx: str) -> DataFrame:
    return df.groupBy(series).agg(F.count("*").alias("_slen"))


BLOCK = 4096  # positions of a series that one window partition holds, halos aside


def with_halos(df: DataFrame, series: str, idx: str, before: int, after: int = 0) -> tuple[DataFrame, WindowSpec]:
    """(rows, window): rows carry their block ``_b`` and ``_home`` (false for a halo copy); inside the
    window over (series, block) every home row sees its ``before`` predecessors and ``after`` successors.
    ``before`` and ``after`` are at most ``BLOCK``."""
    i, size = F.col(idx), F.lit(BLOCK)
    own = F.floor(i / size)
    blocks = F.array_distinct(F.array(own, F.floor((i + before) / size), F.floor((i - after) / size)))
    rows = df.withColumn("_b", F.explode(blocks)).withColumn("_home", F.col("_b") == own)
    return rows, Window.partitionBy(series, "_b").orderBy(idx)


def _framed(df: DataFrame, series: str, idx: str, value: str, before: int, after: int = 0) -> DataFrame:
    """Home rows with ``_f``: (position, value) of the rows from ``before`` back to ``after`` ahead."""
    rows, w = with_halos(df, series, idx, before, after)
    f = F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v"))).over(w.rowsBetween(-before, after))
    return rows.withColumn("_f", f).where("_home").drop("_b", "_home")


def centred_moving_average(df: DataFrame, series: str, idx: str, value: str, max_w: int = 5) -> DataFrame:
    """HS1: pandas ``rolling(w, center=True).mean()`` with w = min(max_w, N // 4) when N > 5
    (otherwise no average); a position lacking a full window gets NULL."""
    n = series_lengths(df, series, idx)
    src = df.join(n, series).where(F.col("_slen") > 5).withColumn("_wv", F.least(F.lit(max_w), F.floor(F.col("_slen") / 4)).cast("int"))
    half = F.floor(F.col("_wv") / 2)
    inside = F.filter("_f", lambda x: (x["i"] >= F.col(idx) - half) & (x["i"] <= F.col(idx) + F.col("_wv") - 1 - half) & x["v"].isNotNull())
    fr = _framed(src, series, idx, value, max_w // 2, max_w // 2).withColumn("_in", inside)
    total = F.aggregate("_in", F.lit(0.0), lambda s, x: s + x["v"])
    ma = F.when((F.size("_in") == F.col("_wv")) & (F.col("_wv") > 0), total / F.col("_wv"))
    return fr.select(series, idx, ma.alias("moving_avg"), F.col("_wv").alias("window"))


def step_diff(df: DataFrame, series: str, idx: str, value: str) -> DataFrame:
    """HS2: ``value[t] − value[t−1]`` (NULL at t = 0)."""
    rows, w = with_halos(df.select(series, idx, value), series, idx, 1)
    return (rows.withColumn("diff", F.when(F.col(idx) > 0, F.col(value) - F.lag(value).over(w)))
            .where("_home").select(series, idx, "diff"))


def convergence_index(df: DataFrame, series: str, idx: str, value: str, max_w: int = 10) -> DataFrame:
    """HS3: for N > 10, w = min(max_w, N // 4); r[t] = mean of the last w diffs
    = (v[t] − v[t−w]) / w (t ≥ w); threshold = 0.1 · sample std of r; converged at the first
    t ≥ w with |r[t]| < threshold (NULL when none)."""
    n = series_lengths(df, series, idx).where(F.col("_slen") > 10) \
        .withColumn("_w", F.least(F.lit(max_w), F.floor(F.col("_slen") / 4)).cast("int"))
    fr = _framed(df.join(n, series), series, idx, value, max_w)
    past = F.get(F.filter("_f", lambda x: x["i"] == F.col(idx) - F.col("_w")), F.lit(0))
    r = (fr.where(F.col(idx) >= F.col("_w"))
         .select(series, F.col(idx).alias("_t"), ((F.col(value) - past["v"]) / F.col("_w")).alias("r")))
    thr = r.groupBy(series).agg((F.stddev_samp("r") * 0.1).alias("_thr"))
    hit = r.join(thr, series).where(F.abs(F.col("r")) < F.col("_thr")).groupBy(series).agg(F.min("_t").alias("converged_idx"))
    return n.join(hit, series, "left").select(series, F.col("_w").alias("window"), "converged_idx")


def patience_convergence(df: DataFrame, series: str, idx: str, value: str, patience: int = 10,
                         threshold: float = 1e-3) -> DataFrame:
    """HS4: converged when the last ``patience`` values span less than ``threshold`` (then at
    N − patience, else −1); also max, mean, population variance and a monotonic flag."""
    n = series_lengths(df, series, idx)
    j = df.join(n, series)
    recent = F.col(idx) >= F.col("_slen") - patience
    g = j.groupBy(series, "_slen").agg(
        F.max(F.when(recent, F.col(value))).alias("_rmax"), F.min(F.when(recent, F.col(value))).alias("_rmin"),
        F.max(value).alias("total_improvement"), F.avg(value).alias("average_improvement"),
        F.when(F.count(value) < 2, F.lit(0.0)).otherwise(F.var_pop(value)).alias("improvement_variance"))
    d = step_diff(df, series, idx, value).groupBy(series).agg(
        F.coalesce(F.min("diff") >= 0, F.lit(True)).alias("monotonic_improvement"))
    conv = (F.col("_slen") > patience) & (F.col("_rmax") - F.col("_rmin") < threshold)
    return g.join(d, series, "left").select(
        series, F.when(conv, "converged").otherwise("completed").alias("status"),
        F.when(conv, F.col("_slen") - patience).otherwise(F.lit(-1)).cast("long").alias("convergence_step"),
        "total_improvement", "average_improvement", "improvement_variance",
        F.coalesce("monotonic_improvement", F.lit(True)).alias("monotonic_improvement"))


def early_stop_step(df: DataFrame, series: str, idx: str, value: str, patience: int = 5,
                    threshold: float = 0.01) -> DataFrame:
    """HS5: first position whose trailing ``patience`` values span less than ``threshold``."""
    rows, w = with_halos(df.select(series, idx, value), series, idx, patience - 1)
    frame = w.rowsBetween(-(patience - 1), 0)
    calm = (F.count(value).over(frame) == patience) & (F.max(value).over(frame) - F.min(value).over(frame) < threshold)
    # A series' first calm position; a halo row has too short a frame in the block it was copied to.
    return (rows.withColumn("_calm", calm).where("_home").groupBy(series)
            .agg(F.min(F.when(F.col("_calm"), F.col(idx))).alias("stop_step")))


def history_report(df: DataFrame, series: str, idx: str, value: str) -> DataFrame:
    """HS6: initial, final, improvement, iterations (min_by/max_by aggregate partially)."""
    g = df.groupBy(series).agg(F.min_by(value, idx).alias("initial_score"), F.max_by(value, idx).alias("final_score"),
                               F.count("*").alias("iterations"))
    return g.withColumn("improvement", F.col("final_score") - F.col("initial_score"))


def best_step(df: DataFrame, series: str, idx: str, value: str) -> DataFrame:
    """HS7: best position (first on ties) and its improvement over the baseline (position 0)."""
    g = df.groupBy(series).agg(
        F.max_by(F.col(idx), F.struct(F.col(value), -F.col(idx))).alias("best_step"),
        F.max(value).alias("best_score"), F.min_by(value, idx).alias("baseline_score"))
    return g.withColumn("improvement", F.col("best_score") - F.col("baseline_score"))


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """HS8: per column mean, sample std, min, max (one pass, unpivoted)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
                 F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
    w = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in ("mean", "std", "min", "max")])
            for c in cols]
    return w.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def group_summary(df: DataFrame, by: str, cols: list[str], digits: int = 3) -> DataFrame:
    """HS9: mean / sample std / count of every numeric column per group, rounded."""
    aggs = []
    for c in cols:
        aggs += [F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.stddev_samp(c), digits).alias(f"{c}_std"),
                 F.count(c).alias(f"{c}_count")]
    return df.groupBy(by).agg(*aggs)


def distribution_summary(df: DataFrame, col: str) -> DataFrame:
    """HS10: count, mean, median, population std, min, max, q25, q75, biased skewness, excess
    kurtosis (scipy defaults) — NaN dropped; one aggregation pass."""
    x = F.nanvl(F.col(col), F.lit(None).cast("double"))
    src = df.select(x.alias("_x"))
    m = src.agg(F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"),
                F.min("_x").alias("min"), F.max("_x").alias("max"), F.skewness("_x").alias("skewness"),
                F.kurtosis("_x").alias("kurtosis"))
    q = exact_percentiles(src, [], "_x", {"median": 0.5, "q25": 0.25, "q75": 0.75}).select(
        F.struct("median", "q25", "q75")).scalar()
    return m.select("count", "mean", q["median"].alias("median"), "std", "min", "max", q["q25"].alias("q25"),
                    q["q75"].alias("q75"), "skewness", "kurtosis")


def _beta_ratio(a: np.ndarray, b: np.ndarray, x: np.ndarray, terms: int = 1500) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) for x below its mean, by the continued fraction
    x^a (1-x)^b / (a B(a, b)) / (1 + d1 / (1 + d2 / ...)), evaluated from its tail."""
    tail = np.ones_like(x)
    for k in range(terms, 0, -1):
        m = k // 2
        if k % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        tail = 1 + d / tail
    log_beta = np.array([math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q) for p, q in zip(a, b)])
    return np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta) / (a * tail)


def _t_sf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t: I_{df/(df+t²)}(df/2, 1/2); NaN without a t or with df <= 0."""
    out = np.where(np.isnan(t) | ~(df > 0), np.nan, 0.0)
    ok = np.isfinite(t) & (df > 0)
    a, h = df[ok] / 2.0, np.full(int(ok.sum()), 0.5)
    x = df[ok] / (df[ok] + t[ok] * t[ok])
    low = x < (a + 1) / (a + 2.5)
    p = np.ones_like(x)
    p[low] = _beta_ratio(a[low], h[low], np.maximum(x[low], 1e-300))
    rest = ~low & (x < 1)  # the mirrored argument converges there
    p[rest] = 1 - _beta_ratio(h[rest], a[rest], 1 - x[rest])
    out[ok] = p
    return out


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_t_sf(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))


def linear_trend(df: DataFrame, series: str, order: list[str], value: str, with_p: bool = True) -> DataFrame:
    """HS11: regress the non-NULL values on their 0-based index per series: slope, r², SE,
    slope ± 1.96·SE, t; with ``with_p`` the two-sided p-value (Arrow UDF on the per-series
    result rows) and the direction (increasing / decreasing when p < .05, else stable);
    fewer than 3 values ⇒ insufficient_data.  The index is the skew-safe group rank."""
    src = df.where(F.col(value).isNotNull())
    r = with_group_rank(src, [series], order, "_x")
    y, x = F.col(value), F.col("_x").cast("double")
    g = r.groupBy(series).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r_squared"),
                              F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    se = F.sqrt((1 - F.col("r_squared")) * F.col("_syy") / ((F.col("n") - 2) * F.col("_sxx")))
    out = g.select(series, "n", "slope", "r_squared", se.alias("std_err")) \
        .withColumn("ci_low", F.col("slope") - 1.96 * F.col("std_err")) \
        .withColumn("ci_high", F.col("slope") + 1.96 * F.col("std_err")) \
        .withColumn("t_stat", F.when(F.col("std_err") > 0, F.col("slope") / F.col("std_err")))
    if not with_p:
        return out
    p = F.when(F.col("n") >= 3, F.coalesce(t_two_sided_p(F.col("t_stat"), (F.col("n") - 2).cast("double")), F.lit(0.0))) \
        .otherwise(F.lit(1.0))
    out = out.withColumn("p_value", p)
    d = (F.when(F.col("n") < 3, "insufficient_data").when(F.col("p_value") < 0.05,
         F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")).otherwise("stable"))
    return out.withColumn("trend_direction", d)


def iqr_outliers(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """HS12: rows outside [q1 − k·iqr, q3 + k·iqr] (numpy linear percentiles); the bounds are one row."""
    b = exact_percentiles(df, [], value, {"q1": 0.25, "q3": 0.75})
    s = b.select(F.struct("q1", "q3")).scalar()  # scalar subquery
    iqr = s["q3"] - s["q1"]
    return df.where((F.col(value) < s["q1"] - k * iqr) | (F.col(value) > s["q3"] + k * iqr))


def zscore_outliers(df: DataFrame, value: str, z: float = 3.0) -> DataFrame:
    """HS13: |x − mean| / population std > z."""
    s = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))).scalar()  # scalar subquery
    return df.where(F.abs((F.col(value) - s["m"]) / s["s"]) > z)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """HS14: Pearson correlation of every ordered column pair, pairwise complete, one pass."""
    aggs = [F.corr(a, b).alias(f"{a}__{b}") for i, a in enumerate(cols) for b in cols[i + 1:]]
    w = df.agg(*aggs) if aggs else None
    rows = []
    for a in cols:
        for b in cols:
            if a == b:
                v = F.lit(1.0)
            else:
                v = F.col(f"{a}__{b}") if f"{a}__{b}" in [x for x in w.columns] else F.col(f"{b}__{a}")
            rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), v.alias("corr")))
    return w.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def histogram_unit(df: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """HS16: ``np.histogram(x, bins, range=(0, 1))``: edges i/bins as numpy computes them, last bin
    closed, values outside dropped; empty bins reported with count 0."""
    edges = list(np.linspace(0.0, 1.0, bins + 1))
    x = F.col(value)
    b = sum((F.when(x >= float(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    counted = df.where((x >= 0.0) & (x <= 1.0)).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    spark = df.sparkSession
    all_bins = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(bins)],
                                     "bin int, lo double, hi double")
    return F.broadcast(all_bins).join(counted, "bin", "left").select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count"))


def auto_histogram(df: DataFrame, value: str) -> DataFrame:
    """HS17: bin width = the smaller positive of Freedman–Diaconis (2·IQR·n^−1/3) and Sturges
    (range / (log2 n + 1)); equal-width bins over [min, max], last bin closed."""
    q = exact_percentiles(df, [], value, {"q1": 0.25, "q3": 0.75}).select(F.struct("q1", "q3")).scalar()
    st = df.agg(F.struct(F.count(value).alias("n"), F.min(value).alias("mn"), F.max(value).alias("mx"))).scalar()
    rng = st["mx"] - st["mn"]
    fd = 2 * (q["q3"] - q["q1"]) * F.pow(st["n"], -1.0 / 3)
    sturges = rng / (F.log2(st["n"]) + 1)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    k = F.greatest(F.lit(1), F.ceil(rng / width)).cast("int")
    b = F.least(F.floor((F.col(value) - st["mn"]) / rng * k), k - 1).cast("int")
    return df.select(b.alias("bin"), k.alias("n_bins")).groupBy("bin", "n_bins").agg(F.count("*").alias("count"))


def box_plot(df: DataFrame, by: str, value: str) -> DataFrame:
    """HS18: five-number summary per group plus whiskers (extreme values within 1.5·IQR)."""
    q = df.groupBy(by).agg(F.min(value).alias("min"), F.max(value).alias("max")).join(
        exact_percentiles(df, [by], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), by)
    j = df.join(q.select(by, "q1", "q3"), by)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - 1.5 * iqr) & (F.col(value) <= F.col("q3") + 1.5 * iqr)
    wk = j.where(inside).groupBy(by).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return q.join(wk, by, "left")


def timeline(df: DataFrame, ts: str, metrics: list[str], bucket: str | None = None) -> DataFrame:
    """HS19: metrics melted to (ts, metric, value); with ``bucket`` (a ``date_trunc`` unit such as
    'hour' or 'day') averaged per bucket.  Truncation works on the wall-clock value, so the result
    does not depend on the session time zone."""
    long = df.select(ts, *metrics).unpivot([ts], metrics, "metric", "value")
    if not bucket:
        return long
    return long.groupBy(F.date_trunc(bucket, F.col(ts)).alias("bucket"), "metric") \
        .agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def parameter_sensitivity(df: DataFrame, param: str, value: str, score: str, ordinal: str) -> DataFrame:
    """HS20: per parameter the value with the best score (first row on ties)."""
    return df.groupBy(param).agg(F.max_by(value, F.struct(F.col(score), -F.col(ordinal))).alias("best_value"),
                                 F.max(score).alias("best_score"), F.count("*").alias("n"))


def ablation(df: DataFrame, component: str, score: str, baseline: str = "baseline") -> DataFrame:
    """HS21: importance = baseline score − score (no baseline ⇒ max score); components sorted by
    importance with the cumulative sum; the input is one row per component (a small table)."""
    b = df.agg(F.struct(F.coalesce(F.max(F.when(F.col(component) == baseline, F.col(score))), F.max(score)).alias("b"),
                        F.max((F.col(component) == baseline).cast("int")).alias("has"))).scalar()
    j = df.where((b["has"] == 0) | (F.col(component) != baseline))
    j = j.withColumn("importance", b["b"] - F.col(score))
    o = with_ordinal(j, [F.col("importance").desc(), F.col(component)], "_o")
    w = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    return o.select(component, "importance", F.col("_o").alias("rank"),
                    F.sum("importance").over(w).alias("cumulative_importance"))


def variant_metric_matrix(facts: DataFrame, variant: str, metric: str, score: str, metrics: list[str]) -> DataFrame:
    """HS22: variants × metrics (pivot with the metric list given, so no extra distinct job)."""
    return facts.groupBy(variant).pivot(metric, metrics).agg(F.avg(score))


def benchmark_summary(df: DataFrame, group: str, score: str, seq: str, threshold: float = 0.85) -> DataFrame:
    """HS23: per group mean, median, sample std, range, best, worst, count ≥ threshold and a rank
    (mean desc, then group) from the distributed ordinal."""
    g = df.groupBy(group).agg(F.avg(score).alias("mean"),
                              F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"),
                              (F.max(score) - F.min(score)).alias("range"), F.max(score).alias("best"),
                              F.min(score).alias("worst"), F.count_if(F.col(score) >= threshold).alias("n_above"),
                              F.count("*").alias("n")).join(exact_percentiles(df, [group], score, {"median": 0.5}), group)
    return with_ordinal(g, [F.col("mean").desc(), F.col(group)], "rank")


def strategy_benchmark(df: DataFrame, strategy: str, score: str, success: str, time: str) -> DataFrame:
    """HS24: success rate, mean, population variance, mean time per strategy, and advice flags."""
    g = df.groupBy(strategy).agg(F.avg(F.col(success).cast("double")).alias("success_rate"),
                                 F.avg(score).alias("mean_quality"), F.var_pop(score).alias("quality_variance"),
                                 F.avg(time).alias("time_per_variant"), F.count("*").alias("n"))
    return g.withColumn("low_success", F.col("success_rate") < 0.8).withColumn("high_variance", F.col("quality_variance") > 0.1) \
        .withColumn("efficiency", F.col("mean_quality") * F.col("success_rate"))


def latest_per_key(df: DataFrame, key: str, ts: str, n: int = 10, tiebreak: str | None = None) -> DataFrame:
    """HS25: newest n rows per key (row_number ≤ n is planned with a partial WindowGroupLimit)."""
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
