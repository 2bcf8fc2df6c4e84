"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Every query is executed in full through the ``noop`` sink (no collect to the
driver).  One warm-up pass, then the median of $BENCH_REPEAT runs per query.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evalspark.plans.registry import all_queries  # noqa: E402
from evalspark.session import local_session  # noqa: E402

HEADLINE = [
    "pm_summary_by_lang",        # tokens, n-gram explode, BLEU/ROUGE, grouped means
    "pm7_tfidf_similarity",      # term frequencies, document frequencies, cosine
    "pm5_rouge_l",               # Arrow UDF (bit-parallel LCS)
    "ev4_latency_stats",         # case table + exact percentiles
    "ev9_pairwise_winner",       # roll-ups + control comparison
    "lg9_performance_by_model",  # order statistics on the distributed ordinal
    "lg13_analytics_bundle",     # one-pass log analytics
    "rg2_list_prompts",          # pre-aggregated children, left joins, paging
    "hs1_moving_average",        # skew-safe framed aggregation
    "hs11_trend",                # group rank + regression aggregates
    "sa2_stratified_sample",     # skew-safe quota sampling
    "tx3_complexity",            # whole-text corpus metrics
    "si4_similarity_join",       # prefix-filter set-similarity join
    "si12_pareto_front",         # distributed running max
    "cl5_fill_mode",             # one-pass statistics + broadcast one-row fill
]


# All-pairs or recursive SQL: minutes at sf0.1; these are compared at sf0.01 (tools/check_oracle.py).
SLOW_ORACLES = {"si4_similarity_join", "pm_summary_by_lang", "pm7_tfidf_similarity"}


def run(q, spark, sf):
    t0 = time.perf_counter()
    q(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def check_results(spark, qs, names, sf):
    """Untimed: row counts of each query, and the names whose rows differ from the SQL oracle's."""
    import duckdb

    from evalspark.plans.registry import all_oracles
    from evalspark.sources.tables import TABLES
    from tools.check_oracle import digest

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    oracles, rows, wrong = all_oracles(), {}, []
    for n in names:
        got = qs[n](spark, sf).toPandas()
        rows[n] = len(got)
        if n in oracles and n not in SLOW_ORACLES and digest(got, 6)[0] != digest(con.sql(oracles[n]).df(), 6)[0]:
            wrong.append(n)
    return rows, wrong


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    partitions = int(os.environ.get("BENCH_SHUFFLE", int(cpus) * 2))
    # The sf0.1 text files hold one row group each: spread them as a real table's many would be.
    spark = local_session(cpus, shuffle_partitions=partitions, app="evalspark-bench", extra={"evalspark.text.partitions": cpus})
    qs = all_queries()
    for n in names:  # warm-up pass (JIT, file listing, Python workers)
        run(qs[n], spark, sf)
    rows, wrong = check_results(spark, qs, names, sf) if os.environ.get("BENCH_CHECK", "1") == "1" else ({}, [])
    times = {}
    for n in names:
        times[n] = round(statistics.median(run(qs[n], spark, sf) for _ in range(repeat)), 3)
    sf_val = sf.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf_val) if sf_val.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "repeat": repeat, "spark": spark.version, "shuffle_partitions": partitions,
                      "rows": rows, "wrong": wrong}))
    spark.stop()


if __name__ == "__main__":
    main()
