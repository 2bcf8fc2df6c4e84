"""Event-time streams, day tables, fronts of many objectives, frames with halos, pairwise means, checksums."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import history as H
from evalspark.operators import log_tables as LT
from evalspark.operators import pair_metrics as pm
from evalspark.operators import quality as Q
from evalspark.operators import similarity as SIM
from evalspark.operators.logs import admissions
from evalspark.plans import q_streaming
from evalspark.plans.registry import all_queries
from evalspark.sources import day_table
from evalspark.streaming import jobs as J

from .conftest import SF001

T0 = dt.datetime(2024, 1, 1)


def land(spark, rows, schema, path):
    return lambda: spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


# ------------------------------------------------------------------ streams
def test_every_response_is_in_one_output(spark):
    kinds = {r.kind: r.n for r in all_queries()["st2_orphan_responses"](spark, SF001).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"matched", "unanswered", "orphan", "late"}


@pytest.mark.parametrize("name,zone", [("st2_orphan_responses", "ck2w"), ("st2_correlate_stream", "ck2")])
def test_join_state_follows_cores_not_shuffle_partitions(spark, tmp_path, monkeypatch, name, zone):
    """Each state partition opens and commits four stores in every micro-batch, so there are no more of them than the
    cores need, and the rows and the session's setting stay what they were."""
    ts = {k: T0 + dt.timedelta(hours=3 * k, minutes=7) for k in range(0, 240)}
    spark.createDataFrame([(k, t, 1, "view", 1.0, "{}") for k, t in ts.items()],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    zones = {}
    monkeypatch.setattr(q_streaming, "_zone", lambda spark, n: zones.setdefault(n, str(tmp_path / n)))
    monkeypatch.setattr(J, "JOIN_PARTITIONS", 2, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = sorted(map(tuple, all_queries()[name](spark, str(tmp_path)).collect()))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [p for p in (tmp_path / zone / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(parts) == 2 * spark.sparkContext.defaultParallelism < 9
    asked, replied = {k for k in ts if k % 10 != 3}, {k for k in ts if k % 7}
    if name == "st2_correlate_stream":
        want = [(k, k in replied and k % 9 != 0) for k in asked if ts[k] < ts[239] - dt.timedelta(hours=3)]
    else:
        late = {k for k in replied if k % 23 == 5 and ts[k].hour < 10}
        matched = {k for k in (replied & asked) - late if k % 11 != 4}
        kinds = [*((k, "late" if k in late else "matched" if k in matched else "orphan") for k in replied), *((k, "unanswered") for k in asked - matched)]
        want = [x for x in kinds if ts[x[0]] < ts[239] - dt.timedelta(hours=6)]
    assert got == sorted(want)


def test_limiter_equals_the_batch_fold_and_forgets(spark, tmp_path):
    """Out-of-order rows over several micro-batches."""
    rng = random.Random(3)
    events = [(k, T0 + dt.timedelta(seconds=rng.randrange(0, 40_000)), k % 4) for k in range(400)]
    waves = [[], [], [], []]
    for e in events:
        k = int((e[1] - T0).total_seconds() // 10_000)
        waves[min(3, k + (rng.random() < 0.3 and (e[1] - T0).total_seconds() % 10_000 > 8_000))].append(e)
    schema = "event_id long, ts timestamp_ntz, user_id long"
    path, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    waves = [sorted(w, key=lambda e: rng.random()) for w in waves] + [[(None, T0 + dt.timedelta(days=2), None)], [(None, T0 + dt.timedelta(days=9), None)]]

    def writer():
        s = J.rate_limit_stream(J.read_stream(spark, path, schema), 3, 900.0, "1 hour")
        return s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).queryName("limiter")

    J.run_in_waves([land(spark, w, schema, path) for w in waves], writer)
    got = {r.event_id: r.allowed for r in spark.read.parquet(sink).where("user_id is not null").collect()}
    want = {}
    for user in range(4):
        mine = sorted((e[1], e[0]) for e in events if e[2] == user)
        ok, _ = admissions([int((t - T0).total_seconds() * 1e6) for t, _ in mine], 3, 900_000_000)
        want |= {i: x for (_, i), x in zip(mine, ok)}
    assert got == want and not all(want.values())


def test_limiter_state_is_released():
    """The state function by itself: idle clients leave, waiting events keep a timeout."""
    import pandas as pd

    class State:
        def __init__(self):
            self.value, self.hasTimedOut, self.mark, self.timeout = None, False, 0, None
        exists = property(lambda s: s.value is not None)
        get = property(lambda s: s.value)

        def update(self, v):
            self.value = v

        def remove(self):
            self.value = None

        def getCurrentWatermarkMs(self):
            return self.mark

        def setTimeoutTimestamp(self, t):
            assert t > self.mark
            self.timeout = t

    fn, st = J._limiter(2, 10_000_000), State()
    assert list(fn((1,), [pd.DataFrame({"_t": [5_000_000, 1_000_000], "event_id": [2, 1]})], st)) == [] and st.timeout == 1000
    st.mark, st.hasTimedOut = 6000, True
    out = pd.concat(fn((1,), [], st))
    assert out.event_id.tolist() == [1, 2] and out.allowed.tolist() == [True, True] and st.value is not None
    st.mark = 16_000
    assert list(fn((1,), [], st)) == [] and st.value is None


def test_limiter_calls_follow_buckets_not_clients(spark, tmp_path):
    """More clients than buckets, unknown clients and ids: decisions are the batch fold's, and the state has a row
    per bucket at most."""
    rng = random.Random(9)
    n = J.LIMIT_BUCKETS * 2
    events = [(k, T0 + dt.timedelta(seconds=rng.randrange(0, 4_000)), (1 << 60) + k % n) for k in range(3 * n)]
    odd = [(None, T0 + dt.timedelta(seconds=9), 7), (-5, T0 + dt.timedelta(seconds=10), None)]
    schema, path, sink, ck = "event_id long, ts timestamp_ntz, user_id long", *(str(tmp_path / x) for x in ("in", "out", "ck"))
    seen = []

    def writer():
        s = J.rate_limit_stream(J.read_stream(spark, path, schema), 1, 1000.0, "5 hours")
        return s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).queryName("buckets")

    def run():
        w = writer().trigger(availableNow=True).start()
        assert w.awaitTermination(300) and w.exception() is None
        seen.append(max(p["stateOperators"][0]["numRowsTotal"] for p in w.recentProgress if p["stateOperators"]))

    for wave in (events + odd, [(None, T0 + dt.timedelta(days=2), None)], [(None, T0 + dt.timedelta(days=9), None)]):
        land(spark, wave, schema, path)()
        run()
    got = {(r.user_id, r.event_id): r.allowed for r in spark.read.parquet(sink).collect()}
    want = {}
    for user in {u for *_, u in events}:
        mine = sorted((t, k) for k, t, u in events if u == user)
        want |= {(user, k): x for (_, k), x in zip(mine, admissions([int((t - T0).total_seconds() * 1e6) for t, _ in mine], 1, 1_000_000_000)[0])}
    assert got.items() >= want.items() and not all(want.values()) and got[7, None] and got[None, -5]
    assert 0 < seen[0] <= J.LIMIT_BUCKETS + 1


# ------------------------------------------------------------------ day tables
def rows_at(spark, hours):
    return spark.createDataFrame([(k, T0 + dt.timedelta(hours=h)) for k, h in enumerate(hours)], "id long, timestamp timestamp_ntz")


def test_day_table_replay_and_retention(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = rows_at(spark, range(0, 96, 3)), rows_at(spark, range(1, 96, 3))
    day_table.write_batch(a, path, 0)
    for _ in range(3):
        day_table.write_batch(b, path, 1)
    assert spark.read.parquet(path).count() == 64
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "date=2024-01-04").rglob("*.parquet")}
    done = [tuple(r) for r in day_table.retain(spark, path, T0 + dt.timedelta(days=1, hours=9)).collect()]
    assert done == [(dt.date(2024, 1, 1), "dropped", 16, 0), (dt.date(2024, 1, 2), "rewritten", 16, 10)]
    left = spark.read.parquet(path)
    assert left.count() == 42 and left.agg(F.min("timestamp")).first()[0] == T0 + dt.timedelta(hours=33)
    assert untouched == {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "date=2024-01-04").rglob("*.parquet")}
    assert day_table.retain(spark, path, T0 + dt.timedelta(days=1, hours=9)).collect() == []  # repeated: nothing to do
    assert day_table.retain(spark, path, T0 + dt.timedelta(days=2)).count() == 1
    assert len(day_table.days(spark, path)) == 2 and day_table.days(spark, str(tmp_path / "none")) == []


def test_merged_metadata_replaces_entries(spark):
    d = spark.sql("SELECT map('a', '1', 'step', 'x') AS m UNION ALL SELECT CAST(NULL AS map<string,string>)")
    got = [r.m for r in d.select(LT.merged(F.col("m"), {"step": F.lit(7)}).alias("m")).collect()]
    assert got == [{"a": "1", "step": "7"}, {"step": "7"}]


# ------------------------------------------------------------------ fronts
@pytest.mark.parametrize("dims,top", [(1, 5), (3, 4), (3, 50), (5, 30)])
def test_skyline_equals_brute_force(spark, dims, top):
    rng = np.random.default_rng(dims * 100 + top)
    x = rng.integers(0, top, (400, dims)).astype(float)
    rows = [(k, *map(float, v)) for k, v in enumerate(x)] + [(1000, *[None] * dims), (1001, *[float("nan")] * dims)]
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    want = {k for k in range(400) if not ((x >= x[k]).all(1) & (x > x[k]).any(1)).any()}
    assert {r.id for r in SIM.skyline(df, cols).collect()} == want
    assert SIM.skyline(df.limit(0), cols).collect() == []


def test_third_objective_counts(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 9.0), (2, 2.0, 2.0, 1.0)], "id long, a double, b double, c double")
    assert SIM.multi_objective(df, "id", {"a": 1, "b": 1, "c": 1}).count() == 2


# ------------------------------------------------------------------ frames
def test_frames_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    rng = np.random.default_rng(1)
    v = rng.random(100).round(3)
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)] + [("t", 0, 1.0)], "s string, i long, v double")
    import pandas as pd
    got = H.centred_moving_average(df, "s", "i", "v").orderBy("i").toPandas()
    want = pd.Series(v).rolling(5, center=True).mean()
    assert np.allclose(got.moving_avg.astype(float), want, equal_nan=True) and len(got) == 100
    d = H.step_diff(df, "s", "i", "v").where("s = 's'").orderBy("i").toPandas()["diff"].astype(float)
    assert np.allclose(d, pd.Series(v).diff(), equal_nan=True)
    calm = pd.Series(v).rolling(5).max() - pd.Series(v).rolling(5).min()
    stop = {r.s: r.stop_step for r in H.early_stop_step(df, "s", "i", "v", 5, 0.3).collect()}
    assert stop == {"s": next((i for i, c in enumerate(calm) if c < 0.3), None), "t": None}
    rows, _ = H.with_halos(df, "s", "i", 4)
    assert rows.count() <= 101 + 4 * 6  # the input and the halos


# ------------------------------------------------------------------ pairwise means
def test_pairwise_mean_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(SIM, "PAIR_BLOCK", 3)
    rng = random.Random(5)
    rows = [(g, k, " ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 5)))) for g in ("x", "y", None) for k in range(20)] + [("one", 0, "a")]
    df = spark.createDataFrame(rows, "g string, k long, t string")
    got = {r.g: (r.n_items, r.n_pairs, round(r.sum_sim, 9)) for r in SIM.group_pair_similarity(df, "g", "k", "t", 1.0).collect()}
    for g in ("x", "y", None, "one"):
        sets = [set(t.split()) for h, _, t in rows if h == g]
        pairs = list(itertools.combinations(sets, 2))
        assert got[g] == (len(sets), len(pairs), round(sum(len(a & b) / len(a | b) if a | b else 1.0 for a, b in pairs), 9))


# ------------------------------------------------------------------ checksum, n-grams
def test_ordered_checksum(spark):
    rows = [(k, f"v{k}", None if k % 3 else "x") for k in range(60)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    base = Q.ordered_checksum(df, ["k"], fan=4).first()
    assert Q.ordered_checksum(df.repartition(7), ["k"], fan=4).first() == base and base.n == 60
    swapped = df.withColumn("a", F.when(F.col("k") == 3, "v4").when(F.col("k") == 4, "v3").otherwise(F.col("a")))
    moved = spark.createDataFrame([(0, "a|b", "c")], "k long, a string, b string"), spark.createDataFrame([(0, "a", "b|c")], "k long, a string, b string")
    assert Q.ordered_checksum(swapped, ["k"], fan=4).first().checksum != base.checksum
    assert len({Q.ordered_checksum(d, ["k"]).first().checksum for d in moved}) == 2
    assert len({Q.checksum(d).first().checksum_xor for d in moved}) == 2
    assert Q.ordered_checksum(df.limit(0), ["k"]).first().n == 0


def test_ngram_counts_equal_counters(spark, monkeypatch):
    from collections import Counter
    monkeypatch.setattr(pm, "NGRAM_TOKENS", 40)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["a", "b", "C", "dd"]) for _ in range(rng.randrange(0, 14)))
    rows = [(k, text(), text()) for k in range(60)] + [(60, "A  b", "a b"), (61, None, "x"), (62, "", None)]
    df = spark.createDataFrame(rows, "k long, pred string, ref string")
    for r in pm.ngram_match_counts(df, "k", max_n=5).collect():
        p, q = ((x or "").lower().split() for x in rows[r.k][1:])
        assert (r.lp, r.lr, r.same) == (len(p), len(q), p == q)
        assert (r.dp, r.dr, r.db) == (len(set(p)), len(set(q)), len(set(p) & set(q)))
        for n in range(1, 6):
            a, b = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (p, q))
            assert r[f"m{n}"] == sum((a & b).values())


# ------------------------------------------------------------------ sources
def test_json_documents_are_bounded_and_csv_is_split(spark, tmp_path):
    """Every record comes back from documents of few characters; a CSV file is read by several tasks
    unless its fields hold line breaks."""
    from evalspark.sources import io as IO
    rows = [(i, f"text {i}, \"quoted\"") for i in range(500)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(2)
    path = IO.write_json_array(df, str(tmp_path / "docs"), most_chars=2_000)
    files = list((tmp_path / "docs").glob("part-*"))
    assert len(files) > 5 and max(f.stat().st_size for f in files) < 2_200
    assert sorted((r.k, r.t) for r in IO.load_json(spark, path, "k long, t string").collect()) == rows
    one = IO.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        split, whole = IO.load_csv(spark, one, "k long, t string"), IO.load_csv(spark, one, "k long, t string", multi_line=True)
        assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.k, r.t) for r in split.collect()) == rows
    broken = IO.write_csv(spark.createDataFrame([(1, "two\nlines")], "k long, t string"), str(tmp_path / "broken"))
    assert [(r.k, r.t) for r in IO.load_csv(spark, broken, "k long, t string", multi_line=True).collect()] == [(1, "two\nlines")]


def test_dual_write_shuffles_the_record_and_makes_both_forms_after(spark, tmp_path, monkeypatch):
    seen = []
    made = LT.request_rows
    monkeypatch.setitem(LT.ROWS, "llm_requests", lambda df: seen.append(df._jdf.queryExecution().analyzed().toString()) or made(df))
    rows = [(T0 + dt.timedelta(hours=7 * k), f"s{k}", "p" * k, "m", None if k == 2 else "r", {"tokens_used": str(k), "cost": "0.5"}, 1.0) for k in range(9)] + [(None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, session_id string, prompt string, model string, response string, metrics map<string,string>, duration_ms double")
    for _ in range(2):
        LT.dual_write(df, "llm_requests", str(tmp_path), 3)
    assert all("RebalancePartitions" in plan for plan in seen) and len(seen) == 2
    stored = spark.read.parquet(f"{tmp_path}/llm_requests")
    want = made(df).select(F.to_json("typed").alias("t"), F.to_json("log").alias("l"))
    assert sorted(map(str, stored.select(F.to_json("typed").alias("t"), F.to_json("log").alias("l")).collect())) == sorted(map(str, want.collect()))
    assert {r.date for r in stored.select("date").distinct().collect()} == {None, *((T0 + dt.timedelta(hours=7 * k)).date() for k in range(9))}
