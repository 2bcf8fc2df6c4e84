"""Properties and brute-force comparisons on small fixtures."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.operators import history as H
from evalspark.operators import logs as L
from evalspark.operators import ordinal as O
from evalspark.operators import pair_metrics as pm
from evalspark.operators import sampling as SM
from evalspark.operators import similarity as SIM
from evalspark.sources import bindings as B
from evalspark.sources.tables import table

from .conftest import SF001


def _lcs_dp(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=30), st.lists(st.sampled_from("abcde"), max_size=30))
def test_bit_parallel_lcs(a, b):
    assert pm.lcs_length(a, b) == _lcs_dp(a, b)


def _bleu_py(p, r):
    pt, rt = p.lower().split(), r.lower().split()
    if not pt:
        return 0.0
    import math
    precs = []
    for n in range(1, 5):
        pg = Counter(" ".join(pt[i:i + n]) for i in range(len(pt) - n + 1))
        rg = Counter(" ".join(rt[i:i + n]) for i in range(len(rt) - n + 1))
        if not pg:
            precs.append(0.0)
            continue
        m = sum(min(c, rg.get(g, 0)) for g, c in pg.items())
        precs.append(m / len(pt) if len(pt) >= n else 0.0)
    if all(x > 0 for x in precs):
        return math.exp(sum(math.log(x) for x in precs) / 4) * min(1.0, math.exp(1 - len(rt) / len(pt)))
    return 0.0


def test_bleu_matches_python(spark):
    ep = B.eval_pairs(spark, SF001)
    got = {r["pair_id"]: r["bleu"] for r in pm.ngram_scores(ep, "pair_id").collect()}
    for r in ep.collect():
        assert got[r["pair_id"]] == pytest.approx(_bleu_py(r["pred"], r["ref"]), abs=1e-9)


def test_ordinal_equals_row_number(spark):
    li = table(spark, SF001, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = O.with_ordinal(li, ["l_partkey", "l_orderkey", "l_linenumber"], "o", num_partitions=4)
    b = li.withColumn("o", F.row_number().over(Window.orderBy("l_partkey", "l_orderkey", "l_linenumber")) - 1)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_group_rank_and_prefix_max(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 4), i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    got = {(r["g"], r["i"]): r["rank"] for r in O.with_group_rank(df, ["g"], ["v", "i"], "rank").collect()}
    for g in range(5):
        ordered = sorted((v, i) for gg, i, v in rows if gg == g)
        assert all(got[(g, i)] == k for k, (v, i) in enumerate(ordered))
    pm_ = {r["i"]: r["pm"] for r in O.with_prefix_max(df, ["i"], "v", "pm").collect()}
    best = None
    for g, i, v in sorted(rows, key=lambda x: x[1]):
        assert pm_[i] == best
        best = v if best is None else max(best, v)


def test_samplers(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "lang")
    n = docs.count()
    assert SM.random_sample(docs, 25, "doc_id").count() == 25
    split = SM.train_test_split(docs, "doc_id", 0.8)
    c = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert c["train"] == int(n * 0.8) and c["train"] + c["test"] == n
    assert split.select("doc_id").distinct().count() == n
    strat = SM.stratified_sample(docs, 50, "lang", "doc_id")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    got = {r["lang"]: r["count"] for r in strat.groupBy("lang").count().collect()}
    for lang, size in sizes.items():
        assert got[lang] == min(size, max(1, int(50 * size / n)))
    # Samples do not depend on the partitioning of the input.
    a = {r["doc_id"] for r in SM.random_sample(docs.repartition(7), 25, "doc_id").collect()}
    b = {r["doc_id"] for r in SM.random_sample(docs.coalesce(1), 25, "doc_id").collect()}
    assert a == b


def _jac(a, b):
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return len(a & b) / len(a | b)


def test_similarity_join_and_near_dedup_brute_force(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    rows = sorted((r["doc_id"], set(r["text"].lower().split())) for r in docs.collect())
    sets = SIM.token_sets(docs, "doc_id", "text")
    reps, _ = SIM.collapse_identical_sets(sets, "doc_id")
    edges = {(r["a"], r["b"]) for r in SIM.similarity_join(reps, "doc_id", 0.5).collect()}
    rep_ids = {r["doc_id"] for r in reps.collect()}
    rs = [(i, s) for i, s in rows if i in rep_ids]
    brute = {(i, j) for x, (i, a) in enumerate(rs) for (j, b) in rs[x + 1:] if _jac(a, b) > 0.5}
    assert edges == brute
    kept = {r["doc_id"] for r in SIM.near_dedup(docs, "doc_id", "text", 0.8).where("kept").collect()}
    greedy = []
    for i, s in rows:
        if all(_jac(s, t) <= 0.8 for _, t in greedy):
            greedy.append((i, s))
    assert kept == {i for i, _ in greedy}


def test_pareto_front_brute_force(spark):
    part = table(spark, SF001, "part").select("p_partkey", "p_size", "p_retailprice")
    pts = [(r[0], r[1], r[2]) for r in part.collect()]
    brute = {k for k, x, y in pts if not any(x2 >= x and y2 >= y and (x2 > x or y2 > y) for _, x2, y2 in pts)}
    got = {r["p_partkey"] for r in SIM.pareto_front(part, "p_size", "p_retailprice").collect()}
    assert got == brute


def test_rate_limiter_fold(spark):
    ev = table(spark, SF001, "events")
    got = {r["event_id"]: r["allowed"] for r in L.rate_limit(ev, "user_id", "ts", "event_id", 3, 3600.0).collect()}
    by_user = {}
    for r in sorted(ev.collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        acc = by_user.setdefault(r["user_id"], [])
        t = r["ts"].timestamp()
        acc[:] = [a for a in acc if a > t - 3600.0]
        ok = len(acc) < 3
        if ok:
            acc.append(t)
        assert got[r["event_id"]] == ok


def test_t_distribution_tail():
    import numpy as np
    p = H._t_sf(np.array([2.228138851986, 0.0, 1.96]), np.array([10.0, 5.0, 1e6]))
    assert p[0] == pytest.approx(0.05, abs=1e-6) and p[1] == pytest.approx(1.0) and p[2] == pytest.approx(0.05, abs=1e-4)


def test_repartition_invariance(spark):
    ep = B.eval_pairs(spark, SF001)
    a = pm.ngram_scores(ep.repartition(5), "pair_id")
    b = pm.ngram_scores(ep.coalesce(1), "pair_id")
    assert a.exceptAll(b).count() == 0


def test_moving_average_matches_pandas(spark):
    import pandas as pd
    rows = [(r, i, float((i * 7 + r) % 11)) for r in range(3) for i in range(6 + 4 * r)]
    df = spark.createDataFrame(rows, "run long, it long, v double")
    got = {(x["run"], x["it"]): x["moving_avg"] for x in H.centred_moving_average(df, "run", "it", "v").collect()}
    for r in range(3):
        s = pd.Series([v for rr, _, v in rows if rr == r])
        w = min(5, len(s) // 4)
        exp = s.rolling(window=w, center=True).mean()
        for i, e in enumerate(exp):
            g = got[(r, i)]
            assert (g is None and pd.isna(e)) or g == pytest.approx(e)


def test_noise_injection_invariants(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "a b c"), (3, "")],
                               "k long, t string")
    n = {(r["k"], r["level"]): r["noisy"] for r in SIM.inject_noise(df, "k", "t", [0.0, 0.3, 1.0]).collect()}
    assert n[(1, 0.0)] == "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    orig = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    changed = [a != b for a, b in zip(orig, n[(1, 0.3)].split())]
    assert len(n[(1, 0.3)].split()) == 10 and sum(changed) <= 3
    assert all(len(a) == len(b) for a, b in zip(orig, n[(1, 1.0)].split()))
    assert n[(2, 1.0)] == "a b c"  # one-letter words are never changed
    again = {(r["k"], r["level"]): r["noisy"] for r in SIM.inject_noise(df.repartition(3), "k", "t", [0.0, 0.3, 1.0]).collect()}
    assert again == n


def test_render_template(spark):
    from evalspark.operators import corpus as C
    df = spark.createDataFrame([(1, "Hi {{ name:string }}, rate {{item}}", {"name": "Ann", "extra": "x"})],
                               "k long, t string, v map<string,string>")
    r = df.select(C.render_template("t", "v").alias("r")).first()["r"]
    assert r == "Hi Ann, rate {{item}}"
    issues = {(x["variable"], x["severity"]) for x in C.template_variable_issues(df, "k", "t", "v").collect()}
    assert issues == {("item", "error"), ("extra", "warning")}


def test_similarity_join_splits_hot_tokens(spark):
    """Near copies of one text share all prefix tokens: any tile size gives the brute-force links, each once."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, sorted(set(words) - set(rng.sample(words, rng.randint(0, 5))) | {f"own{i % 40}"})) for i in range(90)]
    rows = [r for i, r in enumerate(rows) if r[1] not in [x[1] for x in rows[:i]]]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len({*x} & {*y}) / len({*x} | {*y}) > 0.8}
    sets = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, toks array<string>, n int")
    for tile in (4, 2048):
        got = [(r.a, r.b) for r in SIM.similarity_join(sets, "doc_id", 0.8, tile=tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_similarity_join_tests_pairs_inside_the_join(spark):
    """Position and signature are conditions of the join on prefix tokens, so pairs that fail them are never
    shuffled; links stay those of brute force, with empty, null and one-token sets and unknown keys."""
    rng = random.Random(5)
    rows = [(i, sorted({f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(1, 60))})) for i in range(150)]
    rows += [(200 + i, sorted({*rows[i][1], f"more{i}"})) for i in range(40)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and _jac({*x}, {*y}) > 0.7}
    odd = [(None, rows[0][1]), (400, []), (401, None)]
    sets = spark.createDataFrame([(k, t, len(t or [])) for k, t in rows + odd], "doc_id long, toks array<string>, n int")
    joined = SIM.similarity_join(sets, "doc_id", 0.7)
    got = [(r.a, r.b) for r in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join Inner" in x and "bit_count" in x and "least(" in x]


def test_lcs_makes_objects_of_few_pairs_at_once():
    """A batch of many pairs: equal to pairs one by one, and only some of the tokens are Python objects."""
    import tracemalloc

    import pyarrow as pa

    from evalspark.operators import pair_metrics as PM
    rng = random.Random(12)
    rows = [[f"{rng.randrange(50)}-{'x' * 40}" for _ in range(300)] for _ in range(3000)]
    a, b = pa.array([None, [], *rows]), pa.array([["x"], None, *rows[::-1]])
    tracemalloc.start()
    got = PM.lcs_udf.func(a, b).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:2] == [0, 0] and got[2:40] == [PM.lcs_length(x, y) for x, y in zip(rows[:38], rows[::-1])]
    assert peak < 25e6


def test_pair_tiles_leave_out_tokens_of_one_side():
    """Sums equal brute force for rare and frequent tokens, empty sets and multiplicities; a large vocabulary of
    tokens that no pair shares makes no matrix."""
    import tracemalloc
    rng = random.Random(21)
    x, y = ([[*{f"f{rng.randrange(12)}" for _ in range(rng.randint(0, 9))} | {f"r{rng.randrange(300)}" for _ in range(rng.randint(0, 5))}]
             for _ in range(n)] for n in (70, 90))
    mx, my = (np.array([rng.randint(1, 4) for _ in s], float) for s in (x, y))
    brute = lambda a, b: _jac(set(a), set(b)) if a or b else 0.5
    want = sum(brute(a, b) * m * n for a, m in zip(x, mx) for b, n in zip(y, my))
    assert abs(SIM._jaccard_sum(x, mx, y, my, 0.5, False) - want) < 1e-6
    own = sum(brute(x[i], x[j]) * mx[i] * mx[j] for i in range(len(x)) for j in range(i + 1, len(x)))
    assert abs(SIM._jaccard_sum(x, mx, x, mx, 0.5, True) - own) < 1e-6
    wide = [[f"own{i}-{k}" for k in range(40)] + ["all"] for i in range(400)]
    tracemalloc.start()
    got = SIM._jaccard_sum(wide[:200], np.ones(200), wide[200:], np.ones(200), 0.0, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(got - 200 * 200 / 81) < 1e-6 and peak < 10e6


def test_repeated_words_are_counted_in_the_row(spark):
    """Unique keys, repeated keys and keys without value: the same words as counting; with unique keys only
    repeated words are dealt out."""
    from evalspark.operators import corpus as C
    rng = random.Random(31)
    texts = [" ".join(rng.choice(["word", "Other", "and", "third", *[f"rare{i}" for i in range(30)]]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "lone", "same " * 10, " ".join(["tenth"] + [f"more{i}" for i in range(9)]), " ".join(["twice"] * 2 + [f"more{i}" for i in range(18)])]

    def brute(rows):
        sums = Counter()
        for k, t in rows:
            words = (t or "").lower().split()
            for x in words:
                if len(x) > 3:
                    sums[k, len(words), x] += 1
        return sorted((str(k), x) for (k, n, x), c in sums.items() if c > n * 0.1)

    for keys in (range(len(texts)), [i // 2 for i in range(len(texts))], [i if i % 9 else None for i in range(len(texts))]):
        rows = list(zip(keys, texts))
        issues = C.potential_issues(spark.createDataFrame(rows, "k long, t string"), "t", "k").where("rule = 'repetition'")
        got = sorted((str(r.k), r.message.split("'")[1]) for r in issues.collect())
        assert got == brute(rows) and got
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan


def test_table_profile_counts(spark):
    """Null, distinct and repeated-row counts of one pass against counting in Python; empty tables too."""
    from evalspark.operators import quality as Q
    rows = [(1, None, "a"), (None, 1, "a"), (1, None, "a"), (2, 2, None), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "x int, `y.z` int, s string")
    got = {r["column"]: (r.null_count, r.unique_count, r.n_rows) for r in Q.table_profile(df, rows=True).collect()}
    assert got == {"x": (3, 2, 6), "y.z": (4, 2, 6), "s": (3, 1, 6), None: (0, 4, 6)}
    assert Q.data_quality(df).where("rule = 'duplicates'").first().message == "Found 2 duplicate records"
    empty = {r["column"]: (r.null_count, r.unique_count, r.n_rows) for r in Q.table_profile(df.limit(0), rows=True).collect()}
    assert set(empty.values()) == {(0, 0, 0)} and set(empty) == set(got)
    assert "empty" in {r.rule for r in Q.validate_dataset(df.limit(0)).collect()}
    assert Q.table_profile(df, rows=True)._jdf.queryExecution().executedPlan().toString().count("Scan ") <= 2  # the rows, the column list
