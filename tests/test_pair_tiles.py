"""Pairs of texts are compared in tiles: every pair once, a text once to each tile."""

import difflib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.operators import similarity as SIM
from evalspark.plans import q_similarity as Q


def test_a_row_goes_once_to_each_tile_of_its_pairs(spark):
    rows = spark.range(60).select(F.col("id").alias("k"), F.lit("x").alias("text"))
    pairs = rows.select(F.col("k").alias("a")).join(rows.select(F.col("k").alias("b")), F.col("a") < F.col("b"))

    def count(p, r):
        return pa.table({"pairs": [p.num_rows], "rows": [r.num_rows]})

    got = SIM.in_tiles(pairs, rows, "k", 1, count, "pairs long, rows long").agg(F.sum("pairs"), F.sum("rows")).first()
    assert got[0] == 60 * 59 // 2
    assert got[1] <= 60 * 8  # a pair a row would be 2 * 1,770


def test_char_ratio_pairs(spark):
    texts = {1: "the Cat sat", 2: "the cat sat on", 3: "", 4: None, 5: "a mat"}
    df = spark.createDataFrame([*texts.items(), (5, "another mat")], "k int, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (2, 5)], "a int, b int")
    got = sorted((r.a, r.b, r.ratio) for r in SIM.char_ratio_pairs(pairs, df, "k").collect())

    def ratio(x, y):
        return difflib.SequenceMatcher(None, y.lower(), x.lower()).ratio()

    want = sorted([(1, 2, ratio(texts[1], texts[2])), (1, 3, 0.0), (2, 4, 0.0), (2, 5, ratio(texts[2], "a mat")), (2, 5, ratio(texts[2], "another mat"))])
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_join_of_large_sets_without_rare_tokens(spark):
    """Sets of far more tokens than a signature has bits, whose pairs all share some prefix tokens."""
    import random
    rnd = random.Random(3)
    sets = {k: rnd.sample(range(3000), 1200) for k in range(30)}
    sets |= {100 + k: rnd.sample(sets[k], 1000) + rnd.sample(range(3000, 3400), 200) for k in range(10)}
    df = spark.createDataFrame([(k, [str(t) for t in v]) for k, v in sets.items()], "k long, toks array<string>").withColumn("n", F.size("toks"))
    got = {(r.a, r.b): r.jaccard for r in SIM.similarity_join(df, "k", 0.5, tile=16).collect()}
    want = {}
    for a in sets:
        for b in sets:
            common = len(set(sets[a]) & set(sets[b]))
            if a < b and common / (2400 - common) > 0.5:
                want[a, b] = common / (2400 - common)
    assert got == pytest.approx(want) and len(got) == 10


def test_copies_are_pairs_too(spark, monkeypatch):
    """Texts of one token set are pairs of Jaccard 1, and each copy has the pairs of its set; two texts are compared once."""
    texts = {1: "the cat sat on a mat", 2: "THE cat sat on a mat", 3: "mat a on sat cat the", 4: "the cat sat on a rug", 5: "the cat sat on a rug",
             6: "nothing like it", 7: "", 8: " ", 9: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(Q.B, "variants", lambda *_: df.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    rows = Q.si3(spark, "").collect()
    sets = {k: set(t.lower().split()) for k, t in texts.items() if t is not None}

    def alike(x, y):
        return x == y or len(x & y) / max(1, len(x | y)) > 0.5

    want = {(a, b): difflib.SequenceMatcher(None, texts[b].lower(), texts[a].lower()).ratio() for a in sets for b in sets if a < b and alike(sets[a], sets[b])}
    assert len(rows) == len(want) == 11
    assert {(r.a, r.b): r.char_ratio for r in rows} == pytest.approx(want, abs=1e-6)


def test_equal_tokens_have_one_hash():
    words = ["", "a", "b", "ab", "ba", "é", "x" * 200_000, "a" * 65_536, *(str(i) for i in range(50_000))]
    flat = pa.array(["zz", *words, *words[::-1]])[1:]
    for tokens in (flat, flat.cast(pa.large_string())):
        h = SIM._hash_tokens(tokens).tolist()
        assert h[:len(words)] == h[len(words):][::-1] and len(set(h)) == len(words)


def test_few_pairs_meet_that_cannot_reach_the_overlap():
    """A set's place of a token bounds the sizes it is compared with: here the rest of each set is too short for all."""
    import numpy as np
    n, held = np.arange(100, 300), np.zeros((200, SIM.COUNT_BUCKETS // 2), np.uint8)
    tried = []
    ceil = np.ceil
    tok = np.zeros(200, np.int64)
    try:
        SIM.np.ceil = lambda x: tried.append(np.size(x)) or ceil(x)
        SIM._met(n, held, np.arange(200), tok, (n // 2) * 4, 0.5)
    finally:
        SIM.np.ceil = ceil
    assert sum(tried) == 0


def test_high_thresholds_shuffle_one_narrow_row_a_prefix_token(spark):
    """No token array and no wide signature is shuffled: rows of a prefix token hold its key, place and 256 bits."""
    sets = spark.createDataFrame([(k, [f"w{i}" for i in range(k, k + 40)], 40) for k in range(30)], "k long, toks array<string>, n int")
    joined = SIM.similarity_join(sets, "k", 0.8)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan
    assert [x.count("bit_count") for x in plan.splitlines() if "Join Inner" in x and "bit_count" in x] == [4]
    got = {(r.a, r.b): r.jaccard for r in joined.collect()}
    want = {(a, b): (40 - b + a) / (40 + b - a) for a in range(30) for b in range(a + 1, 30) if (40 - b + a) / (40 + b - a) > 0.8}
    assert got == pytest.approx(want)


def test_collapsed_sets_shuffle_hashes_only(spark):
    """Copies leave without a shuffle of token arrays; null texts and repeated keys stay as they were."""
    rows = [(1, "a b"), (2, "b a"), (2, "b a"), (3, "c"), (4, None), (None, "c"), (5, "")]
    sets = SIM.token_sets(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    reps, members = SIM.collapse_identical_sets(sets, "k")
    plan = reps._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "toks" in x]
    assert sorted((r.k, sorted(r.toks or [])) for r in reps.collect()) == [(1, ["a", "b"]), (3, ["c"]), (4, []), (5, [])]
    assert sorted((r.k or 0, r.rep, r.copies) for r in members.collect()) == [(0, 3, 2), (1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 3, 2), (5, 5, 1)]
