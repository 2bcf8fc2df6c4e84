"""Character ratios against difflib, and the operators that use them."""

import difflib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions import char_ratio as C
from evalspark.operators import similarity as SIM


def _texts():
    return st.one_of(st.text(alphabet="ab c", max_size=40), st.text(alphabet=" etaoinshrdluzq", min_size=190, max_size=420),
                     st.text(max_size=30))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(_texts(), _texts(), st.integers(0, 400), st.integers(0, 60)), max_size=6))
def test_ratios_equal_difflib(rows):
    a = [x for x, _, _, _ in rows] * 2
    # Unrelated texts, and texts with a part cut out and another put in.
    b = [y for _, y, _, _ in rows] + [x[:at] + y[:5] + x[at + n:] for x, y, at, n in rows]
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    for chars, places in ((1 << 20, 1 << 22), (300, 500), (1, 1)):
        assert C.char_ratios(a, b, chars, places).tolist() == want


def test_difflib_takes_no_pair_of_few_places(monkeypatch):
    asked = []
    monkeypatch.setattr(C, "one_ratio", lambda a, b: asked.append((a, b)) or 0.5)
    rng = np.random.default_rng(3)
    a, b = ["".join(rng.choice(list("abcdefgh zqxj" + "e" * 30), 3000)) for _ in range(2)]
    C.char_ratios([a] * 3, [b, a + "x", b[:40]])
    assert asked == []


def _pick(rows, k, w):
    """Brute force: (key, rank) of one group."""
    sim = lambda x, y: difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio()
    chosen = [max(rows, key=lambda r: (r[2], -r[0]))]
    while len(chosen) < min(k, len(rows)):
        rest = [r for r in rows if r not in chosen]
        chosen.append(max(rest, key=lambda r: ((1 - w) * r[2] + w * (1 - min(sim(r[1], c[1]) for c in chosen)), -r[0])))
    return {r[0]: n for n, r in enumerate(chosen)}


def _documents(n):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "Gamma", "delta", "zeta", "query", "x"]
    return [(i, " ".join(rng.choice(words, rng.integers(1, 60))), float(rng.integers(0, 20)) / 20) for i in range(n)]


def test_diversity_pick_equals_brute_force_and_reads_each_text_once_a_round(spark, monkeypatch):
    docs = _documents(40)
    df = spark.createDataFrame([(("g", "h")[i % 2], i, t, q) for i, t, q in docs], "g string, k long, t string, q double")
    for groups in (SIM.PICK_GROUPS, 0):  # picks broadcast, and joined
        monkeypatch.setattr(SIM, "PICK_GROUPS", groups)
        got = {(r.g, r.k): r["rank"] for r in SIM.diversity_pick(df, "g", "k", "t", "q", 5, 0.3).collect()}
        want = {(g, key): n for p, g in enumerate("gh") for key, n in _pick([d for d in docs if d[0] % 2 == p], 5, 0.3).items()}
        assert got == want


def test_diversity_pick_compares_texts_that_can_be_chosen(spark, monkeypatch):
    """Low qualities are never compared, odd ones have no score, and picks stay those of brute force."""
    docs = [(i, t, round((i * 37 % 400) / 400, 4)) for i, t, _ in _documents(400)]
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return pd.Series(C.char_ratios(a.tolist(), b.tolist()))

    monkeypatch.setattr(SIM, "char_ratio_udf", counted)
    df = spark.createDataFrame([("g", *d) for d in docs], "g string, k long, t string, q double")
    got = {r.k: r["rank"] for r in SIM.diversity_pick(df, "g", "k", "t", "q", 5, 0.3).collect()}
    assert got == _pick(docs, 5, 0.3)
    assert asked.value < 900  # each text with each of four picks: 1,596
    for w in (1.0, -0.5):
        assert {r.k: r["rank"] for r in SIM.diversity_pick(df, "g", "k", "t", "q", 2, w).collect()} == _pick(docs, 2, w)
    odd = spark.createDataFrame([("h", 1, "a b", None), ("h", 2, "c d", 0.5), ("h", 3, "e", None), ("h", 2, "c d", 0.5), (None, 4, "x", 1.0)], df.schema)
    # The rows of a repeated key double a group's rows, and each later round squares that.
    assert sorted((r.k, r["rank"]) for r in SIM.diversity_pick(odd, "g", "k", "t", "q", 3, 0.3).collect()) == 4 * [(1, 1)] + 8 * [(2, 0)] + 4 * [(3, 2)]


def test_pairs_are_spread_before_costly_work(spark):
    one = spark.range(100).coalesce(1)
    assert SIM.spread_pairs(one).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_combined_similarity_of_null_and_empty_texts(spark):
    rows = [("a b c", "a b c"), ("abc", None), ("", "abc"), ("The quick fox", "the quick Fox!")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.s for r in df.select(SIM.combined_similarity("a", "b").alias("s")).collect()]
    ratio = difflib.SequenceMatcher(None, *rows[3]).ratio()
    assert got[:3] == [1.0, 0.0, 0.0]
    assert got[3] == pytest.approx(0.3 * ratio + 0.5 * 2 / 4 + 0.2 * (1 - 1 / 14), abs=1e-3)
    assert df.select(SIM.char_similarity("a", F.lit(None).cast("string")).alias("s")).distinct().collect()[0].s == 0.0
