"""TF-IDF cosine: counted in the row; listed and joined terms give the same sums."""

import math
import re
from collections import Counter

import pytest

from evalspark.operators import pair_metrics as pm

ROWS = [(1, "red fish blue fish", "blue fish"), (2, "", "red"), (3, "one two red", "Two ONE"), (4, None, "red fish"), (5, "the and", "the"), (6, "rare words", "rare words here"), (None, "red", "red")]


def _brute(rows):
    texts = [Counter(re.findall(r"\w{2,}", (t or "").lower())) for _, p, r in rows for t in (p, r)]
    df = Counter(w for t in texts for w in t)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for i, (k, _, _) in enumerate(rows):
        p, r = ({w: n * idf[w] for w, n in t.items()} for t in texts[2 * i:2 * i + 2])
        norms = math.sqrt(sum(x * x for x in p.values())) * math.sqrt(sum(x * x for x in r.values()))
        out.append((k, 0.0 if k is None or not norms else sum(x * r.get(w, 0) for w, x in p.items()) / norms))
    return out


@pytest.mark.parametrize("listed", [1 << 20, 2, 0])
def test_tfidf_against_brute_force(spark, listed):
    df = spark.createDataFrame(ROWS, "k int, pred string, ref string")
    got = {r.k: r.tfidf_similarity for r in pm.tfidf_cosine(df, "k", stop_words=(), listed_terms=listed).collect()}
    assert got == pytest.approx(dict(_brute(ROWS)))


def test_listed_terms_are_not_shuffled(spark):
    df = spark.createDataFrame(ROWS, "k int, pred string, ref string")
    assert "Exchange" not in pm.tfidf_cosine(df, "k")._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_key_are_one_pair(spark):
    df = spark.createDataFrame([(1, "red fish", "x"), (1, "blue", "fish here"), (2, "fish", "fish")], "k int, pred string, ref string")
    got = sorted((r.k, round(r.tfidf_similarity, 6)) for r in pm.tfidf_cosine(df, "k").collect())
    assert len(got) == 3 and got[0] == got[1] and 0 < got[0][1] < 1 and got[2] == (2, 1.0)
