"""Near-duplicate vectors and whitening against brute force; the bidiagonal solver against LAPACK."""

import numpy as np
import pandas as pd
import pytest

from evalspark.llm import bidiagonal, embedding_dedup, whitening
from evalspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, key string, uid long, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "k", 1, 2) for i, v in rows], SCHEMA)


def brute_links(rows, cosine=0.95):
    """Per row: links and smallest id reachable, by all pairs."""
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None and len(v)
             and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sound:
        for b in sound:
            u, v = np.asarray(rows[a][1], float), np.asarray(rows[b][1], float)
            if a < b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i if i is not None else -1, links[k], -1 if i is None else least[find(k)]) for k, (i, _) in enumerate(rows))


def got_links(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_near_vectors_edge_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 8))
    rows = [(k, v) for k, v in enumerate(base)] + [(20 + k, v * (k + 1) + 0.03 * rng.standard_normal(8)) for k, v in enumerate(base[:6])]
    rows += [(40, base[0]), (40, base[0]), (40, base[1]), (None, base[2]), (50, None), (51, np.zeros(8)), (52, [np.nan] * 8),
             (53, [np.inf] + [0.0] * 7), (54, []), (55, [None] + [1.0] * 7), (56, [1e-300, 0, 0]), (57, [5.0, 0, 0]), (58, [1e300, 1e280, 0])]
    out = embedding_dedup.near_vectors(table(spark, rows))
    assert got_links(out) == brute_links([(i, None if v is None else v if i not in (56, 58) else [1.0, 0, 0]) for i, v in rows])
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out.collect())
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_near_vectors_empty_table(spark):
    assert embedding_dedup.near_vectors(table(spark, [])).collect() == []
    assert got_links(embedding_dedup.near_vectors(table(spark, [(1, None), (2, [])]))) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("noise,leaf", [(0.02, 32), (0.14, 64)])
def test_near_vectors_dense_group_and_small_leaves(spark, noise, leaf):
    """A third of all vectors in one group, pairs around the threshold, several rounds of splits."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 32))
    x[:500] = rng.standard_normal(32) + noise * rng.standard_normal((500, 32))
    b = x[500:800] / np.linalg.norm(x[500:800], axis=1)[:, None]
    o = rng.standard_normal((300, 32))
    o -= b * (o * b).sum(1)[:, None]
    c = rng.uniform(0.94, 0.97, 300)[:, None]
    x[800:1100] = b * c + o / np.linalg.norm(o, axis=1)[:, None] * np.sqrt(1 - c * c)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= 0.95).sum(1) - 1
    out = embedding_dedup.near_vectors(table(spark, list(enumerate(x))), leaf=leaf).toPandas().sort_values("vec_id")
    got = out.n_links.to_numpy()
    assert (got <= want).all()
    assert got.sum() >= 0.99 * want.sum()


def test_op11_equals_brute_force(spark):
    out = QUERIES["op11_embedding_dedup"](spark, SF)
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert got_links(out) == brute_links([(r.vec_id, r.embedding) for r in raw])


# ------------------------------------------------------------------ whitening
@pytest.mark.parametrize("name", ["plain", "graded", "rank", "equal", "clusters", "zero", "constant"])
def test_principal_directions(name):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((200, 40))
    q, p = np.linalg.qr(a)[0], np.linalg.qr(rng.standard_normal((40, 40)))[0]
    a = {"plain": a, "graded": a * np.logspace(0, -8, 40), "rank": a[:, :20] @ rng.standard_normal((20, 40)), "equal": q,
         "clusters": q * np.r_[np.full(15, 3.0), np.full(15, 2.0), np.ones(10)] @ p, "zero": a * 0, "constant": np.c_[a[:, :36], np.zeros((200, 4))]}[name]
    r = np.linalg.qr(a, mode="r")
    values, v = bidiagonal.principal_directions(r, 16)
    want = np.linalg.svd(r, compute_uv=False)
    top = max(want[0], 1.0)
    assert np.abs(values - want[:16]).max() < 1e-12 * top
    d, above, _ = bidiagonal.bidiagonalise(r)
    assert np.abs(bidiagonal.singular_values(d, above) - want).max() < 1e-12 * top
    assert np.abs(v.T @ v - np.eye(16)).max() < 1e-10
    assert np.abs(r.T @ (r @ v) - v * values ** 2).max() < 1e-11 * top ** 2


def check_whitened(df, rows, components=16):
    """Against numpy's eigenvectors; rows: (vec_id, vector) of one length."""
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-12 * max(e[0], 1e-300)).sum()))
    want = (x * n - s) / n @ q[:, :k] / np.sqrt(e[:k])
    got = df.toPandas()
    assert len(got) == len(rows) * k
    if not k:
        return
    got = got.sort_values(["vec_id", "component"], kind="stable")
    order = np.argsort([i for i, _ in rows], kind="stable")
    w = got.whitened.to_numpy().reshape(len(rows), -1)
    if len({i for i, _ in rows}) == len(rows):
        sign = np.sign((w * want[order]).sum(0))
        assert np.abs(w * sign - want[order]).max() < 1e-6
        assert got.deviation.tolist() == np.repeat(((x * n - s) ** 2).sum(1)[order], k).tolist()
    assert set(got.n) == {n} and got.identity_error.max() < 1e-4
    assert np.allclose(got.groupby("component").explained.first(), e[:k] / e.sum(), rtol=1e-6)


def test_whiten_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 20)) * np.linspace(3, 0.2, 20)
    rows = list(enumerate(np.vstack([x, x[:50]])))
    check_whitened(whitening.whiten(table(spark, rows)), rows)
    assert whitening.whiten(table(spark, rows)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whiten_edge_rows(spark):
    rng = np.random.default_rng(5)
    good = [(k, v) for k, v in enumerate(rng.standard_normal((30, 5)))]
    bad = [(100, None), (101, []), (102, [np.nan] * 5), (103, [None] * 5), (104, [np.inf] * 5)]
    check_whitened(whitening.whiten(table(spark, good + bad)), good)
    again = [*good, *good[:3]]
    check_whitened(whitening.whiten(table(spark, again)), again)
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, bad)).collect() == []
    assert whitening.whiten(table(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect() == []  # one distinct vector
    flat = [(k, [v, 2.0, 3.0]) for k, v in enumerate(rng.standard_normal(9))]  # rank one
    check_whitened(whitening.whiten(table(spark, flat)), flat)
    both = whitening.whiten(table(spark, good + [(200 + k, v) for k, v in flat]))
    check_whitened(both.where("vec_id < 200"), good)
    assert both.where("vec_id >= 200").count() == 9
    assert whitening.whiten(table(spark, [(None, [1.0, 5.0]), (7, [2.0, 1e300])])).count() == 2


def test_op13_equals_numpy(spark):
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitened(QUERIES["op13_embedding_whitening"](spark, SF), [(r.vec_id, r.embedding) for r in raw])


def test_triangles_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    rows = list(enumerate(rng.standard_normal((200, 6))))
    check_whitened(whitening.whiten(table(spark, rows).repartition(9)), rows)
