"""Runs of words against brute force, and the digests of the registered query."""

import hashlib
import re
import zlib

import numpy as np

from evalspark.llm import periodic_runs
from evalspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, w int, h int, n_words int"


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x + q < len(w):
            y = x
            while y + q < len(w) and w[y] == w[y + q]:
                y += 1
            if y > x and y + q - x >= max(least, 2 * q):
                found.setdefault((x, y + q), q)
            x = max(y, x + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        docs = []
        for _ in range(int(rng.integers(0, 7))):
            n, kind = int(rng.integers(0, 110)), int(rng.integers(0, 3))
            d = rng.integers(0, [1, 2, 3, 30][int(rng.integers(0, 4))], n)
            if kind == 0 and n > 3:
                a = int(rng.integers(0, n))
                p = 1 + int(rng.integers(0, n - a)) // 3
                d = np.array([d[i] if i < a else d[a + (i - a) % p] for i in range(n)])
            docs.append(d)
        least = int(rng.choice([12, 6, 5, 2]))
        for d, r in zip(docs, periodic_runs.runs_of(docs, least)):
            assert [tuple(x) for x in r.tolist()] == brute_runs(d.tolist(), least)


def test_grammar_answers_extensions():
    rng = np.random.default_rng(2)
    for top in (1, 2, 5):
        w = rng.integers(0, top, 300)
        g = periodic_runs.Grammar(w)
        i = rng.integers(0, 300, 500)
        j = np.minimum(i + rng.integers(1, 50, 500), 300)
        i = np.minimum(i, j - 1)
        want = [next((k for k in range(300 - b) if w[a + k] != w[b + k]), 300 - b) for a, b in zip(i, j)]
        assert g.common(i, j).tolist() == want


def test_long_periodic_texts():
    """A word repeated 100,000 times, a long period, and a Fibonacci word (runs within runs)."""
    assert periodic_runs.runs_of([np.zeros(100_000, int)])[0].tolist() == [[0, 100_000, 1]]
    assert periodic_runs.runs_of([np.arange(60_000) % 7_000])[0].tolist() == [[0, 60_000, 7_000]]
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert [tuple(x) for x in periodic_runs.runs_of([np.array(b)])[0].tolist()] == brute_runs(b)


def test_edge_rows(spark):
    texts = [None, "", " \t\n", "one", "ab " * 12, "ab " * 11, "x y " * 6 + "z", "a b " * 14, "e " * 20 + "f g " * 9, "wort " * 3000]
    rows = [(k, t, "r", 1, 2, 3) for k, t in enumerate(texts)] + [(5, texts[4], "r", 1, 2, 3), (None, texts[6], "r", 1, 2, 3)]
    out = periodic_runs.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    want = []
    for k, t, *_ in rows:
        w = words_of(t)
        r = brute_runs(w)
        want.append((-1 if k is None else k, len(w), r, brute_collapsed(w, r)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out) == sorted(want)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op12_equals_brute_force(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(raw)
    seen = 0
    for d in raw:
        w = planted(d.doc_id, words_of(d.text))
        r = got[d.doc_id]
        digest = hashlib.sha256
        if len(w) <= 400:
            runs = brute_runs(w)
        else:  # brute force is quadratic; long texts are compared through the tested function
            names = {x: k for k, x in enumerate(dict.fromkeys(w))}
            runs = [tuple(x) for x in periodic_runs.runs_of([np.array([names[x] for x in w])])[0].tolist()]
        seen += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == digest(brute_collapsed(w, runs).encode()).hexdigest()
    assert seen > 5
