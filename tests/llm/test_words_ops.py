"""Substring dedup, Jaccard join and exact dedup against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from evalspark.llm import exact_dedup, jaccard_join, substring_dedup
from evalspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def removed_brute(rows, length=20):
    docs = sorted((d, WORD.findall(t or "")) for d, t in rows)
    first = {}
    for d, w in docs:
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s:s + length]), (d, s))
    out = {}
    for d, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] != (d, s):
                gone[s:s + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def classes_brute(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def corpus():
    """Copies, near copies of two hot texts, shared passages, long and short texts, odd white space."""
    rnd = random.Random(4)
    words = [f"W{i}é" for i in range(400)] + ["\x85", "a\xa0b"]
    passages = [[rnd.choice(words) for _ in range(40)] for _ in range(3)]
    rows = {}
    for g in range(20):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 120))] + (rnd.choice(passages) if g % 3 == 0 else [])
        for c in range(rnd.choice([1, 2, 3, 40 if g < 2 else 4])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            if rnd.random() < 0.2:
                w = w[:int(len(w) * rnd.uniform(0.7, 1))]
            text = rnd.choice([" ", "\n", "\t \x0b"]).join(w)
            rows[rnd.randint(10, 10**12)] = text.swapcase() if c % 2 else text
    rows |= {1: None, 2: "", 3: " \t", 4: "one two", 5: "One two", 6: "q " * 3000, 7: "q " * 500, -8: "One  two"}
    rows[8] = " ".join(rnd.choice(words) for _ in range(30_000))
    return list(rows.items())


def test_remove_repeats(spark, clash):
    rows = corpus()
    df = clash(spark.createDataFrame(rows, DOC).repartition(5))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats_digest(df).collect()}
    assert got == removed_brute(rows)
    assert sum(v[1] for v in got.values()) > 1000


def test_remove_repeats_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (1, None), (2, text), (2, text), (3, text)], DOC)
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()))
    assert got == [(0, 40, 0), (1, 0, 0), (2, 40, 0), (2, 40, 0), (3, 40, 40)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOC)).collect() == []


def test_remove_repeats_texts_under_one_id(spark):
    """Different texts under one id stand at one place; each counts for larger ids."""
    p, q = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    df = spark.createDataFrame([(5, p), (5, q), (9, q), (7, p + " " + q), (5, q), (6, "x " + q), (5, p + " " + p)], DOC)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(5, 40, 0), (5, 40, 0), (5, 40, 0), (5, 80, 40), (6, 41, 40), (7, 80, 80), (9, 40, 40)]


def test_difference_cover():
    p, c = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


def test_near_copies(spark, clash):
    rows = corpus()
    df = clash(spark.createDataFrame(rows, DOC).repartition(4))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(df).collect()}
    assert got == classes_brute(rows)


def test_near_copies_trees_alone(spark):
    """Without the early contraction the trees find every link."""
    rows = [r for r in corpus() if r[0] != 8]
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.near_copies(spark.createDataFrame(rows, DOC), pivots=0).collect()}
    assert got == classes_brute(rows)


def test_near_copies_edges(spark):
    df = spark.createDataFrame([(None, "x y"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None)], DOC)
    got = sorted(tuple(r) for r in jaccard_join.near_copies(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert jaccard_join.near_copies(spark.createDataFrame([], DOC)).collect() == []
    kept = jaccard_join.keep_one(df).orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == [None, 1, 1, 3]


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.range(n - 1).selectExpr(f"pmod(id * 7, {n}) a", f"pmod((id + 1) * 7, {n}) b")
    got = components(edges).agg(F.count("*"), F.max("component")).first()
    assert tuple(got) == (n, 0)


def copies_brute(rows):
    groups = {}
    for d, t in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d is None, d or 0, d))
    return {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}


def test_find_copies(spark, clash, tmp_path):
    rnd = random.Random(2)
    rows = [(i if i % 17 else None, None if i % 50 == 0 else "".join(rnd.choice("ab cé\n\t\xa0") for _ in range(rnd.randint(0, 5))))
            for i in range(200)] + [(7, "abc"), (7, "abc"), (500, "x" * 200_000), (501, " " + "x" * 200_000)]
    path = str(tmp_path / "docs")
    clash(spark.createDataFrame(rows, DOC).repartition(6)).write.parquet(path)
    df = spark.read.parquet(path)
    want = copies_brute(rows)
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)  # noqa: E731  16 digests: the full texts must decide
    for digest, trigger in ((None, 1 << 28), (None, 2000), (weak, 1 << 28)):
        got = exact_dedup.find_copies(df, digest, trigger).collect()
        assert len(got) == len(rows)
        assert all(want[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
        kept = {}
        for r in got:
            kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert set(kept.values()) == {1}
    assert exact_dedup.find_copies(spark.createDataFrame([], DOC)).collect() == []


def test_find_copies_when_every_hash_collides(spark, monkeypatch):
    """With one digest and one SHA-256 for all texts, their bytes still tell them apart."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    rows = [(1, "a b"), (2, "ab "), (3, "b"), (4, "c"), (5, "b\n"), (None, "c")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {(1, 1, 2, True), (2, 1, 2, False), (3, 5, 2, False), (5, 5, 2, True), (4, 4, 2, True), (None, 4, 2, False)}


def test_keep_one_with_clashing_names(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words"), (None, "x")]
    df = spark.createDataFrame(rows, DOC).select("*", *[F.lit(1).alias(c) for c in ("_kept", "_sha", "_gone", "text_sha256", "_own")])
    for keep in (exact_dedup.keep_one, jaccard_join.keep_one):
        out = keep(df)
        assert out.columns == df.columns
        assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3]


def test_only_results_stay_in_the_shared_folder(spark, tmp_path, monkeypatch):
    """near_copies, components and exact_dedup.keep_one leave one written table each; the tables on the way go."""
    from evalspark.llm import common
    monkeypatch.setattr(common, "scratch_path", lambda _, name: str(tmp_path / name))
    rows = [(i, " ".join(f"w{j}" for j in range(i % 3, 40 + i % 3))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.near_copies(docs).collect()} == {0}
    assert [p.name.split("-")[:2] for p in tmp_path.iterdir()] == [["near", "copies"]]
    ends = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    assert {(r.id, r.component) for r in components(ends).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()) == [0, 1, 2]
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["components", "dedup", "near"]


def test_words_are_hashed_in_bounded_runs():
    """Hashing works on runs of words: its arrays do not follow the slice, and hashes do not follow the runs."""
    import tracemalloc

    import pyarrow as pa

    from evalspark.llm import words
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcÄx") for _ in range(rng.randint(1, 12))) for _ in range(40_000)) for _ in range(8)]
    (_, _, all_at_once), = words.slices(pa.array(texts), 100_000_000)
    tracemalloc.start()
    got = all_at_once.hashes(3, lower=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = [h for t in texts for h in next(words.slices(pa.array([t])))[2].hashes(3, lower=True).tolist()]
    assert got.tolist() == alone and peak < 16 * len(all_at_once.raw)
