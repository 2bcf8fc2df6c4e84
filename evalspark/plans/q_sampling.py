"""Sampling and splitting queries (SA*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as SM
from ..sources.tables import table
from .registry import query

SEED = 7


def _md5(key: str) -> str:
    return f"md5(concat('{SEED}:', CAST({key} AS VARCHAR)))"


@query("sa1_random_sample", sql=f"SELECT doc_id, lang FROM documents ORDER BY {_md5('doc_id')}, doc_id LIMIT 100")
def sa1(spark, d):
    return SM.random_sample(table(spark, d, "documents").select("doc_id", "lang"), 100, "doc_id", SEED)


@query("sa2_stratified_sample", sql=f"""
WITH s AS (SELECT lang, count(*) AS len FROM documents GROUP BY lang), t AS (SELECT count(*) AS n FROM documents),
q AS (SELECT lang, least(len, greatest(1, floor(100 * len / n))) AS quota FROM s, t),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_md5('doc_id')}, doc_id) - 1 AS rk FROM documents)
SELECT doc_id, r.lang FROM r JOIN q USING (lang) WHERE rk < quota""")
def sa2(spark, d):
    return SM.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), 100, "lang", "doc_id", SEED)


@query("sa3_systematic_sample", sql="""
WITH o AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS o FROM lineitem),
t AS (SELECT greatest(1, floor(count(*) / 500)) AS iv FROM lineitem)
SELECT l_orderkey, l_linenumber FROM o, t WHERE o % iv = 0 AND floor(o / iv) < 500""")
def sa3(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return SM.systematic_sample(li, 500, ["l_orderkey", "l_linenumber"])


@query("sa4_balanced_sample", sql=f"""
WITH k AS (SELECT count(DISTINCT lang) + max(CAST(lang IS NULL AS INTEGER)) AS k FROM documents),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_md5('doc_id')}, doc_id) - 1 AS rk FROM documents WHERE lang IS NOT NULL)
SELECT doc_id, lang FROM r, k WHERE rk < floor(100 / k)""")
def sa4(spark, d):
    return SM.balanced_sample(table(spark, d, "documents").select("doc_id", "lang"), 100, "lang", "doc_id", SEED)


@query("sa5_sample_dispatch", sql=f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_md5('doc_id')}, doc_id) - 1 AS rk FROM documents),
s AS (SELECT source, count(*) AS len FROM documents GROUP BY source), t AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, r.source FROM r JOIN s USING (source), t WHERE rk < least(len, greatest(1, floor(30 * len / n)))""")
def sa5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return SM.sample_dataset(docs, 30, "stratified", key="doc_id", seed=SEED, stratify_column="source")


@query("sa6_train_test_split", sql=f"""
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_md5('doc_id')}, doc_id) - 1 AS o FROM documents),
t AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, CASE WHEN o < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM o, t""")
def sa6(spark, d):
    return SM.train_test_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.8, SEED)


@query("sa7_ordered_split", sql="""
WITH o AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS o FROM conversations),
t AS (SELECT count(*) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n < 10 THEN 'both' WHEN o < floor(n * 0.8) THEN 'train' ELSE 'validation' END AS split FROM o, t""")
def sa7(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return SM.ordered_split(c, ["conv_id", "turn"], 0.2)


@query("sa8_fewshot_examples", sql=f"""
SELECT d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1
ORDER BY {_md5('d.doc_id')}, d.doc_id LIMIT 8""")
def sa8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    good = table(spark, d, "labels").where(F.col("quality") == 1).select("doc_id")
    return SM.random_sample(docs.join(good, "doc_id", "left_semi"), 8, "doc_id", SEED)


@query("sa9_downsample", sql="""
WITH o AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS o FROM lineitem),
t AS (SELECT count(*) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber FROM o, t WHERE n <= 1000 OR o % floor(n / 1000) = 0 OR o = n - 1""")
def sa9(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return SM.downsample(li, ["l_orderkey", "l_linenumber"], 1000)
