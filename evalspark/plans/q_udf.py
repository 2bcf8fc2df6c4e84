"""User-defined extension queries (UD*) and the TF-IDF metric (PM7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.common import r6
from ..functions.stopwords import english_stop_words
from ..functions.tokens import split_ws
from ..operators import pair_metrics as pm
from ..operators import udf as U
from ..sources import bindings as B
from ..sources.tables import table
from . import sqlfrag as S
from . import udf_fixtures as X
from .registry import query

_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in english_stop_words())


@query("pm7_tfidf_similarity", uses=("eval_pairs",), sql=f"""
WITH d AS (SELECT pair_id AS k, 'p' AS side, pred AS t FROM eval_pairs UNION ALL SELECT pair_id, 'r', ref FROM eval_pairs),
tm AS (SELECT k, side, unnest(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{_STOPS}], w))) AS term FROM d),
tf AS (SELECT k, side, term, count(*) AS tf FROM tm GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) * 2 AS n FROM eval_pairs),
w AS (SELECT k, side, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
pt AS (SELECT k, term, sum(CASE WHEN side = 'p' THEN w END) AS wp, sum(CASE WHEN side = 'r' THEN w END) AS wr FROM w GROUP BY k, term),
g AS (SELECT k, sum(coalesce(wp, 0) * coalesce(wr, 0)) AS dot, sqrt(sum(pow(coalesce(wp, 0), 2))) AS np, sqrt(sum(pow(coalesce(wr, 0), 2))) AS nr FROM pt GROUP BY k)
SELECT e.pair_id, round(coalesce(CASE WHEN np > 0 AND nr > 0 THEN greatest(0.0, dot / (np * nr)) END, 0.0), 6) AS tfidf_similarity
FROM eval_pairs e LEFT JOIN g ON g.k = e.pair_id""")
def pm7(spark, d):
    t = pm.tfidf_cosine(B.eval_pairs(spark, d), "pair_id")
    return t.select("pair_id", r6("tfidf_similarity", "tfidf_similarity"))


def _registry():
    reg = U.MetricRegistry()
    reg.register("exact_match", lambda p, r: pm.exact_match(p, r))
    reg.register("jaccard", lambda p, r: pm.token_jaccard(p, r))
    reg.register("length_ratio", lambda p, r: F.when(F.length(r) > 0, F.least(F.lit(1.0), F.length(p) / F.length(r))).otherwise(F.lit(0.0)))
    return reg


@query("ud1_custom_metric", uses=("eval_pairs",), sql=f"""
SELECT pair_id, round(CASE WHEN length(ref) > 0 THEN least(1.0, length(pred) / length(ref)) ELSE 0.0 END, 6) AS length_ratio,
  round({S.jaccard(S.toks('pred'), S.toks('ref'))}, 6) AS jaccard FROM eval_pairs""")
def ud1(spark, d):
    e = _registry().evaluate(B.eval_pairs(spark, d), "pred", "ref", ["length_ratio", "jaccard"])
    return e.select("pair_id", r6("length_ratio", "length_ratio"), r6("jaccard", "jaccard"))


@query("ud2_python_evaluator", uses=("eval_pairs",), sql=f"""
SELECT pair_id, CASE WHEN pred = '' THEN 0.0 WHEN {S.split_ws('pred')}[1] IS NOT NULL AND lower({S.split_ws('pred')}[1]) = lower({S.split_ws('ref')}[1]) THEN 1.0 ELSE 0.0 END AS first_word,
  CASE WHEN pred = '' THEN 'ValueError: empty prediction' END AS first_word_error FROM eval_pairs""")
def ud2(spark, d):
    reg = U.MetricRegistry()
    reg.register_python("first_word", X.first_word_match)
    e = reg.evaluate(B.eval_pairs(spark, d), "pred", "ref", ["first_word"])
    return e.select("pair_id", "first_word", "first_word_error")


def _ud3_sql():
    from .q_corpus import FORMATTED_SQL
    return f"""WITH {FORMATTED_SQL},
g AS (SELECT CASE WHEN len({S.split_ws('prompt')}) > 0 THEN 'stop' ELSE 'error' END AS finish_reason,
             len({S.split_ws('prompt')}[1:5]) AS tokens FROM f)
SELECT finish_reason, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM g GROUP BY finish_reason"""


@query("ud3_generate_batch", uses=("templates",), sql=_ud3_sql())
def ud3(spark, d):
    """Model calls over templates × benchmark prompts through mapInPandas; error rows kept."""
    bench = table(spark, d, "benchmark")
    prompts = B.with_templates(bench).select((F.col("template_id") * 1000000 + F.col("item_id")).alias("prompt_id"),
                                        pm.format_prompt("template", "text").alias("prompt"))
    out = U.generate_batch(prompts, "prompt", "prompt_id", X.EchoModel)
    return out.groupBy("finish_reason").agg(F.count("*").alias("n"), F.sum(F.size(split_ws("text"))).alias("tokens"))


@query("ud4_batch_apply", sql=f"SELECT doc_id, CAST(len({S.split_ws('text')}) AS BIGINT) AS n_words FROM documents")
def ud4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return U.batch_apply(docs, X.word_count, "text", "n_words", "bigint", keep=["doc_id"])


def _german_long(df):
    return df.where(F.col("lang") == "de").withColumn("n_chars_calc", F.length("text"))


@query("ud5_custom_transform", sql="SELECT doc_id, length(text) AS n_chars_calc FROM documents WHERE lang = 'de'")
def ud5(spark, d):
    return table(spark, d, "documents").transform(_german_long).select("doc_id", "n_chars_calc")
