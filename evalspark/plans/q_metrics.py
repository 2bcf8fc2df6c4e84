"""Pair-metric queries (PM*) over the fixture bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import r6
from ..operators import pair_metrics as pm
from ..sources import bindings as B
from ..sources.tables import table
from . import sqlfrag as S
from .registry import query

EP = ("eval_pairs",)


# ------------------------------------------------------------------ flagship slice
def pm_summary_by_lang(spark, d):
    # One scan and one pass over the tokens; only the means are shuffled.
    rows = pm.ngram_scores(B.eval_pairs(spark, d), "pair_id", carry=["lang"], sets=True)
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), r6(F.avg("exact_match"), "exact_match"), r6(F.avg("bleu"), "bleu"),
        r6(F.avg("rouge1_f"), "rouge1_f"), r6(F.avg("rouge2_f"), "rouge2_f"), r6(F.avg("jaccard"), "jaccard"))


_r1p, _r1r, _r1f = S.rouge_n(1)
_r2p, _r2r, _r2f = S.rouge_n(2)
EM_SQL = f"CAST(array_to_string({S.toks('pred')}, ' ') = array_to_string({S.toks('ref')}, ' ') AS DOUBLE)"
JAC_SQL = S.jaccard(S.toks("pred"), S.toks("ref"))

query("pm_summary_by_lang", uses=EP, sql=f"""
WITH {S.ngram_counts('eval_pairs', 'pair_id')}
SELECT e.lang, count(*) AS n, round(avg({EM_SQL}), 6) AS exact_match, round(avg({S.bleu()}), 6) AS bleu,
       round(avg({_r1f}), 6) AS rouge1_f, round(avg({_r2f}), 6) AS rouge2_f, round(avg({JAC_SQL}), 6) AS jaccard
FROM eval_pairs e JOIN _nc USING (pair_id) GROUP BY e.lang""")(pm_summary_by_lang)


@query("pm1_exact_match", uses=EP, sql=f"SELECT pair_id, {EM_SQL} AS exact_match FROM eval_pairs")
def pm1(spark, d):
    return B.eval_pairs(spark, d).select("pair_id", pm.exact_match("pred", "ref").alias("exact_match"))


@query("pm1_exact_match_score", uses=EP,
       sql=f"SELECT count(*) AS n, round(coalesce(avg({EM_SQL}), 0.0), 6) AS exact_match_score FROM eval_pairs")
def pm1_score(spark, d):
    return B.eval_pairs(spark, d).agg(F.count("*").alias("n"),
                                      r6(F.coalesce(F.avg(pm.exact_match("pred", "ref")), F.lit(0.0)),
                                         "exact_match_score"))


@query("pm2_exact_match_switches", uses=EP, sql=f"""
SELECT pair_id,
  CAST(array_to_string({S.split_ws('pred')}, ' ') = array_to_string({S.split_ws('ref')}, ' ') AS DOUBLE) AS em_case_sensitive,
  CAST(lower(pred) = lower(ref) AS DOUBLE) AS em_raw_ws,
  CAST(pred = ref AS DOUBLE) AS em_strict
FROM eval_pairs""")
def pm2(spark, d):
    return B.eval_pairs(spark, d).select(
        "pair_id", pm.exact_match("pred", "ref", case_sensitive=True).alias("em_case_sensitive"),
        pm.exact_match("pred", "ref", normalize_whitespace=False).alias("em_raw_ws"),
        pm.exact_match("pred", "ref", True, False).alias("em_strict"))


@query("pm3_bleu", uses=EP, sql=f"""
WITH {S.ngram_counts('eval_pairs', 'pair_id')}
SELECT pair_id, round({S.bleu()}, 6) AS bleu FROM _nc""")
def pm3(spark, d):
    c = pm.ngram_match_counts(B.eval_pairs(spark, d), "pair_id")
    return c.select("pair_id", r6(pm.bleu_from_counts(), "bleu"))


@query("pm3_bleu_score", uses=EP, sql=f"""
WITH {S.ngram_counts('eval_pairs', 'pair_id')}
SELECT round(coalesce(avg({S.bleu()}), 0.0), 6) AS bleu_score, count(*) AS n FROM _nc""")
def pm3_score(spark, d):
    c = pm.ngram_match_counts(B.eval_pairs(spark, d), "pair_id")
    return c.agg(r6(F.coalesce(F.avg(pm.bleu_from_counts()), F.lit(0.0)), "bleu_score"), F.count("*").alias("n"))


@query("pm4_rouge_n", uses=EP, sql=f"""
WITH {S.ngram_counts('eval_pairs', 'pair_id')}
SELECT pair_id, round({_r1p}, 6) AS rouge1_p, round({_r1r}, 6) AS rouge1_r, round({_r1f}, 6) AS rouge1_f,
       round({_r2p}, 6) AS rouge2_p, round({_r2r}, 6) AS rouge2_r, round({_r2f}, 6) AS rouge2_f FROM _nc""")
def pm4(spark, d):
    s = pm.ngram_scores(B.eval_pairs(spark, d), "pair_id")
    return s.select("pair_id", *[r6(c, c) for c in s.columns if c.startswith("rouge")])


@query("pm4_rouge_n_mean", uses=EP, sql=f"""
WITH {S.ngram_counts('eval_pairs', 'pair_id')}
SELECT round(avg({_r1p}), 6) AS rouge1_p, round(avg({_r1r}), 6) AS rouge1_r, round(avg({_r1f}), 6) AS rouge1_f,
       round(avg({_r2p}), 6) AS rouge2_p, round(avg({_r2r}), 6) AS rouge2_r, round(avg({_r2f}), 6) AS rouge2_f FROM _nc""")
def pm4_mean(spark, d):
    s = pm.ngram_scores(B.eval_pairs(spark, d), "pair_id")
    return s.agg(*[r6(F.avg(c), c) for c in s.columns if c.startswith("rouge")])


# Oracle: the same bit-parallel LCS as a recursive CTE over one token of the reference per step;
# the bit masks are BIGINT, which holds because eval_pairs predictions have at most 40 tokens.
@query("pm5_rouge_l")
def pm5(spark, d):
    """ROUGE-L P/R/F of whole texts (LCS in an Arrow UDF).  No SQL: an LCS over thousands of tokens is
    too slow there; tests check it against a brute-force table."""
    s = pm.rouge_l(B.eval_pairs(spark, d))
    return s.select("pair_id", r6("rougeL_p", "rougeL_p"), r6("rougeL_r", "rougeL_r"), r6("rougeL_f", "rougeL_f"))


@query("pm6_token_jaccard", uses=EP, sql=f"SELECT pair_id, round({JAC_SQL}, 6) AS jaccard FROM eval_pairs")
def pm6(spark, d):
    return B.eval_pairs(spark, d).select("pair_id", r6(pm.token_jaccard("pred", "ref"), "jaccard"))


def _emb_pairs(spark, d):
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return a.join(b, "a_id")


EMB_SQL = """_ep AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
_cs AS (SELECT a_id, b_id, CASE WHEN list_dot_product(a, a) = 0 OR list_dot_product(b, b) = 0 THEN 0.0
   ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END AS cos FROM _ep)"""


@query("pm8_embedding_cosine", sql=f"""WITH {EMB_SQL}
SELECT a_id, b_id, round(greatest(0.0, cos), 6) AS similarity, greatest(0.0, cos) >= 0.8 AS is_similar FROM _cs""")
def pm8(spark, d):
    p = _emb_pairs(spark, d)
    sim = pm.semantic_similarity("a", "b")
    return p.select("a_id", "b_id", r6(sim, "similarity"), pm.similarity_flag(sim, 0.8).alias("is_similar"))


@query("pm9_bertscore", sql=f"""WITH {EMB_SQL}
SELECT round(avg(greatest(0.0, cos)), 6) AS precision_mean, round(avg(greatest(0.0, cos)), 6) AS recall_mean,
       round(avg(greatest(0.0, cos)), 6) AS f1_mean FROM _cs""")
def pm9(spark, d):
    sim = pm.semantic_similarity("a", "b")
    a = _emb_pairs(spark, d).agg(F.avg(sim).alias("s"))
    return a.select(r6("s", "precision_mean"), r6("s", "recall_mean"), r6("s", "f1_mean"))


@query("pm10_similarity_threshold", sql=f"""WITH {EMB_SQL}
SELECT count(*) AS n, count_if(greatest(0.0, cos) >= 0.05) AS n_similar FROM _cs""")
def pm10(spark, d):
    sim = pm.semantic_similarity("a", "b")
    return _emb_pairs(spark, d).agg(F.count("*").alias("n"),
                                    F.count_if(pm.similarity_flag(sim, 0.05)).alias("n_similar"))


_pieces = "string_split(text, '.')"
_lens = f"list_filter(list_transform({_pieces}, lambda s: len({S.split_ws('s')})), lambda n: n > 0)"
_words = S.toks("text")
COH_SQL = f"""least(1.0, 0.5
  + CASE WHEN regexp_matches(text, '[.!?][\\s\\x{{00A0}}]*$') THEN 0.1 ELSE 0.0 END
  + CASE WHEN len({_pieces}) BETWEEN 1 AND 10 THEN 0.2 ELSE 0.0 END
  + CASE WHEN len({_pieces}) > 1 AND len({_lens}) >= 2 AND list_aggregate({_lens}, 'stddev_samp') > 2 THEN 0.1 ELSE 0.0 END
  + CASE WHEN len({_words}) > 0 THEN len(list_distinct({_words})) / len({_words}) ELSE 0.0 END * 0.2)"""


@query("pm11_coherence", sql=f"SELECT doc_id, round({COH_SQL}, 6) AS coherence FROM documents")
def pm11(spark, d):
    c = pm.with_coherence(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", r6("coherence", "coherence"))


@query("pm12_keyword_relevance", uses=("turns",), sql=f"""
SELECT conv_id, turn, round(CASE WHEN len(list_distinct({S.toks('context')})) = 0 THEN 0.0
  ELSE least(1.0, {S.inter(S.toks('response'), S.toks('context'))} / len(list_distinct({S.toks('context')}))) END, 6) AS relevance
FROM turns""")
def pm12(spark, d):
    return B.turns(spark, d).select("conv_id", "turn", r6(pm.keyword_relevance("response", "context"), "relevance"))


def _any_sql(e, words):
    return "(" + " OR ".join(f"contains({e}, '{w}')" for w in words) + ")"


_rt = S.toks("response")
APPROP_SQL = f"""greatest(0.0, least(1.0, 0.5
  + CASE WHEN len({S.split_ws('response')}) BETWEEN 5 AND 100 THEN 0.2 ELSE 0.0 END
  + CASE WHEN contains(context, '?') AND {_any_sql('lower(response)', pm.ANSWER_WORDS)} THEN 0.1 ELSE 0.0 END
  + CASE WHEN {_any_sql('lower(response)', pm.POLITE_WORDS)} THEN 0.1 ELSE 0.0 END
  - CASE WHEN len({_rt}) > 0 AND len(list_distinct({_rt})) / len({_rt}) < 0.7 THEN 0.2 ELSE 0.0 END))"""


@query("pm13_response_appropriateness", uses=("turns",),
       sql=f"SELECT conv_id, turn, round({APPROP_SQL}, 6) AS appropriateness FROM turns")
def pm13(spark, d):
    return B.turns(spark, d).select("conv_id", "turn",
                                    r6(pm.response_appropriateness("response", "context"), "appropriateness"))


def _rq_sql(r, e):
    nw = f"len({S.split_ws(r)})"
    ew = S.toks(e)
    ov = f"(CASE WHEN len(list_distinct({ew})) = 0 THEN 0.0 ELSE {S.inter(ew, S.toks(r))} / len(list_distinct({ew})) END)"
    ls = f"least(1.0, {nw} / 50) * 0.3"
    return (f"(CASE WHEN {r} IS NULL OR {nw} = 0 THEN 0.0 ELSE least(1.0, CASE WHEN coalesce({e}, '') <> '' "
            f"THEN {ls} + {ov} * 0.7 ELSE {ls} + CASE WHEN {nw} > 5 THEN 0.7 ELSE 0.3 END END) END)")


RQ_SQL = _rq_sql("pred", "ref")


@query("pm14_response_quality", uses=EP, sql=f"SELECT pair_id, round({RQ_SQL}, 6) AS response_quality FROM eval_pairs")
def pm14(spark, d):
    return B.eval_pairs(spark, d).select("pair_id", r6(pm.response_quality("pred", "ref"), "response_quality"))


_gp, _gt = f"lower({S.strip('pred')})", f"lower({S.strip('ref')})"
GM_SQL = f"""(CASE WHEN {_gp} = {_gt} THEN 1.0 WHEN contains({_gp}, {_gt}) OR contains({_gt}, {_gp}) THEN 0.7
  WHEN len(list_distinct({S.split_ws(_gt)})) = 0 THEN 0.0
  ELSE {S.inter(S.split_ws(_gp), S.split_ws(_gt))} / len(list_distinct({S.split_ws(_gt)})) END)"""


@query("pm15_graded_match", uses=EP, sql=f"SELECT pair_id, round({GM_SQL}, 6) AS graded_match FROM eval_pairs")
def pm15(spark, d):
    return B.eval_pairs(spark, d).select("pair_id", r6(pm.graded_match("pred", "ref"), "graded_match"))


@query("pm16_reward", sql=f"""SELECT doc_id, round((least(1.0, length(text) / 200) +
  CASE WHEN len({S.split_ws('text')}) > 5 THEN 1.0 ELSE 0.5 END) / 2, 6) AS reward FROM documents""")
def pm16(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(pm.reward("text"), "reward"))


@query("pm17_latency_score", uses=("eval_results",), sql="""
SELECT run_id, count(*) AS n,
  round(avg(CASE WHEN latency_ms > 0 THEN least(1.0, 1000.0 / latency_ms) ELSE 0.0 END), 6) AS latency_score,
  count_if(latency_ms <= 1000.0) AS n_meets_target
FROM eval_results WHERE metric = 'exact_match' GROUP BY run_id""")
def pm17(spark, d):
    er = B.eval_results(spark, d).where(F.col("metric") == "exact_match")
    return er.groupBy("run_id").agg(F.count("*").alias("n"), r6(F.avg(pm.latency_score("latency_ms")), "latency_score"),
                                    F.count_if(pm.meets_target("latency_ms")).alias("n_meets_target"))


@query("pm18_normalize_score", uses=("eval_results",), sql="""
SELECT metric, round(avg(greatest(0.0, least(1.0, score))), 6) AS similarity_norm,
  round(avg(greatest(0.0, least(1.0, 1.0 - score))), 6) AS error_norm,
  round(avg(greatest(0.0, least(1.0, 1.0 - (latency_ms / 1000.0) / 10.0))), 6) AS latency_norm
FROM eval_results GROUP BY metric""")
def pm18(spark, d):
    er = B.eval_results(spark, d)
    return er.groupBy("metric").agg(
        r6(F.avg(pm.normalize_score("score", "similarity")), "similarity_norm"),
        r6(F.avg(pm.normalize_score("score", "error")), "error_norm"),
        r6(F.avg(pm.normalize_score(F.col("latency_ms") / 1000.0, "latency")), "latency_norm"))


def _judge_num_sql(lo, hi):
    m = f"regexp_extract({S.strip('response')}, '-?\\d+\\.?\\d*', 0)"
    return f"(CASE WHEN {m} = '' THEN {(lo + hi) / 2.0} ELSE greatest({lo}, least({hi}, CAST({m} AS DOUBLE))) END)"


@query("pm19_judge_scores", uses=("judge_raw",), sql=f"""
SELECT id, round({_judge_num_sql(-2.0, 2.0)} / 2.0, 6) AS pairwise, round(({_judge_num_sql(1.0, 10.0)} - 1.0) / 9.0, 6) AS scale10
FROM judge_raw""")
def pm19(spark, d):
    j = B.judge_raw(spark, d)
    return j.select("id", r6(pm.judge_pairwise("response"), "pairwise"), r6(pm.judge_scale10("response"), "scale10"))


@query("pm19_judge_mean", uses=("judge_raw",), sql=f"""
SELECT count(*) AS n, round(avg({_judge_num_sql(-2.0, 2.0)} / 2.0), 6) AS pairwise, round(avg(({_judge_num_sql(1.0, 10.0)} - 1.0) / 9.0), 6) AS scale10
FROM judge_raw""")
def pm19_mean(spark, d):
    j = B.judge_raw(spark, d)
    return j.agg(F.count("*").alias("n"), r6(F.avg(pm.judge_pairwise("response")), "pairwise"),
                 r6(F.avg(pm.judge_scale10("response")), "scale10"))


_jraw = """(CASE WHEN NOT json_valid(response) THEN coalesce(CAST(nullif(regexp_extract(response, '\\d+\\.?\\d*', 0), '') AS DOUBLE), 0.0)
  WHEN json_type(response) = 'OBJECT' THEN coalesce(TRY_CAST(json_extract(response, '$.score') AS DOUBLE), 0.0) ELSE 0.0 END)"""
_jnorm = f"(CASE WHEN {_jraw} > 1.0 THEN CASE WHEN {_jraw} <= 10.0 THEN {_jraw} / 10.0 ELSE {_jraw} / 100.0 END ELSE {_jraw} END)"


@query("pm20_judge_json", uses=("judge_raw",),
       sql=f"SELECT id, round({_jnorm}, 6) AS score, {_jnorm} >= 0.5 AS score_binary FROM judge_raw")
def pm20(spark, d):
    s = pm.judge_json_score("response")
    return B.judge_raw(spark, d).select("id", r6(s, "score"), (s >= 0.5).alias("score_binary"))


def _cnt(ch):
    return f"(length(html) - length(replace(html, '{ch}', '')))"


@query("pm21_bracket_balance", sql=f"""
SELECT count(*) AS n, round(avg(CASE WHEN {_cnt('{')} = {_cnt('}')} AND {_cnt('(')} = {_cnt(')')} AND {_cnt('[')} = {_cnt(']')}
  THEN 1.0 ELSE 0.0 END), 6) AS balanced_rate FROM pages""")
def pm21(spark, d):
    p = table(spark, d, "pages")
    return p.agg(F.count("*").alias("n"), r6(F.avg(pm.brackets_balanced("html").cast("double")), "balanced_rate"))


@query("pm22_classification", sql="""
WITH c AS (SELECT count(*) AS n, count_if(quality = 0 AND toxic = 1) AS tp, count_if(quality <> 0 AND toxic = 1) AS fp,
                  count_if(quality = 0 AND toxic <> 1) AS fn, count_if(quality <> 0 AND toxic <> 1) AS tn FROM labels),
m AS (SELECT *, (tp + tn) / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec FROM c)
SELECT n, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(prec, 6) AS "precision", round(rec, 6) AS recall,
       round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1 FROM m""")
def pm22(spark, d):
    lab = table(spark, d, "labels")
    m = pm.classification_metrics(lab, F.col("quality") == 0, F.col("toxic") == 1)
    return m.select("n", "tp", "fp", "fn", "tn", *[r6(c, c) for c in ("accuracy", "precision", "recall", "f1")])


@query("pm23_metric_table", uses=EP, sql=f"""
WITH {S.ngram_counts('eval_pairs', 'pair_id')},
s AS (SELECT e.pair_id, {EM_SQL} AS exact_match, {JAC_SQL} AS jaccard, {RQ_SQL} AS response_quality,
             {GM_SQL} AS graded_match, {S.bleu()} AS bleu FROM eval_pairs e JOIN _nc USING (pair_id)),
l AS (UNPIVOT s ON exact_match, jaccard, response_quality, graded_match, bleu INTO NAME metric VALUE value),
a AS (SELECT metric, count(value) AS n, avg(value) AS score, stddev_samp(value) AS sd FROM l GROUP BY metric)
SELECT metric, n, round(coalesce(score, 0.0), 6) AS score,
  round(CASE WHEN n < 2 THEN 0.0 ELSE greatest(0.0, score - 1.96 * sd / sqrt(n)) END, 6) AS ci_low,
  round(CASE WHEN n < 2 THEN 1.0 ELSE least(1.0, score + 1.96 * sd / sqrt(n)) END, 6) AS ci_high FROM a""")
def pm23(spark, d):
    ep = pm.row_metrics(B.eval_pairs(spark, d))
    scored = pm.ngram_scores(ep, "pair_id", carry=["exact_match", "jaccard", "response_quality", "graded_match"])
    t = pm.metric_table(scored, ["exact_match", "jaccard", "response_quality", "graded_match", "bleu"])
    return t.select("metric", "n", *[r6(c, c) for c in ("score", "ci_low", "ci_high")])


@query("pm24_format_prompt", uses=("templates",), sql="""
SELECT t.template_id, b.item_id,
  CASE WHEN contains(t.template, '{input}') THEN replace(replace(replace(t.template, '{{', '{'), '}}', '}'), '{input}', b.text)
       WHEN contains(t.template, '[INPUT]') THEN replace(t.template, '[INPUT]', b.text)
       ELSE concat(t.template, chr(10), chr(10), 'Input: ', b.text) END AS prompt
FROM templates t CROSS JOIN benchmark b""")
def pm24(spark, d):
    bench = table(spark, d, "benchmark")
    return B.with_templates(bench).select("template_id", "item_id", pm.format_prompt("template", "text").alias("prompt"))
