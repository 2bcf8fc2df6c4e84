"""Similarity / de-duplication / selection queries (SI*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import r6
from ..functions.tokens import split_ws
from ..operators import similarity as SIM
from ..sources import bindings as B
from ..sources.tables import table
from . import sqlfrag as S
from .registry import query

T_NEAR = 0.8


@query("si1_exact_dedup", sql="SELECT min(doc_id) AS doc_id, count(*) OVER () AS n_kept FROM documents GROUP BY md5(text)")
def si1(spark, d):
    k = SIM.exact_dedup(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    n = table(spark, d, "documents").agg(F.countDistinct(F.md5("text"))).scalar()
    return k.select("doc_id", n.alias("n_kept"))


_SETS = f"s AS (SELECT doc_id, list_distinct({S.toks('text')}) AS toks FROM documents)"
_REPS = """reps AS (SELECT min(doc_id) AS doc_id FROM s GROUP BY array_to_string(list_sort(toks), ' ')),
r AS (SELECT s.* FROM s JOIN reps USING (doc_id))"""


@query("si4_similarity_join", sql=f"""WITH {_SETS}, {_REPS}
SELECT a, b, round(j, 6) AS jaccard FROM (
  SELECT x.doc_id AS a, y.doc_id AS b, {S.jaccard('x.toks', 'y.toks')} AS j FROM r x JOIN r y
  ON x.doc_id < y.doc_id AND len(y.toks) >= len(x.toks) * {T_NEAR} AND len(x.toks) >= len(y.toks) * {T_NEAR}) t WHERE j > {T_NEAR}""")
def si4(spark, d):
    sets = SIM.token_sets(table(spark, d, "documents"), "doc_id", "text")
    reps, _ = SIM.collapse_identical_sets(sets, "doc_id")
    return SIM.similarity_join(reps, "doc_id", T_NEAR).select("a", "b", r6("jaccard", "jaccard"))


SI2_SQL = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, list_distinct({S.toks('text')}) AS toks FROM documents),
reps AS MATERIALIZED (SELECT min(doc_id) AS doc_id FROM s GROUP BY array_to_string(list_sort(toks), ' ')),
r AS MATERIALIZED (SELECT s.* FROM s JOIN reps USING (doc_id)),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, {S.jaccard('x.toks', 'y.toks')} AS j FROM r x JOIN r y
  ON x.doc_id < y.doc_id AND len(y.toks) >= len(x.toks) * {T_NEAR} AND len(x.toks) >= len(y.toks) * {T_NEAR}) t WHERE j > {T_NEAR}),
o AS MATERIALIZED (SELECT r.doc_id, row_number() OVER (ORDER BY r.doc_id) AS k, coalesce(nb.earlier, []::BIGINT[]) AS earlier
      FROM r LEFT JOIN (SELECT b, list(a) AS earlier FROM e GROUP BY b) nb ON nb.b = r.doc_id),
m(k, kept) AS (SELECT 0, []::BIGINT[]
  UNION ALL SELECT m.k + 1, CASE WHEN list_has_any(m.kept, o.earlier) THEN m.kept ELSE list_append(m.kept, o.doc_id) END
  FROM m JOIN o ON o.k = m.k + 1),
fin AS (SELECT kept FROM m ORDER BY k DESC LIMIT 1)
SELECT d.doc_id, list_contains((SELECT kept FROM fin), d.doc_id) AS kept FROM documents d"""


@query("si2_near_dedup", sql=SI2_SQL)
def si2(spark, d):
    """Greedy near-duplicate removal (token Jaccard > .8 to an earlier kept text); iterative MIS."""
    return SIM.near_dedup(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", T_NEAR)


@query("si3_char_similarity_candidates")
def si3(spark, d):
    """Ratcliff–Obershelp ratio of the near-duplicate candidate pairs among variant contents, copies included."""
    v = B.variants(spark, d).select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    sets = SIM.token_sets(v, "doc_id", "text")
    reps, members = SIM.collapse_identical_sets(sets, "doc_id")
    e = SIM.similarity_join(reps, "set_id", 0.5)
    return SIM.char_ratio_pairs(SIM.member_pairs(e, members, "doc_id"), v, "doc_id").select("a", "b", r6("ratio", "char_ratio"))


def _pairs_sql(src: str, group: str, both_empty: str) -> str:
    return f"""p AS (SELECT x.{group} AS g, {S.jaccard('x.toks', 'y.toks', both_empty, '0.0')} AS j FROM {src} x JOIN {src} y
  ON x.{group} = y.{group} AND x.idx < y.idx)"""


_RESP = f"rs AS (SELECT group_id, idx, list_distinct({S.toks('response')}) AS toks, response FROM responses)"


@query("si5_diversity", uses=("responses",), sql=f"""WITH {_RESP}, {_pairs_sql('rs', 'group_id', '1.0')},
n AS (SELECT group_id, count(*) AS n_items FROM rs GROUP BY group_id)
SELECT group_id, n_items, round(CASE WHEN n_items <= 1 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - (SELECT avg(j) FROM p WHERE p.g = n.group_id))) END, 6) AS diversity
FROM n""")
def si5(spark, d):
    r = SIM.diversity(B.responses(spark, d), "group_id", "idx", "response")
    return r.select("group_id", "n_items", r6("diversity", "diversity"))


@query("si6_diversity_pick")
def si6(spark, d):
    """Greedy quality + diversity pick of 10 variants per strategy (k rounds, difflib similarity)."""
    return SIM.diversity_pick(B.variants(spark, d), "strategy", "id", "content", "quality_score", k=10, w=0.3)


@query("si7_quality_filter", uses=("variants",), sql="SELECT id, quality_score, count(*) OVER () AS n_passed FROM variants WHERE quality_score >= 0.6")
def si7(spark, d):
    f = SIM.quality_filter(B.variants(spark, d), "quality_score", 0.6).select("id", "quality_score")
    return f.select("*", f.agg(F.count("*")).scalar().alias("n_passed"))


@query("si8_variant_quality", uses=("variants",), sql="""
SELECT id, round(greatest(0.0, least(1.0, 0.4 * coalesce(quality_score, 0.5) + 0.3 * coalesce(diversity_score, 0.5)
  + 0.3 * coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE generation_time END, 0.5))), 6) AS variant_quality FROM variants""")
def si8(spark, d):
    v = B.variants(spark, d)
    coh = F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("generation_time"))
    return v.select("id", r6(SIM.variant_quality("quality_score", "diversity_score", coh), "variant_quality"))


@query("si9_strategy_rollup", uses=("variants",), sql="""
SELECT strategy, count(*) AS count, round(avg(quality_score), 6) AS avg_quality, round(avg(diversity_score), 6) AS avg_diversity,
  round(avg(generation_time), 6) AS avg_generation_time, round(min(quality_score), 6) AS min_quality, round(max(quality_score), 6) AS max_quality
FROM variants GROUP BY strategy""")
def si9(spark, d):
    s = SIM.strategy_rollup(B.variants(spark, d), "strategy", "quality_score", "diversity_score", "generation_time")
    return s.select("strategy", "count", *[r6(c, c) for c in ("avg_quality", "avg_diversity", "avg_generation_time", "min_quality", "max_quality")])


@query("si10_generation_stats", uses=("variants",), sql="""
SELECT count(*) AS total_variants, round(min(quality_score), 6) AS min_quality, round(max(quality_score), 6) AS max_quality,
  round(avg(quality_score), 6) AS avg_quality, round(stddev_pop(quality_score), 6) AS std_quality,
  round(sum(generation_time), 6) AS total_generation_time FROM variants""")
def si10(spark, d):
    g = SIM.generation_stats(B.variants(spark, d), "quality_score", "generation_time")
    return g.select("total_variants", *[r6(c, c) for c in ("min_quality", "max_quality", "avg_quality", "std_quality", "total_generation_time")])


@query("si11_best_n", uses=("variants",), sql="""
SELECT 3 AS n, id FROM (SELECT id FROM variants ORDER BY quality_score DESC, id LIMIT 3) a
UNION ALL SELECT 20, id FROM (SELECT id FROM variants ORDER BY quality_score DESC, id LIMIT 20) b""")
def si11(spark, d):
    v = B.variants(spark, d)
    t3 = SIM.best_n(v, "quality_score", "id", 3).select(F.lit(3).alias("n"), "id")
    t20 = SIM.best_n(v, "quality_score", "id", 20).select(F.lit(20).alias("n"), "id")
    return t3.unionByName(t20)


@query("si12_pareto_front", sql="""
SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= p.p_size
  AND q.p_retailprice >= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice > p.p_retailprice))""")
def si12(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return SIM.pareto_front(p, "p_size", "p_retailprice")


_FIVE = ("quality_score", "diversity_score", "generation_time", "brevity", "spread")


def _dominates(cols, q="q", p="p"):
    return (" AND ".join(f"{q}.{c} >= {p}.{c}" for c in cols)) + " AND (" + " OR ".join(f"{q}.{c} > {p}.{c}" for c in cols) + ")"


_FIVE_SQL = """v AS (SELECT id, quality_score, diversity_score, generation_time, 1.0 / (1 + length(content)) AS brevity,
  CAST(id * 7919 % 211 AS DOUBLE) AS spread FROM variants)"""


def _five(spark, d):
    return B.variants(spark, d).select("id", "quality_score", "diversity_score", "generation_time", (1.0 / (1 + F.length("content"))).alias("brevity"),
                                       (F.col("id") * 7919 % 211).cast("double").alias("spread"))


@query("si12_pareto_front_3d", sql=f"""
WITH o AS (SELECT p_partkey, p_size, p_retailprice, CAST(p_partkey * 31 % 97 AS DOUBLE) AS margin FROM part)
SELECT * FROM o p WHERE NOT EXISTS (SELECT 1 FROM o q WHERE {_dominates(("p_size", "p_retailprice", "margin"))})""")
def si12_3d(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") * 31 % 97).cast("double").alias("margin"))
    return SIM.pareto_front(p, "p_size", "p_retailprice", "margin")


@query("si12_pareto_front_5d", uses=("variants",), sql=f"""
WITH {_FIVE_SQL} SELECT id FROM v p WHERE NOT EXISTS (SELECT 1 FROM v q WHERE {_dominates(_FIVE)})""")
def si12_5d(spark, d):
    return SIM.pareto_front(_five(spark, d), *_FIVE).select("id")


@query("si13_five_objectives", uses=("variants",), sql=f"""
WITH {_FIVE_SQL}, f AS (SELECT *, quality_score * 0.4 + diversity_score * 0.3 + generation_time * 0.1 + brevity * 0.1 + spread * 0.001 AS ws
  FROM v p WHERE NOT EXISTS (SELECT 1 FROM v q WHERE {_dominates(_FIVE)}))
SELECT id, round(ws, 6) AS weighted_score FROM f ORDER BY ws DESC, id LIMIT 10""")
def si13_five(spark, d):
    m = SIM.multi_objective(_five(spark, d), "id", dict(zip(_FIVE, (0.4, 0.3, 0.1, 0.1, 0.001))), 10)
    return m.select("id", r6("weighted_score", "weighted_score"))


@query("si13_multi_objective", uses=("variants",), sql="""
WITH v AS (SELECT id, quality_score, diversity_score, quality_score * 0.7 + diversity_score * 0.3 AS ws FROM variants),
f AS (SELECT * FROM v p WHERE NOT EXISTS (SELECT 1 FROM v q WHERE q.quality_score >= p.quality_score AND q.diversity_score >= p.diversity_score
  AND (q.quality_score > p.quality_score OR q.diversity_score > p.diversity_score)))
SELECT id, round(ws, 6) AS weighted_score FROM f ORDER BY ws DESC, id LIMIT 10""")
def si13(spark, d):
    v = B.variants(spark, d).select("id", "quality_score", "diversity_score")
    m = SIM.multi_objective(v, "id", {"quality_score": 0.7, "diversity_score": 0.3}, 10)
    return m.select("id", r6("weighted_score", "weighted_score"))


@query("si14_consistency", uses=("responses",), sql=f"""WITH {_RESP}, {_pairs_sql('rs', 'group_id', '0.0')},
n AS (SELECT group_id, count(*) AS n_items FROM rs GROUP BY group_id)
SELECT group_id, n_items, round(CASE WHEN n_items < 2 THEN 1.0 ELSE (SELECT avg(j) FROM p WHERE p.g = n.group_id) END, 6) AS consistency FROM n""")
def si14(spark, d):
    c = SIM.consistency(B.responses(spark, d), "group_id", "idx", "response")
    return c.select("group_id", "n_items", r6("consistency", "consistency"))


@query("si15_robustness", uses=("eval_pairs",), sql=f"""
SELECT lang, round(avg({S.jaccard(S.toks('pred'), S.toks('ref'), '0.0', '0.0')}), 6) AS robustness FROM eval_pairs GROUP BY lang""")
def si15(spark, d):
    ep = B.eval_pairs(spark, d)
    r = SIM.robustness(ep.select("lang", "pair_id", F.col("pred").alias("t")), ep.select("lang", "pair_id", F.col("ref").alias("t")),
                       "lang", "pair_id", "t")
    return r.select("lang", r6("robustness", "robustness"))


@query("si16_variance_score", uses=("responses",), sql=f"""
SELECT group_id, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE 1.0 / (1.0 + var_samp(len({S.split_ws('response')}))) END, 6) AS variance_score
FROM responses GROUP BY group_id""")
def si16(spark, d):
    v = SIM.variance_score(B.responses(spark, d), "group_id", F.size(split_ws("response")))
    return v.select("group_id", r6("variance_score", "variance_score"))


@query("si17_stability", uses=("responses",), sql=f"""WITH {_RESP}, {_pairs_sql('rs', 'group_id', '0.0')},
n AS (SELECT group_id, count(*) AS n_items, CASE WHEN count(*) < 2 THEN 1.0 ELSE 1.0 / (1.0 + var_samp(len({S.split_ws('response')}))) END AS vs
      FROM rs GROUP BY group_id),
c AS (SELECT group_id, vs, CASE WHEN n_items < 2 THEN 1.0 ELSE (SELECT avg(j) FROM p WHERE p.g = n.group_id) END AS cons FROM n)
SELECT group_id, round(0.7 * cons + 0.3 * vs, 6) AS stability FROM c""")
def si17(spark, d):
    s = SIM.stability(B.responses(spark, d), "group_id", "idx", "response")
    return s.select("group_id", r6("stability", "stability"))


@query("si18_cross_fold_stability", uses=("responses",), sql=f"""
WITH rs AS (SELECT group_id % 7 AS prompt, fold, group_id * 1000 + idx AS idx, list_distinct({S.toks('response')}) AS toks FROM responses),
p AS (SELECT x.prompt, x.fold, {S.jaccard('x.toks', 'y.toks', '0.0', '0.0')} AS j FROM rs x JOIN rs y ON x.prompt = y.prompt AND x.fold = y.fold AND x.idx < y.idx),
n AS (SELECT prompt, fold, count(*) AS n FROM rs GROUP BY prompt, fold),
c AS (SELECT prompt, fold, CASE WHEN n < 2 THEN 1.0 ELSE (SELECT avg(j) FROM p WHERE p.prompt = n.prompt AND p.fold = n.fold) END AS cons FROM n)
SELECT prompt, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE avg(cons) * (1 - var_samp(cons)) END, 6) AS cross_fold_stability, count(*) AS n_folds
FROM c GROUP BY prompt""")
def si18(spark, d):
    r = B.responses(spark, d).select((F.col("group_id") % 7).alias("prompt"), "fold",
                                     (F.col("group_id") * 1000 + F.col("idx")).alias("idx"), "response")
    s = SIM.cross_fold_stability(r, "prompt", "fold", "idx", "response")
    return s.select("prompt", r6("cross_fold_stability", "cross_fold_stability"), "n_folds")


def _cnt_sql(words):
    return f"len(list_filter({S.toks('response')}, lambda w: w IN ({', '.join(repr(x) for x in words)})))"


@query("si19_word_class_consistency", uses=("responses",), sql=f"""
WITH f AS (SELECT group_id, {_cnt_sql(SIM.SENTIMENT_WORDS)} AS s, {_cnt_sql(SIM.QUESTION_WORDS)} AS q, {_cnt_sql(SIM.ACTION_WORDS)} AS a FROM responses),
g AS (SELECT group_id, count(*) AS n,
  CASE WHEN min(s) = max(s) THEN 1.0 ELSE 1.0 / (1.0 + var_samp(s)) END AS cs, CASE WHEN min(q) = max(q) THEN 1.0 ELSE 1.0 / (1.0 + var_samp(q)) END AS cq,
  CASE WHEN min(a) = max(a) THEN 1.0 ELSE 1.0 / (1.0 + var_samp(a)) END AS ca, var_samp(s + q + a) AS sv FROM f GROUP BY group_id)
SELECT group_id, round(CASE WHEN n < 2 THEN 1.0 ELSE (cs + cq + ca) / 3 END, 6) AS semantic_consistency,
  round(CASE WHEN n < 2 THEN 0.0 ELSE sv END, 6) AS semantic_variance FROM g""")
def si19(spark, d):
    w = SIM.word_class_consistency(B.responses(spark, d), "group_id", "response")
    return w.select("group_id", r6("semantic_consistency", "semantic_consistency"), r6("semantic_variance", "semantic_variance"))


@query("si20_structural_consistency", sql=f"""
SELECT doc_id, round((CAST(regexp_matches(text, '[.!?]') AS DOUBLE) + CAST(NOT regexp_matches(text, '[\\s\\x{{00A0}}]{{2,}}') AS DOUBLE)
  + CAST(NOT regexp_matches({S.strip('text')}, '[\\p{{Lu}}\\p{{Lt}}]') OR NOT regexp_matches({S.strip('text')}, '[\\p{{Ll}}\\p{{Lt}}]') AS DOUBLE)) / 3.0, 6) AS structural_consistency
FROM documents""")
def si20(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(SIM.structural_consistency("text"), "structural_consistency"))


@query("si22_template_terms", sql=f"""
WITH w AS (SELECT unnest({S.toks('d.text')}) AS w FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
t AS (SELECT w, count(*) AS c FROM w GROUP BY w ORDER BY c DESC, w LIMIT 10)
SELECT coalesce(array_to_string(list(w ORDER BY c DESC, w)[1:3], ','), '') AS terms, count(*) AS n_verbs
FROM t WHERE w IN ({', '.join(repr(x) for x in SIM.TEMPLATE_VERBS)})""")
def si22(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").where(F.col("quality") == 1).select("doc_id"), "doc_id", "left_semi")
    t = SIM.template_terms(docs, "text")
    return t.select(F.array_join("terms", ",").alias("terms"), "n_verbs")


@query("si23_combined_similarity")
def si23(spark, d):
    """.3·difflib ratio + .5·Jaccard + .2·length similarity of each prediction/reference pair."""
    ep = SIM.spread_pairs(B.eval_pairs(spark, d))
    return ep.select("pair_id", SIM.combined_similarity("pred", "ref").alias("similarity"))


@query("si25_template_expansion", sql="""
SELECT item_id, kind, variant FROM (
  SELECT item_id, 'prefix0' AS kind, concat('Please carefully ', lower(text)) AS variant FROM benchmark
  UNION ALL SELECT item_id, 'prefix1', concat('Think step by step and ', lower(text)) FROM benchmark
  UNION ALL SELECT item_id, 'prefix2', concat('Consider the context and ', lower(text)) FROM benchmark
  UNION ALL SELECT item_id, 'prefix3', concat('Using your expertise, ', lower(text)) FROM benchmark
  UNION ALL SELECT item_id, 'suffix0', concat(text, ' Provide a detailed explanation.') FROM benchmark
  UNION ALL SELECT item_id, 'suffix1', concat(text, ' Be concise and accurate.') FROM benchmark
  UNION ALL SELECT item_id, 'suffix2', concat(text, ' Consider multiple perspectives.') FROM benchmark
  UNION ALL SELECT item_id, 'suffix3', concat(text, ' Focus on the key points.') FROM benchmark) t""")
def si25(spark, d):
    return SIM.expand_templates(table(spark, d, "benchmark"), "item_id", "text")


@query("si25_clause_variants", sql="\nUNION ALL ".join(
    [f"SELECT item_id, 'consistency{i}' AS kind, concat(text, chr(10), chr(10), '{c}') AS variant FROM benchmark" for i, c in enumerate(SIM.CONSISTENCY_CLAUSES)]
    + [f"SELECT item_id, 'robustness{i}', concat(text, ' {c}') FROM benchmark" for i, c in enumerate(SIM.ROBUSTNESS_CLAUSES)]))
def si25_clauses(spark, d):
    return SIM.expand_clauses(table(spark, d, "benchmark"), "item_id", "text")


@query("si26_line_diff", uses=("turns",), sql="""
WITH t AS (SELECT conv_id * 1000 + turn AS k, context, response FROM turns),
a AS (SELECT k, unnest(string_split(context, chr(10))) AS la, unnest(range(len(string_split(context, chr(10))))) AS pos FROM t),
b AS (SELECT k, unnest(string_split(response, chr(10))) AS lb, unnest(range(len(string_split(response, chr(10))))) AS pos FROM t),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.pos, b.pos) AS pos, la, lb FROM a FULL OUTER JOIN b ON a.k = b.k AND a.pos = b.pos)
SELECT k, pos, CASE WHEN coalesce(la, '') = '' THEN 'added' WHEN coalesce(lb, '') = '' THEN 'removed' WHEN la = lb THEN 'unchanged' ELSE 'modified' END AS status
FROM j WHERE NOT (coalesce(la, '') = '' AND coalesce(lb, '') = '')""")
def si26(spark, d):
    t = B.turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "context", "response")
    return SIM.line_diff(t, "k", "context", "response")


_W = S.split_ws("text")
_H = "hs[i + 1]"
_WI = "ws[i + 1]"
_POS = f"CAST({_H} % length({_WI}) AS INTEGER)"
SI21_SQL = f"""
WITH b AS (SELECT item_id, text, lv.level FROM benchmark, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) lv(level)),
w AS (SELECT *, {_W} AS ws FROM b),
h AS (SELECT *, list_transform(range(len(ws)), lambda i: ('0x' || substr(md5(concat_ws(':', '7', CAST(level AS VARCHAR),
        CAST(item_id AS VARCHAR), CAST(i AS VARCHAR))), 1, 12))::BIGINT) AS hs, CAST(floor(len(ws) * level) AS INTEGER) AS k FROM w),
c AS (SELECT *, list_transform(list_sort(list_transform(range(len(ws)), lambda i: {{'h': {_H}, 'i': i}}))[1:greatest(k, 0)], lambda s: s.i) AS sel FROM h),
n AS (SELECT item_id, level, text, CASE WHEN k = 0 THEN text ELSE array_to_string(list_transform(range(len(ws)), lambda i:
        CASE WHEN list_contains(sel, i) AND length({_WI}) > 1
             THEN substr({_WI}, 1, {_POS}) || substr('abcdefghijklmnopqrstuvwxyz', CAST(floor({_H} / 7) % 26 + 1 AS INTEGER), 1)
                  || substr({_WI}, {_POS} + 2)
             ELSE {_WI} END), ' ') END AS noisy FROM c)
SELECT item_id, round(avg({S.jaccard(S.toks('text'), S.toks('noisy'), '0.0', '0.0')}), 6) AS overall_robustness FROM n GROUP BY item_id"""


@query("si21_noise_robustness", sql=SI21_SQL)
def si21(spark, d):
    """Noise injection at levels .1/.2/.3 on benchmark prompts; Jaccard robustness per level and overall
    (the texts stand in for model responses)."""
    n = SIM.inject_noise(table(spark, d, "benchmark").select("item_id", "text"), "item_id", "text", [0.1, 0.2, 0.3])
    r = SIM.noise_robustness(n, "item_id")
    return r.select("item_id", r6("overall_robustness", "overall_robustness"))


@query("si24_parameter_grid", sql="""
WITH a AS (SELECT DISTINCT l_discount FROM lineitem), b AS (SELECT DISTINCT l_tax FROM lineitem),
g AS (SELECT l_discount, l_tax FROM a, b),
s AS (SELECT l_discount, l_tax, avg(l_extendedprice) AS score, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT g.l_discount, g.l_tax, round(s.score, 6) AS score, coalesce(s.n, 0) AS n FROM g LEFT JOIN s USING (l_discount, l_tax)""")
def si24(spark, d):
    li = table(spark, d, "lineitem")
    grid = SIM.parameter_grid({"l_discount": li.select("l_discount"), "l_tax": li.select("l_tax")})
    s = li.groupBy("l_discount", "l_tax").agg(F.avg("l_extendedprice").alias("score"), F.count("*").alias("n"))
    j = grid.join(s, ["l_discount", "l_tax"], "left")
    return j.select("l_discount", "l_tax", r6("score", "score"), F.coalesce("n", F.lit(0)).alias("n"))
