"""Cleaning / validation / profiling queries (CL*, VP*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import r6
from ..operators import quality as Q
from ..sources import bindings as B
from ..sources.tables import TABLES, table
from . import sqlfrag as S
from .registry import query

NO = ("nulled_orders",)
WS = S.WS


def _norm_sql(c):
    return f"regexp_replace(lower({S.strip(c)}), '{WS}', ' ', 'g') AS {c}"


@query("cl1_normalize_text", sql=f"SELECT doc_id, {_norm_sql('text')}, {_norm_sql('lang')}, {_norm_sql('source')}, n_chars FROM documents")
def cl1(spark, d):
    return Q.normalize_text_fields(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("cl2_drop_missing", uses=NO, sql="""
SELECT * FROM nulled_orders WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL""")
def cl2(spark, d):
    return Q.handle_missing(B.nulled_orders(spark, d), "drop")


@query("cl3_fill_mean", uses=NO, sql="""
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM nulled_orders)), 6) AS o_totalprice,
  o_orderpriority, o_orderstatus FROM nulled_orders""")
def cl3(spark, d):
    f = Q.handle_missing(B.nulled_orders(spark, d), "fill_mean")
    return f.select("o_orderkey", r6("o_totalprice", "o_totalprice"), "o_orderpriority", "o_orderstatus")


@query("cl4_fill_median", uses=NO, sql="""
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM nulled_orders)), 6) AS o_totalprice,
  o_orderpriority, o_orderstatus FROM nulled_orders""")
def cl4(spark, d):
    f = Q.handle_missing(B.nulled_orders(spark, d), "fill_median")
    return f.select("o_orderkey", r6("o_totalprice", "o_totalprice"), "o_orderpriority", "o_orderstatus")


def _mode_sql(c):
    return f"(SELECT {c} FROM nulled_orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("cl5_fill_mode", uses=NO, sql=f"""
SELECT o_orderkey, round(coalesce(o_totalprice, {_mode_sql('o_totalprice')}), 6) AS o_totalprice,
  coalesce(o_orderpriority, {_mode_sql('o_orderpriority')}) AS o_orderpriority,
  coalesce(o_orderstatus, {_mode_sql('o_orderstatus')}) AS o_orderstatus FROM nulled_orders""")
def cl5(spark, d):
    f = Q.handle_missing(B.nulled_orders(spark, d), "fill_mode")
    return f.select("o_orderkey", r6("o_totalprice", "o_totalprice"), "o_orderpriority", "o_orderstatus")


@query("cl6_fill_zero", uses=NO, sql="""
SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice, coalesce(o_orderpriority, '0') AS o_orderpriority,
  coalesce(o_orderstatus, '0') AS o_orderstatus FROM nulled_orders""")
def cl6(spark, d):
    return Q.handle_missing(B.nulled_orders(spark, d), "fill_zero")


@query("cl7_fill_custom", uses=NO, sql="""
SELECT o_orderkey, coalesce(o_totalprice, -1.0) AS o_totalprice, coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority,
  o_orderstatus FROM nulled_orders""")
def cl7(spark, d):
    return Q.handle_missing(B.nulled_orders(spark, d), "fill_custom", {"o_totalprice": -1.0, "o_orderpriority": "UNKNOWN"})


CL8_FILTERS = {"o_orderstatus": {"ne": "F"}, "o_orderpriority": {"not_in": ["1-URGENT", "2-HIGH"]},
               "o_totalprice": {"gt": 50000.0}, "no_such_column": 5}


@query("cl8_apply_filters", uses=NO, sql="""
SELECT * FROM nulled_orders WHERE o_orderstatus IS DISTINCT FROM 'F'
  AND coalesce(o_orderpriority NOT IN ('1-URGENT', '2-HIGH'), true) AND o_totalprice > 50000.0""")
def cl8(spark, d):
    return Q.apply_filters(B.nulled_orders(spark, d), CL8_FILTERS)


@query("cl8_apply_filters_eq_in", uses=NO, sql="""
SELECT * FROM nulled_orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('3-MEDIUM', '5-LOW') AND o_totalprice < 100000.0""")
def cl8b(spark, d):
    return Q.apply_filters(B.nulled_orders(spark, d), {"o_orderstatus": "O", "o_orderpriority": {"in": ["3-MEDIUM", "5-LOW"]},
                                                       "o_totalprice": {"lt": 100000.0}})


def _add_words(df):
    return df.withColumn("n_words", F.size(F.split("text", " ")))


@query("cl9_process_dataset", sql=f"""
SELECT doc_id, lang, len(string_split(regexp_replace(lower({S.strip('text')}), '{WS}', ' ', 'g'), ' ')) AS n_words
FROM documents WHERE regexp_replace(lower({S.strip('lang')}), '{WS}', ' ', 'g') = 'en'""")
def cl9(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    out = Q.process_dataset(docs, normalize=True, missing=None, filters={"lang": "en"}, transforms=[_add_words])
    return out.select("doc_id", "lang", "n_words")


@query("cl10_redact_props", sql="""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[REDACTED]' ELSE CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS token,
  json_extract_string(props, '$.k') AS k FROM events""")
def cl10(spark, d):
    e = table(spark, d, "events")
    # A request record per event: its props plus a credential-bearing key on even events.
    m = F.from_json("props", "map<string,string>")
    m = F.when(F.col("event_id") % 2 == 0, F.map_concat(m, F.create_map(F.lit("Token"), F.col("props")))).otherwise(
        F.map_concat(m, F.create_map(F.lit("plain"), F.element_at(m, "k"))))
    r = e.select("event_id", Q.redact_map(m).alias("m"))
    return r.select("event_id", F.coalesce(F.element_at("m", "Token"), F.element_at("m", "plain")).alias("token"),
                    F.element_at("m", "k").alias("k"))


@query("cl10_redact_nested", sql="""
SELECT event_id, '[REDACTED]' AS header_token, event_type AS header_kind, '[REDACTED]' AS first_secret, user_id AS first_user,
  CASE WHEN event_id % 2 = 0 THEN '[REDACTED]' ELSE props END AS body FROM events""")
def cl10_nested(spark, d):
    """A nested request record of each event: struct, array of structs and map."""
    e = table(spark, d, "events")
    record = e.select(
        "event_id", F.struct(F.col("props").alias("Token"), F.col("event_type").alias("kind")).alias("header"),
        F.array(F.struct(F.col("value").alias("secret"), F.col("user_id").alias("user"))).alias("parts"),
        F.create_map(F.when(F.col("event_id") % 2 == 0, "Cookie").otherwise("plain"), F.col("props")).alias("body"))
    r = Q.redact_record(record)
    return r.select("event_id", F.col("header.Token").alias("header_token"), F.col("header.kind").alias("header_kind"),
                    F.element_at("parts", 1)["secret"].alias("first_secret"), F.element_at("parts", 1)["user"].alias("first_user"),
                    F.element_at(F.map_values("body"), 1).alias("body"))


def _orders_cols_sql():
    return [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("vp1_infer_schema", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS type, count_if({c} IS NULL) > 0 AS nullable, count_if({c} IS NULL) AS null_count, "
    f"count(DISTINCT {c}) AS unique_count, count(*) AS n_rows FROM orders" for c, t in _orders_cols_sql()))
def vp1(spark, d):
    return Q.column_stats(table(spark, d, "orders"))


EXPECTED = {"o_orderkey": {"type": "bigint", "nullable": False}, "o_totalprice": {"type": "double", "nullable": False},
            "o_comment": {"type": "string"}, "o_orderstatus": {"type": "int", "nullable": True},
            "o_orderpriority": {"type": "string", "nullable": True}}


@query("vp2_schema_compliance", uses=NO, sql="""
SELECT 'missing_column' AS rule, 'error' AS severity, 'o_comment' AS column, 'Required column ''o_comment'' is missing' AS message
UNION ALL SELECT 'type_mismatch', 'warning', 'o_orderstatus', 'Column ''o_orderstatus'' has type string, expected int'
UNION ALL SELECT 'null_in_non_nullable', 'error', 'o_totalprice', 'Column ''o_totalprice'' contains null values but is marked as non-nullable'
  FROM nulled_orders HAVING count_if(o_totalprice IS NULL) > 0
UNION ALL SELECT 'null_in_non_nullable', 'error', 'o_orderkey', 'Column ''o_orderkey'' contains null values but is marked as non-nullable'
  FROM nulled_orders HAVING count_if(o_orderkey IS NULL) > 0""")
def vp2(spark, d):
    return Q.schema_compliance(B.nulled_orders(spark, d), EXPECTED)


@query("vp3_column_consistency", sql="""
SELECT count(DISTINCT array_to_string(list_sort(json_keys(props)), ',')) AS n_key_sets,
  count(DISTINCT array_to_string(list_sort(json_keys(props)), ',')) = 1 AS consistent FROM events""")
def vp3(spark, d):
    e = table(spark, d, "events")
    ks = F.array_join(F.array_sort(F.json_object_keys("props")), ",")
    return e.agg(F.count_distinct(ks).alias("n_key_sets"), (F.count_distinct(ks) == 1).alias("consistent"))


@query("vp4_data_quality", uses=NO, sql="""
WITH s AS (SELECT count(*) AS n, count_if(o_orderkey IS NULL) AS a, count_if(o_totalprice IS NULL) AS b,
  count_if(o_orderpriority IS NULL) AS c, count_if(o_orderstatus IS NULL) AS d FROM nulled_orders),
l AS (SELECT 'o_orderkey' AS col, a AS k, n FROM s UNION ALL SELECT 'o_totalprice', b, n FROM s
      UNION ALL SELECT 'o_orderpriority', c, n FROM s UNION ALL SELECT 'o_orderstatus', d, n FROM s),
dup AS (SELECT coalesce(sum(cnt - 1), 0) AS dups FROM (SELECT count(*) AS cnt FROM nulled_orders GROUP BY o_orderkey, o_totalprice, o_orderpriority, o_orderstatus) t)
SELECT 'empty_column' AS rule, 'warning' AS severity, col AS column, concat('Column ''', col, ''' is completely empty') AS message FROM l WHERE k = n
UNION ALL SELECT 'high_missing_rate', 'warning', col, concat('Column ''', col, ''' has high missing value rate: ', printf('%.2f', k / n * 100), '%') FROM l WHERE k / n > 0.5
UNION ALL SELECT 'duplicates', 'warning', NULL, concat('Found ', dups, ' duplicate records') FROM dup WHERE dups > 0""")
def vp4(spark, d):
    return Q.data_quality(B.nulled_orders(spark, d))


@query("vp4_duplicate_texts", sql="""
SELECT CAST(coalesce(sum(cnt - 1), 0) AS BIGINT) AS duplicates FROM (SELECT text, lang, count(*) AS cnt FROM documents GROUP BY text, lang) t""")
def vp4_dup(spark, d):
    return Q.duplicate_rows(table(spark, d, "documents").select("text", "lang"))


@query("vp5_suggestions", sql="""
SELECT 'categorical' AS rule, 'suggestion' AS severity, col AS column, concat('Consider converting ''', col, ''' to categorical type') AS message
FROM (SELECT 'o_orderstatus' AS col, count(DISTINCT o_orderstatus) / count(*) AS r FROM orders
      UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) / count(*) FROM orders) t WHERE r < 0.1
UNION ALL SELECT 'sample', 'suggestion', NULL, 'Consider sampling the dataset for faster processing' FROM orders HAVING count(*) > 10000""")
def vp5(spark, d):
    return Q.suggestions(table(spark, d, "orders"))


@query("vp6_validate_summary", uses=NO, sql="""
WITH n AS (SELECT count(*) AS n FROM nulled_orders),
s AS (SELECT count_if(o_totalprice IS NULL) AS b, count_if(o_orderpriority IS NULL) AS c, count(*) AS n FROM nulled_orders)
SELECT 3 AS n_errors_or_warnings_base,
  (SELECT count(*) FROM (SELECT 1 WHERE (SELECT b FROM s) > 0)) + 1 AS n_errors,
  1 + (SELECT CAST(c > n / 2 AS INTEGER) + CAST(b > n / 2 AS INTEGER) FROM s) + (SELECT CAST(n > 10000 AS INTEGER) FROM n) AS n_warnings,
  (SELECT count(*) FROM (SELECT 1 WHERE (SELECT b FROM s) > 0)) + 1 = 0 AS is_valid""")
def vp6(spark, d):
    v = Q.validate_dataset(B.nulled_orders(spark, d), EXPECTED)
    return v.agg(F.lit(3).alias("n_errors_or_warnings_base"), F.count_if(F.col("severity") == "error").alias("n_errors"),
                 F.count_if(F.col("severity") == "warning").alias("n_warnings"),
                 (F.count_if(F.col("severity") == "error") == 0).alias("is_valid"))


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("vp7_profile_numeric", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, "
    f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM lineitem" for c in _LI_NUM))
def vp7n(spark, d):
    p = Q.profile_numeric(table(spark, d, "lineitem"), _LI_NUM)
    return p.select("column", *[r6(c, c) for c in ("mean", "median", "std", "min", "max")])


@query("vp7_profile_text", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS nunique, "
    f"(SELECT {c} FROM part GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode, round(avg(length({c})), 6) AS mean_length FROM part"
    for c in ("p_brand", "p_type", "p_name")))
def vp7t(spark, d):
    p = Q.profile_text(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])
    return p.select("column", "nunique", "mode", r6("mean_length", "mean_length"))


def _digest_sql(cols):
    return "sha256(concat(" + ", ".join(f"coalesce('s' || strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in cols) + "))"


_VP8 = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("vp8_checksum", sql=f"""
WITH h AS (SELECT CAST('0x' || substr({_digest_sql(_VP8)}, 1, 15) AS BIGINT) AS h FROM orders)
SELECT count(*) AS n, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS checksum_sum, bit_xor(h) AS checksum_xor FROM h""")
def vp8(spark, d):
    return Q.checksum(table(spark, d, "orders").select(*_VP8))


@query("vp8_ordered_checksum", uses=NO, sql=f"""
WITH l0 AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, {_digest_sql(("o_orderkey", "o_orderpriority", "o_orderstatus"))} AS h FROM nulled_orders),
l1 AS (SELECT k AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM (SELECT *, i // 1024 AS k FROM l0) t GROUP BY k),
l2 AS (SELECT k AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM (SELECT *, i // 1024 AS k FROM l1) t GROUP BY k),
l3 AS (SELECT k AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM (SELECT *, i // 1024 AS k FROM l2) t GROUP BY k)
SELECT (SELECT count(*) FROM nulled_orders) AS n, sha256(string_agg(h, '' ORDER BY i)) AS checksum FROM l3""")
def vp8_ordered(spark, d):
    return Q.ordered_checksum(B.nulled_orders(spark, d).select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderkey"])


@query("vp9_metric_inputs", uses=("eval_pairs",), sql="""
WITH p AS (SELECT pair_id, pred FROM eval_pairs WHERE pair_id % 13 <> 0), r AS (SELECT pair_id, ref FROM eval_pairs)
SELECT count(*) AS n_keys, count_if(p.pair_id IS NULL OR r.pair_id IS NULL) AS n_unmatched,
  count_if(pred IS NULL AND p.pair_id IS NOT NULL) AS n_null_pred, count_if(ref IS NULL AND r.pair_id IS NOT NULL) AS n_null_ref,
  count_if(pred = '') AS n_empty_pred FROM p FULL OUTER JOIN r ON p.pair_id = r.pair_id""")
def vp9(spark, d):
    ep = B.eval_pairs(spark, d)
    p = ep.where(F.col("pair_id") % 13 != 0).select(F.col("pair_id").alias("pk"), "pred")
    r = ep.select(F.col("pair_id").alias("rk"), "ref")
    j = p.join(r, F.col("pk") == F.col("rk"), "full_outer")
    return j.agg(F.count("*").alias("n_keys"), F.count_if(F.col("pk").isNull() | F.col("rk").isNull()).alias("n_unmatched"),
                 F.count_if(F.col("pred").isNull() & F.col("pk").isNotNull()).alias("n_null_pred"),
                 F.count_if(F.col("ref").isNull() & F.col("rk").isNotNull()).alias("n_null_ref"),
                 F.count_if(F.col("pred") == "").alias("n_empty_pred"))


@query("vp10_metric_result_validation", uses=("eval_results",), sql="""
WITH m AS (SELECT metric, count_if(score < 0 OR score > 1) AS n_out_of_range, avg(score) AS mean, stddev_samp(score) AS sd, count(score) AS n
           FROM eval_results GROUP BY metric),
c AS (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE greatest(0.0, mean - 1.96 * sd / sqrt(n)) END AS lo,
             CASE WHEN n < 2 THEN 1.0 ELSE least(1.0, mean + 1.96 * sd / sqrt(n)) END AS hi FROM m)
SELECT metric, n_out_of_range, lo <= hi AND lo >= 0 AND hi <= 1 AS ci_valid, n_out_of_range = 0 AND lo <= hi AND lo >= 0 AND hi <= 1 AS valid FROM c""")
def vp10(spark, d):
    from ..operators.rollups import metric_confidence
    er = B.eval_results(spark, d)
    oor = er.groupBy("metric").agg(F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("n_out_of_range"))
    ci = metric_confidence(er, ["metric"])
    ok = (F.col("ci_low") <= F.col("ci_high")) & (F.col("ci_low") >= 0) & (F.col("ci_high") <= 1)
    return oor.join(ci, "metric").select("metric", "n_out_of_range", ok.alias("ci_valid"),
                                         ((F.col("n_out_of_range") == 0) & ok).alias("valid"))


# Strategies a variant may be generated by.
KNOWN_STRATEGIES = ["ape", "stable", "custom", "evolutionary", "beam", "paraphrase", "mutation", "crossover"]


@query("vp11_variant_validation", uses=("variants",), sql=f"""
WITH r AS (SELECT id, strategy, quality_score, length({S.strip('content')}) >= 10 AS content_ok,
  strategy IN ({', '.join(repr(s) for s in KNOWN_STRATEGIES)}) AS strategy_ok, quality_score BETWEEN 0 AND 1 AS score_ok FROM variants)
SELECT strategy, count(*) AS n, count_if(NOT content_ok) AS bad_content, count_if(NOT strategy_ok) AS bad_strategy,
  count_if(NOT score_ok) AS bad_score, round(stddev_pop(quality_score), 6) AS score_std, round(avg(quality_score), 6) AS score_mean,
  stddev_pop(quality_score) < 0.1 AND avg(quality_score) < 0.6 AS advice_low_spread FROM r GROUP BY strategy""")
def vp11(spark, d):
    from ..operators.pair_metrics import strip_ws
    v = B.variants(spark, d)
    r = v.select("id", "strategy", "quality_score", (F.length(strip_ws("content")) >= 10).alias("content_ok"),
                 F.col("strategy").isin(KNOWN_STRATEGIES).alias("strategy_ok"),
                 F.col("quality_score").between(0, 1).alias("score_ok"))
    return r.groupBy("strategy").agg(
        F.count("*").alias("n"), F.count_if(~F.col("content_ok")).alias("bad_content"),
        F.count_if(~F.col("strategy_ok")).alias("bad_strategy"), F.count_if(~F.col("score_ok")).alias("bad_score"),
        r6(F.stddev_pop("quality_score"), "score_std"), r6(F.avg("quality_score"), "score_mean"),
        ((F.stddev_pop("quality_score") < 0.1) & (F.avg("quality_score") < 0.6)).alias("advice_low_spread"))


@query("vp12_table_counts", sql=" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES))
def vp12(spark, d):
    return Q.table_counts({t: table(spark, d, t) for t in TABLES})
