"""Source / sink queries (IO*): each writes derived data to the shared scratch area and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import r6
from ..sources import bindings as B
from ..sources import io as IO
from ..sources.tables import table
from .registry import query

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@query("io1_csv_roundtrip", sql="SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents")
def io1(spark, d):
    p = IO.write_csv(table(spark, d, "documents"), IO.new_scratch(spark, "docs-csv"))
    back = IO.load_csv(spark, p, DOC_SCHEMA, multi_line=True)
    return back.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


@query("io2_json_scan", sql="""
SELECT event_type, count(*) AS n, round(sum(value), 6) AS total_value, max(ts) AS last_ts FROM events GROUP BY event_type""")
def io2(spark, d):
    p = IO.write_json_array(table(spark, d, "events"), IO.new_scratch(spark, "events-json"))
    back = IO.load_json(spark, p, EVENT_SCHEMA)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), "total_value"), F.max("ts").alias("last_ts"))


@query("io3_jsonl_strict", sql="SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def io3(spark, d):
    p = IO.write_jsonl(table(spark, d, "events"), IO.new_scratch(spark, "events-jsonl"))
    return IO.load_jsonl(spark, p, EVENT_SCHEMA, strict=True).groupBy("user_id").agg(F.count("*").alias("n"))


@query("io3_jsonl_lenient", sql="""
SELECT count_if(event_id % 50 = 0) AS bad_lines, count_if(event_id % 50 <> 0) AS good_lines FROM events""")
def io3b(spark, d):
    e = table(spark, d, "events")
    lines = e.select(F.when(F.col("event_id") % 50 == 0, F.lit("{not json")).otherwise(
        F.to_json(F.struct("event_id", "user_id", "event_type", "value"))).alias("value"))
    p = IO.new_scratch(spark, "events-dirty")
    lines.write.mode("overwrite").text(p)
    back = IO.load_jsonl(spark, p, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, _corrupt_record STRING",
                         strict=False)
    # Spark refuses queries that read only the corrupt-record column, so the id is referenced too.
    bad = F.col("_corrupt_record").isNotNull() & (F.col("event_id").isNull() | F.col("event_id").isNotNull())
    return back.agg(F.count_if(bad).alias("bad_lines"), F.count_if(~bad).alias("good_lines"))


@query("io4_parquet_roundtrip", sql="""
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 4) AS revenue FROM lineitem GROUP BY l_returnflag""")
def io4(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_shipdate")
    p = IO.write_parquet(li, IO.new_scratch(spark, "li-parquet"), partition_by=["l_returnflag"])
    back = IO.load_parquet(spark, p)
    return back.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 4).alias("revenue"))


@query("io5_load_dataset", sql="""
SELECT fmt, count(*) AS n FROM (SELECT 'csv' AS fmt FROM documents UNION ALL SELECT 'jsonl' FROM documents
  UNION ALL SELECT 'parquet' FROM documents UNION ALL SELECT 'json' FROM documents) t GROUP BY fmt""")
def io5(spark, d):
    docs = table(spark, d, "documents")
    base = IO.new_scratch(spark, "dispatch")
    out = None
    for fmt, ext, writer in (("csv", ".csv", IO.write_csv), ("jsonl", ".jsonl", IO.write_jsonl),
                             ("parquet", ".parquet", IO.write_parquet), ("json", ".data", IO.write_json_array)):
        p = writer(docs, f"{base}/docs{ext}")
        # ".data" is not a known extension: it falls back to JSON
        df = IO.load_dataset(spark, p, None, DOC_SCHEMA if fmt != "parquet" else None, multi_line=True)
        c = df.agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"))
        out = c if out is None else out.unionByName(c)
    return out


@query("io6_export_logs_csv", uses=("logs",), sql="""
SELECT id, level, message, metadata FROM logs ORDER BY "timestamp" DESC, id DESC""")
def io6(spark, d):
    lg = B.logs(spark, d).orderBy(F.col("timestamp").desc(), F.col("id").desc()).select("id", "level", "message", "metadata")
    p = IO.write_csv(lg, IO.new_scratch(spark, "logs-csv"))
    return IO.load_csv(spark, p, "id BIGINT, level STRING, message STRING, metadata STRING", multi_line=True)


@query("io7_request_log_csv", uses=("prompt_logs",), sql="""
WITH p AS (SELECT request_id, concat(prompt, ' ', prompt, ' ', prompt) AS prompt, response, model, session_id FROM prompt_logs)
SELECT request_id, CASE WHEN length(prompt) > 100 THEN concat(substr(prompt, 1, 100), '...') ELSE prompt END AS prompt,
  CASE WHEN length(response) > 100 THEN concat(substr(response, 1, 100), '...') ELSE response END AS response,
  concat(model, ',', session_id) AS tags FROM p""")
def io7(spark, d):
    pl = B.prompt_logs(spark, d).select("request_id", F.concat("prompt", F.lit(" "), F.col("prompt"), F.lit(" "), F.col("prompt")).alias("p3"),
                                        "response", F.array("model", "session_id").alias("tags"))
    pl = pl.withColumnRenamed("p3", "prompt")
    proj = IO.request_log_csv_projection(pl)
    p = IO.write_csv(proj, IO.new_scratch(spark, "reqlog-csv"))
    return IO.load_csv(spark, p, "request_id BIGINT, prompt STRING, response STRING, tags STRING", multi_line=True).select(
        "request_id", "prompt", "response", "tags")


@query("io8_nested_export", uses=("logs",), sql="""
SELECT id AS request_id, message AS prompt, category AS model, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS max_tokens,
  CAST(json_extract_string(metadata, '$.temperature') AS DOUBLE) AS temperature FROM logs""")
def io8(spark, d):
    lg = B.logs(spark, d).select(F.col("id").alias("request_id"), F.col("message").alias("prompt"), F.col("category").alias("model"),
                                 F.regexp_replace("metadata", '"k"', '"max_tokens"').alias("metadata"), F.lit(None).cast("string").alias("response"))
    n = IO.nested_request_export(lg)
    p = IO.write_jsonl(n, IO.new_scratch(spark, "nested-json"))
    back = spark.read.schema(n.schema).json(p)
    return back.select("request_id", F.col("prompt_inputs.prompt").alias("prompt"), F.col("llm_kwargs.model").alias("model"),
                       F.col("llm_kwargs.max_tokens").alias("max_tokens"), F.col("llm_kwargs.temperature").alias("temperature"))


@query("io9_json_export_count", uses=("prompt_logs",), sql="""
SELECT count(*) AS count, CAST(sum(request_id) AS BIGINT) AS id_sum FROM prompt_logs
WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AND "timestamp" <= TIMESTAMP '2024-01-31 00:00:00'""")
def io9(spark, d):
    now = F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")
    pl = B.prompt_logs(spark, d).where((F.col("timestamp") >= now - F.expr("INTERVAL 7 DAYS")) & (F.col("timestamp") <= now))
    p = IO.write_jsonl(pl, IO.new_scratch(spark, "export-json"))
    back = spark.read.schema(pl.schema).json(p)
    return back.agg(F.count("*").alias("count"), F.sum("request_id").alias("id_sum"))


@query("io10_flatten_results", uses=("eval_results",), sql="""
SELECT case_id, sample_index, variant_id, round(max(CASE WHEN metric = 'exact_match' THEN score END), 6) AS exact_match,
  round(max(CASE WHEN metric = 'bleu' THEN score END), 6) AS bleu, round(max(CASE WHEN metric = 'rouge' THEN score END), 6) AS rouge
FROM eval_results GROUP BY case_id, sample_index, variant_id""")
def io10(spark, d):
    f = IO.flatten_results(B.eval_results(spark, d), ["case_id", "sample_index", "variant_id"], "metric", "score", list(B.METRICS))
    p = IO.write_csv(f, IO.new_scratch(spark, "flat-csv"))
    back = IO.load_csv(spark, p, "case_id BIGINT, sample_index INT, variant_id BIGINT, exact_match DOUBLE, bleu DOUBLE, rouge DOUBLE")
    return back.select("case_id", "sample_index", "variant_id", *[r6(c, c) for c in B.METRICS])


@query("io11_run_export", uses=("eval_results",), sql="""
SELECT run_id, count(*) AS n_results, round(avg(score), 6) AS average_score, count_if(NOT success) AS failed FROM eval_results GROUP BY run_id""")
def io11(spark, d):
    """Summaries and results are two row files keyed by run, so a run of any size is never one row."""
    er = B.eval_results(spark, d)
    results = er.select("run_id", "case_id", "metric", "score", "success")
    rows = IO.write_jsonl(results, IO.new_scratch(spark, "run-results-json"))
    runs = er.groupBy("run_id").agg(F.count("*").alias("n_results"), F.avg("score").alias("average_score"),
                                    F.count_if(~F.col("success")).alias("failed"))
    heads = spark.read.schema(runs.schema).json(IO.write_jsonl(runs, IO.new_scratch(spark, "runs-json")))
    written = spark.read.schema(results.schema).json(rows).groupBy("run_id").agg(F.count("*").alias("n_results"))
    return heads.drop("n_results").join(written, "run_id").select("run_id", "n_results", r6("average_score", "average_score"), "failed")


@query("io12_prompt_export", uses=("prompts", "prompt_variants"), sql="""
SELECT p.id, p.title, count(v.id) AS n_variants FROM prompts p LEFT JOIN prompt_variants v ON v.prompt_id = p.id AND v.deleted_at IS NULL
GROUP BY p.id, p.title""")
def io12(spark, d):
    p = B.prompts(spark, d).select("id", "title", "content")
    v = B.prompt_variants(spark, d).where(F.col("deleted_at").isNull()).select(F.col("prompt_id").alias("id"), F.col("id").alias("vid"), "performance_score")
    # Prompts and their variants are two row files keyed by prompt.
    heads = spark.read.schema(p.schema).json(IO.write_jsonl(p, IO.new_scratch(spark, "prompt-export")))
    rows = spark.read.schema(v.schema).json(IO.write_jsonl(v, IO.new_scratch(spark, "variant-export")))
    n = rows.groupBy("id").agg(F.count("*").alias("n_variants"))
    return heads.join(n, "id", "left").select("id", "title", F.coalesce("n_variants", F.lit(0)).alias("n_variants"))


@query("io12_text_export", uses=("prompts", "prompt_variants"), sql="""
WITH v AS (SELECT v.*, row_number() OVER (PARTITION BY prompt_id ORDER BY v.created_at, v.id) AS i FROM prompt_variants v)
SELECT id, 0 AS part, concat('Title: ', title, chr(10), chr(10), 'Description: N/A', chr(10), chr(10), 'Tags: ', array_to_string(tags, ', '), chr(10), chr(10),
  'Model Type: ', model_type, chr(10), chr(10), 'Content:', chr(10), content, chr(10)) AS text FROM prompts
UNION ALL
SELECT p.id, CAST(i AS INTEGER), concat(CASE WHEN i = 1 THEN concat(chr(10), chr(10), 'Variants:', chr(10)) ELSE '' END, CASE WHEN v.deleted_at IS NULL THEN concat(chr(10),
  '--- Variant ', i, ' ---', chr(10), 'Strategy: ', strategy, chr(10), 'Performance: ', CASE WHEN coalesce(performance_score, 0) = 0 THEN 'N/A' ELSE CAST(performance_score AS VARCHAR) END,
  chr(10), 'Content:', chr(10), 'variant ', v.id, chr(10)) ELSE '' END)
FROM v JOIN prompts p ON p.id = v.prompt_id WHERE v.deleted_at IS NULL OR i = 1""")
def io12_text(spark, d):
    """Prompts and variants as text files, written in order; the parts are returned."""
    p = B.prompts(spark, d).withColumn("description", F.lit(None).cast("string"))
    v = B.prompt_variants(spark, d).withColumn("content", F.concat(F.lit("variant "), F.col("id").cast("string")))
    parts = IO.prompt_text_parts(p, v)
    IO.write_text_parts(parts, IO.new_scratch(spark, "prompt-text"))
    return parts


@query("io13_import_prompts", sql=f"""
WITH r AS (SELECT CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS title, text AS content,
  concat(source, ' ', lang) AS description, list_filter(regexp_split_to_array(lower(text), '[\\s\\x{{00A0}}]+'), lambda w: w <> '') AS tags FROM documents)
SELECT title, md5(content) AS content_md5, description, CAST(len(tags) AS INTEGER) AS n_tags, 'gpt-4' AS model_type FROM r WHERE coalesce(title, '') <> '' AND coalesce(content, '') <> ''""")
def io13(spark, d):
    from ..functions.tokens import tokens
    docs = table(spark, d, "documents")
    raw = docs.select(F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("text")).alias("title"),
                      F.col("text").alias("content"), F.concat("source", F.lit(" "), F.col("lang")).alias("description"),
                      tokens("text").alias("tags"), F.lit(None).cast("string").alias("model_type"))
    imp = IO.import_rows(raw)
    return imp.select("title", F.md5("content").alias("content_md5"), "description", F.size("tags").alias("n_tags"), "model_type")


@query("io14_head_sample", sql="SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def io14(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(5)


@query("io15_append_examples", sql="""
SELECT count(*) AS n, count_if(output IS NULL) AS n_without_output FROM
  (SELECT text AS input, lang AS output FROM documents UNION ALL SELECT text AS input, NULL AS output FROM benchmark) t""")
def io15(spark, d):
    base = table(spark, d, "documents").select(F.col("text").alias("input"), F.col("lang").alias("output"))
    new = table(spark, d, "benchmark").select(F.col("text").alias("input"))
    a = IO.append_examples(base, new)
    return a.agg(F.count("*").alias("n"), F.count_if(F.col("output").isNull()).alias("n_without_output"))
