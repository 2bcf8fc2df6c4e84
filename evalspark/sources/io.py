"""Readers and writers.

Readers take explicit schemas where the library owns the table; schema
inference happens only at the ingest edge.  Writers are plain DataFrame
writers (CSV / JSON Lines / Parquet, optionally partitioned).  Intermediate
outputs live under the shared checkpoint folder (``scratch_path``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import with_group_rank
from ..session import scratch_path

# File extensions and the format each one selects; anything else reads as JSON.
EXTENSION_FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}
SUPPORTED = ("csv", "json", "jsonl", "parquet")
# Timestamps keep their microseconds in text formats (Spark's default pattern stops at milliseconds).
TS_OPTS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def new_scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------------ IO1–IO5
def load_csv(spark: SparkSession, path: str, schema=None, encoding: str = "utf-8", header: bool = True, multi_line: bool = False) -> DataFrame:
    """Files are split over tasks.  ``multi_line`` is for files whose quoted fields hold line breaks: those are
    read by one task a file, and without it such records come out torn."""
    r = (spark.read.options(**TS_OPTS).option("header", header).option("encoding", encoding).option("multiLine", multi_line)
         .option("escape", '"').option("quote", '"'))
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def load_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON document whose root is a list of records, or one record (read as a one-row list)."""
    r = spark.read.options(**TS_OPTS).option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def load_jsonl(spark: SparkSession, path: str, schema=None, strict: bool = True) -> DataFrame:
    """JSON Lines; blank lines are skipped.  ``strict`` fails the job on a malformed line
    (FAILFAST); otherwise malformed lines are kept in ``_corrupt_record``."""
    r = spark.read.options(**TS_OPTS).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        r = r.option("columnNameOfCorruptRecord", "_corrupt_record")
    return (r.schema(schema) if schema is not None else r).json(path)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def detect_format(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    return EXTENSION_FORMATS.get(ext, "json")


def load_dataset(spark: SparkSession, path: str, fmt: str | None = None, schema=None, multi_line: bool = False) -> DataFrame:
    """Dispatch on the format (given, or from the extension; unknown extensions read as JSON).
    ``multi_line`` goes to the CSV reader."""
    fmt = (fmt or detect_format(path)).lower()
    if fmt not in SUPPORTED:
        raise ValueError(f"Unsupported format: {fmt}")
    if fmt == "csv":
        return load_csv(spark, path, schema, multi_line=multi_line)
    if fmt == "json":
        return load_json(spark, path, schema)
    if fmt == "jsonl":
        return load_jsonl(spark, path, schema)
    return load_parquet(spark, path)


# ------------------------------------------------------------------ writers
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).options(**TS_OPTS).option("header", True).option("escape", '"').option("quote", '"').csv(path)
    return path


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).options(**TS_OPTS).json(path)
    return path


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite", most_chars: int = 32 << 20) -> str:
    """JSON documents whose root is a list of records (the shape ``load_json`` reads), a file each.  A task
    closes a document once its records pass ``most_chars`` characters, so neither writing nor reading
    holds a whole partition, and nothing passes through the driver."""
    lines = df.select(F.to_json(F.struct(*df.columns), TS_OPTS).alias("j"))

    def to_docs(batches):
        import pandas as pd
        parts, held = [], 0
        for b in batches:
            for record in b["j"]:
                parts.append(record)
                held += len(record) + 1
                if held > most_chars:
                    yield pd.DataFrame({"value": ["[" + ",".join(parts) + "]"]})
                    parts, held = [], 0
        if parts:
            yield pd.DataFrame({"value": ["[" + ",".join(parts) + "]"]})

    lines.mapInPandas(to_docs, "value string").write.mode(mode).option("maxRecordsPerFile", 1).text(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# ------------------------------------------------------------------ IO6–IO13 projections
def prompt_text_parts(prompts: DataFrame, variants: DataFrame) -> DataFrame:
    """IO12 text form: (id, part, text).  Part 0 is the prompt (title, description, tags, model type,
    content), part i its i-th variant by (created_at, id); deleted variants are numbered but not written.
    The parts of a prompt in order are its text file; no group of variants is gathered in one row.

    ``prompts``: id, title, content, description, tags, model_type; ``variants``: id, prompt_id, strategy,
    performance_score, content, created_at, deleted_at."""
    head = F.concat(F.lit("Title: "), "title", F.lit("\n\nDescription: "), F.coalesce(F.nullif("description", F.lit("")), F.lit("N/A")),
                    F.lit("\n\nTags: "), F.array_join("tags", ", "), F.lit("\n\nModel Type: "), "model_type", F.lit("\n\nContent:\n"), "content", F.lit("\n"))
    numbered = with_group_rank(variants.join(prompts.select(F.col("id").alias("prompt_id")), "prompt_id", "left_semi"),
                               ["prompt_id"], ["created_at", "id"], "_r")
    score = F.when(F.coalesce("performance_score", F.lit(0.0)) == 0, F.lit("N/A")).otherwise(F.col("performance_score").cast("string"))
    number = (F.col("_r") + 1).cast("int")
    first = F.when(number == 1, F.lit("\n\nVariants:\n")).otherwise("")
    block = F.concat(F.lit("\n--- Variant "), number.cast("string"), F.lit(" ---\nStrategy: "), F.coalesce("strategy", F.lit("None")),
                     F.lit("\nPerformance: "), score, F.lit("\nContent:\n"), F.coalesce("content", F.lit("None")), F.lit("\n"))
    body = F.concat(first, F.when(F.col("deleted_at").isNull(), block).otherwise(""))
    parts = numbered.select(F.col("prompt_id").alias("id"), number.alias("part"), body.alias("text")).where("text <> ''")
    return prompts.select("id", F.lit(0).alias("part"), head.alias("text")).unionByName(parts)


def write_text_parts(parts: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Text files with the parts in (id, part) order: range-partitioned, so files follow one another.
    Every part ends in a line break, which the writer adds."""
    (parts.repartitionByRange("id", "part").sortWithinPartitions("id", "part")
     .select(F.regexp_replace("text", "\n$", "").alias("text")).write.mode(mode).text(path))
    return path


def shorten(c, n: int = 100) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def request_log_csv_projection(df: DataFrame) -> DataFrame:
    """IO7: prompt / response cut to 100 chars + '...' when longer; tags comma-joined."""
    cols = [F.col(c) for c in df.columns if c not in ("prompt", "response", "tags")]
    return df.select(*cols, shorten("prompt").alias("prompt"), shorten("response").alias("response"),
                     F.array_join("tags", ",").alias("tags"))


def nested_request_export(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """IO8: prompt inputs and model kwargs (model, temperature, max_tokens taken out of metadata)."""
    m = F.col(metadata)
    return df.select(
        "request_id", F.struct(F.col("prompt").alias("prompt")).alias("prompt_inputs"),
        F.struct(F.col("model").alias("model"),
                 F.get_json_object(m, "$.temperature").cast("double").alias("temperature"),
                 F.get_json_object(m, "$.max_tokens").cast("bigint").alias("max_tokens")).alias("llm_kwargs"),
        "response")


def flatten_results(facts: DataFrame, ids: list[str], metric: str, score: str, metrics: list[str]) -> DataFrame:
    """IO10: one row per example, one column per evaluator (pivot with the metric list given;
    ``max`` keeps it deterministic when an example key repeats)."""
    return facts.groupBy(*ids).pivot(metric, metrics).agg(F.max(score))


def import_rows(df: DataFrame, max_title: int | None = None, max_content: int | None = None,
                max_description: int | None = None, max_tags: int | None = None) -> DataFrame:
    """IO13: rows without title or content are skipped; model_type defaults to 'gpt-4'.  Fields are
    taken whole unless a bound is asked for (the reference's are 200, 10 000, 1 000 and 10)."""
    cut = lambda c, n: (F.substring(c, 1, n) if n else F.col(c)).alias(c)
    ok = F.coalesce(F.col("title"), F.lit("")) != ""
    ok = ok & (F.coalesce(F.col("content"), F.lit("")) != "")
    return df.where(ok).select(
        cut("title", max_title), cut("content", max_content), cut("description", max_description),
        (F.slice("tags", 1, max_tags) if max_tags else F.col("tags")).alias("tags"),
        F.coalesce(F.col("model_type"), F.lit("gpt-4")).alias("model_type"))


def append_examples(base: DataFrame, new: DataFrame, required: tuple[str, ...] = ("input",)) -> DataFrame:
    """IO15: schema check (required columns present) and ``unionByName`` allowing missing columns."""
    for r in required:
        if r not in new.columns:
            raise ValueError(f"Example is missing required field '{r}'")
    return base.unionByName(new, allowMissingColumns=True)
