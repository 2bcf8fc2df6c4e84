"""Data-set cleaning, imputation, filtering, validation and profiling.

Column statistics are computed in *one* aggregation pass over all columns and
then unpivoted to a long table; imputation joins a one-row statistics frame
(a proven single-row broadcast) and applies ``coalesce``.  Validation results
are long rule tables ``(rule, severity, column, message)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordinal import exact_percentiles, mode_value, with_ordinal

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# ------------------------------------------------------------------ CL1
def normalize_text_fields(df: DataFrame) -> DataFrame:
    """strip → lower → collapse every whitespace run to one space, on every string column."""
    strs = set(string_cols(df))
    return df.select(*[
        F.regexp_replace(F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ").alias(c)
        if c in strs else F.col(c) for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas treats NaN as missing; turn NaN into NULL once at ingest."""
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in dbl else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ CL2-CL7
def handle_missing(df: DataFrame, strategy: str, values: dict | None = None) -> DataFrame:
    """drop | fill_mean | fill_median | fill_mode | fill_zero | fill_custom."""
    df = nan_to_null(df)
    if strategy == "drop":
        return df.na.drop("any")
    if strategy == "fill_zero":
        nums, strs = numeric_cols(df), string_cols(df)
        return df.na.fill(0, nums).na.fill("0", strs) if strs else df.na.fill(0, nums)
    if strategy == "fill_custom":
        return df.na.fill(values or {})
    if strategy == "fill_mean":
        cols = numeric_cols(df)
        stats = df.agg(*[F.avg(c).alias(f"_s_{c}") for c in cols])  # one row
    elif strategy == "fill_median":
        cols = numeric_cols(df)
        stats = _one_row([exact_percentiles(df, [], c, {f"_s_{c}": 0.5}) for c in cols])
    elif strategy == "fill_mode":
        cols = list(df.columns)
        stats = _one_row([mode_value(df, c).withColumnRenamed(c, f"_s_{c}") for c in cols])
    else:
        raise ValueError(f"Unsupported missing value strategy: {strategy}")
    s = stats.select(F.struct(*stats.columns).alias("s")).scalar()  # one struct-valued scalar subquery
    return df.select(*[F.coalesce(F.col(c), s[f"_s_{c}"].cast(df.schema[c].dataType)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """Side-by-side combination of one-row frames (each cross join is 1 × 1)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


# ------------------------------------------------------------------ CL8
def filter_predicate(df: DataFrame, filters: dict) -> Column:
    """Conjunctive filter map: scalar ⇒ equality; dict of ops eq/ne/gt/lt/in/not_in; unknown
    columns ignored.  ``ne`` and ``not_in`` keep NULL rows; ``eq``/``in``/``gt``/``lt`` drop them."""
    conds = []
    for col, spec in filters.items():
        if col not in df.columns:
            continue
        c = F.col(col)
        if not isinstance(spec, dict):
            conds.append(c == F.lit(spec))
            continue
        for op, v in spec.items():
            if op == "eq":
                conds.append(c == F.lit(v))
            elif op == "ne":
                conds.append(~c.eqNullSafe(F.lit(v)))
            elif op == "gt":
                conds.append(c > F.lit(v))
            elif op == "lt":
                conds.append(c < F.lit(v))
            elif op == "in":
                conds.append(c.isin(list(v)))
            elif op == "not_in":
                conds.append(F.coalesce(~c.isin(list(v)), F.lit(True)))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    return df.where(filter_predicate(df, filters))


# ------------------------------------------------------------------ CL9 / UD5
def process_dataset(df: DataFrame, normalize: bool = True, missing: str | None = None, filters: dict | None = None,
                    transforms=()) -> DataFrame:
    """normalise → impute → filter → user transforms (each ``DataFrame -> DataFrame``)."""
    if normalize:
        df = normalize_text_fields(df)
    if missing:
        df = handle_missing(df, missing)
    if filters:
        df = apply_filters(df, filters)
    for t in transforms:
        df = df.transform(t)
    return df


# ------------------------------------------------------------------ CL10
# Keys whose values are redacted in request records.
SENSITIVE_KEYS = ["password", "token", "api_key", "secret", "auth", "authorization", "x-api-key", "cookie"]


def redact_map(m) -> Column:
    keys = F.array(*[F.lit(k) for k in SENSITIVE_KEYS])
    return F.transform_values(F.col(m) if isinstance(m, str) else m,
                              lambda k, v: F.when(F.array_contains(keys, F.lower(k)), F.lit("[REDACTED]")).otherwise(v))


def redact_nested(c: Column, kind: T.DataType) -> Column:
    """Redact sensitive keys at any depth of structs, arrays and maps; a sensitive field's whole value
    becomes text.  The expression follows the schema, so it stays inside code generation."""
    hidden = F.lit("[REDACTED]")
    if isinstance(kind, T.StructType):
        fields = [(hidden if f.name.lower() in SENSITIVE_KEYS else redact_nested(c[f.name], f.dataType)).alias(f.name) for f in kind]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array(*[F.lit(k) for k in SENSITIVE_KEYS])
        text = isinstance(kind.valueType, T.StringType)
        return F.transform_values(c, lambda k, v: F.when(F.array_contains(keys, F.lower(k)), hidden if text else F.lit(None))
                                  .otherwise(redact_nested(v, kind.valueType)))
    return c


def redact_record(df: DataFrame) -> DataFrame:
    """Every column of the table through :func:`redact_nested`, sensitive columns included."""
    return df.select(*[(F.lit("[REDACTED]") if f.name.lower() in SENSITIVE_KEYS else redact_nested(F.col(f.name), f.dataType)).alias(f.name)
                       for f in df.schema])


# ------------------------------------------------------------------ VP1 / VP4 / VP5 / VP6 single pass
def table_profile(df: DataFrame, rows: bool = False) -> DataFrame:
    """(i, column, type, null_count, unique_count, n_rows): one row per column, from one scan.

    Every value goes as a narrow (column, 128-bit hash) cell through two levels of aggregation: equal
    cells are combined in the map tasks, so a value that a third of all rows share is one row of the
    shuffle, and texts never leave their task.  ``rows`` adds a line with column NULL for whole rows
    (NULLs equal); its unique_count is the number of different rows."""
    def cell(i: int, missing: Column, *values: Column) -> Column:
        return F.struct(F.lit(i).alias("i"), missing.alias("missing"), F.xxhash64(F.lit(1), *values).alias("h1"), F.xxhash64(F.lit(2), *values).alias("h2"))

    cells = [cell(i, F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for i, c in enumerate(df.columns)]
    names = [F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema)]
    if rows:  # a hash skips NULLs, so the flags tell (NULL, 1) from (1, NULL)
        flagged = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
        cells.append(cell(-1, F.lit(False), *flagged))
        names.append(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("type")))
    counted = df.select(F.inline(F.array(*cells))).groupBy("i", "missing", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    stats = counted.groupBy("i").agg(F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("null_count"),
                                     F.count_if(~F.col("missing")).alias("unique_count"), F.sum("n").alias("n_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)  # noqa: E731  an empty table has no cells
    every = df.sparkSession.range(1).select(F.inline(F.array(*names)))
    return every.join(F.broadcast(stats), "i", "left").select("i", "column", "type", zero("null_count"), zero("unique_count"), zero("n_rows"))


def column_stats(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """VP1: per column its type, nullable, null count, distinct non-null count (long table; one scan)."""
    if not approx_distinct:
        return table_profile(df).select("column", "type", (F.col("null_count") > 0).alias("nullable"), "null_count", "unique_count", "n_rows")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in df.columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls__{c}"), F.approx_count_distinct(c).alias(f"distinct__{c}")]
    cells = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                      F.col(f"nulls__{c}").alias("null_count"), F.col(f"distinct__{c}").alias("unique_count")) for c in df.columns]
    return df.agg(*aggs).select("_n", F.inline(F.array(*cells))).select(
        "column", "type", (F.col("null_count") > 0).alias("nullable"), "null_count", "unique_count", F.col("_n").alias("n_rows"))


def _findings(profile: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """(rule, severity, column, message) of each profile line and each (rule, severity, condition,
    message) whose condition holds there: all rules read one profile."""
    held = F.filter(F.array(*[F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "column", text.alias("message")))
                              for rule, severity, when, text in rules]), lambda x: x.isNotNull())
    return profile.select(F.inline(held))


def _quality_rules() -> list[tuple[str, str, Column, Column]]:
    column, whole = F.col("column").isNotNull(), F.col("column").isNull()
    rate, repeats = F.col("null_count") / F.nullif("n_rows", F.lit(0)), F.col("n_rows") - F.col("unique_count")
    return [("empty_column", "warning", column & (F.col("null_count") == F.col("n_rows")), F.concat(F.lit("Column '"), "column", F.lit("' is completely empty"))),
            ("high_missing_rate", "warning", column & (rate > 0.5),
             F.concat(F.lit("Column '"), "column", F.lit("' has high missing value rate: "), F.format_number(rate * 100, 2), F.lit("%"))),
            ("duplicates", "warning", whole & (repeats > 0), F.concat(F.lit("Found "), repeats.cast("string"), F.lit(" duplicate records")))]


def _suggestion_rules(max_rows: int) -> list[tuple[str, str, Column, Column]]:
    few = F.col("unique_count") / F.nullif("n_rows", F.lit(0)) < 0.1
    return [("categorical", "suggestion", (F.col("type") == "string") & few, F.concat(F.lit("Consider converting '"), "column", F.lit("' to categorical type"))),
            ("sample", "suggestion", F.col("column").isNull() & (F.col("n_rows") > max_rows), F.lit("Consider sampling the dataset for faster processing"))]


def _null_message(column: str) -> Column:
    return F.concat(F.lit("Column '"), F.col(column), F.lit("' contains null values but is marked as non-nullable"))


def schema_compliance(df: DataFrame, expected: dict[str, dict]) -> DataFrame:
    """VP2: missing column ⇒ error; type mismatch ⇒ warning; NULL in a non-nullable column ⇒ error.
    The schema diff is metadata only; the NULL check is one aggregation."""
    spark = df.sparkSession
    meta_rows = []
    null_checks = []
    for col, spec in expected.items():
        if col not in df.columns:
            meta_rows.append(("missing_column", "error", col, f"Required column '{col}' is missing"))
            continue
        actual = df.schema[col].dataType.simpleString()
        if spec.get("type") and spec["type"] != actual:
            meta_rows.append(("type_mismatch", "warning", col, f"Column '{col}' has type {actual}, expected {spec['type']}"))
        if not spec.get("nullable", True):
            null_checks.append(col)
    meta = spark.createDataFrame(meta_rows, "rule string, severity string, column string, message string")
    if not null_checks:
        return meta
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in null_checks])
    nulls = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in null_checks])).alias("s")) \
        .where(F.col("s.n") > 0).select(
            F.lit("null_in_non_nullable").alias("rule"), F.lit("error").alias("severity"), F.col("s.column").alias("column"),
            _null_message("s.column").alias("message"))
    return meta.unionByName(nulls)


def data_quality(df: DataFrame) -> DataFrame:
    """VP4: all-NULL columns, duplicate rows (N − distinct, NULLs equal) and missing rate > 0.5; one scan."""
    return _findings(table_profile(df, rows=True), _quality_rules())


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row (all columns, NULLs equal): Σ (count − 1)."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def suggestions(df: DataFrame, max_rows: int = 10000) -> DataFrame:
    """VP5: text column with distinct/N < 0.1 ⇒ categorical; more than ``max_rows`` rows ⇒ sample; one scan."""
    return _findings(table_profile(df, rows=True), _suggestion_rules(max_rows))


def validate_dataset(df: DataFrame, expected: dict | None = None, max_rows: int = 10000) -> DataFrame:
    """VP6: empty ⇒ one error; else VP2 + VP4 + VP5 and the row-limit warning.  All rules read one
    profile, made in one scan; what VP2 says of the schema alone needs none."""
    whole = F.col("column").isNull()
    rules = [("empty", "error", whole & (F.col("n_rows") == 0), F.lit("Dataset is empty")), *_quality_rules(), *_suggestion_rules(max_rows),
             ("row_limit", "warning", whole & (F.col("n_rows") > max_rows),
              F.concat(F.lit("Dataset has "), F.col("n_rows").cast("string"), F.lit(" rows, more than recommended")))]
    strict = [c for c, spec in (expected or {}).items() if c in df.columns and not spec.get("nullable", True)]
    rules.append(("null_in_non_nullable", "error", F.col("column").isin(strict) & (F.col("null_count") > 0), _null_message("column")))
    found = _findings(table_profile(df, rows=True), rules)
    lenient = {c: {**spec, "nullable": True} for c, spec in (expected or {}).items()}
    return schema_compliance(df, lenient).unionByName(found) if expected else found


def profile_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """VP7 numeric: mean, median (exact, distributed), sample std, min, max per column; the
    moments come from one pass, the medians from the rank-based percentile; then unpivot."""
    cols = cols or numeric_cols(df)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
                 F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
    w = _one_row([df.agg(*aggs)] + [exact_percentiles(df, [], c, {f"{c}__median": 0.5}) for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in ("mean", "median", "std", "min", "max")])
            for c in cols]
    return w.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def profile_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """VP7 text: distinct count, mode (lowest on ties), mean length per column."""
    cols = cols or string_cols(df)
    aggs = []
    for c in cols:
        aggs += [F.count_distinct(c).alias(f"{c}__nunique"), F.avg(F.length(c)).alias(f"{c}__mean_length")]
    w = _one_row([df.agg(*aggs)] + [mode_value(df, c).withColumnRenamed(c, f"{c}__mode") for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in ("nunique", "mode", "mean_length")])
            for c in cols]
    return w.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def _row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row as length-prefixed fields: no two different rows have one byte sequence."""
    fields = []
    for c in df.columns:
        v = F.col(c).cast("string")
        fields.append(F.coalesce(F.concat(F.lit("s"), F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("n")))
    return F.sha2(F.concat(*fields), 256)


def checksum(df: DataFrame) -> DataFrame:
    """VP8 for tables without an order: Σ and XOR of 60 bits of each row's digest, and the row count.
    Independent of partitioning and row order."""
    h = F.conv(F.substring(_row_digest(df), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("checksum_sum"),
                  F.bit_xor(h).alias("checksum_xor"))


CHECKSUM_FAN = 1024


def ordered_checksum(df: DataFrame, order: list[str], fan: int = CHECKSUM_FAN, height: int = 4) -> DataFrame:
    """VP8: (n, checksum), sensitive to the order of rows.

    Rows are numbered along ``order`` (then by all columns, so rows that still tie are equal).  A hash
    tree of fixed fan-out stands on the numbers: each node is the SHA-256 of its children's digests in
    order, ``height`` levels up to one root.  Nodes depend on row numbers alone, never on partitions, and a
    node holds ``fan`` digests; the root holds more only beyond fan ** height rows."""
    rest = [c for c in df.columns if c not in order]
    level = with_ordinal(df, [*order, *rest], "_i").select("_i", _row_digest(df).alias("_h"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_h"))), lambda x: x["_h"]), "")
    n = df.agg(F.count("*")).scalar()
    for _ in range(height - 1):
        level = level.groupBy(F.floor(F.col("_i") / fan).alias("_p")).agg(F.sha2(joined, 256).alias("_h")).withColumnRenamed("_p", "_i")
    return level.agg(F.sha2(joined, 256).alias("checksum")).select(n.alias("n"), "checksum")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """VP12: one row per table with its row count (a union of global counts)."""
    return reduce(lambda a, b: a.unionByName(b),
                  [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in tables.items()])
