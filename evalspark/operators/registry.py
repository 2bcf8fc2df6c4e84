"""Registry queries over prompts, variants and optimisation sessions.

Child tables are aggregated *before* they are joined to the parents (one
left join per child instead of the reference's per-row lookups); paging is
``orderBy(..).offset(..).limit(..)`` with an id tie-break so pages are stable;
top-n per group uses ``row_number`` ≤ n, which Spark plans with a partial
``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sort fields the listing endpoints accept; anything else sorts by created_at.
PROMPT_SORT_FIELDS = ["created_at", "updated_at", "title", "best_score"]
ACTIVE_SESSION_STATUSES = ["running", "pending"]


def live(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted).isNull())


def search_prompts(prompts: DataFrame, best: DataFrame | None = None, *, owner=None, query: str | None = None,
                   tags: list[str] | None = None, model_type: str | None = None, date_from=None, date_to=None,
                   min_score: float | None = None, text_cols=("title", "content")) -> DataFrame:
    """RG1: owner, not deleted, ILIKE over the text columns, *all* tags contained, model equality,
    inclusive date range, minimum best score (``best``: prompt_id → best_score)."""
    conds = [F.col("deleted_at").isNull()]
    if owner is not None:
        conds.append(F.col("created_by") == F.lit(owner))
    if query:
        pat = f"%{query}%"
        conds.append(reduce(lambda a, b: a | b, [F.col(c).ilike(pat) for c in text_cols]))
    for t in tags or []:
        conds.append(F.array_contains("tags", F.lit(t)))
    if model_type is not None:
        conds.append(F.col("model_type") == F.lit(model_type))
    if date_from is not None:
        conds.append(F.col("created_at") >= F.lit(date_from))
    if date_to is not None:
        conds.append(F.col("created_at") <= F.lit(date_to))
    out = prompts.where(reduce(lambda a, b: a & b, conds))
    if min_score is not None and best is not None:
        out = out.join(best.where(F.col("best_score") >= min_score).select(F.col("prompt_id").alias("id")), "id", "left_semi")
    return out


def variant_rollup(variants: DataFrame) -> DataFrame:
    """Per prompt over live variants: count and best (max) score."""
    return live(variants).groupBy("prompt_id").agg(F.count("*").alias("variant_count"),
                                                    F.max("performance_score").alias("best_score"))


def list_prompts(prompts: DataFrame, variants: DataFrame, sessions: DataFrame, sort_by: str = "created_at",
                 desc: bool = True, offset: int = 0, limit: int = 20) -> DataFrame:
    """RG2: live prompts with variant count, session count and best score; sorted and paged."""
    vr = variant_rollup(variants).withColumnRenamed("prompt_id", "id")
    sr = sessions.groupBy(F.col("prompt_id").alias("id")).agg(F.count("*").alias("session_count"))
    j = live(prompts).join(vr, "id", "left").join(sr, "id", "left").select(
        "*", F.coalesce("variant_count", F.lit(0)).alias("n_variants"),
        F.coalesce("session_count", F.lit(0)).alias("n_sessions")).drop("variant_count", "session_count")
    field = sort_by if sort_by in PROMPT_SORT_FIELDS and sort_by in j.columns else "created_at"
    o = F.col(field).desc() if desc else F.col(field).asc()
    idc = F.col("id").desc() if desc else F.col("id").asc()
    return j.orderBy(o, idc).offset(offset).limit(limit)


def flag_best_variants(variants: DataFrame) -> DataFrame:
    """RG3: ``is_best`` = score equals the max truthy score of the prompt (ties all flagged).
    The per-prompt max is a partial aggregation joined back on the prompt (no window holding a
    whole prompt's variants in one task)."""
    best = variants.groupBy("prompt_id").agg(
        F.max(F.when(F.col("performance_score") != 0, F.col("performance_score"))).alias("_best"))
    return (variants.join(best, "prompt_id", "left")
            .withColumn("is_best", F.coalesce(F.col("performance_score") == F.col("_best"), F.lit(False))).drop("_best"))


def top_tags(prompts: DataFrame, n: int = 10) -> DataFrame:
    """RG6: most frequent tags (ties by tag)."""
    return (live(prompts).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))
            .orderBy(F.col("count").desc(), "tag").limit(n))


def soft_delete(prompts: DataFrame, variants: DataFrame, sessions: DataFrame, ids: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """RG8: soft-delete the requested prompts unless they have an active session; cascade to
    their variants.  Semi/anti joins; returns the new versions of both tables."""
    active = sessions.where(F.col("status").isin(ACTIVE_SESSION_STATUSES)).select(F.col("prompt_id").alias("id")).distinct()
    deletable = ids.join(active, "id", "left_anti").withColumn("_del", F.lit(True))
    ts = F.lit(at) if not isinstance(at, Column) else at
    p = (prompts.join(deletable, "id", "left")
         .withColumn("deleted_at", F.when(F.col("_del") & F.col("deleted_at").isNull(), ts).otherwise(F.col("deleted_at")))
         .drop("_del"))
    dv = deletable.withColumnRenamed("id", "prompt_id")
    v = (variants.join(dv, "prompt_id", "left")
         .withColumn("deleted_at", F.when(F.col("_del") & F.col("deleted_at").isNull(), ts).otherwise(F.col("deleted_at")))
         .drop("_del"))
    return p, v


def apply_updates(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """RG10: rows of ``changes`` replace the base rows with the same key (left anti + union)."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def page(df: DataFrame, sort: str, allowed: list[str], default: str, desc: bool, offset: int, limit: int,
         key: str) -> DataFrame:
    """RG11 / RG12 / RG13: whitelisted sort with a stable tie-break, then one page."""
    field = sort if sort in allowed else default
    o = F.col(field).desc() if desc else F.col(field).asc()
    k = F.col(key).desc() if desc else F.col(key).asc()
    return df.orderBy(o, k).offset(offset).limit(limit)


def shorten(c, max_len: int = 100, keep: int = 97) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(col) > max_len, F.concat(F.substring(col, 1, keep), F.lit("..."))).otherwise(col)


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """RG14: first n rows per group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def batch_status(sessions: DataFrame, batch: str = "batch_id") -> DataFrame:
    """RG15: status counts per batch; progress = (100·completed + running·avg active progress)/total;
    batch status completed / failed / running / partial."""
    st = F.col("status")
    g = sessions.groupBy(batch).agg(
        F.count("*").alias("total_jobs"), F.count_if(st == "completed").alias("completed"),
        F.count_if(st == "failed").alias("failed"), F.count_if(st == "running").alias("running"),
        F.count_if(st.isin("running", "queued")).alias("_active"),
        F.count_if((st == "running") & (F.col("progress") > 0)).alias("_wp"),
        F.avg(F.when((st == "running") & (F.col("progress") > 0), F.col("progress"))).alias("_ap"))
    prog = (F.when(F.col("_wp") > 0, (F.col("completed") * 100 + F.col("running") * F.col("_ap")) / F.col("total_jobs"))
             .when(F.col("completed") > 0, F.col("completed") / F.col("total_jobs") * 100).otherwise(F.lit(0.0)))
    status = (F.when(F.col("completed") == F.col("total_jobs"), "completed")
               .when(F.col("failed") == F.col("total_jobs"), "failed")
               .when(F.col("_active") > 0, "running").otherwise("partial"))
    return g.select(batch, status.alias("batch_status"), F.round(prog, 2).alias("overall_progress"), "total_jobs",
                    "completed", "failed", "running")
