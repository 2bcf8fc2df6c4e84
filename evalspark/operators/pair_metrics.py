"""Pair metrics: a prediction column scored against a reference column, one row per pair.

Row-local metrics are plain column expressions (whole-stage codegen, no
shuffle).  The n-gram metrics (BLEU, ROUGE-1/2) are row-local too: n-grams are
numbered and counted in arrays, a batch of pairs at a time.  ROUGE-L needs a
longest common subsequence, which has no built-in: it runs in an Arrow UDF using
the bit-parallel LCS length (Allison & Dix 1986; Hyyrö 2004).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import clamp
from ..functions.tokens import UNICODE_WS, set_jaccard, split_ws, tokens
from ..session import stored


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


# ---------------------------------------------------------------- PM1 / PM2
def exact_match(pred, ref, case_sensitive: bool = False, normalize_whitespace: bool = True) -> Column:
    """1.0 when the texts are equal after optional lower-casing and whitespace collapse."""
    p, r = _c(pred), _c(ref)
    if not case_sensitive:
        p, r = F.lower(p), F.lower(r)
    if normalize_whitespace:
        p, r = F.array_join(split_ws(p), " "), F.array_join(split_ws(r), " ")
    return (p == r).cast("double")


# ---------------------------------------------------------------- PM6 / PM12
def token_jaccard(pred, ref, both_empty: float = 1.0, one_empty: float = 0.0) -> Column:
    return set_jaccard(tokens(pred), tokens(ref), both_empty, one_empty)


def keyword_relevance(output, context) -> Column:
    """|out ∩ ctx| / |ctx| over token sets, capped at 1; empty context scores 0."""
    o, c = F.array_distinct(tokens(output)), F.array_distinct(tokens(context))
    return F.when(F.size(c) == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.size(F.array_intersect(o, c)) / F.size(c)))


# ---------------------------------------------------------------- PM3 / PM4 shared n-gram plan
NGRAM_TOKENS = 1_000_000  # tokens of the pairs counted at a time, or of one longer pair


def _grams(codes: np.ndarray, ends: np.ndarray, max_n: int):
    """For n = 1..max_n: (places where an n-gram starts, its number); equal numbers for equal n-grams only.
    ``ends``: end of the text that each token belongs to.  Numbers are made of those of two shorter
    n-grams and ranked again before they could leave 64 bits."""
    at = np.arange(len(codes))
    known = {1: codes}  # by n: number of the n-gram at each place, where it fits
    for n in range(1, max_n + 1):
        fits = at[at + n - 1 < ends[at]]
        if n > 1:
            half = 1 << (n - 1).bit_length() - 1
            first, second = known[half], known[n - half]
            ids = np.zeros(len(codes), np.int64)
            ids[fits] = first[fits] * (second.max(initial=0) + 1) + second[fits + half]
            if n & (n - 1) == 0 and n < max_n:  # a power of two: longer ones are built on it
                ids[fits] = np.unique(ids[fits], return_inverse=True)[1].ravel()
            known[n] = ids
        yield fits, known[n][fits]


def _matches(owner: np.ndarray, second: np.ndarray, ids: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per pair: Σ of the smaller count of each number, and how many numbers are in the first text, in
    the second and in both."""
    span = int(ids.max(initial=0)) + 1
    if span * max(rows, 1) >= 1 << 61:
        ids, span = np.unique(ids, return_inverse=True)[1].ravel().astype(np.int64), len(ids) + 1
    key = np.sort((owner * span + ids) * 2 + second)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    value, count = key[head], np.diff(np.append(head, len(key)))
    row = (value >> 1) // span
    both = np.flatnonzero(value[1:] == value[:-1] + 1) if len(value) else head
    both = both[(value[both] & 1) == 0]
    least = np.minimum(count[both], count[both + 1])
    return (np.bincount(row[both], least, rows).astype(np.int64), np.bincount(row[(value & 1) == 0], minlength=rows),
            np.bincount(row[(value & 1) == 1], minlength=rows), np.bincount(row[both], minlength=rows))


def _counted(pred: pa.ListArray, ref: pa.ListArray, max_n: int) -> tuple[list[np.ndarray], tuple, np.ndarray]:
    """(clipped matches of each order, distinct tokens of pred / ref / both, same token sequence) per pair."""
    rows = len(pred)
    lp, lr = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (pred, ref))
    sizes = np.concatenate([lp, lr])
    words = pa.chunked_array([pred.flatten(), ref.flatten()]).combine_chunks().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(2 * rows), sizes)
    ends = np.cumsum(sizes)[text]
    out, sets = [], ()
    for at, ids in _grams(codes, ends, max_n):
        second = text[at] >= rows
        m, *distinct = _matches(text[at] - second * rows, second, ids, rows)
        out.append(m)
        sets = sets or tuple(distinct)
    # Same sequences: of equal length, and no place differs.
    same = lp == lr
    start = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(rows), lp * same)
    place = np.arange(len(own)) - np.repeat(np.cumsum(lp * same) - lp * same, lp * same)
    differs = codes[start[own] + place] != codes[start[rows + own] + place] if len(own) else np.zeros(0, bool)
    same[own[differs]] = False
    return out, sets or (np.zeros(rows, np.int64),) * 3, same


def _count_batches(names: list[str], max_n: int):
    def run(batches):
        for batch in batches:
            sizes = sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_pt", "_rt"))
            total = np.cumsum(sizes)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + NGRAM_TOKENS, "right")))
                part = batch.slice(a, b - a)
                pred, ref = part.column("_pt"), part.column("_rt")
                counts, sets, same = _counted(pred, ref, max_n)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), *(pc.list_value_length(x).cast(pa.int32()) for x in (pred, ref)), *(pa.array(c) for c in counts),
                     *(pa.array(c, pa.int64()) for c in sets), pa.array(same)],
                    names=[*names, "lp", "lr", *(f"m{n}" for n in range(1, max_n + 1)), "dp", "dr", "db", "same"])
                a = b
    return run


def ngram_match_counts(df: DataFrame, key: str, pred: str = "pred", ref: str = "ref",
                       max_n: int = 4, carry: list[str] | None = None) -> DataFrame:
    """Per pair: token counts ``lp``, ``lr``, clipped n-gram matches ``m1..m{max_n}``, distinct tokens of pred,
    ref and both (``dp``, ``dr``, ``db``), and whether the token sequences are the ``same``.

    Clipped matches of order n = Σ_g min(count_pred(g), count_ref(g)).  Counting is row-local: tokens
    (split in the JVM) become numbers, n-grams are numbered from (n−1)-grams, and the sorted numbers
    of all pairs of an Arrow batch are merged at once.  No n-gram is a row and nothing is shuffled.
    ``carry`` columns ride along.  A NULL text has no tokens."""
    names = [key, *(carry or [])]
    empty = F.array().cast("array<string>")
    base = df.select(*names, F.coalesce(tokens(pred), empty).alias("_pt"), F.coalesce(tokens(ref), empty).alias("_rt"))
    fields = [*base.select(*names).schema.fields, T.StructField("lp", T.IntegerType()), T.StructField("lr", T.IntegerType()),
              *[T.StructField(c, T.LongType()) for c in (*(f"m{n}" for n in range(1, max_n + 1)), "dp", "dr", "db")],
              T.StructField("same", T.BooleanType())]
    return base.mapInArrow(_count_batches(names, max_n), T.StructType(fields))


def bleu_from_counts(lp="lp", lr="lr", max_n: int = 4) -> Column:
    """The reference's BLEU: precision_n = clipped matches / |pred tokens| (0 if |pred| < n);
    any zero precision ⇒ 0; geometric mean × brevity min(1, exp(1 − |ref|/|pred|)); empty pred ⇒ 0."""
    lp, lr = _c(lp), _c(lr)
    precs = [F.when(lp >= i, F.col(f"m{i}") / lp).otherwise(F.lit(0.0)) for i in range(1, max_n + 1)]
    all_pos = precs[0] > 0
    for p in precs[1:]:
        all_pos = all_pos & (p > 0)
    logsum = F.log(precs[0])
    for p in precs[1:]:
        logsum = logsum + F.log(p)
    bleu = F.exp(logsum / max_n) * F.least(F.lit(1.0), F.exp(1 - lr / lp))
    return F.when((lp > 0) & all_pos, bleu).otherwise(F.lit(0.0))


def rouge_n_from_counts(n: int, lp="lp", lr="lr") -> tuple[Column, Column, Column]:
    """ROUGE-n precision, recall, F (no reference n-grams ⇒ all zero)."""
    lp, lr = _c(lp), _c(lr)
    m = F.col(f"m{n}")
    pc = F.greatest(lp - n + 1, F.lit(0))
    rc = F.greatest(lr - n + 1, F.lit(0))
    prec = F.when(rc == 0, F.lit(0.0)).when(pc > 0, m / pc).otherwise(F.lit(0.0))
    rec = F.when(rc == 0, F.lit(0.0)).otherwise(m / rc)
    f = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return prec, rec, f


def ngram_scores(df: DataFrame, key: str, pred: str = "pred", ref: str = "ref",
                 carry: list[str] | None = None, sets: bool = False) -> DataFrame:
    """BLEU and ROUGE-1/2 P/R/F per pair (plus the ``carry`` columns).  ``sets`` adds ``exact_match`` and
    ``jaccard`` (as :func:`exact_match` and :func:`token_jaccard` by default), counted in the same pass."""
    c = ngram_match_counts(df, key, pred, ref, 4, carry)
    p1, r1, f1 = rouge_n_from_counts(1)
    p2, r2, f2 = rouge_n_from_counts(2)
    union = F.col("dp") + F.col("dr") - F.col("db")
    jac = F.when(union == 0, F.lit(1.0)).otherwise(F.col("db") / union)
    return c.select(key, *(carry or []), bleu_from_counts().alias("bleu"),
                    p1.alias("rouge1_p"), r1.alias("rouge1_r"), f1.alias("rouge1_f"),
                    p2.alias("rouge2_p"), r2.alias("rouge2_r"), f2.alias("rouge2_f"),
                    *([F.col("same").cast("double").alias("exact_match"), jac.alias("jaccard")] if sets else []))


# ---------------------------------------------------------------- PM5 ROUGE-L
def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token sequences (bit-parallel)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


LCS_ROWS = 128  # pairs whose tokens are Python objects at once


@F.arrow_udf(T.LongType())
def lcs_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    out: list[int] = []
    for i in range(0, len(a), LCS_ROWS):
        out += [lcs_length(x or [], y or []) for x, y in zip(a.slice(i, LCS_ROWS).to_pylist(), b.slice(i, LCS_ROWS).to_pylist())]
    return pa.array(out, pa.int64())


def rouge_l(df: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Adds ``rougeL_p``, ``rougeL_r``, ``rougeL_f`` (tokenised JVM-side, LCS in Arrow batches)."""
    t = df.withColumn("_pt", tokens(pred)).withColumn("_rt", tokens(ref))
    t = t.withColumn("_lcs", lcs_udf("_pt", "_rt"))
    lp, lr, l_ = F.size("_pt"), F.size("_rt"), F.col("_lcs")
    prec = F.when(lr == 0, F.lit(0.0)).when(lp > 0, l_ / lp).otherwise(F.lit(0.0))
    rec = F.when(lr == 0, F.lit(0.0)).otherwise(l_ / lr)
    f = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return (t.withColumn("rougeL_p", prec).withColumn("rougeL_r", rec).withColumn("rougeL_f", f)
             .drop("_pt", "_rt", "_lcs"))


# ---------------------------------------------------------------- PM8 / PM9 / PM10
def cosine(a, b) -> Column:
    """Cosine of two numeric arrays in double precision; 0 when a norm is 0."""
    a = F.transform(_c(a), lambda x: x.cast("double"))
    b = F.transform(_c(b), lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb))


def semantic_similarity(a, b) -> Column:
    """Embedding cosine clamped at 0 (PM8; PM9's precision = recall = F1 = this value)."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def similarity_flag(sim, threshold: float = 0.8) -> Column:
    return _c(sim) >= F.lit(threshold)


# ---------------------------------------------------------------- PM11 coherence heuristic
def with_coherence(df: DataFrame, text: str = "text", out: str = "coherence") -> DataFrame:
    """0.5 base; +0.1 ends in . ! ?; +0.2 for 1..10 pieces on '.'; +0.1 when the sample stdev of
    the word counts of the non-blank pieces exceeds 2 (needs two of them); +0.2·unique-word ratio.

    Per-row arrays are materialised once in a lower projection so the statistics do not
    re-split the text (Catalyst does not duplicate such expressions when collapsing)."""
    t = F.col(text)
    tmp = df.withColumn("_pieces_n", F.size(F.split(t, r"\.", -1))) \
            .withColumn("_lens", F.filter(F.transform(F.split(t, r"\.", -1), lambda s: F.size(split_ws(s))),
                                          lambda n: n > 0)) \
            .withColumn("_words", tokens(t))
    k = F.size("_lens")
    s1 = F.aggregate("_lens", F.lit(0.0), lambda a, x: a + x)
    s2 = F.aggregate("_lens", F.lit(0.0), lambda a, x: a + x * x)
    var = (s2 - s1 * s1 / k) / (k - 1)
    nw = F.size("_words")
    uniq = F.when(nw > 0, F.size(F.array_distinct("_words")) / nw).otherwise(F.lit(0.0))
    n_pieces = F.col("_pieces_n")
    score = (F.lit(0.5)
             + F.when(t.rlike(r"(?U)[.!?]\s*$"), 0.1).otherwise(0.0)
             + F.when((n_pieces >= 1) & (n_pieces <= 10), 0.2).otherwise(0.0)
             + F.when((n_pieces > 1) & (k >= 2) & (F.sqrt(var) > 2), 0.1).otherwise(0.0)
             + uniq * 0.2)
    return tmp.withColumn(out, F.least(F.lit(1.0), score)).drop("_pieces_n", "_lens", "_words")


# ---------------------------------------------------------------- PM13 appropriateness
# Marker words of the reference's heuristic.
ANSWER_WORDS = ["yes", "no", "because", "since"]
POLITE_WORDS = ["please", "thank", "sorry", "excuse"]


def _contains_any(c: Column, words) -> Column:
    out = None
    for w in words:
        e = c.contains(w)
        out = e if out is None else (out | e)
    return out


def response_appropriateness(response, context) -> Column:
    r, c = _c(response), _c(context)
    low = F.lower(r)
    nw = F.size(split_ws(r))
    words = tokens(r)
    uniq = F.size(F.array_distinct(words)) / F.size(words)
    score = (F.lit(0.5)
             + F.when((nw >= 5) & (nw <= 100), 0.2).otherwise(0.0)
             + F.when(c.contains("?") & _contains_any(low, ANSWER_WORDS), 0.1).otherwise(0.0)
             + F.when(_contains_any(low, POLITE_WORDS), 0.1).otherwise(0.0)
             - F.when((F.size(words) > 0) & (uniq < 0.7), 0.2).otherwise(0.0))
    return clamp(score)


# ---------------------------------------------------------------- PM14 / PM15 / PM16
def response_quality(response, expected) -> Column:
    r, e = _c(response), _c(expected)
    nw = F.size(split_ws(r))
    length_score = F.least(F.lit(1.0), nw / 50) * 0.3
    ew, rw = F.array_distinct(tokens(e)), F.array_distinct(tokens(r))
    overlap = F.when(F.size(ew) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(ew, rw)) / F.size(ew))
    with_exp = length_score + overlap * 0.7
    no_exp = length_score + F.when(nw > 5, 0.7).otherwise(0.3)
    score = F.least(F.lit(1.0), F.when(F.coalesce(e, F.lit("")) != "", with_exp).otherwise(no_exp))
    return F.when(r.isNull() | (F.size(split_ws(r)) == 0), F.lit(0.0)).otherwise(score)


def graded_match(pred, truth) -> Column:
    p = F.lower(strip_ws(pred))
    t = F.lower(strip_ws(truth))
    pw, tw = F.array_distinct(split_ws(p)), F.array_distinct(split_ws(t))
    overlap = F.when(F.size(tw) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(pw, tw)) / F.size(tw))
    return (F.when(p == t, F.lit(1.0)).when(p.contains(t) | t.contains(p), F.lit(0.7)).otherwise(overlap))


def reward(output) -> Column:
    o = _c(output)
    return (F.least(F.lit(1.0), F.length(o) / 200) + F.when(F.size(split_ws(o)) > 5, 1.0).otherwise(0.5)) / 2


# ---------------------------------------------------------------- PM17 / PM18
def latency_score(latency_ms, target_ms: float = 1000.0) -> Column:
    ms = _c(latency_ms)
    return F.when(ms > 0, F.least(F.lit(1.0), F.lit(target_ms) / ms)).otherwise(F.lit(0.0))


def meets_target(latency_ms, target_ms: float = 1000.0) -> Column:
    return _c(latency_ms) <= F.lit(target_ms)


def normalize_score(score, metric_type: str = "similarity", max_latency_s: float = 10.0) -> Column:
    s = _c(score)
    if metric_type == "error":
        return clamp(1.0 - s)
    if metric_type == "latency":
        return clamp(1.0 - s / max_latency_s)
    return clamp(s)


# ---------------------------------------------------------------- PM19 / PM20 judge outputs
NUMBER_RE = r"-?\d+\.?\d*"
UNSIGNED_NUMBER_RE = r"\d+\.?\d*"


def judge_numeric(response, lo: float, hi: float) -> Column:
    """First number in the stripped response, clamped to [lo, hi]; none ⇒ the mid-point."""
    m = F.regexp_extract(strip_ws(response), NUMBER_RE, 0)
    v = F.when(m != "", m.cast("double"))
    return F.when(v.isNull(), F.lit((lo + hi) / 2.0)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def judge_pairwise(response) -> Column:
    """Pairwise judge verdict on −2..2 scaled to −1..1."""
    return judge_numeric(response, -2.0, 2.0) / 2.0


def judge_scale10(response) -> Column:
    """1..10 judge rating scaled to 0..1."""
    return (judge_numeric(response, 1.0, 10.0) - 1.0) / 9.0


def judge_json_score(response, key: str = "score") -> Column:
    """JSON object ⇒ its ``key`` (missing ⇒ 0); other valid JSON ⇒ 0; not JSON ⇒ first
    unsigned number or 0.  Then >1 ⇒ /10 when ≤10, else /100."""
    r = _c(response)
    v = F.try_parse_json(r)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    from_obj = F.coalesce(F.try_variant_get(v, f"$.{key}", "double"), F.lit(0.0))
    m = F.regexp_extract(r, UNSIGNED_NUMBER_RE, 0)
    from_text = F.when(m != "", m.cast("double")).otherwise(F.lit(0.0))
    raw = F.when(v.isNull(), from_text).when(is_obj, from_obj).otherwise(F.lit(0.0))
    return F.when(raw > 1.0, F.when(raw <= 10.0, raw / 10.0).otherwise(raw / 100.0)).otherwise(raw)


# ---------------------------------------------------------------- PM21 bracket balance
def _count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def brackets_balanced(code) -> Column:
    c = _c(code)
    return ((_count_char(c, "{") == _count_char(c, "}")) & (_count_char(c, "(") == _count_char(c, ")"))
            & (_count_char(c, "[") == _count_char(c, "]")))


# ---------------------------------------------------------------- PM22 classification
def classification_metrics(df: DataFrame, y_true, y_pred, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 of boolean predictions (one grouped pass)."""
    t, p = _c(y_true), _c(y_pred)
    g = df.groupBy(*(by or []))
    out = g.agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
                F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return (out.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))
               .withColumn("precision", prec).withColumn("recall", rec)
               .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                        2 * F.col("precision") * F.col("recall")
                                        / (F.col("precision") + F.col("recall"))).otherwise(0.0)))


# ---------------------------------------------------------------- PM24 prompt formatting
def format_prompt(template, input_text) -> Column:
    """``{input}`` ⇒ str.format (doubled braces undone), ``[INPUT]`` ⇒ replace, else append."""
    t, x = _c(template), _c(input_text)
    fmt = F.replace(F.replace(F.replace(t, F.lit("{input}"), F.lit("\u0000")), F.lit("{{"), F.lit("{")),
                    F.lit("}}"), F.lit("}"))
    fmt = F.replace(fmt, F.lit("\u0000"), x)
    return (F.when(t.contains("{input}"), fmt)
             .when(t.contains("[INPUT]"), F.replace(t, F.lit("[INPUT]"), x))
             .otherwise(F.concat(t, F.lit("\n\nInput: "), x)))


# ---------------------------------------------------------------- PM23 metric table
def confidence_interval(mean: Column, std: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """mean ± z·s/√n clamped to [0, 1]; fewer than 2 scores ⇒ (0, 1)."""
    margin = z * std / F.sqrt(n)
    lo = F.when(n < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), mean - margin))
    hi = F.when(n < 2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), mean + margin))
    return lo, hi


def metric_table(scored: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Long table ``(metric, n, score, ci_low, ci_high)`` from per-pair score columns
    (one unpivot, one grouped aggregation)."""
    by = by or []
    long = scored.select(*by, *metrics).unpivot(by, metrics, "metric", "value")
    agg = long.groupBy(*by, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("score"),
                                          F.stddev_samp("value").alias("_sd"))
    lo, hi = confidence_interval(F.col("score"), F.col("_sd"), F.col("n"))
    return agg.select(*by, "metric", "n", F.coalesce("score", F.lit(0.0)).alias("score"),
                      lo.alias("ci_low"), hi.alias("ci_high"))


def row_metrics(df: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """All row-local metrics in a single projection."""
    return df.select("*",
                     exact_match(pred, ref).alias("exact_match"),
                     token_jaccard(pred, ref).alias("jaccard"),
                     response_quality(pred, ref).alias("response_quality"),
                     graded_match(pred, ref).alias("graded_match"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["UNICODE_WS"]


# ---------------------------------------------------------------- PM7 TF-IDF cosine
# Word tokens of two or more word characters (letters, digits, underscore), lower-cased.
WORD2_RE = r"[\p{L}\p{N}_]{2,}"


LISTED_TERMS = 1 << 20  # terms whose document frequencies go to every task


def _term_counts(batches):
    """(_k, h, tp, tr): of each pair its distinct terms and how often each side has them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            size, h = zip(*((c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), c.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                            for c in (some.column(1), some.column(2))))
            row = np.concatenate([np.repeat(np.arange(some.num_rows), n) for n in size])
            of_ref = np.repeat([0, 1], [len(x) for x in h])
            h = np.concatenate(h)
            order = np.lexsort((h, row))
            row, h, of_ref = row[order], h[order], of_ref[order]
            new = np.ones(len(h), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            every = np.diff(np.append(first, len(h)))
            refs = np.add.reduceat(of_ref, first) if len(first) else every
            ends = pa.array(np.searchsorted(row[first], np.arange(some.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h[first], (every - refs).astype(np.int32), refs.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([some.column(0), *lists], names=["_k", "h", "tp", "tr"])


def _flat_counts(batch: pa.RecordBatch, listed: np.ndarray):
    """(row, term, count of each side, place among the listed terms, is it there) of a batch of ``_term_counts``."""
    row = np.repeat(np.arange(batch.num_rows), batch.column("h").value_lengths().to_numpy(zero_copy_only=False))
    h, tp, tr = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "tp", "tr"))
    at = np.minimum(np.searchsorted(listed, h), max(len(listed) - 1, 0))
    return row, h, tp, tr, at, listed[at] == h if len(listed) else np.zeros(len(h), bool)


def _listed_sums(shared):
    """(_k, dot, pp, rr) of each pair over its listed terms."""
    def run(batches):
        listed, idf = shared.value
        for batch in batches:
            row, _, tp, tr, at, there = _flat_counts(batch, listed)
            row, wp, wr = row[there], tp[there] * idf[at[there]], tr[there] * idf[at[there]]
            sums = [pa.array(np.bincount(row, x, batch.num_rows).astype(float)) for x in (wp * wr, wp * wp, wr * wr)]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), *sums], names=["_k", "dot", "pp", "rr"])
    return run


def _unlisted_rows(shared):
    """(_k, h, tp, tr) of each term of a pair that is not listed."""
    def run(batches):
        listed, _ = shared.value
        for batch in batches:
            row, h, tp, tr, _, there = _flat_counts(batch, listed)
            rest = np.flatnonzero(~there)
            yield pa.RecordBatch.from_arrays([batch.column("_k").take(pa.array(row[rest])), pa.array(h[rest]), pa.array(tp[rest]), pa.array(tr[rest])],
                                             names=["_k", "h", "tp", "tr"])
    return run


def tfidf_cosine(df: DataFrame, key: str, pred: str = "pred", ref: str = "ref",
                 stop_words: tuple[str, ...] | None = None, listed_terms: int = LISTED_TERMS) -> DataFrame:
    """Per pair: cosine of TF-IDF vectors fitted on predictions ∪ references (smooth idf
    ln((1+n)/(1+df)) + 1, raw term counts, L2 norm, English stop words removed), clamped at 0.

    Terms (as 64-bit hashes) are counted inside the row and the counts written once.  The
    ``listed_terms`` most frequent terms at most go to every task with their frequencies, so that their part
    of a pair's sums is made in the row; only rarer ones are joined on the term and regrouped by pair.
    Where keys repeat, rows of a key are one pair (``_tfidf_by_key``)."""
    from ..functions.stopwords import english_stop_words
    stops = list(stop_words if stop_words is not None else english_stop_words())
    if not df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        return _tfidf_by_key(df, key, pred, ref, stops)
    spark = df.sparkSession

    def hashes(text: str) -> Column:
        words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD2_RE), 0), lambda w: ~w.isin(stops))  # InSet: hash lookup
        return F.transform(words, lambda w: F.xxhash64(w))

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("_k", kind), T.StructField("h", T.ArrayType(T.LongType())),
                           *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("tp", "tr"))])
    counts = stored(df.select(F.col(key).alias("_k"), hashes(pred).alias("p"), hashes(ref).alias("r")).mapInArrow(_term_counts, schema), "term-counts")
    n_docs = 2 * counts.count()
    sides = (F.col("t.tp") > 0).cast("int") + (F.col("t.tr") > 0).cast("int")
    dfreq = stored(counts.select(F.explode(F.arrays_zip("h", "tp", "tr")).alias("t")).select(F.col("t.h").alias("h"), sides.alias("n"))
                   .groupBy("h").agg(F.sum("n").alias("df")), "term-frequencies")
    least, listed, total = 1, 0, 0  # terms of this frequency or more are listed
    of_each = dfreq.groupBy("df").agg(F.count(F.lit(1)).alias("terms")).toArrow()
    for d, terms in sorted(zip(*(of_each[c].to_pylist() for c in ("df", "terms"))), reverse=True):
        total += terms
        if total > listed_terms:
            least = d + 1
            break
        listed = total
    table = dfreq.where(F.col("df") >= least).orderBy("h").toArrow() if listed else dfreq.limit(0).toArrow()
    idf = np.log((1 + n_docs) / (1 + table["df"].to_numpy())) + 1
    shared = spark.sparkContext.broadcast((table["h"].to_numpy().astype(np.int64), idf))
    sums = T.StructType([T.StructField("_k", kind), *(T.StructField(c, T.DoubleType()) for c in ("dot", "pp", "rr"))])
    g = counts.mapInArrow(_listed_sums(shared), sums)
    if least > 1:
        flat = T.StructType([T.StructField("_k", kind), *(T.StructField(c, T.LongType()) for c in ("h", "tp", "tr"))])
        weight = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
        rest = (counts.mapInArrow(_unlisted_rows(shared), flat).join(dfreq.where(F.col("df") < least), "h")
                .select("_k", (F.col("tp") * weight).alias("wp"), (F.col("tr") * weight).alias("wr"))
                .select("_k", (F.col("wp") * F.col("wr")).alias("dot"), (F.col("wp") ** 2).alias("pp"), (F.col("wr") ** 2).alias("rr")))
        g = g.unionByName(rest).groupBy("_k").agg(*[F.sum(c).alias(c) for c in ("dot", "pp", "rr")])
    cos = F.when(F.col("_k").isNotNull() & (F.col("pp") > 0) & (F.col("rr") > 0), F.greatest(F.lit(0.0), F.col("dot") / (F.sqrt("pp") * F.sqrt("rr"))))
    return g.select(F.col("_k").alias(key), F.coalesce(cos, F.lit(0.0)).alias("tfidf_similarity"))


def _tfidf_by_key(df: DataFrame, key: str, pred: str, ref: str, stops: list[str]) -> DataFrame:
    """Term counts come from one explode + ``groupBy``; document frequencies from a ``groupBy(term)``
    joined back on the term (AQE splits a skewed term partition); dot products and norms are
    regrouped by pair."""
    docs = (df.select(F.col(key).alias("_k"), F.explode(F.array(
        F.struct(F.lit("p").alias("side"), F.col(pred).alias("t")),
        F.struct(F.lit("r").alias("side"), F.col(ref).alias("t")))).alias("d"))
        .select("_k", "d.side", F.filter(F.regexp_extract_all(F.lower(F.col("d.t")), F.lit(WORD2_RE), 0),
                                         lambda w: ~w.isin(stops)).alias("terms")))  # InSet: hash lookup
    n_docs = df.agg(F.count("*") * 2).scalar()  # scalar subquery
    # term counts of both sides of a pair in one aggregation keyed (pair, term)
    kt = (docs.select("_k", "side", F.explode("terms").alias("term"))
              .groupBy("_k", "term").agg(F.count_if(F.col("side") == "p").alias("tp"),
                                         F.count_if(F.col("side") == "r").alias("tr")))
    dfreq = kt.groupBy("term").agg(F.sum((F.col("tp") > 0).cast("int") + (F.col("tr") > 0).cast("int")).alias("df"))
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    w = kt.join(dfreq, "term").select("_k", (F.col("tp") * idf).alias("wp"), (F.col("tr") * idf).alias("wr"))
    g = w.groupBy("_k").agg(F.sum(F.col("wp") * F.col("wr")).alias("dot"), F.sqrt(F.sum(F.col("wp") ** 2)).alias("np"),
                            F.sqrt(F.sum(F.col("wr") ** 2)).alias("nr"))
    cos = F.when((F.col("np") > 0) & (F.col("nr") > 0), F.greatest(F.lit(0.0), F.col("dot") / (F.col("np") * F.col("nr"))))
    keys = df.select(F.col(key).alias("_k"))
    return keys.join(g, "_k", "left").select(F.col("_k").alias(key), F.coalesce(cos, F.lit(0.0)).alias("tfidf_similarity"))
