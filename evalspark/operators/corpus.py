"""Corpus text jobs: a table of texts in, a table of scores / issues / rewrites out.

Everything is a JVM-side column expression over whole texts (no prefixes).
Arrays a text needs more than once (tokens, pattern tags, variables) are
materialised in a lower projection so Catalyst does not re-split the text for
every use.  Python ``re`` is Unicode-aware, so the Java patterns carry ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import split_ws, tokens


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


# ---------------------------------------------------------------- TX1 / TX2
def clean_text(c) -> Column:
    """Strip and collapse every whitespace run (newlines included) to one space."""
    return F.coalesce(F.regexp_replace(strip_ws(c), r"(?U)\s+", " "), F.lit(""))


def normalize_text(c) -> Column:
    """clean → pad ``{{ v }}`` → one space after . ! ? → one space after ':' → strip."""
    t = clean_text(c)
    t = F.regexp_replace(t, r"\{\{([^}]+)\}\}", "{{ $1 }}")
    t = F.regexp_replace(t, r"(?U)\s*([.!?])\s*", "$1 ")
    t = F.regexp_replace(t, r"(?U):\s*", ": ")
    return strip_ws(t)


def normalize_structure(c) -> Column:
    """TX2 for stable prompts: white space runs become one space, one space after each . ! ?, and a final
    full stop where the text does not end in . ! ? or ':'."""
    t = F.regexp_replace(strip_ws(c), r"(?U)\s+", " ")
    t = strip_ws(F.regexp_replace(t, r"(?U)([.!?])\s*", "$1 "))
    return F.when(F.substring(t, -1, 1).isin(".", "!", "?", ":"), t).otherwise(F.concat(t, F.lit(".")))


# ---------------------------------------------------------------- TX5 variables
VAR_RE = r"\{\{([^}]+)\}\}"


def variables(c) -> Column:
    """Distinct variable names of ``{{name}}`` / ``{{name:type}}`` in first-seen order."""
    raw = F.regexp_extract_all(_c(c), F.lit(VAR_RE), 1)
    return F.array_distinct(F.transform(raw, lambda m: strip_ws(F.split(m, ":", 2)[0])))


def variable_schema(df: DataFrame, text: str, key: str) -> DataFrame:
    """Schema rows (name, type — default string, required) per text."""
    raw = F.regexp_extract_all(F.col(text), F.lit(VAR_RE), 1)
    e = df.select(key, F.posexplode(raw).alias("pos", "m"))
    name = strip_ws(F.split("m", ":", 2)[0])
    typ = F.when(F.size(F.split("m", ":", 2)) > 1, strip_ws(F.split("m", ":", 2)[1])).otherwise(F.lit("string"))
    return (e.groupBy(key, name.alias("name")).agg(F.min("pos").alias("first_pos"), F.min_by(typ, F.col("pos")).alias("type"))
             .withColumn("required", F.lit(True)))


# ---------------------------------------------------------------- TX3 complexity
def with_complexity(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    tmp = (df.withColumn("_words", split_ws(t)).withColumn("_uniq", F.size(F.array_distinct(tokens(t))))
             .withColumn("_nsent", F.size(F.split(t, "[.!?]+", -1)))
             .withColumn("_npara", F.size(F.filter(F.split(t, "\n\n", -1), lambda p: p.rlike(r"(?U)\S"))))
             .withColumn("_vars", F.size(variables(t))))
    wc = F.size("_words")
    uniq = F.col("_uniq")
    div = F.when(wc > 0, uniq / wc).otherwise(F.lit(0.0))
    score = F.least(F.lit(100.0), (wc / 10) * 0.3 + (F.col("_nsent") / 5) * 0.2 + (F.col("_vars") * 5) * 0.2 + (div * 50) * 0.3)
    empty = (t.isNull()) | (t == "")
    cols = {
        "character_count": F.length(t), "word_count": wc, "sentence_count": F.col("_nsent"),
        "paragraph_count": F.col("_npara"), "unique_words": uniq, "vocabulary_diversity": div,
        "variable_count": F.col("_vars"),
        "avg_words_per_sentence": F.when(F.col("_nsent") > 0, wc / F.col("_nsent")).otherwise(F.lit(0.0)),
        "avg_chars_per_word": F.when(wc > 0, F.length(t) / wc).otherwise(F.lit(0.0)),
        "complexity_score": score,
    }
    out = tmp
    for k, v in cols.items():
        out = out.withColumn(k, F.when(~empty, v))
    out = out.withColumn("error", F.when(empty, F.lit("Empty prompt")))
    return out.drop("_words", "_uniq", "_nsent", "_npara", "_vars")


# ---------------------------------------------------------------- TX4 patterns
# The reference's prompt-pattern regexes (case-insensitive) and tag names.
PATTERNS = [
    (r"\bplease\b", "polite_request"),
    (r"\bstep by step\b", "step_by_step"),
    (r"\bfor example\b", "examples_requested"),
    (r"\bexplain\b", "explanation_request"),
    (r"\blist\b", "list_request"),
    (r"\bcompare\b", "comparison_request"),
    (r"\bsummarize\b", "summarization_request"),
    (r"\banalyze\b", "analysis_request"),
    (r"\{([^}]+)\}", "template_variables"),
    (r"\b(you are|act as|role)\b", "role_assignment"),
    (r"\b(context|background):", "context_provided"),
    (r"\b(output|format|structure):", "format_specification"),
    (r"\b(do not|don't|avoid)\b", "negative_instruction"),
    (r"\b(must|should|required)\b", "requirement_specification"),
]
FEW_SHOT_RE = r"\bexample\s*\d+"
COT_RE = r"\bthink\b.*\bstep\b"


def pattern_tags(c) -> Column:
    t = _c(c)
    tags = [F.when(t.rlike("(?iU)" + p), F.lit(n)) for p, n in PATTERNS]
    tags.append(F.when(F.size(F.regexp_extract_all(t, F.lit("(?iU)" + FEW_SHOT_RE), 0)) > 1, F.lit("few_shot_examples")))
    tags.append(F.when(t.rlike("(?iU)" + COT_RE), F.lit("chain_of_thought")))
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


def pattern_frequency(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(pattern_tags(text)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("count"))


# ---------------------------------------------------------------- TX7 validation rules
def _count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def validation_issues(df: DataFrame, text: str, key: str, min_length: int = 10, max_length: int = 50000,
                      forbidden: list[str] | None = None, required: list[str] | None = None) -> DataFrame:
    """Long issue table (key, rule, severity, message).  The malformed-brace regex also fires on
    every well-formed ``{{x}}``; that case is reported under its own rule name."""
    t = F.col(text)
    ln = F.length(t)
    ob, cb = _count_char(t, "{"), _count_char(t, "}")
    malformed = t.rlike(r"\{[^}]*\{|\}[^{]*\}")
    only_vars = F.regexp_replace(t, VAR_RE, "").rlike(r"\{[^}]*\{|\}[^{]*\}")
    issues = [
        F.when(ln < min_length, F.struct(F.lit("too_short").alias("rule"), F.lit("error").alias("severity"),
                                         F.concat(F.lit("Prompt too short: "), ln.cast("string"), F.lit(f" < {min_length}")).alias("message"))),
        F.when(ln > max_length, F.struct(F.lit("too_long").alias("rule"), F.lit("error").alias("severity"),
                                         F.concat(F.lit("Prompt too long: "), ln.cast("string"), F.lit(f" > {max_length}")).alias("message"))),
        F.when(ob != cb, F.struct(F.lit("unmatched_braces").alias("rule"), F.lit("error").alias("severity"),
                                  F.concat(F.lit("Unmatched braces: "), ob.cast("string"), F.lit(" open, "), cb.cast("string"),
                                           F.lit(" close")).alias("message"))),
        F.when(malformed & only_vars, F.struct(F.lit("malformed_variables").alias("rule"), F.lit("error").alias("severity"),
                                               F.lit("Malformed variable syntax detected").alias("message"))),
        F.when(malformed & ~only_vars, F.struct(F.lit("malformed_variables_wellformed").alias("rule"), F.lit("error").alias("severity"),
                                                F.lit("Malformed variable syntax detected").alias("message"))),
    ]
    for p in forbidden or []:
        issues.append(F.when(t.rlike("(?iU)" + p), F.struct(F.lit("forbidden_pattern").alias("rule"), F.lit("error").alias("severity"),
                                                           F.lit(f"Forbidden pattern found: {p}").alias("message"))))
    for p in required or []:
        issues.append(F.when(~t.rlike("(?iU)" + p), F.struct(F.lit("required_pattern").alias("rule"), F.lit("warning").alias("severity"),
                                                            F.lit(f"Required pattern missing: {p}").alias("message"))))
    base = df.select(key, F.explode(F.filter(F.array(*issues), lambda x: x.isNotNull())).alias("i")).select(key, "i.*")
    lines = df.select(key, F.posexplode(F.split(t, "\n", -1)).alias("ln", "line"))
    trailing = lines.where(F.col("line").endswith(" ") | F.col("line").endswith("\t")).select(
        key, F.lit("trailing_whitespace").alias("rule"), F.lit("warning").alias("severity"),
        F.concat(F.lit("Trailing whitespace at line "), (F.col("ln") + 1).cast("string")).alias("message"))
    return base.unionByName(trailing)


# ---------------------------------------------------------------- TX8 potential issues
# Action verbs the reference looks for.
ACTION_VERBS = ["please", "create", "generate", "write", "explain", "describe", "analyze", "summarize"]


def potential_issues(df: DataFrame, text: str, key: str) -> DataFrame:
    """Empty; > 10 000 chars; a word of > 3 chars above 10 % of the words; no action verb;
    unmatched ( ) and [ ].  Word repetition is counted by (key, number of words, word): where every key has
    one row, inside the row's sorted words (a repeated word stands again a tenth of the words further on), so
    only repeated words become rows; where keys repeat, over all words."""
    t = F.col(text)
    low = F.lower(t)
    blank = F.size(split_ws(t)) == 0
    verb = None
    for v in ACTION_VERBS:
        verb = low.contains(v) if verb is None else (verb | low.contains(v))
    rules = [
        F.when(blank, F.struct(F.lit("empty").alias("rule"), F.lit("critical").alias("severity"), F.lit("Empty prompt").alias("message"))),
        F.when(~blank & (F.length(t) > 10000), F.struct(F.lit("token_limit").alias("rule"), F.lit("high").alias("severity"),
                                                       F.lit("Prompt may exceed token limits").alias("message"))),
        F.when(~blank & ~verb, F.struct(F.lit("no_action_verb").alias("rule"), F.lit("medium").alias("severity"),
                                        F.lit("No clear action verb found").alias("message"))),
        F.when(~blank & (_count_char(t, "(") != _count_char(t, ")")),
               F.struct(F.lit("unmatched_parentheses").alias("rule"), F.lit("low").alias("severity"), F.lit("Unmatched parentheses").alias("message"))),
        F.when(~blank & (_count_char(t, "[") != _count_char(t, "]")),
               F.struct(F.lit("unmatched_brackets").alias("rule"), F.lit("low").alias("severity"), F.lit("Unmatched brackets").alias("message"))),
    ]
    base = df.select(key, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("i")).select(key, "i.*")
    most = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).scalar()  # rows of a key
    w = (df.select(key, tokens(t).alias("_tok"))
         .select(key, F.size("_tok").alias("_n"), F.sort_array(F.filter("_tok", lambda x: F.length(x) > 3)).alias("_long"), most.alias("_rows")))
    least = F.floor(F.col("_n") * 0.1).cast("int")  # a word found so many places further on occurs once more than that
    again = F.array_distinct(F.filter("_long", lambda x, i: F.get(F.col("_long"), i + least) == x))
    here = F.transform(again, lambda x: F.struct(x.alias("word"), F.size(F.filter("_long", lambda y: y == x)).cast("long").alias("c")))
    every = F.transform("_long", lambda x: F.struct(x.alias("word"), F.lit(1).cast("long").alias("c")))
    w = w.select(key, "_n", F.explode(F.when(F.col("_rows") == 1, here).otherwise(every)).alias("_w"))
    rep = (w.groupBy(key, "_n", F.col("_w.word").alias("word")).agg(F.sum("_w.c").alias("c"))
            .where(F.col("c") > F.col("_n") * 0.1)
            .select(key, F.lit("repetition").alias("rule"), F.lit("medium").alias("severity"),
                    F.concat(F.lit("Excessive repetition of word: '"), F.col("word"), F.lit("'")).alias("message")))
    return base.unionByName(rep)


# ---------------------------------------------------------------- TX9 / TX11 quality + cost
def with_quality(df: DataFrame, text: str = "text", input_cost_per_1k: float = 0.001,
                 output_cost_per_1k: float = 0.002) -> DataFrame:
    """readability = clamp(100 − complexity); clarity 100 (−20 if > 20 words/sentence);
    completeness 80 +10 examples +10 format +5 context; overall .3/.3/.4; tokens and cost."""
    c = with_complexity(df, text).withColumn("_tags", pattern_tags(text))
    readability = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - F.col("complexity_score")))
    clarity = F.when(F.col("avg_words_per_sentence") > 20, 80.0).otherwise(100.0)
    has = lambda n: F.array_contains("_tags", n)
    completeness = (F.lit(80.0) + F.when(has("examples_requested"), 10).otherwise(0)
                    + F.when(has("format_specification"), 10).otherwise(0) + F.when(has("context_provided"), 5).otherwise(0))
    ntok = F.size(split_ws(text))
    c = (c.withColumn("readability_score", readability).withColumn("clarity_score", clarity)
          .withColumn("completeness_score", completeness)
          .withColumn("overall_score", F.col("readability_score") * 0.3 + F.col("clarity_score") * 0.3
                      + F.col("completeness_score") * 0.4)
          .withColumn("token_count", ntok))
    return with_cost(c, "token_count", input_cost_per_1k, output_cost_per_1k).drop("_tags")


def with_cost(df: DataFrame, token_count: str, input_cost_per_1k: float = 0.001, output_cost_per_1k: float = 0.002) -> DataFrame:
    n = F.col(token_count)
    out_tok = n * 0.15
    return (df.withColumn("estimated_output_tokens", F.floor(out_tok).cast("long"))
              .withColumn("input_cost", n / 1000 * input_cost_per_1k)
              .withColumn("output_cost", out_tok / 1000 * output_cost_per_1k)
              .withColumn("total_cost", F.col("input_cost") + F.col("output_cost")))


# ---------------------------------------------------------------- TX10 suggestions
# Vague words and suggestion texts of the reference.
VAGUE_WORDS = ["good", "bad", "nice", "fine", "okay", "some", "many", "few"]


def suggestions(df: DataFrame, text: str, key: str) -> DataFrame:
    c = with_complexity(df.select(key, text), text).withColumn("_tags", pattern_tags(text))
    has = lambda n: F.array_contains("_tags", n)
    low = F.lower(F.col(text))
    padded_hits = [F.when(low.contains(f" {w} "), F.lit(w)) for w in VAGUE_WORDS]
    first_vague = F.coalesce(*padded_hits)
    s = lambda cat, msg, pr: F.struct(F.lit(cat).alias("category"), msg.alias("message") if isinstance(msg, Column)
                                      else F.lit(msg).alias("message"), F.lit(pr).alias("priority"))
    rules = [
        F.when(~has("context_provided"), s("structure", "Consider adding context or background information", 2)),
        F.when(~has("format_specification"), s("structure", "Specify the desired output format", 1)),
        F.when(~has("examples_requested") & (F.col("word_count") > 50), s("clarity", "Consider adding examples to illustrate your request", 2)),
        F.when(F.col("avg_words_per_sentence") > 25, s("readability", "Break long sentences into shorter ones", 2)),
        F.when(F.col("vocabulary_diversity") < 0.4, s("vocabulary", "Use more varied vocabulary", 3)),
        F.when(first_vague.isNotNull(), s("specificity", F.concat(F.lit("Replace vague word '"), first_vague,
                                                                  F.lit("' with more specific terms")), 2)),
        F.when(~has("role_assignment") & (F.col("word_count") > 100), s("technique", "Consider assigning a specific role to the AI", 3)),
        F.when((low.contains("analyze") | low.contains("explain")) & ~has("chain_of_thought"),
               s("technique", "Ask the AI to think step by step", 2)),
    ]
    return c.select(key, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("s")).select(key, "s.*")


# ---------------------------------------------------------------- TX12 truncate
def truncate_tokens(c, max_tokens: int) -> Column:
    """Keep the first ``max_tokens`` whitespace tokens; if they contain a sentence end, cut after
    the last complete sentence (pieces re-joined with '.')."""
    t = _c(c)
    toks = split_ws(t)
    joined = F.array_join(F.slice(toks, 1, max_tokens), " ")
    pieces = F.split(joined, "[.!?]+", -1)
    cut = F.concat(F.array_join(F.slice(pieces, 1, F.size(pieces) - 1), "."), F.lit("."))
    return (F.when(t.isNull() | (t == ""), F.lit("")).when(F.size(toks) <= max_tokens, t)
             .when(F.size(pieces) > 1, cut).otherwise(joined))


# ---------------------------------------------------------------- TX13 merge
def merge_texts(df: DataFrame, group: str, order: str, text: str, strategy: str = "concatenate") -> DataFrame:
    """Merge the non-blank texts of each group (ordered by ``order``): concatenate with blank
    lines, interleave sentences round-robin, or numbered sections.  Interleave explodes sentences
    and re-aggregates them ordered by (sentence index, text order)."""
    src = df.where(F.size(split_ws(text)) > 0).select(group, order, clean_text(text).alias("_t"))
    if strategy == "concatenate":
        return src.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))),
                                                                lambda s: s["_t"]), "\n\n").alias("merged"))
    if strategy == "template":
        return src.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))),
                                                                lambda s, i: F.concat(F.lit("## Section "), (i + 1).cast("string"),
                                                                                      F.lit("\n"), s["_t"])), "\n\n").alias("merged"))
    if strategy == "interleave":
        e = src.select(group, order, F.posexplode(F.split("_t", "[.!?]+", -1)).alias("_i", "_s")).where(F.size(split_ws("_s")) > 0)
        agg = e.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", order, strip_ws("_s").alias("s")))).alias("_a"))
        return agg.select(group, F.concat(F.array_join(F.transform("_a", lambda x: x["s"]), ". "), F.lit(".")).alias("merged"))
    raise ValueError(f"Unknown merge strategy: {strategy}")


# ---------------------------------------------------------------- TX14 style
def convert_style(c, target: str) -> Column:
    t = _c(c)
    if target == "formal":
        return F.regexp_replace(F.regexp_replace(t, r"(?iU)\bplease\b", "kindly"), r"(?iU)\bcan you\b", "would you")
    if target == "casual":
        return F.regexp_replace(F.regexp_replace(t, r"(?iU)\bkindly\b", "please"), r"(?iU)\bwould you\b", "can you")
    if target == "instruction":
        t2 = F.when(strip_ws(t).endswith("."), t).otherwise(F.concat(t, F.lit(".")))
        return F.regexp_replace(t2, r"(?iU)^\s*please\s+", "")
    if target == "question":
        return F.when(strip_ws(t).endswith("?"), t).otherwise(F.concat(F.lit("Can you "), F.lower(strip_ws(t)), F.lit("?")))
    return t


# ---------------------------------------------------------------- TX16 examples / context
def examples_block(df: DataFrame, group: str, order: str, fields: list[str], style: str = "numbered") -> DataFrame:
    """Few-shot block per group from its example rows (ordered)."""
    st = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_ord"), *[F.col(f).alias(f) for f in fields])))
    if style == "numbered":
        fmt = lambda s, i: F.concat(F.lit("\nExample "), (i + 1).cast("string"), F.lit(":\n"),
                                    *[x for f in fields for x in (F.lit(f"{f}: "), s[f].cast("string"), F.lit("\n"))])
        return df.groupBy(group).agg(F.array_join(F.transform(st, fmt), "").alias("examples"))
    if style == "bullet":
        fmt = lambda s: F.concat(F.lit("\n• "), F.concat_ws(" | ", *[F.concat(F.lit(f"{f}: "), s[f].cast("string")) for f in fields]))
        return df.groupBy(group).agg(F.array_join(F.transform(st, fmt), "").alias("examples"))
    fmt = lambda s: F.concat(F.lit("("), F.concat_ws(", ", *[F.concat(F.lit(f"{f}: "), s[f].cast("string")) for f in fields]), F.lit(")"))
    return df.groupBy(group).agg(F.concat(F.lit("\nExamples: "), F.array_join(F.transform(st, fmt), ", ")).alias("examples"))


def add_context(prompt, context, position: str = "before") -> Column:
    p, c = clean_text(prompt), clean_text(context)
    has = _c(context).isNotNull() & (_c(context) != "")
    if position == "before":
        v = F.concat(c, F.lit("\n\n"), p)
    elif position == "after":
        v = F.concat(p, F.lit("\n\n"), c)
    else:
        v = c
    return F.when(has, v).otherwise(_c(prompt))


# ---------------------------------------------------------------- TX17 common keys
def common_keys(df: DataFrame, group: str, json_col: str) -> DataFrame:
    """Keys present in every JSON record of the group, sorted (intersection as a count)."""
    e = df.select(group, F.explode(F.array_distinct(F.json_object_keys(json_col))).alias("k"))
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    c = e.groupBy(group, "k").agg(F.count("*").alias("_c"))
    return (c.join(n, group).where(F.col("_c") == F.col("_n")).groupBy(group)
             .agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("keys")))


# ---------------------------------------------------------------- TX18 model output cleanup
# Boilerplate prefixes stripped from generated prompts, in the reference's order.
BOILERPLATE_PREFIXES = [
    "Here's the", "Here is the", "The modified", "The enhanced",
    "Modified prompt:", "Enhanced prompt:", "Paraphrased prompt:",
    "Simplified prompt:", "Reformatted prompt:", "Combined prompt:",
]


def clean_response(c, min_len: int = 10, max_len: int | None = None) -> Column:
    """strip; drop the first matching boilerplate prefix (then strip); < min_len ⇒ ''; cut at
    ``max_len`` only if given (the reference's is 2 000)."""
    t = strip_ws(c)
    out = t
    for p in reversed(BOILERPLATE_PREFIXES):
        out = F.when(F.lower(t).startswith(p.lower()), strip_ws(F.substring(t, len(p) + 1, 1 << 30))).otherwise(out)
    return F.when(F.length(out) < min_len, F.lit("")).otherwise(F.substring(out, 1, max_len) if max_len else out)


def numbered_items(df: DataFrame, text: str, key: str) -> DataFrame:
    """Lines that start with ``N.``, with the number removed."""
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    s = strip_ws("line")
    return lines.where(s.rlike(r"^\d+\.")).select(key, "line_no", strip_ws(F.regexp_replace(s, r"^\d+\.", "")).alias("item"))


# ---------------------------------------------------------------- TX19
def content_hash(c) -> Column:
    return F.md5(_c(c))


# ---------------------------------------------------------------- TX6 render
VAR_WHOLE_RE = r"(\{\{[^}]+\}\})"
VAR_SPLIT_RE = r"\{\{[^}]+\}\}"


def render_template(template, values) -> Column:
    """Replace every ``{{name}}`` / ``{{name:type}}`` by ``values[name]`` (a map column); a
    variable without a value keeps its placeholder."""
    t, m = _c(template), _c(values)
    parts = F.split(t, VAR_SPLIT_RE, -1)
    whole = F.regexp_extract_all(t, F.lit(VAR_WHOLE_RE), 1)
    names = F.transform(F.regexp_extract_all(t, F.lit(VAR_RE), 1), lambda s: strip_ws(F.split(s, ":", 2)[0]))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.size(names) - 1),
                                    lambda i: F.concat(F.coalesce(F.element_at(m, F.element_at(names, i + 1)), F.element_at(whole, i + 1)),
                                                       F.element_at(parts, i + 2))), "")
    return F.when(F.size(names) == 0, t).otherwise(F.concat(F.element_at(parts, 1), body))


def template_variable_issues(df: DataFrame, key: str, template: str, values: str) -> DataFrame:
    """Missing required variables (errors) and unused provided variables (warnings)."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(F.col(template), F.lit(VAR_RE), 1),
                                         lambda s: strip_ws(F.split(s, ":", 2)[0])))
    keys = F.map_keys(F.col(values))
    miss = df.select(key, F.explode(F.array_except(names, keys)).alias("variable")).select(
        key, "variable", F.lit("error").alias("severity"), F.concat(F.lit("Missing required variable: "), F.col("variable")).alias("message"))
    unused = df.select(key, F.explode(F.array_except(keys, names)).alias("variable")).select(
        key, "variable", F.lit("warning").alias("severity"), F.concat(F.lit("Unused variable: "), F.col("variable")).alias("message"))
    return miss.unionByName(unused)


# ---------------------------------------------------------------- TX15 section reorder
# Section keywords and the section order of the reference.
SECTION_KEYWORDS = [
    ("context", ["context", "background", "about"]),
    ("example", ["example", "instance", "sample"]),
    ("format", ["format", "output", "structure"]),
    ("constraint", ["constraint", "rule", "requirement", "must", "should"]),
    ("task", ["task", "goal", "objective", "do", "create", "generate"]),
]
SECTION_ORDER = ["context", "task", "other", "example", "format", "constraint"]


def reorder_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Split on blank lines (before any whitespace cleaning), strip the lines of each section,
    classify it by keywords (first class that matches) and re-join in the fixed class order
    (stable inside a class)."""
    secs = df.select(key, F.posexplode(F.split(F.col(text), r"\n(?U)\s*\n", -1)).alias("pos", "sec"))
    lines = F.filter(F.transform(F.split("sec", "\n", -1), lambda l: strip_ws(l)), lambda l: l != "")
    secs = secs.select(key, "pos", F.array_join(lines, "\n").alias("sec")).where(F.col("sec") != "")
    low = F.lower("sec")
    cls = F.lit("other")
    for name, words in reversed(SECTION_KEYWORDS):
        hit = None
        for w in words:
            h = low.contains(w)
            hit = h if hit is None else (hit | h)
        cls = F.when(hit, F.lit(name)).otherwise(cls)
    rank = F.array_position(F.array(*[F.lit(c) for c in SECTION_ORDER]), cls)
    s = secs.select(key, "pos", "sec", rank.alias("rank"))
    return s.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "sec"))),
                                                       lambda x: x["sec"]), "\n\n").alias("optimized"))
