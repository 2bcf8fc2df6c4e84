"""Corpus text-job queries (TX*) over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import r6
from ..operators import corpus as C
from ..operators.pair_metrics import format_prompt
from ..sources import bindings as B
from ..sources.tables import table
from . import sqlfrag as S
from .registry import query

WS = S.WS


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


CLEAN = f"coalesce(regexp_replace({S.strip('text')}, '{WS}', ' ', 'g'), '')"


@query("tx1_clean_text", sql=f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def tx1(spark, d):
    return _docs(spark, d).select("doc_id", C.clean_text("text").alias("cleaned"))


def _norm_sql():
    t = CLEAN
    t = f"regexp_replace({t}, '\\{{\\{{([^}}]+)\\}}\\}}', '{{{{ \\1 }}}}', 'g')"
    t = f"regexp_replace({t}, '[\\s\\x{{00A0}}]*([.!?])[\\s\\x{{00A0}}]*', '\\1 ', 'g')"
    t = f"regexp_replace({t}, ':[\\s\\x{{00A0}}]*', ': ', 'g')"
    return S.strip(t)


@query("tx2_normalize_text", sql=f"SELECT doc_id, {_norm_sql()} AS normalized FROM documents")
def tx2(spark, d):
    return _docs(spark, d).select("doc_id", C.normalize_text("text").alias("normalized"))


_STRUCT = S.strip("regexp_replace(" + f"regexp_replace({S.strip('text')}, '{WS}', ' ', 'g')" + ", '([.!?])[\\s\\x{00A0}]*', '\\1 ', 'g')")


@query("tx2_normalize_structure", sql=f"""
SELECT doc_id, CASE WHEN right(t, 1) IN ('.', '!', '?', ':') THEN t ELSE concat(t, '.') END AS normalized
FROM (SELECT doc_id, {_STRUCT} AS t FROM documents) x""")
def tx2_structure(spark, d):
    return _docs(spark, d).select("doc_id", C.normalize_structure("text").alias("normalized"))


_W = S.split_ws("text")
_NS = "len(regexp_split_to_array(text, '[.!?]+'))"
_VARS = f"len(list_distinct(list_transform(regexp_extract_all(text, '\\{{\\{{([^}}]+)\\}}\\}}', 1), lambda m: {S.strip('split_part(m, chr(58), 1)')})))"
_DIV = f"(CASE WHEN len({_W}) > 0 THEN len(list_distinct({S.toks('text')})) / len({_W}) ELSE 0.0 END)"
_SCORE = f"least(100.0, (len({_W}) / 10) * 0.3 + ({_NS} / 5) * 0.2 + ({_VARS} * 5) * 0.2 + ({_DIV} * 50) * 0.3)"
COMPLEXITY_SQL = f"""length(text) AS character_count, len({_W}) AS word_count, {_NS} AS sentence_count,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: len({S.split_ws('p')}) > 0)) AS paragraph_count,
  len(list_distinct({S.toks('text')})) AS unique_words, round({_DIV}, 6) AS vocabulary_diversity, {_VARS} AS variable_count,
  round(CASE WHEN {_NS} > 0 THEN len({_W}) / {_NS} ELSE 0.0 END, 6) AS avg_words_per_sentence,
  round(CASE WHEN len({_W}) > 0 THEN length(text) / len({_W}) ELSE 0.0 END, 6) AS avg_chars_per_word,
  round({_SCORE}, 6) AS complexity_score"""


@query("tx3_complexity", sql=f"SELECT doc_id, {COMPLEXITY_SQL} FROM documents")
def tx3(spark, d):
    c = C.with_complexity(_docs(spark, d))
    return c.select("doc_id", "character_count", "word_count", "sentence_count", "paragraph_count", "unique_words",
                    r6("vocabulary_diversity", "vocabulary_diversity"), "variable_count",
                    r6("avg_words_per_sentence", "avg_words_per_sentence"), r6("avg_chars_per_word", "avg_chars_per_word"),
                    r6("complexity_score", "complexity_score"))


def _tags_sql(t="text"):
    parts = [f"CASE WHEN regexp_matches({t}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for p, n in C.PATTERNS]
    parts.append(f"CASE WHEN len(regexp_extract_all({t}, '(?i){C.FEW_SHOT_RE}')) > 1 THEN 'few_shot_examples' END")
    parts.append(f"CASE WHEN regexp_matches({t}, '(?i){C.COT_RE}') THEN 'chain_of_thought' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@query("tx4_pattern_frequency", sql=f"""
SELECT pattern, count(*) AS count FROM (SELECT unnest({_tags_sql()}) AS pattern FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) u) t
GROUP BY pattern""")
def tx4(spark, d):
    texts = table(spark, d, "documents").select("text").unionByName(table(spark, d, "benchmark").select("text"))
    return C.pattern_frequency(texts, "text")


@query("tx4_pattern_tags", sql=f"SELECT doc_id, array_to_string({_tags_sql()}, ',') AS patterns FROM documents")
def tx4_tags(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(C.pattern_tags("text"), ",").alias("patterns"))


def _formatted(spark, d):
    bench = table(spark, d, "benchmark")
    return B.with_templates(bench).select("template_id", "item_id", format_prompt("template", "text").alias("prompt"))


FORMATTED_SQL = """f AS (SELECT t.template_id, b.item_id,
  CASE WHEN contains(t.template, '{input}') THEN replace(replace(replace(t.template, '{{', '{'), '}}', '}'), '{input}', b.text)
       WHEN contains(t.template, '[INPUT]') THEN replace(t.template, '[INPUT]', b.text)
       ELSE concat(t.template, chr(10), chr(10), 'Input: ', b.text) END AS prompt FROM templates t CROSS JOIN benchmark b)"""


@query("tx5_variable_schema", uses=("templates",), sql=f"""
WITH {FORMATTED_SQL},
m AS (SELECT template_id, item_id, unnest(regexp_extract_all(prompt, '\\{{\\{{([^}}]+)\\}}\\}}', 1)) AS m,
  unnest(range(len(regexp_extract_all(prompt, '\\{{\\{{([^}}]+)\\}}\\}}', 1)))) AS pos FROM f)
SELECT template_id, item_id, {S.strip("split_part(m, ':', 1)")} AS name, min(pos) AS first_pos,
  arg_min(CASE WHEN contains(m, ':') THEN {S.strip("substr(m, strpos(m, ':') + 1)")} ELSE 'string' END, pos) AS type, true AS required
FROM m GROUP BY ALL""")
def tx5(spark, d):
    f = _formatted(spark, d).withColumn("_k", F.struct("template_id", "item_id"))
    s = C.variable_schema(f, "prompt", "_k")
    return s.select(F.col("_k.template_id").alias("template_id"), F.col("_k.item_id").alias("item_id"), "name", "first_pos", "type", "required")


@query("tx7_validation_rules", sql="""
WITH b AS (
  SELECT doc_id, 'too_short' AS rule, 'error' AS severity FROM documents WHERE length(text) < 10
  UNION ALL SELECT doc_id, 'too_long', 'error' FROM documents WHERE length(text) > 50000
  UNION ALL SELECT doc_id, 'unmatched_braces', 'error' FROM documents WHERE length(text) - length(replace(text, '{', '')) <> length(text) - length(replace(text, '}', ''))
  UNION ALL SELECT doc_id, CASE WHEN regexp_matches(regexp_replace(text, '\\{\\{([^}]+)\\}\\}', '', 'g'), '\\{[^}]*\\{|\\}[^{]*\\}')
     THEN 'malformed_variables' ELSE 'malformed_variables_wellformed' END, 'error' FROM documents WHERE regexp_matches(text, '\\{[^}]*\\{|\\}[^{]*\\}')
  UNION ALL SELECT doc_id, 'trailing_whitespace', 'warning' FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l
     WHERE suffix(line, ' ') OR suffix(line, chr(9)))
SELECT rule, severity, count(DISTINCT doc_id) AS n_texts, count(*) AS n_issues FROM b GROUP BY rule, severity""")
def tx7(spark, d):
    i = C.validation_issues(_docs(spark, d), "text", "doc_id")
    return i.groupBy("rule", "severity").agg(F.count_distinct("doc_id").alias("n_texts"), F.count("*").alias("n_issues"))


_LOW = "lower(text)"
_VERB = " OR ".join(f"contains({_LOW}, '{v}')" for v in C.ACTION_VERBS)
_BLANK = f"len({S.split_ws('text')}) = 0"


@query("tx8_potential_issues", sql=f"""
WITH b AS (
  SELECT doc_id, 'empty' AS rule FROM documents WHERE {_BLANK}
  UNION ALL SELECT doc_id, 'token_limit' FROM documents WHERE NOT ({_BLANK}) AND length(text) > 10000
  UNION ALL SELECT doc_id, 'no_action_verb' FROM documents WHERE NOT ({_BLANK}) AND NOT ({_VERB})
  UNION ALL SELECT doc_id, 'unmatched_parentheses' FROM documents WHERE NOT ({_BLANK}) AND length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', ''))
  UNION ALL SELECT doc_id, 'unmatched_brackets' FROM documents WHERE NOT ({_BLANK}) AND length(text) - length(replace(text, '[', '')) <> length(text) - length(replace(text, ']', ''))
  UNION ALL SELECT doc_id, 'repetition' FROM (
     SELECT doc_id, n, word, count(*) AS c FROM (SELECT doc_id, len(tok) AS n, unnest(tok) AS word FROM (SELECT doc_id, {S.toks('text')} AS tok FROM documents) x) y
     WHERE length(word) > 3 GROUP BY doc_id, n, word) z WHERE c > n * 0.1)
SELECT rule, count(*) AS n_issues, count(DISTINCT doc_id) AS n_texts FROM b GROUP BY rule""")
def tx8(spark, d):
    i = C.potential_issues(_docs(spark, d), "text", "doc_id")
    return i.groupBy("rule").agg(F.count("*").alias("n_issues"), F.count_distinct("doc_id").alias("n_texts"))


@query("tx9_quality_report", sql=f"""
WITH c AS (SELECT doc_id, text, {_SCORE} AS raw_complexity, CASE WHEN {_NS} > 0 THEN len({_W}) / {_NS} ELSE 0.0 END AS awps,
  {_tags_sql()} AS tags, len({S.split_ws('text')}) AS token_count FROM documents),
q AS (SELECT doc_id, token_count, least(100.0, greatest(0.0, 100 - raw_complexity)) AS readability_score,
  CASE WHEN awps > 20 THEN 80.0 ELSE 100.0 END AS clarity_score,
  80.0 + CASE WHEN list_contains(tags, 'examples_requested') THEN 10 ELSE 0 END + CASE WHEN list_contains(tags, 'format_specification') THEN 10 ELSE 0 END
       + CASE WHEN list_contains(tags, 'context_provided') THEN 5 ELSE 0 END AS completeness_score FROM c)
SELECT doc_id, token_count, floor(readability_score * 10000 + 0.5) / 10000 AS readability_score, clarity_score, completeness_score,
  floor((readability_score * 0.3 + clarity_score * 0.3 + completeness_score * 0.4) * 10000 + 0.5) / 10000 AS overall_score,
  round(token_count / 1000 * 0.001 + token_count * 0.15 / 1000 * 0.002, 9) AS total_cost FROM q""")
def tx9(spark, d):
    q = C.with_quality(_docs(spark, d))
    return q.select("doc_id", F.col("token_count").cast("long").alias("token_count"),
                    (F.floor(F.col("readability_score") * 10000 + 0.5) / 10000).alias("readability_score"),
                    "clarity_score", "completeness_score",
                    (F.floor(F.col("overall_score") * 10000 + 0.5) / 10000).alias("overall_score"), F.round("total_cost", 9).alias("total_cost"))


_VAGUE = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(text), ' {w} ') THEN '{w}' END" for w in C.VAGUE_WORDS) + ")"


@query("tx10_suggestions", sql=f"""
WITH c AS (SELECT doc_id, text, {COMPLEXITY_SQL}, {_tags_sql()} AS tags, {_VAGUE} AS vague FROM documents),
s AS (
  SELECT 'structure' AS category, 'Consider adding context or background information' AS message, 2 AS priority FROM c WHERE NOT list_contains(tags, 'context_provided')
  UNION ALL SELECT 'structure', 'Specify the desired output format', 1 FROM c WHERE NOT list_contains(tags, 'format_specification')
  UNION ALL SELECT 'clarity', 'Consider adding examples to illustrate your request', 2 FROM c WHERE NOT list_contains(tags, 'examples_requested') AND word_count > 50
  UNION ALL SELECT 'readability', 'Break long sentences into shorter ones', 2 FROM c WHERE avg_words_per_sentence > 25
  UNION ALL SELECT 'vocabulary', 'Use more varied vocabulary', 3 FROM c WHERE vocabulary_diversity < 0.4
  UNION ALL SELECT 'specificity', concat('Replace vague word ''', vague, ''' with more specific terms'), 2 FROM c WHERE vague IS NOT NULL
  UNION ALL SELECT 'technique', 'Consider assigning a specific role to the AI', 3 FROM c WHERE NOT list_contains(tags, 'role_assignment') AND word_count > 100
  UNION ALL SELECT 'technique', 'Ask the AI to think step by step', 2 FROM c WHERE (contains(lower(text), 'analyze') OR contains(lower(text), 'explain')) AND NOT list_contains(tags, 'chain_of_thought'))
SELECT category, message, priority, count(*) AS count FROM s GROUP BY ALL""")
def tx10(spark, d):
    s = C.suggestions(_docs(spark, d), "text", "doc_id")
    return s.groupBy("category", "message", "priority").agg(F.count("*").alias("count"))


@query("tx11_token_cost_by_lang", sql=f"""
SELECT lang, CAST(sum(len({S.split_ws('text')})) AS BIGINT) AS input_tokens, CAST(sum(floor(len({S.split_ws('text')}) * 0.15)) AS BIGINT) AS estimated_output_tokens,
  round(sum(len({S.split_ws('text')}) / 1000 * 0.001 + len({S.split_ws('text')}) * 0.15 / 1000 * 0.002), 6) AS total_cost,
  CAST(sum(length(text) // 4) AS BIGINT) AS char_estimate_tokens FROM documents GROUP BY lang""")
def tx11(spark, d):
    docs = table(spark, d, "documents").select("lang", "text").withColumn("token_count", F.size(C.split_ws("text")))
    c = C.with_cost(docs, "token_count")
    return c.groupBy("lang").agg(F.sum("token_count").alias("input_tokens"), F.sum("estimated_output_tokens").alias("estimated_output_tokens"),
                                 r6(F.sum("total_cost"), "total_cost"),
                                 F.sum(F.floor(F.length("text") / 4)).cast("long").alias("char_estimate_tokens"))


def _trunc_sql(n):
    toks = S.split_ws("text")
    joined = f"array_to_string({toks}[1:{n}], ' ')"
    pieces = f"regexp_split_to_array({joined}, '[.!?]+')"
    return (f"CASE WHEN text IS NULL OR text = '' THEN '' WHEN len({toks}) <= {n} THEN text "
            f"WHEN len({pieces}) > 1 THEN array_to_string({pieces}[1:len({pieces}) - 1], '.') || '.' ELSE {joined} END")


@query("tx12_truncate", sql=f"SELECT doc_id, {_trunc_sql(50)} AS truncated FROM documents")
def tx12(spark, d):
    return _docs(spark, d).select("doc_id", C.truncate_tokens("text", 50).alias("truncated"))


_CONV_CLEAN = f"coalesce(regexp_replace({S.strip('text')}, '{WS}', ' ', 'g'), '')"


@query("tx13_merge_concatenate", sql=f"""
SELECT conv_id, string_agg({_CONV_CLEAN}, chr(10) || chr(10) ORDER BY turn, {_CONV_CLEAN}) AS merged FROM conversations
WHERE len({S.split_ws('text')}) > 0 GROUP BY conv_id""")
def tx13c(spark, d):
    return C.merge_texts(table(spark, d, "conversations"), "conv_id", "turn", "text", "concatenate")


@query("tx13_merge_template", sql=f"""
SELECT conv_id, string_agg(concat('## Section ', rn, chr(10), t), chr(10) || chr(10) ORDER BY rn) AS merged FROM
  (SELECT conv_id, {_CONV_CLEAN} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, {_CONV_CLEAN}) AS rn FROM conversations
   WHERE len({S.split_ws('text')}) > 0) x GROUP BY conv_id""")
def tx13t(spark, d):
    return C.merge_texts(table(spark, d, "conversations"), "conv_id", "turn", "text", "template")


@query("tx13_merge_interleave", sql=f"""
WITH c AS (SELECT conv_id, turn, {_CONV_CLEAN} AS t FROM conversations WHERE len({S.split_ws('text')}) > 0),
s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(t, '[.!?]+')) AS s, unnest(range(len(regexp_split_to_array(t, '[.!?]+')))) AS i FROM c)
SELECT conv_id, string_agg({S.strip('s')}, '. ' ORDER BY i, turn, {S.strip('s')}) || '.' AS merged FROM s WHERE len({S.split_ws('s')}) > 0 GROUP BY conv_id""")
def tx13i(spark, d):
    return C.merge_texts(table(spark, d, "conversations"), "conv_id", "turn", "text", "interleave")


@query("tx14_style_formal", sql="""
SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\bplease\\b', 'kindly', 'g'), '(?i)\\bcan you\\b', 'would you', 'g') AS formal,
  CASE WHEN suffix(rtrim(text), '?') THEN text ELSE concat('Can you ', lower(trim(text)), '?') END AS question FROM documents""")
def tx14(spark, d):
    return _docs(spark, d).select("doc_id", C.convert_style("text", "formal").alias("formal"),
                                  C.convert_style("text", "question").alias("question"))


@query("tx16_examples_numbered", sql="""
SELECT conv_id, string_agg(concat(chr(10), 'Example ', rn, ':', chr(10), 'role: ', role, chr(10), 'text: ', text, chr(10)), '' ORDER BY rn) AS examples
FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) t GROUP BY conv_id""")
def tx16(spark, d):
    return C.examples_block(table(spark, d, "conversations"), "conv_id", "turn", ["role", "text"], "numbered")


@query("tx16_examples_inline", sql="""
SELECT conv_id, concat(chr(10), 'Examples: ', string_agg(concat('(role: ', role, ', turn: ', turn, ')'), ', ' ORDER BY turn)) AS examples
FROM conversations GROUP BY conv_id""")
def tx16i(spark, d):
    return C.examples_block(table(spark, d, "conversations"), "conv_id", "turn", ["role", "turn"], "inline")


@query("tx16_add_context", uses=("turns",), sql=f"""
SELECT conv_id, turn, CASE WHEN context IS NOT NULL AND context <> '' THEN
  concat(coalesce(regexp_replace({S.strip('context')}, '{WS}', ' ', 'g'), ''), chr(10), chr(10), coalesce(regexp_replace({S.strip('response')}, '{WS}', ' ', 'g'), ''))
  ELSE response END AS prompt FROM turns""")
def tx16c(spark, d):
    t = B.turns(spark, d)
    return t.select("conv_id", "turn", C.add_context("response", "context", "before").alias("prompt"))


@query("tx17_common_keys", sql="""
WITH e AS (SELECT user_id, unnest(list_distinct(json_keys(props))) AS k FROM events),
n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
c AS (SELECT user_id, k, count(*) AS c FROM e GROUP BY user_id, k)
SELECT user_id, string_agg(k, ',' ORDER BY k) AS keys FROM c JOIN n USING (user_id) WHERE c = n GROUP BY user_id""")
def tx17(spark, d):
    return C.common_keys(table(spark, d, "events"), "user_id", "props")


def _prefixed(spark, d):
    k = F.col("doc_id") % 4
    pre = (F.when(k == 0, F.lit("Here's the modified prompt: ")).when(k == 1, F.lit("  the ENHANCED version "))
            .when(k == 2, F.lit("Paraphrased prompt:")).otherwise(F.lit("")))
    return _docs(spark, d).select("doc_id", F.concat(pre, F.col("text")).alias("response"))


def _clean_resp_sql():
    t = S.strip("response")
    out = t
    for p in reversed(C.BOILERPLATE_PREFIXES):
        q = p.replace("'", "''")
        out = f"CASE WHEN starts_with(lower({t}), lower('{q}')) THEN {S.strip(f'substr({t}, {len(p) + 1})')} ELSE {out} END"
    return f"CASE WHEN length({out}) < 10 THEN '' ELSE {out} END"


@query("tx18_clean_response", sql=f"""
WITH p AS (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'Here''s the modified prompt: ' WHEN 1 THEN '  the ENHANCED version '
  WHEN 2 THEN 'Paraphrased prompt:' ELSE '' END, text) AS response FROM documents)
SELECT doc_id, {_clean_resp_sql()} AS cleaned FROM p""")
def tx18(spark, d):
    return _prefixed(spark, d).select("doc_id", C.clean_response("response").alias("cleaned"))


@query("tx18_numbered_items", sql=f"""
WITH l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM conversations)
SELECT conv_id, line_no, {S.strip(f"regexp_replace({S.strip('line')}, '^[0-9]+\\.', '')")} AS item FROM l WHERE regexp_matches({S.strip('line')}, '^[0-9]+\\.')""")
def tx18n(spark, d):
    c = table(spark, d, "conversations")
    # One numbered line per assistant turn: "N. <first sentence>" prepended to the text.
    return C.numbered_items(c, "text", "conv_id")


@query("tx19_content_hash", sql="SELECT doc_id, md5(text) AS prompt_hash FROM documents")
def tx19(spark, d):
    return _docs(spark, d).select("doc_id", C.content_hash("text").alias("prompt_hash"))


def _render_input(spark, d):
    bench = table(spark, d, "benchmark")
    vals = F.when(F.col("item_id") % 3 != 0, F.create_map(F.lit("name"), F.concat(F.lit("item "), F.col("item_id").cast("string")),
                                                          F.lit("item"), F.col("text"))) \
        .otherwise(F.create_map(F.lit("name"), F.concat(F.lit("item "), F.col("item_id").cast("string")), F.lit("extra"), F.lit("x")))
    return B.with_templates(bench).select("template_id", "item_id", "template", vals.alias("vals"))


_RENDER_SQL = """r AS (SELECT t.template_id, b.item_id, t.template, b.text,
  regexp_split_to_array(t.template, '\\{\\{[^}]+\\}\\}') AS parts, regexp_extract_all(t.template, '(\\{\\{[^}]+\\}\\})', 1) AS whole,
  list_transform(regexp_extract_all(t.template, '\\{\\{([^}]+)\\}\\}', 1), lambda s: trim(split_part(s, ':', 1))) AS names
  FROM templates t CROSS JOIN benchmark b)"""


@query("tx6_render_template", uses=("templates",), sql=f"""WITH {_RENDER_SQL}
SELECT template_id, item_id, CASE WHEN len(names) = 0 THEN template ELSE parts[1] || array_to_string(list_transform(range(len(names)),
  lambda i: coalesce(CASE names[i + 1] WHEN 'name' THEN concat('item ', item_id) WHEN 'item' THEN CASE WHEN item_id % 3 <> 0 THEN text END END,
                     whole[i + 1]) || parts[i + 2]), '') END AS rendered FROM r""")
def tx6(spark, d):
    r = _render_input(spark, d)
    return r.select("template_id", "item_id", C.render_template("template", "vals").alias("rendered"))


@query("tx6_variable_issues", uses=("templates",), sql=f"""WITH {_RENDER_SQL},
v AS (SELECT template_id, item_id, list_distinct(names) AS names, CASE WHEN item_id % 3 <> 0 THEN ['name', 'item'] ELSE ['name', 'extra'] END AS keys FROM r)
SELECT template_id, item_id, variable, 'error' AS severity, concat('Missing required variable: ', variable) AS message
FROM (SELECT template_id, item_id, unnest(list_filter(names, lambda x: NOT list_contains(keys, x))) AS variable FROM v) a
UNION ALL
SELECT template_id, item_id, variable, 'warning', concat('Unused variable: ', variable)
FROM (SELECT template_id, item_id, unnest(list_filter(keys, lambda x: NOT list_contains(names, x))) AS variable FROM v) b""")
def tx6_issues(spark, d):
    r = _render_input(spark, d).withColumn("_k", F.struct("template_id", "item_id"))
    i = C.template_variable_issues(r, "_k", "template", "vals")
    return i.select(F.col("_k.template_id").alias("template_id"), F.col("_k.item_id").alias("item_id"), "variable", "severity", "message")


def _section_class_sql(s):
    out = "'other'"
    for name, words in reversed(C.SECTION_KEYWORDS):
        cond = " OR ".join(f"contains(lower({s}), '{w}')" for w in words)
        out = f"CASE WHEN {cond} THEN '{name}' ELSE {out} END"
    return out


@query("tx15_reorder_sections", sql=f"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[\\s\\x{{00A0}}]*\\n')) AS sec,
             unnest(range(len(regexp_split_to_array(text, '\\n[\\s\\x{{00A0}}]*\\n')))) AS pos FROM documents),
c AS (SELECT doc_id, pos, array_to_string(list_filter(list_transform(string_split(sec, chr(10)), lambda l: {S.strip('l')}), lambda l: l <> ''), chr(10)) AS sec FROM s),
k AS (SELECT doc_id, pos, sec, list_position({[c for c in C.SECTION_ORDER]}, {_section_class_sql('sec')}) AS rank FROM c WHERE sec <> '')
SELECT doc_id, string_agg(sec, chr(10) || chr(10) ORDER BY rank, pos, sec) AS optimized FROM k GROUP BY doc_id""")
def tx15(spark, d):
    return C.reorder_sections(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
