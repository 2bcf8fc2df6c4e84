"""SQL twins (DuckDB dialect) of :mod:`evalspark.sources.bindings`.

The texts are the fixture bindings as agreed for the oracle; a query's SQL
names the ones it reads and they are prefixed as CTEs.
"""

from __future__ import annotations

BINDINGS: dict[str, str] = {
    "eval_pairs": """eval_pairs AS (
  SELECT doc_id AS pair_id, lang,
         CASE WHEN doc_id % 11 = 10 THEN '' ELSE array_to_string(tok, ' ') END AS pred,
         CASE WHEN doc_id % 5 = 0 THEN lower(array_to_string(tok, '  '))
              ELSE array_to_string([tok[i] FOR i IN range(1, len(tok) + 1) IF (i + doc_id) % 7 <> 0], ' ') END AS ref
  FROM (SELECT doc_id, lang,
               list_filter(regexp_split_to_array(text, '[\\s\\x{00A0}]+'), lambda w: w <> '') AS tok
        FROM documents) t)""",
    "turns": """turns AS (
  SELECT conv_id, turn, text AS context, nxt AS response
  FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t
  WHERE role = 'user' AND nrole = 'assistant')""",
    "responses": """responses AS (SELECT conv_id AS group_id, turn AS idx, conv_id % 5 AS fold, text AS response FROM conversations WHERE role = 'assistant')""",
    "nulled_orders": """nulled_orders AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus
  FROM orders)""",
    "prompt_logs": """prompt_logs AS (
  SELECT event_id AS request_id, ts AS "timestamp", concat('prompt ', event_type, ' ', props) AS prompt,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('response to ', event_id) END AS response,
         CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('model-', user_id % 4) END AS model,
         CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE value END AS latency,
         CASE WHEN event_id % 19 = 0 THEN '' ELSE concat('s', user_id) END AS session_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS output_tokens,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 0.001::DOUBLE AS cost,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN concat('Timeout: after ', user_id) ELSE 'RateLimit' END END AS error,
         user_id
  FROM events)""",
    "logs": """logs AS (
  SELECT event_id AS id, ts AS "timestamp",
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' WHEN 'purchase' THEN 'CRITICAL' ELSE 'INFO' END AS level,
         event_type AS category, concat('Event ', event_type, ' by user ', user_id) AS message, props AS metadata,
         concat('s', user_id) AS session_id, value AS duration_ms, user_id
  FROM events)""",
    "prompts": """prompts AS (
  SELECT c_custkey AS id, c_name AS title, concat('Segment: ', c_mktsegment, ' for ', c_name) AS content, c_mktsegment AS model_type,
         [lower(c_mktsegment), concat('n', c_nationkey % 5), concat('k', c_custkey % 3)] AS tags, c_nationkey AS created_by,
         TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 60 AS INTEGER)) AS created_at,
         CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-03-01' END AS deleted_at
  FROM customer)""",
    "prompt_variants": """prompt_variants AS (
  SELECT o_orderkey AS id, o_custkey AS prompt_id, o_orderpriority AS strategy,
         CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN 0.0 ELSE (o_orderkey % 101) / 100.0::DOUBLE END AS performance_score,
         o_orderdate AS created_at, CASE WHEN o_orderkey % 12 = 0 THEN TIMESTAMP '2024-03-01' END AS deleted_at
  FROM orders)""",
    "sessions": """sessions AS (
  SELECT o_orderkey AS job_id, o_custkey AS prompt_id, o_custkey % 20 AS batch_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
         o_orderkey % 100 AS progress, o_orderdate AS started_at, o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) AS completed_at
  FROM orders)""",
    "eval_results": """eval_results AS (
  SELECT l_suppkey AS run_id, l_partkey AS variant_id, l_orderkey AS case_id, l_linenumber AS sample_index, l_linestatus AS strategy,
         l_returnflag <> 'R' AS success, l_quantity * 40 AS latency_ms, m.metric,
         CASE m.metric WHEN 'exact_match' THEN CAST(l_orderkey % 3 = 0 AS DOUBLE) WHEN 'bleu' THEN (l_partkey % 100) / 100.0::DOUBLE
                       ELSE (l_quantity * 2) / 100.0::DOUBLE END AS score
  FROM lineitem, (VALUES ('exact_match'), ('bleu'), ('rouge')) m(metric))""",
    "opt_history": """opt_history AS (
  SELECT run_id, iteration, current_score, max(current_score) OVER (PARTITION BY run_id ORDER BY iteration) AS best_score
  FROM (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iteration, value AS current_score FROM events) t)""",
    "variants": """variants AS (
  SELECT d.doc_id AS id, d.text AS content, CASE d.doc_id % 3 WHEN 0 THEN 'ape' WHEN 1 THEN 'stable' ELSE 'custom' END AS strategy,
         (d.n_chars % 101) / 100.0::DOUBLE AS quality_score, (d.doc_id % 97) / 96.0::DOUBLE AS diversity_score, d.source AS base_prompt,
         (d.doc_id % 10) * 0.1::DOUBLE AS generation_time
  FROM documents d)""",
    "templates": """templates AS (SELECT * FROM (VALUES (1, 'Answer this: {input}'), (2, 'Answer this: [INPUT]'), (3, 'Answer this:'), (4, 'Hi {{ name:string }}, rate {{item}}')) t(template_id, template))""",
    "judge_raw": """judge_raw AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'Score: 7.5 of 10' WHEN 1 THEN '-3' WHEN 2 THEN 'no idea' WHEN 3 THEN '{"score": 0.8}' ELSE '12' END AS response FROM labels)""",
}
BINDINGS["eval_runs"] = BINDINGS["sessions"].replace("sessions AS (", "eval_runs AS (", 1)


def _rewrite_count_if(sql: str) -> str:
    """DuckDB's ``count_if`` is not BIGINT-typed; spell it as ``count(*) FILTER (WHERE ..)``."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _rewrite_count_if(sql[j + len(key):k - 1])
        out.append(f"count(*) FILTER (WHERE {inner})")
        i = k


def with_bindings(body: str, uses: tuple[str, ...] | list[str]) -> str:
    return _rewrite_count_if(_with_bindings(body, uses))


def _with_bindings(body: str, uses: tuple[str, ...] | list[str]) -> str:
    if not uses:
        return body.strip()
    ctes = ",\n".join(BINDINGS[u] for u in uses)
    body = body.strip()
    # A body that starts its own WITH (RECURSIVE) continues the CTE list.
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


# SQL spelling of a token array (Python ``str.lower().split()``), shared by the oracles.
def sql_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[\\s\\x{{00A0}}]+'), lambda w: w <> '')"


def sql_split_ws(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[\\s\\x{{00A0}}]+'), lambda w: w <> '')"
