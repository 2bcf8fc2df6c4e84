"""DuckDB spellings shared by the oracle texts (Python string builders)."""

from __future__ import annotations

WS = r"[\s\x{00A0}]+"


def split_ws(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS}'), lambda w: w <> '')"


def toks(e: str) -> str:
    return split_ws(f"lower({e})")


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}|{WS}$', '', 'g')"


def inter(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b})))"


def jaccard(a: str, b: str, both_empty="1.0", one_empty="0.0") -> str:
    da, db = f"list_distinct({a})", f"list_distinct({b})"
    return (f"(CASE WHEN len({da}) = 0 AND len({db}) = 0 THEN {both_empty} "
            f"WHEN len({da}) = 0 OR len({db}) = 0 THEN {one_empty} "
            f"ELSE {inter(a, b)} / (len({da}) + len({db}) - {inter(a, b)}) END)")


def r6(e: str, name: str) -> str:
    return f"round({e}, 6) AS {name}"


def ngram_counts(src: str, key: str, pred: str = "pred", ref: str = "ref", max_n: int = 4) -> str:
    """CTEs ``_ep`` (tokens), ``_g`` (grams), ``_nc`` (key, lp, lr, m1..m{max_n})."""
    ms = ", ".join(f"CAST(coalesce(sum(CASE WHEN n = {i} THEN m END), 0) AS BIGINT) AS m{i}"
                   for i in range(1, max_n + 1))
    return f"""_ep AS (SELECT {key} AS _k, {toks(pred)} AS pt, {toks(ref)} AS rt FROM {src}),
_g AS (
  SELECT _k, n, array_to_string(pt[i:i+n-1], ' ') AS g, 1 AS p, 0 AS r
  FROM (SELECT _k, pt, n, unnest(range(1, len(pt) - n + 2)) AS i FROM _ep, range(1, {max_n + 1}) t(n))
  UNION ALL
  SELECT _k, n, array_to_string(rt[i:i+n-1], ' ') AS g, 0 AS p, 1 AS r
  FROM (SELECT _k, rt, n, unnest(range(1, len(rt) - n + 2)) AS i FROM _ep, range(1, {max_n + 1}) t(n))),
_pg AS (SELECT _k, n, g, sum(p) AS cp, sum(r) AS cr FROM _g GROUP BY _k, n, g),
_pn AS (SELECT _k, n, sum(least(cp, cr)) AS m FROM _pg GROUP BY _k, n),
_nc AS (SELECT e._k AS {key}, len(e.pt) AS lp, len(e.rt) AS lr, {ms}
        FROM _ep e LEFT JOIN _pn USING (_k) GROUP BY e._k, len(e.pt), len(e.rt))"""


def bleu(max_n: int = 4) -> str:
    ps = [f"(CASE WHEN lp >= {i} THEN m{i} / lp ELSE 0.0 END)" for i in range(1, max_n + 1)]
    allpos = " AND ".join(f"{p} > 0" for p in ps)
    logs = " + ".join(f"ln({p})" for p in ps)
    return (f"(CASE WHEN lp > 0 AND {allpos} THEN exp(({logs}) / {max_n}) * least(1.0, exp(1 - lr / lp)) "
            f"ELSE 0.0 END)")


def rouge_n(n: int) -> tuple[str, str, str]:
    pc, rc = f"greatest(lp - {n} + 1, 0)", f"greatest(lr - {n} + 1, 0)"
    p = f"(CASE WHEN {rc} = 0 THEN 0.0 WHEN {pc} > 0 THEN m{n} / {pc} ELSE 0.0 END)"
    r = f"(CASE WHEN {rc} = 0 THEN 0.0 ELSE m{n} / {rc} END)"
    f = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return p, r, f
