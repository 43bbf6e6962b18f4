"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality_rules import COMMON, MIN_WORDS, RULES, SYMBOLS, Rule



def quality_rules(rules: tuple[Rule, ...] = RULES, *, rounds: int = 40, tolerance: float = 1e-4, weight: float = 10.0, share: float = 0.8) -> str:
    """The counts of each text, and the label model by a recursive query over the vote patterns: one row per round."""
    n = len(rules)
    slots = f"range(1, {n + 1})"
    votes = ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 END" for r in rules)
    on_good, on_bad = ("[" + ", ".join(f"{x}::DOUBLE" for x in xs) + "]" for xs in zip(*((r.on_good, r.on_bad) for r in rules), strict=True))
    words = "[" + ", ".join(f"'{c}'" for c in dict.fromkeys(COMMON)) + "]"

    def posterior(v: str) -> str:
        each = f"CASE {v}[j] WHEN 1 THEN ln(g[j] / (1 - b[j])) WHEN 0 THEN ln((1 - g[j]) / b[j]) ELSE 0.0::DOUBLE END"
        return f"1 / (1 + exp(-(ln(share / (1 - share)) + list_sum(list_transform({slots}, lambda j: {each})))))"

    def total(of: str, when: str = "true") -> str:
        return f"list_sum(list_transform(z, lambda p: CASE WHEN {when} THEN {of} ELSE 0.0::DOUBLE END))"

    def right(of: str, hit: int, miss: int, prior: str) -> str:
        a, b = (total(of, f"p.v[j] = {x}") for x in (hit, miss))
        return f"list_transform({slots}, lambda j: ({a} + {prior}[j] * {weight}) / ({a} + {b} + {weight}))"

    good, bad = "p.q", "(p.n - p.q)"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM twice GROUP BY 1),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_intersect({words}, list_transform(w, lambda x: lower(x)))) AS n_common,
  length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, length(text) - length(replace(text, '!', '')) AS n_shouts
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
v AS (SELECT *, [{votes}] AS v FROM s),
ps AS (SELECT list({{'v': v, 'n': n}}) AS ps FROM (SELECT v, count(*) AS n FROM v GROUP BY v)),
em AS (SELECT 0 AS step, {share}::DOUBLE AS share, {on_good} AS g, {on_bad} AS b, 1.0::DOUBLE AS moved
  UNION ALL
  SELECT step + 1, s2, g2, b2, list_max([abs(s2 - share)] || list_transform({slots}, lambda j: greatest(abs(g2[j] - g[j]), abs(b2[j] - b[j])))) FROM (
    SELECT *, ({total(good)} + {share * weight}) / ({total(good)} + {total(bad)} + {weight}) AS s2, {right(good, 1, 0, "tg")} AS g2, {right(bad, 0, 1, "tb")} AS b2 FROM (
      SELECT em.*, {on_good} AS tg, {on_bad} AS tb, list_transform(ps, lambda p: {{'v': p.v, 'n': p.n, 'q': p.n * ({posterior("p.v")})}}) AS z FROM em, ps WHERE moved >= {tolerance} AND step < {rounds}))),
m AS (SELECT * FROM em ORDER BY step DESC LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(q, 6) AS quality, NOT base_failed AND q >= 0.5 AS kept FROM (
  SELECT v.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {posterior("v.v")} AS q FROM v, m)"""
