"""SQL text for BM25 rankings, composed from a strategy's settings."""

from __future__ import annotations

from collections.abc import Sequence

from registry.views import AS_OF
from shelfmark.operators.lexical import Strategy

# Fixed values, written out again so that a change of a boost or an option in the library turns a row red.
EXPECTED = {s.name: s for s in (
    Strategy("baseline_bm25", {"title": 4.0, "brand": 2.0, "category": 1.5, "description": 0.8, "catalog_text": 0.5}, "and"),
    Strategy("boosted_bm25", {"title": 4.0, "brand": 2.0, "category": 1.5, "description": 1.0, "catalog_text": 0.8}, "or", 75, True, 0.01, 0.1),
    Strategy("enriched_profile", {"search_profile": 3.0, "title": 2.0, "category": 1.5, "brand": 1.0, "description": 0.5}, "or", 70, True),
    Strategy("baseline_lexical", {"title": 4.0, "brand": 2.0, "category": 1.5, "description": 0.8, "catalog_text": 0.5}, "and"),
    Strategy("boosted_lexical", {"title": 4.0, "brand": 2.0, "category": 1.5, "description": 0.8, "catalog_text": 0.5}, "and", None, False, 0.02, 0.2),
)}

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def tokens(column: str) -> str:
    return TOKENS.format(column)


def postings(kinds: dict[str, str], docs: str) -> str:
    parts = []
    for name, kind in kinds.items():
        toks = tokens(name) if kind == "text" else f"[lower({name})]"
        parts.append(f"SELECT product_id, '{name}' AS field, len(t) AS dl, unnest(t) AS term "
                     f"FROM (SELECT product_id, {toks} AS t FROM {docs})")
    union = " UNION ALL ".join(parts)
    return f"""
postings AS (SELECT product_id, field, dl, term, count(*) AS tf FROM ({union}) GROUP BY ALL),
stats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
heads AS (SELECT field, count(DISTINCT product_id) AS n, sum(tf) / count(DISTINCT product_id) AS avgdl
          FROM postings GROUP BY field)"""


def plan_values(strategies: Sequence[Strategy]) -> str:
    rows = []
    for s in strategies:
        for name, boost in sorted(s.boosts.items()):
            percent = "NULL" if s.match_percent is None else str(s.match_percent)
            rows.append(f"('{s.name}', '{name}', '{s.kinds[name]}', CAST({boost} AS DOUBLE), '{s.operator}', "
                        f"CAST({percent} AS INTEGER), {str(s.fuzzy).upper()})")
    return f"plan(strategy, field, kind, boost, operator, percent, fuzzy) AS (VALUES {', '.join(rows)})"


def scored(strategies: Sequence[Strategy], docs: str = "catalog") -> str:
    """CTEs up to ``fields``: the score of every field that matches."""
    kinds = {name: s.kinds[name] for s in strategies for name in s.boosts}
    any_fuzzy = any(s.fuzzy for s in strategies)
    near = """
near AS (
  SELECT a.field, a.clause, s.term, s.df, levenshtein(a.clause, s.term) AS distance
  FROM (SELECT DISTINCT field, clause FROM clauses WHERE fuzzy) a JOIN stats s ON a.field = s.field
  WHERE levenshtein(a.clause, s.term) <=
    CASE WHEN length(a.clause) <= 2 THEN 0 WHEN length(a.clause) <= 5 THEN 1 ELSE 2 END),
expanded AS (
  SELECT TRUE AS fuzzy, field, clause, term, max(df) OVER (PARTITION BY field, clause) AS df,
    1 - distance / least(length(clause), length(term)) AS weight
  FROM near
  UNION ALL
  SELECT FALSE, s.field, s.term, s.term, s.df, 1.0 FROM stats s)""" if any_fuzzy else """
expanded AS (SELECT FALSE AS fuzzy, field, term AS clause, term, df, 1.0 AS weight FROM stats)"""
    return f"""{postings(kinds, docs)},
{plan_values(strategies)},
cells AS (
  SELECT strategy, qid, field, kind, boost, operator, percent, fuzzy,
    CASE WHEN kind = 'text' THEN {tokens('query')} ELSE [lower(trim(query))] END AS terms
  FROM queries CROSS JOIN plan WHERE trim(query) <> ''),
clauses AS (
  SELECT *, count(*) OVER (PARTITION BY strategy, qid, field) AS n_terms FROM (
    SELECT strategy, qid, field, kind, boost, operator, percent, fuzzy, clause, count(*) AS qtf
    FROM (SELECT * EXCLUDE (terms), unnest(terms) AS clause FROM cells) GROUP BY ALL)),
{near.strip()},
weights AS (
  SELECT c.strategy, c.qid, c.field, c.kind, c.clause, e.term, e.df, h.avgdl, c.boost,
    ln(1 + (h.n - e.df + 0.5) / (e.df + 0.5)) AS idf,
    c.qtf * e.weight * ln(1 + (h.n - e.df + 0.5) / (e.df + 0.5)) * c.boost AS w,
    CASE WHEN operator = 'and' THEN n_terms WHEN percent IS NULL THEN 1 WHEN n_terms <= 2 THEN n_terms
      ELSE greatest(1, n_terms * percent // 100) END AS needed
  FROM clauses c JOIN expanded e ON c.fuzzy = e.fuzzy AND c.field = e.field AND c.clause = e.clause
    JOIN heads h ON c.field = h.field),
hits AS (
  SELECT w.*, p.product_id, p.tf,
    w.w * CASE WHEN kind = 'keyword' THEN 1.0
      ELSE p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / w.avgdl)) END AS contribution
  FROM weights w JOIN postings p ON w.field = p.field AND w.term = p.term),
fields AS (
  SELECT strategy, qid, product_id, field, sum(contribution) AS field_score
  FROM hits GROUP BY strategy, qid, product_id, field, needed HAVING count(DISTINCT clause) >= needed)"""


def boost_sql(strategies: Sequence[Strategy]) -> str:
    cases = []
    for s in strategies:
        if s.boosted:
            days = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400000000.0"
            beyond = f"(greatest(0.0, abs({days}) - 7) / 30)"
            cases.append(
                f"WHEN strategy = '{s.name}' THEN sqrt({s.popularity_factor} * coalesce(popularity_score, 0)) "
                f"+ coalesce({s.freshness_weight} * pow(0.5, {beyond} * {beyond}), {s.freshness_weight})")
    return f"CASE {' '.join(cases)} ELSE 0 END" if cases else "0"


def ranking(strategies: Sequence[Strategy], size: int, docs: str = "catalog", where: str = "TRUE") -> str:
    """CTEs up to ``ranking`` (strategy, qid, product_id, score, rank) and ``matched`` (uncut)."""
    boosted = any(s.boosted for s in strategies)
    join = f"JOIN {docs} c USING (product_id)" if boosted or where != "TRUE" else ""
    add = f" + {boost_sql(strategies)}" if boosted else ""
    return f"""{scored(strategies, docs)},
best AS (SELECT strategy, qid, product_id, max(field_score) AS top FROM fields GROUP BY ALL),
matched AS (SELECT strategy, qid, product_id, round(top{add}, 6) AS score FROM best {join} WHERE {where}),
ranking AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY strategy, qid ORDER BY score DESC, product_id) AS rank FROM matched)
  WHERE rank <= {size})"""
