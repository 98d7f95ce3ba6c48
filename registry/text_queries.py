"""Text scoring queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry import ranking_sql as rs
from registry import views as v
from registry.core import SQL, query
from shelfmark import scale
from shelfmark.operators import fuzzy, inverted, lexical
from shelfmark.operators.lexical import Strategy
from shelfmark.plans import strategies as st

MATCH = Strategy("match", {"body": 1.0}, kinds={"body": "text"})
DOCS = """
docs AS (SELECT CAST(doc_id AS VARCHAR) AS product_id, text AS body FROM documents),
queries AS (SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark)"""
MSM = Strategy("msm_75", st.BASELINE_BOOSTS, match_percent=75)
CAT = f"WITH {v.CATALOG.strip()}, {v.CATALOG_QUERIES.strip()}, "
RANKED = "SELECT strategy, qid, product_id, CAST(rank AS BIGINT) AS rank, score FROM ranking"


def shown(ranking):
    return ranking.select("strategy", "qid", "product_id", F.col("rank").cast("bigint").alias("rank"), "score")


def _catalog_ranking(names, size=10):
    return f"{CAT}{rs.ranking([rs.EXPECTED[n] for n in names], size)} {RANKED}"


@query(f"WITH {DOCS.strip()}, {rs.ranking([MATCH], 10, 'docs')} {RANKED}")
def bm25_match_topk(spark, d):
    return shown(lexical.rank(v.documents(spark, d), v.text_queries(spark, d), [MATCH], 10))


@query(f"""WITH docs AS (SELECT doc_id, {rs.tokens('text')} AS t FROM documents)
SELECT 'body' AS field, term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf
FROM (SELECT doc_id, unnest(t) AS term FROM docs) GROUP BY term""")
def term_statistics(spark, d):
    counts = lexical.postings(v.documents(spark, d), {"body": "text"})
    return counts.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf"))


_KINDS = dict(lexical.FIELD_KINDS)


@query(f"WITH {v.CATALOG.strip()}, {rs.postings(_KINDS, 'catalog').strip()} "
       "SELECT field, CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl FROM heads")
def field_statistics(spark, d):
    stats = lexical.term_statistics(v.catalog(spark, d), _KINDS).where("term = ''")
    return stats.select("field", F.col("df").alias("n"), F.round(F.col("total") / F.col("df"), 6).alias("avgdl"))


@query(_catalog_ranking(["baseline_bm25"]))
def baseline_bm25(spark, d):
    return shown(st.search_all(v.catalog(spark, d), v.catalog_queries(spark, d), ["baseline_bm25"]))


@query(f"{CAT}{rs.ranking([Strategy('msm_75', rs.EXPECTED['baseline_bm25'].boosts, match_percent=75)], 10)} {RANKED}")
def minimum_should_match(spark, d):
    return shown(lexical.rank(v.catalog(spark, d), v.catalog_queries(spark, d), [MSM], 10))


@query(f"""WITH words AS (SELECT DISTINCT unnest({rs.tokens('p_name')}) AS term FROM part),
typos AS (SELECT DISTINCT 'title' AS field, unnest({rs.tokens("substr(p_name, 1, 1) || substr(p_name, 3)")}) AS clause
          FROM part),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT p_partkey, unnest({rs.tokens('p_name')}) AS term FROM part)
       GROUP BY term)
SELECT field, clause, term, CAST(df AS BIGINT) AS df, CAST(levenshtein(clause, term) AS BIGINT) AS distance,
  round(1 - levenshtein(clause, term) / least(length(clause), length(term)), 6) AS weight
FROM typos, df WHERE levenshtein(clause, term) <=
  CASE WHEN length(clause) <= 2 THEN 0 WHEN length(clause) <= 5 THEN 1 ELSE 2 END""")
def fuzzy_expand(spark, d):
    part = v.table(spark, d, "part").withColumnRenamed("p_name", "title")
    vocabulary = lexical.term_statistics(part, {"title": "text"}).where("term <> ''").select("field", "term", "df")
    typed = F.concat(F.substring("title", 1, 1), F.expr("substring(title, 3)"))
    asked = part.select(F.lit("title").alias("field"), F.explode(lexical.tokens(typed)).alias("clause")).distinct()
    return fuzzy.expand(asked, vocabulary).select(
        "field", "clause", "term", "df", F.col("distance").cast("bigint").alias("distance"),
        F.round("weight", 6).alias("weight"))


@query(_catalog_ranking(["boosted_bm25"]))
def boosted_bm25(spark, d):
    return shown(st.search_all(v.catalog(spark, d), v.catalog_queries(spark, d), ["boosted_bm25"], as_of=v.as_of()))


@query(_catalog_ranking(["enriched_profile"]))
def enriched_profile(spark, d):
    return shown(st.search_all(v.catalog(spark, d), v.catalog_queries(spark, d), ["enriched_profile"]))


@query(_catalog_ranking(["boosted_lexical"]))
def boosted_lexical(spark, d):
    return shown(st.search_all(v.catalog(spark, d), v.catalog_queries(spark, d), ["boosted_lexical"], as_of=v.as_of()))


@query(_catalog_ranking(st.EVALUATED))
def all_strategies(spark, d):
    return shown(st.search_all(v.catalog(spark, d), v.catalog_queries(spark, d), as_of=v.as_of()))


REQUESTS = """
prices AS (SELECT p_brand, avg(p_retailprice) AS mean_price FROM part GROUP BY p_brand),
requests AS (
  SELECT 'c:' || p_name || '|' || p_type AS qid, p_name AS query, p_type AS f_category, NULL AS f_brand,
    CAST(NULL AS VARCHAR) AS f_availability, CAST(NULL AS DOUBLE) AS f_min_price, CAST(NULL AS DOUBLE) AS f_max_price
  FROM (SELECT DISTINCT p_name, p_type FROM part)
  UNION ALL
  SELECT 'b:' || p_brand, '', NULL, upper(p_brand), 'in_stock', mean_price, mean_price + 50 FROM prices)"""


def requests(spark, d):
    """Filtered requests: a name within a category, and text-free ones per brand."""
    part = v.table(spark, d, "part")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    named = part.select("p_name", "p_type").distinct().select(
        F.concat(F.lit("c:"), "p_name", F.lit("|"), "p_type").alias("qid"), F.col("p_name").alias("query"),
        F.col("p_type").alias("f_category"), text.alias("f_brand"), text.alias("f_availability"),
        number.alias("f_min_price"), number.alias("f_max_price"))
    priced = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean_price")).select(
        F.concat(F.lit("b:"), "p_brand").alias("qid"), F.lit("").alias("query"), text.alias("f_category"),
        F.upper("p_brand").alias("f_brand"), F.lit("in_stock").alias("f_availability"),
        F.col("mean_price").alias("f_min_price"), (F.col("mean_price") + 50).alias("f_max_price"))
    return named.unionByName(priced)


_BOOSTED = st.strategy("boosted_lexical")


@query(f"""WITH {v.CATALOG.strip()}, {REQUESTS.strip()},
queries AS (SELECT qid, query FROM requests), {rs.scored([rs.EXPECTED['boosted_lexical']])},
best AS (
  SELECT strategy, qid, product_id, max(field_score) AS top FROM fields GROUP BY ALL
  UNION ALL
  SELECT 'boosted_lexical', qid, product_id, 1.0 FROM requests, catalog WHERE trim(requests.query) = ''),
matched AS (
  SELECT strategy, best.qid, best.product_id, round(top + {rs.boost_sql([rs.EXPECTED['boosted_lexical']])}, 6) AS score
  FROM best JOIN catalog c ON best.product_id = c.product_id JOIN requests r ON best.qid = r.qid
  WHERE (f_category IS NULL OR lower(c.category) = lower(f_category)) AND (f_brand IS NULL OR lower(c.brand) = lower(f_brand))
    AND (f_availability IS NULL OR c.availability = f_availability)
    AND (f_min_price IS NULL OR price >= f_min_price) AND (f_max_price IS NULL OR price <= f_max_price)),
ranking AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, qid ORDER BY score DESC, product_id) AS rank
                 FROM matched) WHERE rank <= 10)
{RANKED}""")
def filtered_search(spark, d):
    return shown(st.product_search(v.catalog(spark, d), requests(spark, d), True, 10, v.as_of()))


@query(f"""{CAT}{rs.ranking([rs.EXPECTED['enriched_profile']], 10)},
totals AS (SELECT qid, count(*) AS total FROM matched GROUP BY qid),
counts AS (SELECT qid, count(*) AS n FROM ranking GROUP BY qid)
SELECT r.strategy, r.qid, CAST(total AS BIGINT) AS total, CAST(n AS BIGINT) AS "count", CAST(rank AS BIGINT) AS rank, score,
  product_id AS "productId", title, description, brand, category,
  'audience=' || a_audience || ';color=' || a_color || ';product_locale=us;size=' || a_size AS attributes,
  price, currency, availability, coalesce(popularity_score, 0.0) AS "popularityScore", seller_id AS "sellerId",
  strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS "updatedAt"
FROM ranking r JOIN catalog USING (product_id) JOIN totals ON r.qid = totals.qid JOIN counts ON r.qid = counts.qid""")
def search_products(spark, d):
    rows = st.search_products(v.catalog(spark, d), v.catalog_queries(spark, d))
    return rows.withColumns({"attributes": map_text("attributes"), "rank": F.col("rank").cast("bigint")})


def map_text(name):
    """A map as text in key order, so that both engines print it alike."""
    cells = F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(cells, ";")


@query(f"""{CAT}{rs.ranking([rs.EXPECTED['enriched_profile']], 3)},
shown AS (
  SELECT h.strategy, h.qid, h.product_id, r.rank, h.field, h.clause, h.term, h.tf, h.df, h.idf, h.boost, h.contribution,
    round(f.field_score, 6) AS field_score
  FROM hits h JOIN ranking r ON h.strategy = r.strategy AND h.qid = r.qid AND h.product_id = r.product_id
    LEFT JOIN fields f ON h.strategy = f.strategy AND h.qid = f.qid AND h.product_id = f.product_id AND h.field = f.field)
SELECT strategy, qid, product_id, CAST(rank AS BIGINT) AS rank, field, clause, term, CAST(tf AS BIGINT) AS tf,
  CAST(df AS BIGINT) AS df, round(idf, 6) AS idf, boost, round(contribution, 6) AS contribution, field_score,
  coalesce(field_score = max(field_score) OVER (PARTITION BY strategy, qid, product_id), FALSE) AS wins
FROM shown""")
def explain_match(spark, d):
    rows = lexical.explain(
        v.catalog(spark, d), v.catalog_queries(spark, d), [st.strategy("enriched_profile")], 3)
    return rows.withColumns({
        "rank": F.col("rank").cast("bigint"), "idf": F.round("idf", 6), "contribution": F.round("contribution", 6)})


@query(f"""WITH {v.CATALOG.strip()}
SELECT lower(brand) AS "key", CAST(count(*) AS BIGINT) AS doc_count FROM catalog GROUP BY 1
ORDER BY doc_count DESC, "key" LIMIT 10""")
def facet_brand(spark, d):
    return lexical.facet(v.catalog(spark, d), "brand", 10)


_TUNED = st.tunable("boosted_bm25", {**st.BOOSTED_BOOSTS, "title": 6.0})


_TUNED_SQL = Strategy("boosted_bm25", {**rs.EXPECTED["boosted_bm25"].boosts, "title": 6.0}, "or", 75, True)


@query(f"{CAT}{rs.ranking([_TUNED_SQL], 10)} {RANKED}")
def tunable_search(spark, d):
    return shown(lexical.rank(v.catalog(spark, d), v.catalog_queries(spark, d), [_TUNED], 10))


def stored_index(spark, docs, kinds=None):
    """The inverted index of a corpus, stored anew for the query."""
    return inverted.write_index(docs, f"{scale.ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", kinds)


@query(f"WITH {DOCS.strip()}, {rs.ranking([MATCH], 10, 'docs')} {RANKED}")
def indexed_match_topk(spark, d):
    """The text search from stored postings, pruned by score bounds."""
    index = stored_index(spark, v.documents(spark, d), {"body": "text"})
    return shown(inverted.search(index, v.text_queries(spark, d), [MATCH], 10))


@query(_catalog_ranking(st.EVALUATED))
def indexed_strategies(spark, d):
    index = stored_index(spark, v.catalog(spark, d))
    return shown(inverted.search(index, v.catalog_queries(spark, d), [st.strategy(n) for n in st.EVALUATED], 10, v.as_of()))


@query(SQL["filtered_search"])
def indexed_requests(spark, d):
    """Filtered and text-free requests from the stored index; equal filters share one list."""
    return shown(inverted.search(stored_index(spark, v.catalog(spark, d)), requests(spark, d), [_BOOSTED], 10, v.as_of()))


_MIXED = "CASE length(qid) % 3 WHEN 0 THEN 'baseline_bm25' WHEN 1 THEN 'boosted_bm25' ELSE 'enriched_profile' END"


@query(f"""{CAT}{rs.ranking([rs.EXPECTED[n] for n in st.EVALUATED], 50)},
totals AS (SELECT strategy, qid, count(*) AS total FROM matched GROUP BY strategy, qid)
SELECT r.strategy, r.qid, CAST(total AS BIGINT) AS total, CAST(least(total, 1 + length(r.qid) % 12) AS BIGINT) AS "count", CAST(rank AS BIGINT) AS rank, score,
  product_id AS "productId" FROM ranking r JOIN totals t ON r.strategy = t.strategy AND r.qid = t.qid
WHERE r.strategy = {_MIXED.replace('qid', 'r.qid')} AND rank <= 1 + length(r.qid) % 12""")
def search_requests(spark, d):
    """Every request with its own strategy and size, in one scoring."""
    queries = v.catalog_queries(spark, d)
    asked = queries.select("qid", "query", F.expr(_MIXED).alias("strategy"), (F.length("qid") % 12 + 1).alias("size"))
    rows = st.search_requests(v.catalog(spark, d), asked, v.as_of())
    return rows.select("strategy", "qid", "total", "count", F.col("rank").cast("bigint").alias("rank"), "score", "productId")
