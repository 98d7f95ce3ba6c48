"""Vector, fusion, reranking, metric, latency, gate, tuning and replay queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry import ranking_sql as rs
from registry import views as v
from registry.core import SQL, query
from registry.text_queries import CAT, DOCS, MATCH, map_text
from shelfmark import scale
from shelfmark.functions.text import utc_text
from shelfmark.operators import events as ev
from shelfmark.operators import gate, latency, lexical, metrics, rerank, tune, vector_index, vectors
from shelfmark.plans import evaluate, hybrid, tuning
from shelfmark.plans import strategies as st
from shelfmark.sources.buckets import BucketedTable
from shelfmark.sources.experiments import ExperimentStore
from shelfmark.streaming.keyed import KeyedReplay
from shelfmark.streaming.replay import StreamReplay

# --- vectors and fusion -------------------------------------------------------

PIECES = r"list_filter(regexp_split_to_array(replace(lower({0}), '-', ' '), '\s+'), lambda x: x <> '')"


def hash_sql(source: str, text: str, key: str, name: str) -> str:
    """Components (key, dim, value) of the hash vectors of a table."""
    chunks = " UNION ALL ".join(
        f"SELECT {key}, CAST(('0x' || substr(h, {1 + 4 * i}, 4)) AS INTEGER) % 384 AS dim, "
        f"CASE WHEN CAST(('0x' || substr(h, {1 + 4 * i}, 2)) AS INTEGER) % 2 = 0 THEN n ELSE -n END AS step FROM {name}_h"
        for i in range(16))
    return f"""
{name}_t AS (SELECT {key}, {PIECES.format(text)} AS p, lower({text}) AS low FROM {source} WHERE {text} IS NOT NULL),
{name}_h AS (SELECT {key}, sha256(token) AS h, count(*) AS n FROM (
    SELECT {key}, unnest(CASE WHEN len(p) = 0 THEN [low] ELSE p END) AS token FROM {name}_t) GROUP BY ALL),
{name}_s AS (SELECT {key}, dim, sum(step) AS raw FROM ({chunks}) GROUP BY ALL),
{name} AS (SELECT {key}, dim, CASE WHEN len2 = 0 THEN 0.0 ELSE raw / sqrt(CAST(len2 AS DOUBLE)) END AS value FROM (
    SELECT *, sum(raw * raw) OVER (PARTITION BY {key}) AS len2 FROM {name}_s))"""


@query(f"""WITH {hash_sql('documents', 'text', 'doc_id', 'vec').strip()}
SELECT CAST(doc_id AS VARCHAR) AS product_id, CAST(dim AS INTEGER) AS dim, round(value, 9) AS value FROM vec""")
def hash_embedding(spark, d):
    rows = vectors.hash_components(v.documents(spark, d), "product_id", "body")
    return rows.select("product_id", "dim", F.round("value", 9).alias("value"))


CENTRES = """
cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centres AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY ALL),
lengths AS (SELECT label, sqrt(sum(x * x)) AS l FROM centres GROUP BY label),
norms AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM cells GROUP BY vec_id),
dots AS (SELECT q.label, c.vec_id, sum(q.x * c.x) AS dot FROM centres q JOIN cells c ON q.i = c.i GROUP BY ALL)"""


def centres(spark, d):
    """Mean vector of every label: the query side of the neighbour search."""
    cells = v.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("bigint").alias("qid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("embedding"))


@query(f"""WITH {CENTRES.strip()}
SELECT * FROM (
  SELECT CAST(d.label AS BIGINT) AS qid, d.vec_id AS product_id, round(dot / (q.l * c.l), 6) AS score,
    CAST(row_number() OVER (PARTITION BY d.label ORDER BY round(dot / (q.l * c.l), 6) DESC, d.vec_id) AS BIGINT) AS rank
  FROM dots d JOIN lengths q ON d.label = q.label JOIN norms c ON d.vec_id = c.vec_id) WHERE rank <= 10""")
def knn_topk(spark, d):
    corpus = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("product_id"), "embedding")
    return vectors.knn(scale.spread(corpus), centres(spark, d), 10).select(
        "qid", "product_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query(SQL["knn_topk"])
def indexed_knn(spark, d):
    """The same from a stored vector index that is asked for every candidate."""
    return _candidates(spark, d, centres(spark, d), 1 << 40)


@query()
def knn_candidates(spark, d):
    """Neighbours of every hundredth vector among as many candidates as give a recall of 0.95 on a sample; recall is tested."""
    asked = v.table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return _candidates(spark, d, asked, None)


def _candidates(spark, d, asked, candidates):
    corpus = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("product_id"), "embedding")
    index = vector_index.write_vector_index(scale.spread(corpus), f"{scale.ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}")
    if candidates is None:
        candidates = vector_index.calibrate(index, 10)
    return vector_index.search(index, asked, 10, candidates).select("qid", "product_id", F.col("rank").cast("bigint").alias("rank"), "score")


EMBED_TEXT = """
embed_text AS (SELECT product_id, title || ' ' || brand || ' ' || category || ' ' || description AS text FROM catalog)"""


def near_sql(k: int) -> str:
    return f"""{EMBED_TEXT.strip()}, {hash_sql('embed_text', 'text', 'product_id', 'vec').strip()},
{hash_sql('queries', 'query', 'qid', 'ask').strip()},
cosines AS (SELECT qid, product_id, round(sum(a.value * b.value), 6) AS score FROM ask a JOIN vec b USING (dim) GROUP BY ALL),
everything AS (SELECT qid, product_id, coalesce(score, 0.0) AS score
  FROM (SELECT qid FROM queries) CROSS JOIN (SELECT product_id FROM catalog) LEFT JOIN cosines USING (qid, product_id)),
near AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, product_id) AS rank FROM everything) WHERE rank <= {k})"""


def fused_sql(words: str, near: str, size: int) -> str:
    return f"""
lists AS (SELECT qid, product_id, rank, 0 AS list_no FROM {words} UNION ALL SELECT qid, product_id, rank, 1 FROM {near}),
fused AS (SELECT qid, product_id, sum(1.0 / (60 + rank)) AS score, min(list_no * 1000000 + rank) AS seen FROM lists GROUP BY ALL),
final AS (SELECT qid, product_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM fused)
SELECT qid, product_id, CAST(rank AS BIGINT) AS rank, round(score, 9) AS score FROM final WHERE rank <= {size}"""


def fused(df):
    return df.select("qid", "product_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 9).alias("score"))


@query(f"""{CAT}{rs.ranking([rs.EXPECTED['boosted_lexical']], 10)}, {near_sql(10)}, {fused_sql('ranking', 'near', 10)}""")
def hybrid_rrf(spark, d):
    return fused(hybrid.hybrid(v.catalog(spark, d), v.catalog_queries(spark, d), v.as_of()))


@query(f"""{CAT}{rs.ranking([rs.EXPECTED['baseline_lexical']], 50)}, {near_sql(50)}, {fused_sql('ranking', 'near', 10)}""")
def windowed_rrf(spark, d):
    return fused(hybrid.hybrid(v.catalog(spark, d), v.catalog_queries(spark, d), v.as_of(), window=50))


RRF_LISTS = """
price_list AS (SELECT p_brand AS qid, CAST(p_partkey AS VARCHAR) AS product_id,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
size_list AS (SELECT p_brand AS qid, CAST(p_partkey AS VARCHAR) AS product_id,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part)"""


@query(f"""WITH {RRF_LISTS.strip()}, a AS (SELECT * FROM price_list WHERE rank <= 100), b AS (SELECT * FROM size_list WHERE rank <= 100),
{fused_sql('a', 'b', 10)}""")
def rrf_fuse(spark, d):
    part = v.table(spark, d, "part")

    def ranked(column):
        rows = part.select(
            F.lit("s").alias("strategy"), F.col("p_brand").alias("qid"), F.col("p_partkey").alias("id"),
            F.col(column).cast("double").alias("score"))
        return lexical.top_k(rows, 100, id_col="id").select("qid", F.col("id").cast("string").alias("product_id"), "rank")

    return fused(vectors.rrf([ranked("p_retailprice"), ranked("p_size")]))


# --- reranking ----------------------------------------------------------------

ASCII = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
RERANK = f"""WITH {DOCS.strip()}, {rs.ranking([MATCH], 100, 'docs')},
sim AS (
  SELECT strategy, r.qid, product_id, rank, score, {ASCII.format('query')} AS a, {ASCII.format('body')} AS b
  FROM ranking r JOIN queries q ON r.qid = q.qid JOIN docs USING (product_id)),
scored_sim AS (
  SELECT strategy, qid, product_id, rank AS old_rank, CASE WHEN rank <= 20 THEN 0.001 * score +
    CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
    ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END ELSE score END AS new_score
  FROM sim),
reranked AS (
  SELECT strategy, qid, product_id, old_rank, new_score, row_number() OVER (PARTITION BY strategy, qid ORDER BY
    old_rank > 20, CASE WHEN old_rank <= 20 THEN -round(new_score, 9) ELSE 0 END, old_rank) AS rank FROM scored_sim)"""


def _reranked(spark, d):
    docs, asked = v.documents(spark, d), v.text_queries(spark, d)
    first = scale.settle(lexical.rank(docs, asked, [MATCH], 100)).df
    rows = rerank.candidates(first, docs).join(asked, "qid").withColumnRenamed("body", "text")
    return first, rerank.rerank_window(rows, 20)


@query(f"""{RERANK} SELECT strategy, qid, product_id, CAST(old_rank AS BIGINT) AS old_rank, CAST(rank AS BIGINT) AS rank,
  round(new_score, 6) AS score FROM reranked""")
def rerank_window(spark, d):
    rows = _reranked(spark, d)[1]
    return rows.withColumns({
        "old_rank": F.col("old_rank").cast("bigint"), "rank": F.col("rank").cast("bigint"), "score": F.round("score", 6)})


# Labelled documents are judged for one benchmark text each.
DOC_JUDGED = """
judgments AS (SELECT CAST(doc_id % (SELECT count(*) FROM benchmark) AS VARCHAR) AS query, CAST(doc_id AS VARCHAR) AS product_id,
  quality * 2 + 1 - toxic AS grade FROM labels)"""


def doc_judgments(spark, d):
    n = v.table(spark, d, "benchmark").agg(F.count(F.lit(1))).scalar()
    return v.table(spark, d, "labels").select(
        (F.col("doc_id") % n).cast("string").alias("query"), F.col("doc_id").cast("string").alias("product_id"),
        (F.col("quality") * 2 + 1 - F.col("toxic")).cast("int").alias("grade"))


def metric_sql(ranking: str, names: str, tag: str = "") -> str:
    """CTEs up to ``rows``: metrics per strategy and judged query at 1, 3, 5 and 10."""
    ks = (1, 3, 5, 10)
    gains = ", ".join(
        f"sum(CASE WHEN place <= {k} THEN (pow(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS ideal_{k}" for k in ks)
    found = ", ".join(
        f"sum(CASE WHEN rank <= {k} AND coalesce(grade, 0) > 0 THEN 1 ELSE 0 END) AS hits_{k}, "
        f"sum(CASE WHEN rank <= {k} THEN (pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1) ELSE 0 END) AS dcg_{k}" for k in ks)
    out = ", ".join(
        f"""round({expr}, 12) AS {name}_{k}""" for k in ks for name, expr in (
            ("precision_at", f"CASE WHEN returned > 0 THEN hits_{k} / CAST(least({k}, returned) AS DOUBLE) ELSE 0.0 END"),
            ("precision_k", f"coalesce(hits_{k}, 0) / {float(k)}"),
            ("recall_at", f"CASE WHEN relevant > 0 THEN coalesce(hits_{k}, 0) / CAST(relevant AS DOUBLE) ELSE 0.0 END"),
            ("mrr_at", f"CASE WHEN first <= {k} THEN 1.0 / first ELSE 0.0 END"),
            ("ndcg_at", f"CASE WHEN ideal_{k} > 0 THEN coalesce(dcg_{k}, 0) / ideal_{k} ELSE 0.0 END")))
    return f"""
ideal{tag} AS (SELECT query, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS relevant, {gains} FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS place FROM judgments) GROUP BY query),
found{tag} AS (SELECT r.strategy, r.qid AS query, count(*) AS returned, min(CASE WHEN j.grade > 0 THEN rank END) AS first,
    list(r.product_id ORDER BY rank) AS ids, {found}
  FROM {ranking} r LEFT JOIN judgments j ON r.qid = j.query AND r.product_id = j.product_id GROUP BY r.strategy, r.qid),
rows{tag} AS (SELECT n.strategy, i.query, coalesce(ids, []) AS ids, round(coalesce(1.0 / first, 0.0), 12) AS mrr, {out}
  FROM ideal{tag} i CROSS JOIN (SELECT unnest({names}) AS strategy) n
    LEFT JOIN found{tag} f ON i.query = f.query AND n.strategy = f.strategy)"""


def r9(expression: str) -> str:
    """The library rounds to 12 digits, the comparison to 9."""
    return f"round(round({expression}, 12), 9) + 0.0"


_DELTA = ("ndcg_at_10", "mrr", "precision_at_10")
RERANK_ROWS = f"""{RERANK}, {DOC_JUDGED.strip()}, {metric_sql('ranking', "['match']", '_b').strip()},
{metric_sql('reranked', "['match']", '_a').strip()}"""


def _rerank_rows(spark, d):
    first, second = _reranked(spark, d)
    before = first.withColumnRenamed("qid", "query")
    return evaluate.rerank_report(before, second.withColumnRenamed("qid", "query"), doc_judgments(spark, d), ["match"])


@query(f"""{RERANK_ROWS} SELECT b.strategy, b.query, {', '.join(
    f'{r9("b." + m)} AS before_{m}, {r9("a." + m)} AS after_{m}, {r9(f"a.{m} - b.{m}")} AS delta_{m}' for m in _DELTA)}
FROM rows_b b JOIN rows_a a ON b.strategy = a.strategy AND b.query = a.query""")
def rerank_report(spark, d):
    rows = _rerank_rows(spark, d)
    return rows.select("strategy", "query", *(
        (F.round(c, 9) + 0.0).alias(c) for c in rows.columns if c not in ("strategy", "query")))


@query(f"""{RERANK_ROWS}, times AS (SELECT text, length(text) AS ms FROM benchmark)
SELECT {r9("avg(a.ndcg_at_10 - b.ndcg_at_10)")} AS mean_delta,
  (SELECT quantile_cont(CAST(ms AS DOUBLE), 0.95) FROM times) AS p95_before_ms,
  (SELECT quantile_cont(CAST(ms AS DOUBLE) * 1.5, 0.95) FROM times) AS p95_after_ms,
  avg(a.ndcg_at_10 - b.ndcg_at_10) > 0 AS warning
FROM rows_b b JOIN rows_a a ON b.strategy = a.strategy AND b.query = a.query""")
def rerank_summary(spark, d):
    # Text length stands for the time of a request.
    times = v.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("query"),
        F.length("text").cast("double").alias("first_stage_latency_ms"), (F.length("text") * 1.5).alias("total_latency_ms"))
    rows = _rerank_rows(spark, d).join(times, "query", "full_outer")
    out = evaluate.rerank_summary(rows)
    return out.withColumn("mean_delta", F.round("mean_delta", 9) + 0.0)


# --- metrics --------------------------------------------------------------------

_STRATS = [rs.EXPECTED[n] for n in st.EVALUATED]
EVAL = f"{CAT}{rs.ranking(_STRATS, 10)}, {v.JUDGMENTS.strip()}, {metric_sql('ranking', repr(list(st.EVALUATED))).strip()}"
REPORT = ", ".join(f"{r9(m)} AS {m}" for m in metrics.REPORT_METRICS)


def _rankings(spark, d):
    ranked = st.search_all(v.catalog(spark, d), v.catalog_queries(spark, d), as_of=v.as_of())
    return ranked.withColumnRenamed("qid", "query")


def _rows(spark, d):
    return metrics.evaluation_rows(_rankings(spark, d), v.judgments(spark, d), st.EVALUATED)


def rounded(df, names, digits=9):
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


@query(f"{EVAL} SELECT strategy, query, 'ok' AS status, {REPORT}, array_to_string(ids, ',') AS ids FROM rows")
def evaluation_rows(spark, d):
    rows = rounded(_rows(spark, d), metrics.REPORT_METRICS)
    return rows.select("strategy", "query", "status", *metrics.REPORT_METRICS, F.array_join("ranked_product_ids", ",").alias("ids"))


@query(f"""{EVAL}, means AS (SELECT strategy, count(*) AS n, {', '.join(f'avg({m}) AS {m}' for m in metrics.REPORT_METRICS)} FROM rows GROUP BY strategy)
SELECT m.strategy, 'ok' AS status, CAST(m.n AS BIGINT) AS evaluated_queries, CAST(0 AS BIGINT) AS pending_queries,
  {', '.join(f'{r9("m." + m)} AS {m}, {r9(f"round(m.{m}, 12) - round(b.{m}, 12)")} AS delta_{m}' for m in metrics.REPORT_METRICS)}
FROM means m, (SELECT * FROM means WHERE strategy = 'baseline_bm25') b""")
def evaluation_summary(spark, d):
    out = metrics.summary(_rows(spark, d), "baseline_bm25")
    return rounded(out, [m for x in metrics.REPORT_METRICS for m in (x, f"delta_{x}")])


@query(f"""{EVAL}, keyed AS (SELECT *, row(round(ndcg_at_10, 9), round(mrr_at_10, 9), round(recall_at_5, 9), round(precision_at_5, 9)) AS k FROM rows),
topped AS (SELECT *, max(k) OVER (PARTITION BY query) AS best FROM keyed),
won AS (SELECT *, k = best AND (ndcg_at_10 + mrr_at_10 + recall_at_5 + precision_at_5) > 0 AS wins FROM topped),
named AS (SELECT query, array_to_string(list(strategy ORDER BY strategy) FILTER (wins), ',') AS winners, count(*) FILTER (wins) AS n FROM won GROUP BY query)
SELECT strategy, w.query, coalesce(winners, '') AS winners, CASE WHEN wins AND n > 1 THEN 'tie' WHEN wins THEN 'yes' ELSE '' END AS winner,
  CASE WHEN len(ids) = 0 THEN 'none' ELSE array_to_string(ids[1:5], ', ') END AS top_results
FROM won w JOIN named USING (query)""")
def winners(spark, d):
    return metrics.winners(_rows(spark, d)).select(
        "strategy", "query", F.array_join("winners", ",").alias("winners"), "winner", "top_results")


MULTI_K = " UNION ALL ".join(
    f"SELECT strategy, '{m}' AS metric, {k} AS k, {r9(f'avg({c})')} AS value FROM rows GROUP BY strategy"
    for k in (1, 3, 5, 10)
    for m, c in (("precision", f"precision_k_{k}"), ("recall", f"recall_at_{k}"), ("mrr", f"mrr_at_{k}"), ("ndcg", f"ndcg_at_{k}")))


@query(f"{EVAL} {MULTI_K}")
def metrics_at_k(spark, d):
    return rounded(metrics.metrics_at(_rankings(spark, d), v.judgments(spark, d), st.EVALUATED), ["value"])


@query(f"""{EVAL} SELECT strategy, {r9("avg(precision_at_10)")} AS precision_at_10, {r9("avg(mrr)")} AS mrr,
  {r9("avg(ndcg_at_10)")} AS ndcg_at_10 FROM rows GROUP BY strategy""")
def compare_strategies(spark, d):
    out = metrics.compare(_rankings(spark, d), v.judgments(spark, d), st.EVALUATED)
    return rounded(out, ["precision_at_10", "mrr", "ndcg_at_10"])


@query(f"""WITH {v.JUDGMENTS.strip()}
SELECT query, product_id, CAST(rank AS BIGINT) AS rank, CAST(grade AS INTEGER) AS grade FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, product_id) AS rank FROM judgments) WHERE rank <= 10""")
def ideal_ranking(spark, d):
    return metrics.ideal_ranking(v.judgments(spark, d), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH {v.JUDGMENTS.strip()}
SELECT query, CAST(count(*) AS BIGINT) AS judged FROM judgments
WHERE query IN (SELECT DISTINCT query FROM judgments ORDER BY query LIMIT 25) GROUP BY query""")
def first_queries(spark, d):
    return metrics.first_queries(v.judgments(spark, d), 25).groupBy("query").agg(F.count(F.lit(1)).alias("judged"))


# --- latency and gates ------------------------------------------------------------

SUMMARY = f"""WITH {v.ATTEMPTS.strip()}, latency AS (
SELECT strategy, CAST(count(*) AS BIGINT) AS "count", CAST(count(*) FILTER (success) AS BIGINT) AS success_count,
  CAST(count(*) FILTER (NOT success) AS BIGINT) AS error_count, CAST(count(*) FILTER (timed_out) AS BIGINT) AS timeout_count,
  coalesce(quantile_cont(latency_ms, 0.5) FILTER (success), 0) AS p50, coalesce(quantile_cont(latency_ms, 0.95) FILTER (success), 0) AS p95,
  coalesce(quantile_cont(latency_ms, 0.99) FILTER (success), 0) AS p99, coalesce(min(latency_ms) FILTER (success), 0) AS "min",
  coalesce(max(latency_ms) FILTER (success), 0) AS "max", coalesce(avg(latency_ms) FILTER (success), 0) AS "avg",
  count(*) FILTER (NOT success) / count(*) AS error_rate, count(*) FILTER (timed_out) / count(*) AS timeout_rate
FROM attempts GROUP BY strategy)"""
_NUMBERS = ["p50", "p95", "p99", "min", "max", "avg", "error_rate", "timeout_rate"]


@query(f"""{SUMMARY} SELECT strategy, "count", success_count, error_count, timeout_count,
  {', '.join(f'round("{n}", 6) AS "{n}"' for n in _NUMBERS)} FROM latency""")
def latency_summary(spark, d):
    return rounded(latency.summarize(v.attempts(spark, d)), _NUMBERS, 6)


@query(f"""WITH {v.ATTEMPTS.strip()} SELECT strategy, CAST(count(*) AS BIGINT) AS timeouts FROM attempts WHERE timed_out GROUP BY strategy""")
def timeout_errors(spark, d):
    return v.attempts(spark, d).where(latency.is_timeout(F.col("error"))).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("timeouts"))


@query(f"""WITH {v.ATTEMPTS.strip()}, pairs AS (SELECT strategy, query, count(*) AS n FROM attempts GROUP BY ALL)
SELECT CAST(count(DISTINCT query) AS BIGINT) AS query_count, CAST(max(n) AS BIGINT) AS repeat, CAST(sum(n) AS BIGINT) AS attempt_count FROM pairs""")
def latency_counters(spark, d):
    return latency.run_counters(v.attempts(spark, d))


# The three evaluated strategies in the order of the three attempt groups.
_NAMED = dict(zip(("s0", "s1", "s2"), st.EVALUATED))


def _gate_inputs(spark, d):
    times = v.attempts(spark, d)
    label = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))
    times = times.withColumn("strategy", F.try_element_at(label, F.col("strategy")))
    return metrics.summary(_rows(spark, d), "baseline_bm25"), latency.summarize(times)


GATE = SUMMARY.replace("WITH ", f"{EVAL}, ", 1)


@query(f"""{GATE}, named AS (SELECT CASE strategy {' '.join(f"WHEN '{k}' THEN '{n}'" for k, n in _NAMED.items())} END AS strategy, p95 FROM latency),
report AS (SELECT strategy, avg(precision_at_5) AS p5, avg(mrr_at_10) AS mrr FROM rows GROUP BY strategy)
SELECT strategy, check_no, metric, round(value, 6) AS value, bound, passed, CASE WHEN NOT passed THEN failure END AS failure FROM (
  SELECT r.strategy, 1 AS check_no, 'precision_at_5' AS metric, p5 AS value, CAST(0.6 AS DOUBLE) AS bound, p5 >= 0.6 AS passed,
    format('Precision@5 failed for {{}}: {{:.3f}} < {{:.3f}}', r.strategy, p5, CAST(0.6 AS DOUBLE)) AS failure FROM report r
  UNION ALL SELECT r.strategy, 2, 'mrr_at_10', mrr, 0.75, mrr >= 0.75,
    format('MRR@10 failed for {{}}: {{:.3f}} < {{:.3f}}', r.strategy, mrr, CAST(0.75 AS DOUBLE)) FROM report r
  UNION ALL SELECT r.strategy, 3, 'p95_ms', p95, 100, p95 <= 100,
    format('p95 latency failed for {{}}: {{:.2f}}ms > {{:.2f}}ms', r.strategy, p95, CAST(100 AS DOUBLE)) FROM report r JOIN named n ON r.strategy = n.strategy)""")
def quality_gate(spark, d):
    relevance, times = _gate_inputs(spark, d)
    bounds = relevance.select(
        "strategy", F.lit(0.6).alias("min_precision_at_5"), F.lit(0.75).alias("min_mrr_at_10"), F.lit(100.0).alias("max_p95_ms"))
    return rounded(gate.quality_gate(relevance, times, bounds), ["value"], 6)


@query(f"""{EVAL}, at_k AS ({MULTI_K})
SELECT strategy, metric, k, value, bound, value >= bound AS passed FROM at_k JOIN (
  SELECT 'enriched_profile' AS s, 'precision' AS m, 5 AS n, CAST(0.6 AS DOUBLE) AS bound UNION ALL SELECT 'enriched_profile', 'mrr', 10, 0.75
  UNION ALL SELECT 'baseline_bm25', 'ndcg', 10, 0.1 UNION ALL SELECT 'boosted_bm25', 'ndcg', 10, 0.1)
ON strategy = s AND metric = m AND k = n""")
def threshold_checks(spark, d):
    at = metrics.metrics_at(_rankings(spark, d), v.judgments(spark, d), st.EVALUATED)
    checks = gate.threshold_checks(
        at, {"enriched_profile": {"precision@5": 0.6, "mrr@10": 0.75}, "default": {"ndcg@10": 0.1}})
    return rounded(checks, ["value"])


# --- tuning -----------------------------------------------------------------------

_TUNED = "baseline_bm25"


def _configs() -> list[tuple[int, dict[str, float]]]:
    """The base and its candidates, worked out by hand for the SQL side."""
    base = st.BASELINE_BOOSTS
    out = [(-1, dict(base))]
    for i, name in enumerate(sorted(base)):
        for j, step in enumerate((1.5, 0.5)):
            out.append((2 * i + j, {**base, name: round(min(10.0, max(0.1, base[name] * step)), 4)}))
    return out


def _key(boosts: dict[str, float]) -> str:
    return "|".join([_TUNED] + [f"{k}={b:.4f}" for k, b in sorted(boosts.items())])


_PLAIN = st.tunable(_TUNED).with_boosts({f: 1.0 for f in st.BASELINE_BOOSTS})
_CONFIG_ROWS = ", ".join(
    f"({n}, '{_key(b)}', '{f}', CAST({x} AS DOUBLE))" for n, b in _configs() for f, x in sorted(b.items()))
TUNE = f"""{CAT}{rs.scored([_PLAIN])}, configs(candidate_no, "key", field, weight) AS (VALUES {_CONFIG_ROWS}),
tuned AS (SELECT "key" AS strategy, qid, product_id, round(max(field_score * weight), 6) AS score
  FROM fields JOIN configs USING (field) GROUP BY ALL),
ranking AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, qid ORDER BY score DESC, product_id) AS rank FROM tuned) WHERE rank <= 10),
{v.JUDGMENTS.strip()}, {metric_sql('ranking', '(SELECT list(DISTINCT "key") FROM configs)').strip()},
means AS (SELECT strategy AS "key", {', '.join(f'round(avg({m}), 12) AS {m}' for m in metrics.REPORT_METRICS)} FROM rows GROUP BY strategy)"""


def _tuned(spark, d):
    boosts = F.create_map(*(x for f, b in st.BASELINE_BOOSTS.items() for x in (F.lit(f), F.lit(b))))
    base = spark.range(1).select(F.lit(_TUNED).alias("strategy"), boosts.alias("boosts"))
    candidates = tune.propose(base)
    origin = base.select(
        "strategy", F.lit(-1).alias("candidate_no"), tune.config_key(F.col("strategy"), F.col("boosts")).alias("key"), "boosts")
    configs = candidates.select("strategy", "candidate_no", "key", "boosts").unionByName(origin)
    judged = v.judgments(spark, d)
    measured = tune.evaluate_configs(v.catalog(spark, d), v.catalog_queries(spark, d).select("qid", "query"), judged, _TUNED, configs, judged_by="qid")
    return configs, measured


@query(f"""{TUNE} SELECT "key", {REPORT} FROM means""")
def tune_evaluate(spark, d):
    return rounded(_tuned(spark, d)[1], metrics.REPORT_METRICS)


@query(f"""{TUNE}, base AS (SELECT precision_at_5 AS b FROM means WHERE "key" = '{_key(st.BASELINE_BOOSTS)}')
SELECT DISTINCT c.candidate_no, "key", {r9("precision_at_5")} AS precision_at_5, {r9("precision_at_5 - b")} AS delta,
  precision_at_5 >= 0.4 AND mrr_at_10 >= 0.3 AS gate_passed, precision_at_5 >= 0.4 AND mrr_at_10 >= 0.3 AND precision_at_5 > b AS kept,
  CASE WHEN NOT (precision_at_5 >= 0.4 AND mrr_at_10 >= 0.3) THEN 'rejected: below gate'
    WHEN precision_at_5 <= b THEN 'rejected: does not improve precision_at_5'
    ELSE 'kept: passes gate and improves precision_at_5' END AS reason
FROM means JOIN configs c USING ("key"), base WHERE c.candidate_no >= 0""")
def tune_decisions(spark, d):
    configs, measured = _tuned(spark, d)
    rows = scale.settle(configs.join(measured, "key")).df
    decided = tune.decide(rows.where("candidate_no >= 0"), rows.where("candidate_no < 0"), 0.4, 0.3)
    return rounded(decided, ["precision_at_5", "delta"]).select(
        "candidate_no", "key", "precision_at_5", "delta", "gate_passed", "kept", "reason")


@query()
def tune_rounds(spark, d):
    """Two rounds over one log: the second proposes what the first did not try.  What is proposed depends on what was kept; tested against the rules."""
    log = ExperimentStore(spark, f"{scale.ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}")
    for day in (1, 2):
        tuning.tune_round(
            log, v.catalog(spark, d), v.catalog_queries(spark, d).select("qid", "query"), v.judgments(spark, d), _TUNED,
            F.lit(f"2026-01-0{day}T00:00:00Z"), 0.4, 0.3, judged_by="qid")
    return log.all().select("id", "timestamp", F.round(F.col("metrics")["precision_at_5"], 9).alias("precision_at_5"), "gate_passed", "note")


# --- change replay ----------------------------------------------------------------

REPLAY = f"WITH {v.CHANGES.strip()}, {v.TARGET.strip()}"
OUTCOMES = f"{REPLAY} SELECT seq, product_id, source_system, kind AS event_type, k AS source_version, outcome FROM outcomes"
_OUT = ("seq", "product_id", "source_system", "event_type", "source_version", "outcome")


def _changes(spark, d):
    return v.change_events(v.table(spark, d, "events"))


@query(OUTCOMES)
def event_outcomes(spark, d):
    return ev.outcomes(_changes(spark, d), v.change_target(spark, d)).select(*_OUT)


@query(f"""{REPLAY} SELECT CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (outcome = 'updated') AS BIGINT) AS updated,
  CAST(count(*) FILTER (outcome = 'skipped_stale') AS BIGINT) AS skipped_stale, CAST(count(*) FILTER (outcome = 'failed') AS BIGINT) AS failed FROM outcomes""")
def replay_summary(spark, d):
    return ev.replay_summary(ev.outcomes(_changes(spark, d), v.change_target(spark, d)))


_LAST = {
    "title": ("kind = 'product_title_updated'", "'T' || k"),
    "category": ("kind = 'product_category_updated'", "'C' || k"),
    "availability": ("kind IN ('product_availability_updated', 'product_deleted_or_unavailable')",
                     "CASE WHEN kind = 'product_deleted_or_unavailable' THEN 'discontinued' ELSE 'limited_stock' END"),
    "price": ("kind = 'product_price_updated'", "value"),
    "currency": ("kind = 'product_price_updated'", "'EUR'"),
    "seller_id": ("kind = 'seller_enrichment_updated'", "'S' || k"),
    "popularity_score": ("kind = 'seller_enrichment_updated'", "value"),
}
_DEFAULTS = {"title": "t.title", "category": "t.category", "availability": "'in_stock'", "price": "t.price", "currency": "'USD'",
             "seller_id": "'none'", "popularity_score": "0.0"}


@query(f"""{REPLAY}, done AS (SELECT * FROM outcomes WHERE outcome = 'updated'),
last AS (SELECT product_id, arg_max(event_time, seq) AS changed_at, {', '.join(
    f'arg_max({value}, seq) FILTER ({test}) AS {name}' for name, (test, value) in _LAST.items())} FROM done GROUP BY product_id),
attrs AS (SELECT product_id, name, arg_max(val, seq) AS val FROM (
    SELECT product_id, 'a' || (k % 5) AS name, 'v' || seq AS val, seq FROM done WHERE kind = 'attributes_updated'
    UNION ALL SELECT product_id, 'a0', 'old', -1 FROM target UNION ALL SELECT product_id, 'b', 'kept', -1 FROM target) GROUP BY ALL),
attr_text AS (SELECT product_id, string_agg(name || '=' || val, ';' ORDER BY name) AS attributes FROM attrs GROUP BY product_id),
vers AS (SELECT product_id, source_system AS name, CAST(max(k) AS VARCHAR) AS val FROM (
    SELECT product_id, source_system, k FROM done UNION ALL SELECT product_id, 'click', click_version FROM target) GROUP BY ALL
  UNION ALL SELECT product_id, 'seed', '2001-10-01T00:00:00Z' FROM target),
ver_text AS (SELECT product_id, string_agg(name || '=' || val, ';' ORDER BY name) AS source_versions FROM vers GROUP BY product_id)
SELECT t.product_id, {', '.join(f'coalesce(l.{name}, {_DEFAULTS[name]}) AS {name}' for name in _LAST)}, attributes, source_versions,
  strftime(coalesce(date_trunc('second', changed_at), TIMESTAMP '{v.AS_OF}'), '%Y-%m-%dT%H:%M:%SZ') AS updated_at,
  CASE WHEN changed_at IS NULL THEN '2001-10-01T00:00:00Z' ELSE '2024-06-01T00:00:00Z' END AS indexed_at
FROM target t LEFT JOIN last l ON t.product_id = l.product_id JOIN attr_text x ON t.product_id = x.product_id
  JOIN ver_text y ON t.product_id = y.product_id""")
def replayed_catalog(spark, d):
    target = v.change_target(spark, d)
    done = ev.replay(target, ev.outcomes(_changes(spark, d), target), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return done.select(
        "product_id", *_LAST, map_text("attributes").alias("attributes"), map_text("source_versions").alias("source_versions"),
        utc_text(F.date_trunc("second", "updated_at")).alias("updated_at"), utc_text(F.col("indexed_at")).alias("indexed_at"))


@query(OUTCOMES)
def event_stream(spark, d):
    """The same outcomes, judged batch by batch from a stream of the events."""
    schema = v.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    root = f"{scale.ensure_checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    replay = StreamReplay(v.change_target(spark, d), root)
    replay.start(v.change_events(stream), available_now=True).awaitTermination()
    return replay.outcomes().select(*_OUT)


# Some changes arrive with a time that names no zone.
_WHOLE = OUTCOMES.replace("FROM events", "FROM (SELECT * FROM events WHERE event_id % 29 <> 0)")


@query(f"""SELECT *, '' AS errors FROM ({_WHOLE})
UNION ALL SELECT seq, product_id, source_system, kind, k, 'rejected', 'event_time' FROM ({REPLAY} SELECT * FROM changes) WHERE seq % 29 = 0""")
def keyed_stream(spark, d):
    """The events in four micro-batches with keyed state, checked on arrival; the query stops and starts again after each.

    Each quarter is one batch, in however many files it was written: batches have to follow the order of the events.
    """
    root = f"{scale.ensure_checkpoint_dir(spark)}/keyed-{uuid.uuid4().hex}"
    zone = F.when(F.col("seq") % 29 == 0, "").otherwise("Z")
    wire = _changes(spark, d).withColumn("event_time", F.concat(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone))
    last = wire.agg(F.coalesce(F.max("seq"), F.lit(0))).head()[0]
    numbered = wire.withColumn("quarter", F.floor(F.col("seq") * 4 / F.lit(last + 1)))
    table = BucketedTable.create(v.change_target(spark, d), f"{root}/catalog")
    for number in range(4):
        numbered.where(F.col("quarter") == number).drop("quarter").write.mode("append").parquet(f"{root}/arriving")
        stream = spark.readStream.schema(wire.schema).parquet(f"{root}/arriving")
        replay = KeyedReplay(table, f"{root}/state", v.as_of, slice_width=1000)
        replay.start(stream, available_now=True).awaitTermination()
    return replay.outcomes().select(*_OUT, F.array_join("errors", ",").alias("errors"))
