"""Named strategies and the searches made of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import scale
from shelfmark.functions.enrich import shaped_product
from shelfmark.operators import lexical
from shelfmark.operators.lexical import Strategy

# Field boosts and options of the strategies.
BASELINE_BOOSTS = {"title": 4.0, "brand": 2.0, "category": 1.5, "description": 0.8, "catalog_text": 0.5}
BOOSTED_BOOSTS = {"title": 4.0, "brand": 2.0, "category": 1.5, "description": 1.0, "catalog_text": 0.8}
ENRICHED_BOOSTS = {"search_profile": 3.0, "title": 2.0, "category": 1.5, "brand": 1.0, "description": 0.5}
STRATEGIES = {
    "baseline_bm25": Strategy("baseline_bm25", BASELINE_BOOSTS, operator="and"),
    "boosted_bm25": Strategy(
        "boosted_bm25", BOOSTED_BOOSTS, match_percent=75, fuzzy=True,
        popularity_factor=0.01, freshness_weight=0.1),
    "enriched_profile": Strategy("enriched_profile", ENRICHED_BOOSTS, match_percent=70, fuzzy=True),
    "baseline_lexical": Strategy("baseline_lexical", BASELINE_BOOSTS, operator="and"),
    "boosted_lexical": Strategy(
        "boosted_lexical", BASELINE_BOOSTS, operator="and", popularity_factor=0.02, freshness_weight=0.2),
}
EVALUATED = ("baseline_bm25", "boosted_bm25", "enriched_profile")
DEFAULT_STRATEGY = "enriched_profile"
MAX_SIZE = 50


def strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"no strategy is called {name!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


def tunable(name: str, boosts: dict[str, float] | None = None) -> Strategy:
    """A strategy's match options with free boosts and no document boosts."""
    base = strategy(name)
    chosen = dict(base.boosts if boosts is None else boosts)
    if not chosen:
        raise ValueError("field boosts must not be empty")
    return Strategy(base.name, chosen, base.operator, base.match_percent, base.fuzzy)


def search_all(
    catalog: DataFrame, queries: DataFrame, names: Sequence[str] = EVALUATED,
    size: int = 10, as_of: Column | None = None,
) -> DataFrame:
    """Ranking table (strategy, qid, product_id, rank, score)."""
    return lexical.rank(catalog, queries, [strategy(n) for n in names], size, as_of)


def search_products(
    catalog: DataFrame, queries: DataFrame, name: str = DEFAULT_STRATEGY,
    size: int = 10, as_of: Column | None = None,
) -> DataFrame:
    """Shaped result rows with the total and returned counts per query."""
    chosen = [strategy(name)]
    hits, totals = lexical.search(catalog, queries, chosen, size, as_of)
    return _shape(catalog, hits, totals)


def _shape(catalog: DataFrame, hits: scale.Settled, totals: scale.Settled) -> DataFrame:
    rows = scale.join_settled(catalog, hits, ["product_id"])
    counts = replace(hits, df=hits.df.groupBy("strategy", "qid").agg(F.count(F.lit(1)).alias("count")))
    rows = scale.join_settled(scale.join_settled(rows, counts, ["strategy", "qid"]), totals, ["strategy", "qid"])
    return rows.select("strategy", "qid", "total", "count", "rank", "score", *shaped_product(catalog))


def search_requests(catalog: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Search over a request table where every row names its own strategy, size and filters.

    ``requests`` has ``qid`` and ``query`` and may have ``strategy``, ``size`` and the filter columns; what is missing or
    null takes its default.  One scoring serves all strategies and gives hits and totals.  A size
    outside 1 to ``MAX_SIZE`` or an unknown strategy fails; a request that matches nothing has no row.
    """
    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in requests.columns else default

    known = F.col("strategy").isin(*STRATEGIES)
    fair = F.col("size").between(1, MAX_SIZE)
    bad = F.raise_error(F.format_string("request %s: strategy or size is not allowed", F.col("qid").cast("string"))).cast("boolean")
    asked = scale.settle(requests.withColumns({"strategy": given("strategy", F.lit(DEFAULT_STRATEGY)), "size": given("size", F.lit(10))}).where(
        F.when(known & fair, F.lit(True)).otherwise(bad)))
    # At most as many as there are strategies.
    names = sorted(r[0] for r in asked.df.select("strategy").distinct().collect())
    if not names:
        names = [DEFAULT_STRATEGY]
    chosen = [strategy(n) for n in names]
    hits, totals = lexical.search(catalog, asked.df, chosen, MAX_SIZE, as_of)
    sizes = replace(asked, df=asked.df.select("strategy", "qid", "size"))
    cut = scale.join_settled(hits.df, sizes, ["strategy", "qid"]).where(F.col("rank") <= F.col("size")).drop("size")
    return _shape(catalog, replace(hits, df=cut), totals)


def product_search(
    catalog: DataFrame, requests: DataFrame, boost: bool = True,
    size: int = 10, as_of: Column | None = None,
) -> DataFrame:
    """Filtered product search over a request table.

    ``requests`` has ``qid``, ``query`` (blank matches everything) and any of
    the filter columns in ``lexical.FILTERS``; null means no filter.
    """
    name = "boosted_lexical" if boost else "baseline_lexical"
    return lexical.rank(catalog, requests, [strategy(name)], size, as_of)
