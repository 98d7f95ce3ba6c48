"""A stored inverted index and exact top-k search that skips most of it.

``write_index`` counts a corpus once, by its distinct texts where it repeats them (as ``lexical.distinct_texts``);
otherwise each document is its own text.  Texts are counted where they are read, in segments, and a term's postings in
a segment are one row, a block.  Blocks go by the number of their term, sorted,
into one folder per range of numbers (``bucket``), so a search reads the folders of the terms it asks for and
never touches texts.  Beside them lie the vocabulary with document frequencies and each term's largest share of
its weight (``share``), field lengths, and the documents with their text, boost and filter values.

``search`` gives the rows of ``lexical.rank`` from these tables.  It looks for texts in two ways:

* A match of ``needed`` out of n clauses holds one of the n - needed + 1 rarest.
* The k-th best score that a query's rarest clauses alone give is a score that top rows reach
  (``thresholds``).  Frequent clauses whose bounds add up to less cannot lift a text there by themselves.

Texts found by these clauses are completed if the others could still lift them that far, and where completing
takes fewer rows than meeting the others' postings (``skipping``).  Other clauses meet all their postings, which are
exchanged once by text; what they score is summed where they then lie.  Nothing is estimated: a text that is left
out is below the k-th score for certain, beyond what rounding could turn.

Where only terms decide (no fuzzy clauses, boosts or filters) and the query side is small enough to be sent to every task,
blocks are exchanged by segment and scored there (``segment_scores``): frequent clauses are met only for texts that rarer ones have
found, and each segment passes on only its own best texts.

The best texts of a query are exchanged for their documents.  Filters on values that documents of one text need not
share are judged on the documents of every matching text.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark import scale
from shelfmark.functions.text import normalise, strip
from shelfmark.operators import lexical, segments
from shelfmark.operators.lexical import COPIES, FILTERS, TEXT, Prepared, Strategy

#: Boost and filter values that documents carry where the corpus has them.
CARRIED = ("popularity_score", "updated_at", "_category", "_brand", "_availability", "_price")
#: Stands for a filter that is not set.
OPEN = "\x1e"
#: Scores are rounded to six digits before they are compared.
SLACK = 1e-5
#: The value a filter is about, and the field whose equal texts share it.
FILTERED = {"f_category": ("_category", "category"), "f_brand": ("_brand", "brand")}


#: Below this many estimated bytes per core, texts are spread before they are counted.
COUNTED_BYTES = 4 * 1024 * 1024
#: Estimated bytes of texts that a task counts, about, where there are more tasks than cores need.
GATHERED_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class Index:
    """The tables of a stored index."""

    blocks: DataFrame     # bucket, tid, segment, texts, counts
    terms: DataFrame      # bucket, tid, field, term, df, share, n, avgdl
    documents: DataFrame  # _text, id and carried values
    id_col: str
    buckets: int
    seed: int
    popularity: float     # largest of the corpus
    fields: tuple[str, ...]

    @property
    def postings(self) -> DataFrame:
        """bucket, tid, _text, text_copies, dl, tf"""
        return _unpacked(self.blocks)


def _unpacked(blocks: DataFrame) -> DataFrame:
    kind = blocks.schema["texts"].dataType.elementType.simpleString()
    return blocks.select("bucket", "tid", "texts", "counts").mapInArrow(
        segments.unpacker(), f"bucket int, tid bigint, text {kind}, copies bigint, dl int, tf int").withColumnsRenamed({"text": TEXT, "copies": COPIES})


def _bucket(number: Column, buckets: int) -> Column:
    """The range of numbers that a term's number falls into; ranges keep the order of unsigned numbers."""
    return F.shiftrightunsigned(number, 65 - buckets.bit_length()).cast("int")


def _texts(docs: DataFrame, source: DataFrame, kinds: dict[str, str], id_col: str, carry: Sequence[str]) -> tuple[DataFrame, DataFrame, bool]:
    """The texts to count (_text, text_copies, fields), every document with its text, and whether each document has an id of its own."""
    keyed = scale.settle(source.select(lexical.text_key(kinds).alias("_key"), id_col, *carry))
    texts = scale.settle(keyed.df.groupBy("_key").agg(F.min(id_col).alias(TEXT), F.count(F.lit(1)).alias(COPIES)))
    single = keyed.df.where(F.col(id_col).isNotNull()).select(id_col).distinct().count() == keyed.rows
    own = docs.select(F.col(id_col).alias(TEXT), *kinds)
    if texts.rows * lexical.REPEATED > keyed.rows:
        return own.withColumn(COPIES, F.lit(1).cast("bigint")), keyed.df.withColumn(TEXT, F.col(id_col)).drop("_key"), single
    members = scale.join_settled(keyed.df, replace(texts, df=texts.df.select("_key", TEXT)), ["_key"], salt_by=id_col).drop("_key")
    return scale.join_settled(own, replace(texts, df=texts.df.drop("_key")), [TEXT]), members, single


def _counted(texts: DataFrame, kinds: dict[str, str], single: bool) -> DataFrame:
    """Blocks of postings by segment.  Where documents share an id, all of an id are counted in one task."""
    # Each task writes into every folder, so a corpus in many small files is not given as many tasks.
    texts = scale.gather(scale.spread(texts, COUNTED_BYTES), GATHERED_BYTES) if single else scale.by_key(texts, TEXT)
    rows = lexical.field_rows(texts.sortWithinPartitions(TEXT), kinds, [TEXT, COPIES]).where(F.size("terms") > 0)
    kind = texts.schema[TEXT].dataType.simpleString()
    return rows.select(TEXT, COPIES, "field", "terms").mapInArrow(
        segments.counter(segments.TERMS), f"segment bigint, field string, term string, df bigint, total bigint, texts array<{kind}>, counts binary")


def write_index(docs: DataFrame, path: str, kinds: dict[str, str] | None = None, id_col: str = "product_id", buckets: int = 64) -> Index:
    """Count the corpus and store its index; ``buckets`` is a power of two."""
    if buckets < 2 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    kinds = dict(lexical.FIELD_KINDS if kinds is None else kinds)
    spark = docs.sparkSession
    source = lexical.with_filter_values(docs) if {"category", "brand", "availability", "price"} <= set(docs.columns) else docs
    carry = [c for c in CARRIED if c in source.columns]
    texts, members, single = _texts(docs, source, kinds, id_col, carry)
    found = _counted(texts, kinds, single)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seed = 0
    while True:
        counted = found.withColumn("tid", lexical.term_number(seed)).withColumn("bucket", _bucket(F.col("tid"), buckets))
        # Blocks are written where they were counted; a frequent term lies in as many files as tasks have it.
        counted.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        stored = spark.read.schema(counted.schema).parquet(f"{path}/postings")
        # Texts stand for all documents, unless some share an id.  A field's row is small: one per searched field.
        heads = scale.settle(stored.where("term = ''").groupBy("field").agg(
            F.sum("df").alias("n"), (F.sum("total") / F.sum("df")).alias("avgdl")) if single else lexical.term_lengths(docs, kinds)).df
        share = segments.largest_share(
            (lexical.K1, lexical.B), {r.field: r.avgdl for r in heads.collect()}, {f for f, kind in kinds.items() if kind == "keyword"})
        shares = stored.where("term <> ''").select("field", "term", "df", "counts").mapInArrow(share, "field string, term string, df bigint, share double")
        terms = shares.groupBy("field", "term").agg(F.sum("df").alias("df"), F.max("share").alias("share")).join(F.broadcast(heads), "field")
        terms = terms.withColumn("tid", lexical.term_number(seed)).withColumn("bucket", _bucket(F.col("tid"), buckets))
        terms.repartition(parts, "bucket").sortWithinPartitions("bucket", "tid").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        if spark.read.schema(terms.schema).parquet(f"{path}/terms").groupBy("tid").count().where("count > 1").isEmpty():
            break
        seed += 1  # two terms share a number
    members.write.mode("overwrite").parquet(f"{path}/documents")
    popularity = F.max(F.coalesce("popularity_score", F.lit(0.0))) if "popularity_score" in carry else F.lit(0.0)
    schemas = {"postings": counted.schema.json(), "terms": terms.schema.json(), "documents": members.schema.json()}
    members.agg(
        F.coalesce(popularity.cast("double"), F.lit(0.0)).alias("popularity"), F.lit(id_col).alias("id_col"), F.lit(buckets).alias("buckets"),
        F.lit(seed).alias("seed"), F.lit(json.dumps(sorted(kinds))).alias("fields"),
        *(F.lit(text).alias(name) for name, text in schemas.items())).write.mode("overwrite").parquet(f"{path}/facts")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    facts = spark.read.parquet(f"{path}/facts").head()
    read = {name: spark.read.schema(StructType.fromJson(json.loads(facts[name]))).parquet(f"{path}/{name}") for name in ("postings", "terms", "documents")}
    return Index(read["postings"].drop("field", "term", "df", "total"), read["terms"], read["documents"], facts["id_col"], facts["buckets"], facts["seed"],
                 facts["popularity"], tuple(json.loads(facts["fields"])))


def in_buckets(table: DataFrame, numbers: DataFrame, buckets: int) -> DataFrame:
    """The folders of a table that hold the given ``tid``; at most ``buckets`` numbers come to the driver."""
    asked = [r[0] for r in numbers.select(_bucket(F.col("tid"), buckets)).distinct().collect()]
    return table.where(F.col("bucket").isin(asked) if asked else F.lit(False))


def prepare(index: Index, queries: DataFrame, strategies: Sequence[Strategy]) -> Prepared:
    """The weighted query terms, from the stored vocabulary."""
    def vocabulary(wanted: scale.Settled) -> DataFrame:
        columns = ["field", "term", "df", "n", "avgdl", "share"]
        if any(s.fuzzy for s in strategies):  # any word may be near an asked one
            return index.terms.select(*columns)
        asked = wanted.df.select("field", F.col("clause").alias("term")).select(lexical.term_number(index.seed).alias("tid"))
        return in_buckets(index.terms, asked, index.buckets).select(*columns)

    return lexical.prepare(None, queries, strategies, vocabulary=vocabulary, term_seed=index.seed)


def _asked_blocks(index: Index, scoring: scale.Settled) -> DataFrame:
    """The blocks of the given terms; only their folders are read."""
    blocks = in_buckets(index.blocks, scoring.df, index.buckets).select("segment", "bucket", "tid", "texts", "counts")
    return scale.join_settled(blocks, replace(scoring, df=scoring.df.select("tid")), ["tid"], "left_semi", salt_by="segment")


def _asked_postings(index: Index, scoring: scale.Settled) -> DataFrame:
    return _unpacked(_asked_blocks(index, scoring)).select("tid", TEXT, "dl", "tf")


def _weighed(joined: DataFrame) -> DataFrame:
    return joined.withColumn("contribution", F.col("w") * lexical.term_part(F.col("avgdl"))).drop("w", "avgdl", "kind", "dl", "tf")


def matches(index: Index, prepared: Prepared, scoring: scale.Settled) -> DataFrame:
    """Contribution of every posting of the given weighted terms; only their folders are read."""
    return _weighed(scale.join_settled(_asked_postings(index, scoring), scoring, ["tid"], salt_by=TEXT))


@dataclass(frozen=True)
class Asked:
    """The query side of a search over texts."""

    #: Without filters on what documents of one text need not share.
    prepared: Prepared
    #: What a text brings along: each boosted strategy's largest boost among its documents, and filter values.
    values: scale.Settled | None
    #: (strategy, qid) and filters of requests that tell documents of one text apart.
    narrow: scale.Settled | None


def ask(index: Index, prepared: Prepared, strategies: Sequence[Strategy], as_of: Column | None) -> Asked:
    given = [c for c in FILTERS if c in prepared.weights.df.columns]
    shared = [c for c in given if c in FILTERED and FILTERED[c][1] in index.fields]
    own = [c for c in given if c not in shared]
    boosts = [F.max(lexical.document_boost([s], as_of, every=True)).alias(lexical.top_boost(i)) for i, s in enumerate(strategies) if s.boosted]
    filters = [F.first(FILTERED[c][0]).alias(FILTERED[c][0]) for c in shared]
    values = scale.settle(index.documents.groupBy(TEXT).agg(*boosts, *filters)) if boosts or filters else None
    narrow = None
    if own:
        some = F.coalesce(*(F.col(c).cast("string") for c in own)).isNotNull()
        narrow = scale.settle(prepared.weights.df.where(some).select("strategy", "qid", *own).distinct())
    carry = () if values is None else tuple(c for c in values.df.columns if c != TEXT)
    weights = replace(prepared.weights, df=prepared.weights.df.drop(*own))
    return Asked(replace(prepared, carry=carry, weights=weights), values, narrow if narrow is not None and narrow.rows else None)


def matches_by_text(index: Index, asked: Asked, scoring: scale.Settled) -> DataFrame:
    """``matches`` with all of a text in one task: postings are exchanged, not what each of many queries makes of them."""
    found = scale.by_key(_asked_postings(index, scoring), TEXT)
    if asked.values is not None:
        found = scale.join_settled(found, asked.values, [TEXT])
    return _weighed(scale.join_settled(found, scoring, ["tid"], salt_by=TEXT))


def text_scores(matched: DataFrame, asked: Asked, strategies: Sequence[Strategy]) -> DataFrame:
    return lexical.scored_texts(lexical.field_scores(matched, asked.prepared, TEXT), asked.prepared, strategies)


def _in_segments(asked: Asked) -> bool:
    """Whether texts can be scored segment by segment: their terms alone decide, and the query side fits into a task."""
    return not asked.prepared.fuzzy and asked.values is None and asked.narrow is None and asked.prepared.weights.fits()


def segment_scores(
    index: Index, asked: Asked, scoring: scale.Settled, size: int, slots: DataFrame | None = None, leading: DataFrame | None = None,
) -> DataFrame:
    """``text_scores`` of the texts that can be among the best ``size`` of a query, from blocks exchanged by segment.

    The clauses of ``slots`` (slot, least) that are not ``leading`` (slot, cid) are met only for texts with at least that much from the leading ones.
    """
    terms = scoring.df.select("tid", "slot", "cid", "kind", "w", "avgdl")
    terms = terms.withColumn("leads", F.lit(True)) if leading is None else terms.join(
        leading.withColumn("leads", F.lit(True)), ["slot", "cid"], "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
    # The query side is measured and fits; it goes to every task.
    terms = terms.withColumn("keyword", F.col("kind") == "keyword").drop("kind", "cid").toArrow()
    use = asked.prepared.slots.df.orderBy("qid").toArrow()
    lists = pa.StructArray.from_arrays([use["strategy"].combine_chunks(), use["qid"].combine_chunks()], ["strategy", "qid"])
    first, number = {}, []
    for at, one in enumerate(lists.to_pylist()):
        number.append(first.setdefault((one["strategy"], one["qid"]), at))
    array = lambda column: column.combine_chunks().to_numpy(zero_copy_only=False)
    query = use["qid"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    wanted = segments.Wanted(
        {c: array(terms[c]) for c in terms.column_names},
        {"slot": array(use["slot"]), "list": np.array(number, np.int64), "query": query, "needed": array(use["needed"]), "boost": array(use["boost"])},
        {} if slots is None else {r.slot: np.nan if r.least is None else r.least for r in slots.select("slot", "least").collect()},
        use["strategy"].combine_chunks(), use["qid"].combine_chunks())
    kinds = asked.prepared.slots.df.schema
    blocks = scale.by_key(_asked_blocks(index, scoring).drop("bucket"), "segment").sortWithinPartitions("segment")
    scored = blocks.mapInArrow(
        segments.scorer(wanted, size, (lexical.K1, lexical.B), SLACK, segments.CELLS, segments.MET),
        f"strategy string, qid {kinds['qid'].dataType.simpleString()}, text {blocks.schema['texts'].dataType.elementType.simpleString()}, text_score double")
    return scored.select("strategy", "qid", F.col("text").alias(TEXT), "text_score", F.round("text_score", 6).alias("score"), F.col("text").cast("string").alias("_tie"))


def _clause_bounds(prepared: Prepared) -> DataFrame:
    """Per strategy, slot and clause: how many postings it has at most and the most it can add to a field's score."""
    w = prepared.weights.df
    once = w.dropDuplicates(["strategy", "slot", "cid", "tid"])
    return once.groupBy("strategy", "qid", "slot", "cid", "needed", "boost").agg(
        F.sum("df").alias("rows"), F.sum(F.col("w") * F.col("share")).alias("bound")).withColumn("bound", F.col("bound") * F.col("boost"))


def thresholds(index: Index, asked: Asked, bounds: DataFrame, strategies: Sequence[Strategy], size: int) -> DataFrame:
    """(strategy, qid, floor): a score that the k-th best document reaches at least.

    Taken from slots where one clause makes a match: their rarest clauses, until those have four times
    ``size`` postings.  What a text scores from them alone is no more than the score of its best document.
    Requests that may leave out this document have none.
    """
    rare = Window.partitionBy("strategy", "slot").orderBy("rows", "cid").rowsBetween(Window.unboundedPreceding, -1)
    seeds = bounds.where("needed = 1").withColumn("before", F.coalesce(F.sum("rows").over(rare), F.lit(0))).where(
        F.col("before") < 4 * size).select("slot", "cid").distinct()
    few = scale.settle(asked.prepared.scoring.df.join(seeds, ["slot", "cid"]))
    weights = asked.prepared.weights
    single = replace(asked, prepared=replace(asked.prepared, weights=replace(weights, df=weights.df.where("needed = 1"))))
    some = segment_scores(index, single, few, size) if _in_segments(asked) else text_scores(matches_by_text(index, single, few), single, strategies)
    floors = lexical.top_k(some, size, id_col=TEXT).where(F.col("rank") == size).select("strategy", "qid", F.col("score").alias("floor"))
    if asked.narrow is not None:
        floors = floors.join(asked.narrow.df.select("strategy", "qid"), ["strategy", "qid"], "left_anti")
    return floors


def essential(prepared: Prepared, bounds: DataFrame, floors: DataFrame | None, document: float) -> DataFrame:
    """(slot, cid) of the clauses of which every text in the top rows holds at least one.

    The others, most frequent first, are too few to make a match or too light to reach the floor, whatever
    boost (at most ``document``) a document has.  A slot that several strategies share takes the clauses of all.
    """
    frequent = Window.partitionBy("strategy", "slot").orderBy(F.desc("rows"), "cid").rowsBetween(Window.unboundedPreceding, 0)
    ordered = bounds.withColumns({"nth": F.count(F.lit(1)).over(frequent), "sum": F.sum("bound").over(frequent)})
    if floors is None:
        ordered = ordered.withColumn("floor", F.lit(None).cast("double"))
    else:
        ordered = ordered.join(floors, ["strategy", "qid"], "left")
    light = F.coalesce(F.col("sum") + document + SLACK < F.col("floor"), F.lit(False))
    return ordered.where(~((F.col("nth") < F.col("needed")) | light)).select("slot", "cid").distinct()


def skipping(bounds: DataFrame, floors: DataFrame | None, leading: DataFrame, document: float) -> DataFrame:
    """(slot, least, n, rows) of the slots whose other clauses only complete what the leading ones find.

    A text with less than ``least`` from its leading clauses stays below the floor with all others.  Without a floor
    (null) every text found is completed, in slots where this takes fewer rows than meeting the others' postings.
    """
    marked = bounds.join(leading.withColumn("leads", F.lit(True)), ["slot", "cid"], "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
    if floors is None:
        marked = marked.withColumn("floor", F.lit(None).cast("double"))
    else:
        marked = marked.join(floors, ["strategy", "qid"], "left")
    open_end = F.max("floor") - document - SLACK - F.sum(F.when(F.col("leads"), 0.0).otherwise(F.col("bound")))
    led = F.when(F.col("leads"), F.col("rows")).otherwise(0)
    each = marked.groupBy("strategy", "slot").agg(
        F.when(F.max("boost") > 0, open_end / F.max("boost")).alias("least"), F.sum(led).alias("led"), F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("leads")).cast("int")).alias("others"))
    # A slot that several strategies share keeps what any of them needs.
    slots = each.groupBy("slot").agg(
        F.when(F.count("least") == F.count(F.lit(1)), F.min("least")).alias("least"), *(F.max(c).alias(c) for c in ("led", "rows", "n", "others")))
    return slots.where((F.col("others") > 0) & (F.col("least").isNotNull() | (2 * F.col("led") * F.col("n") < F.col("rows")))).select("slot", "least", "n", "rows")


def _pruning(index: Index, asked: Asked, strategies: Sequence[Strategy], size: int) -> tuple[scale.Settled, scale.Settled]:
    """The ``essential`` clauses, and the slots whose others only complete what these find (``skipping``)."""
    bounds = scale.settle(_clause_bounds(asked.prepared)).df
    floors = None
    if not bounds.where("needed = 1").isEmpty():
        floors = scale.settle(thresholds(index, asked, bounds, strategies, size)).df
    document = max((  # what a document can gain at most beside its text
        (s.popularity_factor or 0.0) ** 0.5 * index.popularity ** 0.5 + (s.freshness_weight or 0.0) for s in strategies), default=0.0)
    leading = scale.settle(essential(asked.prepared, bounds, floors, document))
    return leading, scale.settle(skipping(bounds, floors, leading.df, document))


def pruned_parts(index: Index, asked: Asked, strategies: Sequence[Strategy], size: int) -> list[DataFrame]:
    """Contributions that can matter for the top ``size`` rows of each query; each slot is in one part."""
    prepared = asked.prepared
    leading, slots = _pruning(index, asked, strategies, size)
    scoring, kept = prepared.scoring, None
    if slots.rows:
        first = scale.settle(scoring.df.join(slots.df, "slot", "left_semi").join(leading.df, ["slot", "cid"], "left_semi"))
        found = matches_by_text(index, replace(asked, values=None), first).groupBy("slot", TEXT).agg(F.sum("contribution").alias("got"))
        kept = scale.settle(scale.join_settled(found, slots, ["slot"], salt_by=TEXT).where(
            F.col("least").isNull() | (F.col("got") >= F.col("least"))).select("slot", TEXT))
        # Where many texts stay in reach, meeting all postings takes less.
        many = kept.df.groupBy("slot").count().join(slots.df, "slot").where(2 * F.col("count") * F.col("n") >= F.col("rows")).select("slot")
        slots = scale.settle(slots.df.join(many, "slot", "left_anti"))
    whole = scale.settle(scoring.df.join(slots.df, "slot", "left_anti"))
    parts = [matches_by_text(index, asked, whole)] if whole.rows else []
    if not slots.rows:
        return parts
    # Every term of the texts kept, where their postings meet; no row per missing term.
    kept = scale.settle(kept.df.join(slots.df, "slot", "left_semi"))
    rest = replace(scoring, df=scoring.df.join(slots.df, "slot", "left_semi"))
    texts = replace(kept, df=kept.df.select(TEXT).distinct())
    more = scale.by_key(scale.join_settled(_asked_postings(index, rest), texts, [TEXT], "left_semi"), TEXT)
    if asked.values is not None:
        more = scale.join_settled(more, asked.values, [TEXT])
    more = scale.join_settled(scale.join_settled(more, kept, [TEXT]), rest, ["slot", "tid"], salt_by=TEXT)
    return [*parts, _weighed(more)]


def pruned_matches(index: Index, prepared: Prepared, strategies: Sequence[Strategy], size: int, as_of: Column | None = None) -> DataFrame:
    """The contributions of ``pruned_parts`` in one table."""
    parts = pruned_parts(index, ask(index, prepared, strategies, as_of), strategies, size)
    columns = ["slot", "cid", "clause_no", TEXT, "contribution"]
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts)) if parts else matches(index, prepared, prepared.scoring).select(*columns)


def _scored(index: Index, asked: Asked, strategies: Sequence[Strategy], size: int, prune: bool) -> list[DataFrame]:
    """Scores of the texts that can matter for the top ``size`` rows of each query; each slot is in one part."""
    if _in_segments(asked) and not asked.prepared.weights.rows:
        return []
    if _in_segments(asked):
        leading, slots = _pruning(index, asked, strategies, size) if prune else (None, None)
        skipped = (slots.df, leading.df) if prune and slots.rows else ()
        return [segment_scores(index, asked, asked.prepared.scoring, size, *skipped)]
    parts = pruned_parts(index, asked, strategies, size) if prune else [matches_by_text(index, asked, asked.prepared.scoring)]
    return [text_scores(p, asked, strategies) for p in parts]


def _narrowed(index: Index, asked: Asked, scored: DataFrame, strategies: Sequence[Strategy], size: int, as_of: Column | None) -> DataFrame:
    """Top documents of the requests that tell documents of one text apart: all documents of every matching text are judged."""
    best = scale.join_settled(scored, asked.narrow, ["strategy", "qid"], salt_by=TEXT).groupBy("strategy", "qid", TEXT, *(
        c for c in asked.narrow.df.columns if c in FILTERS)).agg(F.max("text_score").alias("text_score"))
    filters = [c for c in FILTERS if c in best.columns]
    rows = index.documents.join(best, TEXT).where(lexical.passes(filters))
    score = F.col("text_score")
    if any(s.boosted for s in strategies):
        score = score + lexical.document_boost(strategies, as_of)
    return lexical.top_k(rows.select("strategy", "qid", index.id_col, F.round(score, 6).alias("score")), size, id_col=index.id_col)


def match_all(index: Index, queries: DataFrame, strategies: Sequence[Strategy], size: int, as_of: Column | None) -> DataFrame:
    """Top rows of the queries without text (F4): one list per distinct combination of filters, then given to all its queries."""
    filters = [c for c in FILTERS if c in queries.columns]
    folded = {c: normalise(F.col(c)) for c in ("f_category", "f_brand") if c in filters}
    blank = queries.where(F.coalesce(strip("query"), F.lit("")) == "").withColumns(folded)
    for c in ("f_category", "f_brand", "f_availability"):
        if c in filters:
            blank = blank.withColumn(c, F.when(strip(F.col(c)) != "", F.col(c)))
    open_or = lambda c: F.coalesce(F.col(c), F.lit(OPEN)) if c in filters else F.lit(OPEN)
    key = F.concat_ws("\x1f", open_or("f_category"), open_or("f_brand"), open_or("f_availability"))
    prices = [c for c in ("f_min_price", "f_max_price") if c in filters]
    asked = blank.select("qid", key.alias("key"), *prices, F.xxhash64(key, *prices).alias("choice"))
    groups = scale.settle(asked.select("choice", "key", *prices).distinct())
    documents = index.documents
    values = [F.col(c) for c in ("_category", "_brand", "_availability")]
    keys = lexical.filter_keys(*values, OPEN) if filters else F.array(F.lit("\x1f".join([OPEN] * 3)))
    keyed = documents.select("*", F.explode(keys).alias("key"))
    inside = F.lit(True)
    for c, holds in (("f_min_price", lambda: F.col("_price") >= F.col("f_min_price")), ("f_max_price", lambda: F.col("_price") <= F.col("f_max_price"))):
        if c in prices:
            inside = inside & (F.col(c).isNull() | holds())
    hits = scale.join_settled(keyed, groups, ["key"], salt_by=index.id_col).where(inside)
    named = hits.select("*", F.explode(F.array(*(F.lit(s.name) for s in strategies))).alias("strategy"))
    score = F.lit(1.0)
    if any(s.boosted for s in strategies):
        score = score + lexical.document_boost(strategies, as_of)
    scored = named.select("strategy", "choice", index.id_col, F.round(score, 6).alias("score"))
    lists = lexical.top_k(scored, size, keys=("strategy", "choice"), id_col=index.id_col)
    return asked.select("qid", "choice").join(lists, "choice").select("strategy", "qid", index.id_col, "score", "rank")


def search(
    index: Index, queries: DataFrame, strategies: Sequence[Strategy], size: int = 10, as_of: Column | None = None, prune: bool = True,
) -> DataFrame:
    """Every strategy on every query: (strategy, qid, id, score, rank), as ``lexical.rank`` on the corpus itself."""
    if as_of is None and any(s.boosted for s in strategies):
        raise ValueError("a strategy with a freshness boost needs as_of")
    asked = ask(index, prepare(index, queries, strategies), strategies, as_of)
    scored = _scored(index, asked, strategies, size, prune)
    columns = ["strategy", "qid", index.id_col, "score", "rank"]
    rankings = []
    if scored:
        plain = scored if asked.narrow is None else [
            scale.join_settled(s, replace(asked.narrow, df=asked.narrow.df.select("strategy", "qid")), ["strategy", "qid"], "left_anti") for s in scored]
        best = reduce(DataFrame.unionByName, (lexical.leading_texts(s, size) for s in plain))
        if len(scored) > 1:  # a text may have fields in each
            best = best.groupBy("strategy", "qid", TEXT, "_tie").agg(F.max("text_score").alias("text_score"), F.max("score").alias("score"))
        hits = scale.settle(lexical.top_texts(best, size))
        rankings.append(lexical.top_documents(lexical.Texts(None, index.documents), hits, strategies, size, as_of, index.id_col))
        if asked.narrow is not None:
            rankings.append(_narrowed(index, asked, reduce(DataFrame.unionByName, scored), strategies, size, as_of))
    if not queries.where(F.coalesce(strip("query"), F.lit("")) == "").isEmpty():
        rankings.append(match_all(index, queries, strategies, size, as_of))
    if not rankings:
        rankings = [match_all(index, queries.where("false"), strategies, size, as_of)]
    return reduce(DataFrame.unionByName, (r.select(*columns) for r in rankings))
