"""N-gram Jaccard join with set-relation skipping, and the components of its links.

Prefix filtering over one global order of shingles (rarer ones first, by a count
sketch of bounded size), where relations between sets save most of the work:

1. Equal sets are one class from the start.
2. Every class is compared with one leader of the index lists it stands in, the one
   with which it shares most of its prefix.  Similar classes form a group around
   their leader, at a known exact distance.  More rounds, with other leaders, join
   what is still apart; lists whose classes are all in one component are left behind.
3. Lists of several components hold one block per group, with the range of its sizes
   and of the tokens that its classes have left in such lists.  Blocks of one component
   and blocks whose ranges exclude enough overlap are skipped.  For the remaining pairs
   of groups the leaders are compared exactly.  The classes of a long list are dealt in
   blocks of sets instead, and all pairs of two blocks are compared exactly.
4. A member's answers derive from its leader's: a pair of members is looked at only
   if the leaders' distance, less the members' distances to them, leaves room for
   similarity (Jaccard distance is a metric), and then compared exactly.

No link between different sets that could join two components is lost;
``links_and_classes``, which serves the components, does not enumerate links inside a
component already found.  ``all_links`` gives every link: groups that leave room (a
group always does for itself) are dealt in blocks, salted by their leader, and all
pairs of two blocks are compared exactly.  Classes are identified by (64-bit hash of
the set, size).

Defined cases: texts that are null or have no words have an empty set and no
links; rows with a null id take part, but their id names no component unless
nothing else does; equal rows are one class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, partitions, stored
from shelfmark.llm.components import components
from shelfmark.llm.shingles import shingle_set

#: Counters of the sketch, and pieces in which it is added up.
COUNTERS, CHUNKS = 1 << 20, 16
#: Spreads (of the counters of shingles that hardly recur) above the middle from which a counter holds a frequent shingle.
SPREADS = 4
#: Bits of the filter that keeps most shingles of one set only out of the second pass, in words of 64.
FILTER_WORDS = 1 << 18
#: Rounds in which classes meet leaders, at most.
ROUNDS = 3
#: Rows of (id, hash) up to which the documents to compare are named by a broadcast.
BROADCAST_ROWS = 1_000_000
#: Members compared with one copy of their leader's text.
MEMBERS_PER_COPY = 512
#: Classes of an index list from which on they meet block by block.
LONG = 256
#: Sets and shingles of a block (about) when all pairs of two blocks are compared, and columns of the product.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 256, 1 << 20, 8192


def batches(texts: pa.Array):
    for text in texts:
        yield text.as_py()


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def identity(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def summaries(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id``, ``body``, ``fp``, ``n`` per document, and rows of the count sketch (``chunk``, ``counts``)."""
    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    id_type = frame.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, body bigint, fp bigint, n int, chunk int, counts binary"

    def run(parts):
        counts, waiting, held = np.zeros(COUNTERS, np.int64), [], 0
        names = ["id", "body", "fp", "n", "chunk", "counts"]
        id_arrow = None
        for part in parts:
            id_arrow = part.column(0).type
            fps, sizes = [], []
            for text in batches(part.column(2)):
                tokens = shingle_set(text, size)
                fps.append(identity(tokens))
                sizes.append(len(tokens))
                waiting.append(tokens)
                held += len(tokens)
                if held > 1 << 20:
                    counts += np.bincount((np.concatenate(waiting) % COUNTERS).astype(np.int64), minlength=COUNTERS)
                    waiting, held = [], 0
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if id_arrow is None:
            return
        if held:
            counts += np.bincount((np.concatenate(waiting) % COUNTERS).astype(np.int64), minlength=COUNTERS)
        packed = [zlib.compress(x.tobytes(), 1) for x in np.split(counts.astype(np.int32 if counts.max() < 1 << 31 else np.int64), CHUNKS)]
        yield pa.RecordBatch.from_arrays([
            pa.nulls(CHUNKS, id_arrow), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int32()),
            pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], names)

    return frame.mapInArrow(run, schema)


def counters(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * COUNTERS // CHUNKS else np.int64)


def rarity(summary: DataFrame) -> np.ndarray:
    """A level per counter: 0 for ordinary ones, growing with the logarithm of what it holds beyond them.

    Shingles that hardly recur fill the counters evenly, so these differ by the root of their middle only, and a shingle
    stands out with a few such spreads.
    """
    def add(rows):
        import pandas as pd

        total = sum(counters(x).astype(np.int64) for x in rows["counts"])
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = summary.where("chunk IS NOT NULL").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("slot"))
    some = parts.groupBy("chunk", "slot").applyInPandas(add, "chunk int, counts binary")
    rows = some.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()  # CHUNKS rows of fixed size
    return levels(np.concatenate([counters(bytes(r.counts)) for r in sorted(rows)]) if rows else np.zeros(COUNTERS, np.int64))


def levels(counts: np.ndarray) -> np.ndarray:
    middle = float(np.median(counts))
    beyond = (counts - middle) / (SPREADS * np.sqrt(middle + 1))
    return np.where(beyond <= 1, 0, np.log2(np.maximum(beyond, 1)) + 1).astype(np.uint8)


def filter_words(lists: DataFrame) -> np.ndarray:
    """One bit for every value of a token's lowest bits that occurs: a table of fixed size that loses none."""
    bit = F.pmod("token", F.lit(64 * FILTER_WORDS))
    words = lists.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_WORDS rows at most
    found = np.zeros(FILTER_WORDS, np.int64)
    found[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return found.view(np.uint64)


def postings(docs: DataFrame, text_col: str, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """The prefix of every set: ``token``, ``fp``, ``n``, ``pos``."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(parts):
        for part in parts:
            tokens_of, fps, sizes = [], [], []
            for text in batches(part.column(0)):
                tokens = shingle_set(text, size)
                n = len(tokens)
                if n == 0:
                    continue
                fps.append(identity(tokens))
                level = shared.value[tokens % np.uint64(COUNTERS)]
                keep = n - (percent * n + 99) // 100 + 1
                tokens_of.append(tokens[np.argsort(level, kind="stable")[:keep]] if level.any() else tokens[:keep])
                sizes.append(n)
            lengths = [len(x) for x in tokens_of]
            if lengths:
                yield pa.RecordBatch.from_arrays([
                    signed(np.concatenate(tokens_of)), pa.array(np.repeat(np.array(fps, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                    pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]))], ["token", "fp", "n", "pos"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token bigint, fp bigint, n int, pos int")


def passing(prefixes: DataFrame, lists: DataFrame) -> DataFrame:
    """The postings whose token may be in ``lists``: most others are gone before the join moves anything."""
    shared = prefixes.sparkSession.sparkContext.broadcast(filter_words(lists))

    def run(parts):
        bits = shared.value
        for part in parts:
            low = np.asarray(part.column(0)).view(np.uint64) % np.uint64(64 * FILTER_WORDS)
            yield part.filter(pa.array((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0))

    return prefixes.mapInArrow(run, prefixes.schema)


def texts_of(named: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node`` and ``text`` of one document for each class named."""
    where = stored(classes.join(named, "node").select("node", F.col("rep.id").alias("r_id"), F.col("rep.body").alias("r_body")), "named")
    small = where.count() <= BROADCAST_ROWS
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text")).join(
        F.broadcast(where) if small else where, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("body") == F.col("r_body")))
    texts = stored(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
    discard(where)
    return texts


def compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Exact intersections: ``pairs`` (a, b: structs of fp and n) with ``inter`` added.

    Texts of the classes named are fetched once, members travel to their ``b`` side, and
    a ``b`` with many members is copied to several tasks.
    """
    known = stored(pairs.distinct(), "pairs")
    texts = texts_of(known.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs, id_col, text_col)
    copies = known.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_COPY).cast("int").alias("copies"))
    members = known.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"))
    members = members.join(texts, F.col("a") == F.col("node")).select("b", "copy", F.lit(1).alias("side"), "a", "text")
    leaders = copies.join(texts, F.col("b") == F.col("node")).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("side"), F.col("b").alias("a"), "text")
    dealt = members.unionByName(leaders).repartition(partitions(docs.sparkSession), "b", "copy").sortWithinPartitions("b", "copy", "side")
    flat = dealt.select("b.fp", "b.n", "side", F.col("a.fp").alias("a_fp"), F.col("a.n").alias("a_n"), "text")

    def run(parts):
        leader = None
        for part in parts:
            out = []
            for b_fp, b_n, side, a_fp, a_n, text in zip(*(x.to_pylist() for x in part.columns), strict=True):
                tokens = shingle_set(text, size)
                if side == 0:
                    leader = tokens
                else:
                    out.append((a_fp, a_n, b_fp, b_n, len(np.intersect1d(leader, tokens, assume_unique=True))))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if i in (0, 2) else pa.int32()) for i, c in enumerate(columns)], ["a_fp", "a_n", "b_fp", "b_n", "inter"])

    found = flat.mapInArrow(run, "a_fp bigint, a_n int, b_fp bigint, b_n int, inter int")
    done = stored(found.select(
        F.struct(F.col("a_fp").alias("fp"), F.col("a_n").alias("n")).alias("a"), F.struct(F.col("b_fp").alias("fp"), F.col("b_n").alias("n")).alias("b"), "inter"), "compared")
    discard(known, texts)
    return done


def union_size(a: Column, b: Column) -> Column:
    return a["n"] + b["n"] - F.col("inter")


def rules(percent: int):
    """Whether two sizes fit, the lists that similar classes share at least, and the similar pairs."""
    fits = lambda x, y: (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
    enough = lambda x, y: (F.ceil((x + y) * percent / (100 + percent) - 1e-9))
    # Lists that two classes, the sizes of which lie between these bounds, share at least if they are similar.
    meetings = lambda lo_x, hi_x, lo_y, hi_y: (F.greatest(F.lit(1), enough(lo_x, lo_y) - F.ceil(F.greatest(hi_x, hi_y) * percent / 100 - 1e-9) + 1))
    similar = lambda df: df.where(100 * F.col("inter") >= percent * union_size(F.col("a"), F.col("b")))
    return fits, meetings, similar


def reach(percent: int) -> Column:
    """Whether two blocks of a list can hold similar classes: before the token at most the lower of its two places is shared, from it on the lesser rest."""
    shared = F.least("pos_x", "pos_y") + F.least("rest_x", "rest_y")
    return shared * (100 + percent) >= percent * (F.col("least_x") + F.col("least_y"))


def enough_left(left: Column, largest: Column, sizes: Column, percent: int) -> Column:
    """Whether two classes can be similar that share ``left`` tokens at most inside their prefixes.

    Of the class whose prefix ends first, what it shares beyond is in its own rest, which is no larger than that of the ``largest``.
    """
    rest = F.ceil(percent * largest / 100) - 1
    return (left + rest) * (100 + percent) >= percent * sizes


def indexed(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The class of each document, one document of each class, and the index lists of several classes (stored)."""
    node = F.struct("fp", "n")
    summary = stored(summaries(docs, id_col, text_col, size), "sets")
    members = summary.where("chunk IS NULL").select("id", "body", node.alias("node"))
    classes = members.groupBy("node").agg(F.min(F.struct("id", "body")).alias("rep"))
    prefixes = stored(postings(docs, text_col, rarity(summary), size, percent), "prefixes")
    lists = stored(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"), "lists")
    index = stored(
        passing(prefixes, lists).join(lists, "token").groupBy("token", "fp", "n", "pos").agg(F.lit(1).alias("one")).select("token", node.alias("node"), "pos"), "index")
    discard(prefixes, lists)
    return members, classes, index


def links_and_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Links (``a``, ``b``, ``inter``) that connect every component, and the class ``node`` of each document."""
    members, classes, index = indexed(docs, id_col, text_col, size, percent)

    fits, meetings, similar = rules(percent)

    # One leader for each class and round: the top of those of its lists it shares most of its prefix with.
    # Of the index only postings in lists of several components are kept from round to round.
    stars = links = roots = None
    for turn in range(ROUNDS):
        at = index.withColumn("root", F.col("node")) if roots is None else index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        top = stored(at.groupBy("token").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("node.fp", F.lit(turn)).alias("h"), "node", "root")).alias("top")).where("lo != hi")
            .select("token", F.col("top.node").alias("top"), F.col("top.root").alias("top_root")), "tops")
        met = at.join(top, "token").where("root != top_root").groupBy("node", "top").agg(F.count(F.lit(1)).alias("k"))
        likely = fits(F.col("node"), F.col("top")) & (F.col("k") >= meetings(F.col("node.n"), F.col("node.n"), F.col("top.n"), F.col("top.n")))
        best = met.where(likely).groupBy("node").agg(F.max(F.struct("k", "top")).alias("best")).select(F.col("node").alias("a"), F.col("best.top").alias("b"))
        found = stored(similar(compared(best, classes, docs, id_col, text_col, size)), "links")
        left, index = index, stored(index.join(top.select("token"), "token", "left_semi"), "mixed-lists")
        discard(left, top)
        stars = found if stars is None else stars
        links = found if links is None else links.unionByName(found)
        roots = components(links.select("a", "b"))
        if found.isEmpty():
            break
    leaders = stars.select(F.col("b").alias("node"), F.col("b").alias("leader"), F.lit(0.0).alias("far"))
    followers = stars.join(leaders.select(F.col("node").alias("a")).distinct(), "a", "left_anti").select(
        F.col("a").alias("node"), F.col("b").alias("leader"), (1 - F.col("inter") / union_size(F.col("a"), F.col("b"))).alias("far"))
    group = roots.join(leaders.distinct().unionByName(followers), "node", "left")
    group = stored(group.select("node", "root", F.coalesce("leader", "node").alias("leader"), F.coalesce("far", F.lit(0.0)).alias("far")), "groups")

    # Only lists of several components matter.  A class's tokens in them are put in order, those of shorter lists first; from
    # the first one that two classes share, neither has more than ``left`` to share with the other inside its prefix.
    placed = stored(index.select("token", "node").join(group, "node", "left").select(
        "token", "node", F.coalesce("leader", "node").alias("leader"), F.coalesce("root", "node").alias("root"), F.coalesce("far", F.lit(0.0)).alias("far")), "placed")
    mixed = placed.groupBy("token").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k"), F.min("node.n").alias("small"), F.max("node.n").alias("large")).where("lo != hi").drop("lo", "hi")
    ranked = stored(placed.join(mixed, "token").withColumn(
        "left", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("k"), F.desc("token")))), "ranked")
    blocks = stored(ranked.where(F.col("k") <= LONG).groupBy("token", "leader", "root").agg(
        F.min("node.n").alias("least"), F.max("node.n").alias("most"), F.max("left").alias("left"), F.max("far").alias("far")), "blocks")
    side = lambda df, s: df.select("token", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "token"))
    x, y = side(blocks, "x"), side(blocks, "y")
    met = x.join(y, "token").where(
        (F.col("leader_x") < F.col("leader_y")) & (F.col("root_x") != F.col("root_y"))
        & (100 * F.col("most_x") >= percent * F.col("least_y")) & (100 * F.col("most_y") >= percent * F.col("least_x"))
        & enough_left(F.least("left_x", "left_y"), F.greatest("most_x", "most_y"), F.col("least_x") + F.col("least_y"), percent))
    met = stored(met.groupBy(F.col("leader_x").alias("a"), F.col("leader_y").alias("b")).agg(F.max("far_x").alias("far_a"), F.max("far_y").alias("far_b")), "met")

    # The classes of a long list meet block by block, not pair by pair.
    n, more, less = F.col("node.n"), F.least(F.col("large"), F.floor(100 * F.col("node.n") / percent)), F.greatest(F.col("small"), F.ceil(percent * F.col("node.n") / 100))
    crowd = stored(ranked.where(F.col("k") > LONG).where(
        enough_left(F.col("left") + 1, F.greatest(n, more), n + more, percent) | enough_left(F.col("left") + 1, n, n + less, percent)).select(
        F.struct(F.col("token").alias("fp"), F.lit(0).alias("n")).alias("hub"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "node", F.lit(True).alias("own"), "root"), "crowd")
    crowd_texts = texts_of(crowd.select("node").distinct(), classes, docs, id_col, text_col)
    links = links.unionByName(stored(between_blocks(crowd, crowd_texts, size, percent), "crowd-links"))
    between = compared(met.select("a", "b"), classes, docs, id_col, text_col, size)

    # Members of two groups, still in different components, whose leaders' distance leaves room.
    limit = 1 - percent / 100
    links = links.unionByName(stored(similar(between), "between"))
    roots = components(links.select("a", "b"))
    root_of = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    apart = between.join(met, ["a", "b"]).join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    room = stored(apart.withColumn("apart", 1 - F.col("inter") / union_size(F.col("a"), F.col("b"))).where(
        (F.col("far_a") + F.col("far_b") > 0) & (F.col("apart") <= limit + F.col("far_a") + F.col("far_b") + 1e-9)).select("a", "b", "apart"), "room")
    # Members are dealt, not their postings: the larger group is the hub, and its members meet those of its
    # partners that the distances leave room for, block by block.
    # A class without links is a group of its own.
    kept = stored(room.select(F.explode(F.array("a", "b")).alias("leader")).distinct().join(group.drop("root"), "leader", "left").select(
        "leader", F.coalesce("node", "leader").alias("node"), F.coalesce("far", F.lit(0.0)).alias("far")), "kept")
    sizes = kept.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.max("far").alias("far"))
    size_of = lambda s: sizes.select(F.col("leader").alias(s), F.col("m").alias(f"m_{s}"), F.col("far").alias(f"far_{s}"))
    swap = F.col("m_a") < F.col("m_b")
    pick = lambda name, turned: F.when(swap != F.lit(turned), F.col(f"{name}b")).otherwise(F.col(f"{name}a"))
    near = stored(room.join(size_of("a"), "a").join(size_of("b"), "b").select(
        pick("", False).alias("hub"), pick("", True).alias("leader"), "apart", pick("far_", False).alias("reach")), "near")
    guests = near.join(kept, "leader").where(F.col("apart") <= limit + F.col("far") + F.col("reach") + 1e-9).select("hub", F.lit(1).alias("side"), "node")
    # A member of the hub takes part if its own distance leaves room with the widest partner.
    widest = near.join(sizes.select("leader", F.col("far").alias("wide")), "leader").groupBy("hub").agg(F.min(F.col("apart") - F.col("wide")).alias("gap"))
    hosts = widest.join(kept, F.col("hub") == F.col("leader")).where(F.col("gap") <= limit + F.col("far") + 1e-9).select("hub", F.lit(0).alias("side"), "node")
    hubs = stored(hosts.unionByName(guests).withColumn("own", F.lit(False)).distinct(), "hubs")
    texts = texts_of(hubs.select("node").distinct(), classes, docs, id_col, text_col)
    rest = stored(between_blocks(hubs, texts, size, percent), "rest")
    discard(index, placed, ranked, blocks, met, crowd, crowd_texts, between, room, kept, near, hubs, texts)
    return links.unionByName(rest), members


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``xs`` with every set of ``ys``."""
    every = [np.concatenate(s) for s in (xs, ys)]
    row = [np.repeat(np.arange(len(s)), [len(t) for t in s]) for s in (xs, ys)]
    shared = np.intersect1d(*every)
    found = np.zeros((len(xs), len(ys)), np.int64)
    if not len(shared):
        return found
    at = []
    for tokens, rows in zip(every, row, strict=True):
        place = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        held = shared[place] == tokens
        order = np.argsort(place[held], kind="stable")
        at.append((place[held][order], rows[held][order]))
    for low in range(0, len(shared), COLUMNS):
        sides = []
        for (place, rows), n in zip(at, (len(xs), len(ys)), strict=True):
            a, b = np.searchsorted(place, (low, low + COLUMNS))
            side = np.zeros((n, COLUMNS), np.float32)
            side[rows[a:b], place[a:b] - low] = 1
            sides.append(side)
        found += (sides[0] @ sides[1].T).astype(np.int64)
    return found


def between_blocks(hubs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The links between the sets of a hub's two sides: ``hubs`` has ``hub``, ``side``, ``node``, ``own`` (of the hub's group).

    With a ``root`` beside them, one link is given for two roots that meet in a task, and none inside a root.  Each side is cut into blocks; a pair of blocks is a task's work, so a group of any
    size is dealt over many tasks.
    """
    apart = "root" in hubs.columns
    if not apart:
        hubs = hubs.withColumn("root", F.col("node"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("node.n") / BLOCK_SHINGLES)).cast("int")
    counts = hubs.groupBy("hub").pivot("side", [0, 1]).agg(blocks).withColumnsRenamed({"0": "blocks_0", "1": "blocks_1"})
    mine = F.when(F.col("side") == 0, F.col("blocks_0")).otherwise(F.col("blocks_1"))
    other = F.when(F.col("side") == 0, F.col("blocks_1")).otherwise(F.col("blocks_0"))
    dealt = hubs.join(counts, "hub").join(texts, "node").select(
        "hub", "side", "node", "own", "root", "text", F.pmod(F.xxhash64("node", F.lit(1)), mine).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), other - 1)).alias("against"))
    left, right = F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("against")), F.when(F.col("side") == 0, F.col("against")).otherwise(F.col("block"))
    dealt = dealt.select("hub.fp", "hub.n", left.alias("i"), right.alias("j"), "side", F.col("node.fp").alias("a_fp"), F.col("node.n").alias("a_n"), "own",
        F.col("root.fp").alias("r_fp"), F.col("root.n").alias("r_n"), "text")
    dealt = dealt.repartition(partitions(hubs.sparkSession), "fp", "n", "i", "j").sortWithinPartitions("fp", "n", "i", "j", "side")

    def linked(sides):
        if not sides[0] or not sides[1]:
            return
        inter = overlaps([t for *_, t in sides[0]], [t for *_, t in sides[1]])
        fp, n = ([np.array([r[c] for r in s], np.int64) for s in sides] for c in (0, 1))
        union = n[0][:, None] + n[1][None, :] - inter
        first = (fp[0][:, None] < fp[1][None, :]) | ((fp[0][:, None] == fp[1][None, :]) & (n[0][:, None] < n[1][None, :]))
        own = np.array([r[2] for r in sides[1]], bool)
        similar = (100 * inter >= percent * union) & (first | ~own[None, :])
        if apart:
            number = {}
            root = [np.array([number.setdefault(r[3], len(number)) for r in s], np.int64) for s in sides]
            similar &= root[0][:, None] != root[1][None, :]
        x, y = np.nonzero(similar)
        if apart:
            _, one = np.unique(root[0][x] * len(number) + root[1][y], return_index=True)
            x, y = x[one], y[one]
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp[0][x]), pa.array(n[0][x], pa.int32()), pa.array(fp[1][y]), pa.array(n[1][y], pa.int32()), pa.array(inter[x, y], pa.int32())],
            ["a_fp", "a_n", "b_fp", "b_n", "inter"])

    def run(parts):
        key, sides = None, ([], [])
        for part in parts:
            columns = [part.column(i) for i in range(11)]
            for fp, n, i, j, side, a_fp, a_n, own, r_fp, r_n, text in zip(*(x.to_pylist() for x in columns), strict=True):
                if (fp, n, i, j) != key:
                    yield from linked(sides)
                    key, sides = (fp, n, i, j), ([], [])
                sides[side].append((a_fp, a_n, own, (r_fp, r_n), shingle_set(text, size)))
        yield from linked(sides)

    found = dealt.mapInArrow(run, "a_fp bigint, a_n int, b_fp bigint, b_n int, inter int")
    x, y = F.struct(F.col("a_fp").alias("fp"), F.col("a_n").alias("n")), F.struct(F.col("b_fp").alias("fp"), F.col("b_n").alias("n"))
    return found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "inter")


def all_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets (classes ``a`` < ``b``, ``inter``), and per document ``id``, ``body``, ``node`` and ``n_links``.

    ``n_links`` counts the other rows with an equal or a similar set; rows without words have none.
    """
    members, classes, index = indexed(docs, id_col, text_col, size, percent)
    fits, meetings, similar = rules(percent)

    # Groups around leaders: in each round, what has no group yet meets leaders of its own lists.
    free, group = index, None
    for turn in range(ROUNDS):
        top = free.groupBy("token").agg(F.min(F.struct(F.xxhash64("node.fp", F.lit(turn)).alias("h"), "node")).alias("top"))
        met = free.join(top, "token").where("node != top.node").groupBy("node", F.col("top.node").alias("top")).agg(F.count(F.lit(1)).alias("k"))
        likely = fits(F.col("node"), F.col("top")) & (F.col("k") >= meetings(F.col("node.n"), F.col("node.n"), F.col("top.n"), F.col("top.n")))
        best = met.where(likely).groupBy("node").agg(F.max(F.struct("k", "top")).alias("best")).select(F.col("node").alias("a"), F.col("best.top").alias("b"))
        stars = stored(similar(compared(best, classes, docs, id_col, text_col, size)), "stars")
        if stars.isEmpty():
            break
        leaders = stars.select(F.col("b").alias("node")).distinct()
        followers = stars.join(leaders.select(F.col("node").alias("a")), "a", "left_anti").select(
            F.col("a").alias("node"), F.col("b").alias("leader"), (1 - F.col("inter") / union_size(F.col("a"), F.col("b"))).alias("far"))
        grouped = stored(leaders.select("node", F.col("node").alias("leader"), F.lit(0.0).alias("far")).unionByName(followers), "grouped")
        group = grouped if group is None else group.unionByName(grouped)
        free = stored(free.join(grouped.select("node"), "node", "left_anti").select("token", "node", "pos"), "free")
    every = index.select("node").distinct()
    if group is None:
        group = every.select("node", F.col("node").alias("leader"), F.lit(0.0).alias("far"))
    else:
        group = every.join(group, "node", "left").select("node", F.coalesce("leader", "node").alias("leader"), F.coalesce("far", F.lit(0.0)).alias("far"))
    group = stored(group, "groups")
    sizes = stored(group.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.max("far").alias("far")), "group-sizes")

    # Pairs of groups that meet in enough lists, and the exact distance of their leaders.
    blocks = stored(index.join(group, "node").groupBy("token", "leader").agg(
        F.min("node.n").alias("least"), F.max("node.n").alias("most"), F.max("pos").alias("pos"), F.max(F.col("node.n") - F.col("pos")).alias("rest")), "blocks")
    side = lambda s: blocks.select("token", *(F.col(c).alias(f"{c}_{s}") for c in blocks.columns if c != "token"))
    met = side("x").join(side("y"), "token").where(
        (F.col("leader_x") < F.col("leader_y")) & (100 * F.col("most_x") >= percent * F.col("least_y")) & (100 * F.col("most_y") >= percent * F.col("least_x")) & reach(percent))
    met = met.groupBy(F.col("leader_x").alias("a"), F.col("leader_y").alias("b")).agg(
        F.count(F.lit(1)).alias("k"), F.max(F.least("rest_x", "rest_y")).alias("rest"), F.min("least_x").alias("lo_a"), F.max("most_x").alias("hi_a"),
        F.min("least_y").alias("lo_b"), F.max("most_y").alias("hi_b")).where(
        (F.col("k") >= meetings(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")))
        & (F.col("rest") * (100 + percent) >= percent * (F.col("lo_a") + F.col("lo_b"))))
    between = compared(met.select("a", "b"), classes, docs, id_col, text_col, size)
    size_of = lambda s: sizes.select(F.col("leader").alias(s), F.col("m").alias(f"m_{s}"), F.col("far").alias(f"far_{s}"))
    between = stored(between.join(size_of("a"), "a").join(size_of("b"), "b"), "between")
    lone = (F.col("m_a") == 1) & (F.col("m_b") == 1)
    links = similar(between.where(lone)).select("a", "b", "inter")

    # The larger group of a pair is the hub; its members meet those of all its partners, and each other.
    limit = 1 - percent / 100
    apart = 1 - F.col("inter") / union_size(F.col("a"), F.col("b"))
    swap = F.col("m_a") < F.col("m_b")
    pick = lambda name, turned: F.when(swap != F.lit(turned), F.col(f"{name}b")).otherwise(F.col(f"{name}a"))
    near = between.where(~lone & (apart <= limit + F.col("far_a") + F.col("far_b") + 1e-9)).select(
        pick("", False).alias("hub"), pick("", True).alias("leader"), (apart - pick("far_", False)).alias("apart"))
    alone = sizes.where("m > 1").select(F.col("leader").alias("hub"), "leader", F.lit(0.0).alias("apart"))
    near = stored(near.unionByName(alone), "near")
    guests = near.join(group, "leader").where(F.col("apart") <= limit + F.col("far") + 1e-9).select(
        "hub", F.lit(1).alias("side"), "node", (F.col("hub") == F.col("leader")).alias("own"))
    hosts = near.select("hub").distinct().join(group, F.col("hub") == F.col("leader")).select("hub", F.lit(0).alias("side"), "node", F.lit(True).alias("own"))
    hubs = stored(hosts.unionByName(guests), "hubs")
    texts = texts_of(hubs.select("node").distinct(), classes, docs, id_col, text_col)
    links = stored(links.unionByName(between_blocks(hubs, texts, size, percent)), "all-links")

    copies = members.where("node.n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    others = ends.join(copies.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("others"))
    per_class = copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return links, members.join(per_class, "node", "left").select("id", "body", "node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``body``, ``n_shingles`` and ``component`` (smallest id reachable)."""
    links, members = links_and_classes(docs, id_col, text_col, size, percent)
    roots = components(links.select("a", "b"))
    placed = members.join(roots, "node", "left").select("id", "body", "node", F.coalesce("root", "node").alias("root"))
    least = placed.where("node.n > 0").groupBy("root").agg(F.min("id").alias("least"))
    return placed.join(least, "root", "left").select(
        "id", "body", F.col("node.n").cast("long").alias("n_shingles"),
        F.when(F.col("node.n") > 0, F.col("least")).otherwise(F.col("id")).alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Of every component the document with the smallest id; documents without words all stay.

    Of rows that share that id, equal or not, one of the smallest text hash stays.
    """
    found = jaccard_components(docs, id_col, text_col, size, percent)
    least = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("id", "body")).alias("kept"))
    names = least.select(F.col("kept.id").alias("k_id"), F.col("kept.body").alias("k_body"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    full = rows.where(~empty).join(names, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("body") == F.col("k_body")), "left_semi")
    full = full.dropDuplicates(["id", "body"])
    return full.unionByName(rows.where(empty)).select("row.*")
