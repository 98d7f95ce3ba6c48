"""The trie of conversations that share beginnings, from composable fingerprints.

A conversation c is rebuilt as the first h original turns of its base conversation
b = c - c % group, with h = crc32(decimal c) % heads, and then its own turns after its
first h.  Rebuilt texts are never made.  A sequence of turns x1 x2 ... has the fingerprint
element (n, B^n, sum of xi * B^(i-1)) modulo two primes; elements compose, and can be divided
on the left, so the fingerprint of any rebuilt prefix is an expression in three stored
prefix products: the head of the base, the own turns, and the own head that is cut off.

Rebuilt prefixes of one depth and fingerprint form a node.  Every prefix refers to the
stored turn that comes last in it (``turn_conv``, ``turn_pos``) and to the fingerprint of its parent; a
node is proven when all its members agree in their parent and in the SHA-256 of the turn
referred to, for then, from depth 1 on, equal fingerprints mean equal sequences.  If any
node fails, everything is done again with other bases.

A node is named by its smallest member and its depth.  Nodes of one smallest member
form a chain down the trie, and a conversation meets at most as many other chains as it has turns, so sums
over subtrees need one row for each (conversation, chain above it) and one running sum along each chain.
No group is gathered: conversations of any length are scanned in stretches (``scans``),
nodes with many members are joined by a broadcast of at most 1,000 rows, and the lists
of members that end at a node are hashed as a stream.

Defined cases: rows with a null conversation id belong to none and are left out; a null
role or text is empty; null turns come first; equal turns are ordered by the SHA-256 of
role and text, and repeated rows are turns of their own; conversations whose base has no rows take nothing
from it; c % group has the sign of c, as in SQL; without conversations there is no root.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import partitions, stored, words
from shelfmark.llm.scans import scan

#: Two primes below 2^31, so that products fit a bigint.
PRIMES = (2147483647, 2147483629)
#: Nodes and conversations with more than this share of the rows are joined by broadcast; there are fewer of them than one over it.
HOT_SHARE = 1 / 1000
#: Characters of joined ids in one row on their way to the digest.
CHUNK = 1 << 20


def bases(attempt: int) -> list[int]:
    draw = random.Random(attempt)
    return [draw.randrange(1 << 20, p - 1) for p in PRIMES]


def join_hot(rows: DataFrame, small: DataFrame, on: list[str], size: Column, total: int) -> DataFrame:
    """Inner join with a table of unique keys; keys of more than a thousandth of ``total`` rows are broadcast.

    ``size`` counts the rows of each key in ``rows`` or in a table of ``total`` rows that contains it, so at most 1,000 keys are broadcast.
    """
    hot = small.where(size > total * HOT_SHARE)
    often = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(size <= total * HOT_SHARE), on)
    return often.unionByName(rest)


def turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, base: list[int]) -> DataFrame:
    """Each turn with its place and the prefix sums after it: ``conv``, ``pos``, ``s1``, ``s2``, ``x1``, ``x2``, ``digest``, ``n_words``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.size(words(text)).cast("bigint").alias("n_words"),
        *((F.pmod(F.xxhash64(role, text, F.lit(p)), F.lit(p - 1)) + 1).alias(f"x{i}") for i, p in enumerate(PRIMES, 1)))
    unit = said.select(
        "*", F.lit(1).cast("bigint").alias("pos"), *(F.lit(b).cast("bigint").alias(f"p{i}") for i, b in enumerate(base, 1)),
        *(F.col(f"x{i}").alias(f"s{i}") for i in (1, 2)))
    q1, q2 = PRIMES

    def product(a, b):
        return a[0] + b[0], a[1] * b[1] % q1, a[2] * b[2] % q2, (a[3] + a[1] * b[3]) % q1, (a[4] + a[2] * b[4]) % q2

    return scan(unit, "conv", [F.col("turn").asc_nulls_first(), F.col("digest")], ["pos", "p1", "p2", "s1", "s2"], product, "turns")


def paths(said: DataFrame, base: list[int], group: int, heads: int) -> DataFrame:
    """One row for each prefix of each rebuilt conversation, the empty one included.

    ``conv``, ``depth``, fingerprint ``f1, f2``, parent's ``g1, g2``, ``turn_conv`` and ``turn_pos`` and ``digest`` of the last turn, its ``n_words``, ``ends`` if it is the whole.
    """
    first = F.when(F.col("pos") < heads, F.struct("pos", "s1", "s2", "digest", "n_words"))
    convs = stored(said.groupBy("conv").agg(F.max("pos").alias("own"), F.sort_array(F.collect_list(first)).alias("head")), "conversations")
    plans = convs.select(
        "conv", "own", F.col("head").alias("own_head"), (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int").alias("h"),
        (F.col("conv") - F.col("conv") % group).alias("base"))
    above = convs.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    nothing = F.lit(0).cast("bigint")
    at = lambda array, k, field: F.when(k > 0, F.try_element_at(array, k)[field]).otherwise(nothing)
    h, m, own = F.col("h"), F.col("m"), F.col("own")
    plans = stored(
        plans.join(above, "base", "left").withColumn("m", F.least("h", F.coalesce(F.size("base_head"), F.lit(0)))).select(
            "conv", "base", "own", "h", "m", F.slice(F.coalesce("base_head", F.slice("own_head", 1, 0)), 1, m).alias("taken"), (m + F.greatest(own - h, nothing)).alias("whole"),
            *(at(F.col("base_head"), m, f"s{i}").alias(f"t{i}") for i in (1, 2)), *(at(F.col("own_head"), h, f"s{i}").alias(f"c{i}") for i in (1, 2)),
            # Own places move by m - h, at most 0: powers of the inverse.
            *(F.element_at(F.array(*(F.lit(pow(b, -k, p)).cast("bigint") for k in range(heads))), h - m + 1).alias(f"u{i}") for i, (b, p) in enumerate(zip(base, PRIMES, strict=True), 1))),
        "plans")
    root = plans.select(
        "conv", nothing.alias("depth"), *(nothing.alias(c) for c in ("f1", "f2", "g1", "g2")), F.lit(None).cast("bigint").alias("turn_conv"), F.lit(None).cast("bigint").alias("turn_pos"),
        F.unhex(F.lit("")).alias("digest"), nothing.alias("n_words"), (F.col("whole") == 0).alias("ends"))
    t = F.col("t")
    taken = plans.select("conv", "base", "whole", "taken", F.explode("taken").alias("t")).select(
        "conv", t["pos"].alias("depth"), t["s1"].alias("f1"), t["s2"].alias("f2"), *(at(F.col("taken"), (t["pos"] - 1).cast("int"), f"s{i}").alias(f"g{i}") for i in (1, 2)),
        F.col("base").alias("turn_conv"), t["pos"].alias("turn_pos"), t["digest"].alias("digest"), t["n_words"].alias("n_words"), (t["pos"] == F.col("whole")).alias("ends"))
    total = said.count()
    own_rows = join_hot(said, plans.drop("taken", "base"), ["conv"], F.col("own"), total).where("pos > h")
    depth = F.col("pos") - h + m

    def moved(sums: Column, i: int) -> Column:
        p = PRIMES[i - 1]
        return F.pmod(F.col(f"t{i}") + F.col(f"u{i}") * F.pmod(sums - F.col(f"c{i}"), F.lit(p)), F.lit(p))

    def prior(i: int) -> Column:
        """The sum before this turn: after it, less the turn's own term, whose power is that after the turn over B."""
        b, p = base[i - 1], PRIMES[i - 1]
        return F.col(f"s{i}") - F.pmod(F.col(f"x{i}") * F.pmod(F.col(f"p{i}") * F.lit(pow(b, -1, p)), F.lit(p)), F.lit(p))

    rest = own_rows.select(
        "conv", depth.alias("depth"), *(moved(F.col(f"s{i}"), i).alias(f"f{i}") for i in (1, 2)), *(moved(prior(i), i).alias(f"g{i}") for i in (1, 2)),
        F.col("conv").alias("turn_conv"), F.col("pos").alias("turn_pos"), "digest", "n_words", (depth == F.col("whole")).alias("ends"))
    return root.unionByName(taken).unionByName(rest)


def proven(conversations: DataFrame, columns: tuple[str, str, str, str], group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """All prefixes and their nodes, of the first bases that no two different sequences collide under."""
    attempt = 0
    while True:
        base = bases(attempt)
        rows = stored(paths(turns(conversations, *columns, base), base, group, heads), "prefixes")
        parent = F.struct("g1", "g2", "digest")
        nodes = stored(rows.groupBy("depth", "f1", "f2").agg(
            F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("words"), F.min(parent).alias("low"), F.max(parent).alias("high")), "nodes")
        if nodes.where(F.col("low") != F.col("high")).isEmpty():
            return rows, nodes.drop("low", "high")
        attempt += 1


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the joined ids of each (owner, depth), in numerical order.

    Ids are sorted and joined in stretches; a digest then reads one row for about 1 MB of its text.
    """
    spread = ends.select("owner", "depth", "conv").repartitionByRange(partitions(ends.sparkSession), "owner", "depth", "conv").sortWithinPartitions("owner", "depth", "conv")

    def chunks(parts):
        at, first, held, size = None, None, [], 0
        for part in parts:
            out = []
            for owner, depth, conv in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (owner, depth) != at or size > CHUNK:
                    if held:
                        out.append((*at, first, ",".join(held)))
                    at, first, held, size = (owner, depth), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*at, first, ",".join(held)), kinds, strict=True)], names)

    kinds, names = [pa.int64()] * 3 + [pa.string()], ["owner", "depth", "first", "ids"]
    joined = spread.mapInArrow(chunks, "owner bigint, depth bigint, first bigint, ids string").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first")

    def digests(parts):
        at, running = None, None
        for part in parts:
            out = []
            for owner, depth, _, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (owner, depth) == at:
                    running.update(b"," + ids.encode())
                    continue
                if running:
                    out.append((*at, running.hexdigest()))
                at, running = (owner, depth), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), shape, strict=True)], ["owner", "depth", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*at, running.hexdigest()), shape, strict=True)], ["owner", "depth", "ends_sha256"])

    shape = [pa.int64(), pa.int64(), pa.string()]
    return joined.mapInArrow(digests, "owner bigint, depth bigint, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 20, heads: int = 4,
) -> DataFrame:
    """One row per node: ``conv``, ``depth``, ``parent``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and ``turn_conv``, ``turn_pos``.

    The last two say where the node's last turn is stored (the place counts from 1 in turn order).
    """
    rows, groups = proven(conversations, (conv_col, turn_col, role_col, text_col), group, heads)
    total = rows.count()
    placed = stored(
        join_hot(rows.drop("g1", "g2", "digest", "n_words"), groups, ["depth", "f1", "f2"], F.col("n_convs"), total)
        .select("conv", "depth", "owner", "ends", "n_convs", "words", "turn_conv", "turn_pos"), "placed")
    spans = placed.groupBy("conv", "owner").agg(F.min("depth").alias("top"), F.max("depth").alias("last"))
    own = spans.where("conv = owner").select("conv", "top")
    above = stored(spans.where("conv != owner").select("conv", "owner", F.col("last").alias("depth")).join(own, "conv"), "chains")
    children = above.where("depth = top - 1").groupBy(F.col("owner").alias("conv"), "depth").agg(F.count(F.lit(1)).alias("branches"))
    parents = above.where("depth = top - 1").select("conv", F.col("top").alias("depth"), F.col("owner").alias("above"))
    count = F.coalesce("branches", F.lit(0)) + F.when(F.col("ends"), 0).otherwise(1)
    nodes = stored(
        placed.where("conv = owner").drop("owner").join(children, ["conv", "depth"], "left").join(parents, ["conv", "depth"], "left").select(
            "conv", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv")).alias("parent"), "n_convs", count.cast("bigint").alias("n_children"),
            F.when(count == 0, 1).otherwise(0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "turn_conv", "turn_pos"), "own-nodes")
    totals = nodes.groupBy("conv").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    below = above.join(totals, "conv").groupBy(F.col("owner").alias("conv"), "depth").agg(F.sum("leaf").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    zero = F.lit(0).cast("bigint")
    summed = nodes.join(below, ["conv", "depth"], "left").select(
        "conv", "depth", "parent", "n_convs", "n_children", "turn_conv", "turn_pos", (F.col("leaf") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"))
    subtree = scan(summed, "conv", [F.col("depth").desc()], ["n_leaves", "saved_tokens"], lambda a, b: (a[0] + b[0], a[1] + b[1]), "subtrees")
    ends = ends_digest(placed.where("ends")).withColumnRenamed("owner", "conv")
    return subtree.join(ends, ["conv", "depth"], "left").select(
        "conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.unhex(F.lit("")), 256)).alias("ends_sha256"), "turn_conv", "turn_pos")
