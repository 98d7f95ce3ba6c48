"""Exact removal of repeated byte strings by sharded suffix arrays.

Of every text each byte goes that lies in a string of ``length`` bytes which also
starts elsewhere.  What has to be compared is gathered by content: a string's
*anchor* is its 32-byte gram of least hash (the leftmost of equals), so equal
strings have equal anchors.  Successive strings with the same anchor form a *run*,
about one for 185 bytes; a run's fragment is the text it spans.

* A gram that is the anchor of one run only cannot repeat: its run is done.
* Equal fragments under one anchor repeat as a whole.
* Different fragments under one anchor are sorted in shards: a suffix array by
  Larsson-Sadakane refinement, Kasai's common prefixes, and a string repeats where
  the prefix shared with a neighbour reaches ``length``.  An anchor with many
  different fragments is dealt to several shards; each sorts its own, and
  shards are merged by binary search of one's window digests in the other's sorted
  digests, on partitions of the digests that no single anchor can fill.

Texts are UTF-8 bytes.  Defined cases: null is empty; texts shorter than ``length``
keep everything; equal rows are documents of their own and so repeat each other.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import partitions, stored
from shelfmark.llm.shingles import MIX, mixed
from shelfmark.llm.suffix_array import common_prefixes, suffix_array

GRAM = 32
#: Bytes of a text looked at together; positions inside it take the low bits of a hash.
STRETCH_BITS = 18
#: Different fragments of an anchor that one shard takes (about 5 MB, which take 300 MB while they
#: are sorted), and bytes after which a shard of several anchors is full.
SHARD_FRAGMENTS, SHARD_BYTES = 8000, 2 << 20
#: Parts of the digests of one anchor when its shards are merged.
MERGE_PARTS = 64


class Rolling:
    """Hashes of all substrings of one width, from one cumulative sum."""

    def __init__(self):
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * MIX[0])
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            base = MIX[0]
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, inverse))])

    def __call__(self, data: np.ndarray, width: int) -> np.ndarray:
        self.powers(len(data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.table[data] * self.up[: len(data)])])
        return mixed((sums[width:] - sums[:-width]) * self.down[: len(data) - width + 1])


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive values."""
    n = len(x)
    pad = np.append(x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(text: bytes, length: int, rolling: Rolling):
    """(first start, number of starts, anchor hash, fragment hash, anchor's place in the fragment) of every run of a text."""
    stretch, mask = (1 << STRETCH_BITS) - length, np.uint64((1 << STRETCH_BITS) - 1)
    for base in range(0, len(text) - length + 1, stretch):
        piece = text[base : base + stretch + length - 1]
        grams = rolling(np.frombuffer(piece, np.uint8), GRAM)
        at = np.arange(len(grams), dtype=np.uint64)
        least = window_minima((grams & ~mask) | at, length - GRAM + 1) & mask
        first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
        count = np.diff(np.append(first, len(least)))
        least = least[first].astype(np.int64)
        for a, m, anchor, p in zip(first.tolist(), count.tolist(), grams[least].view(np.int64).tolist(), (least - first).tolist(), strict=True):
            yield base + a, m, anchor, xxhash.xxh3_64_intdigest(piece[a : a + m - 1 + length]) - (1 << 63), p


def utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def all_runs(docs: DataFrame, length: int) -> DataFrame:
    id_type = docs.schema["id"].dataType.simpleString()

    def run(parts):
        rolling = Rolling()
        for part in parts:
            of, rows = [], []
            for i, text in enumerate(utf8(part.column(2))):
                if len(text) >= length:
                    found = list(runs(text, length, rolling))
                    rows += found
                    of += [i] * len(found)
            if rows:
                take, columns = pa.array(of), list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), part.column(1).take(take), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int32())], ["id", "body", "a", "m", "anchor", "hash", "p"])

    return docs.mapInArrow(run, f"id {id_type}, body bigint, a int, m int, anchor bigint, hash bigint, p int")


def fragments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs (``id``, ``body``, ``a``, ``m``, ``p``, ``anchor``, ``hash``, ``shard``, ``shards``)."""
    lists = wanted.groupBy(F.col("id").alias("w_id"), F.col("body").alias("w_body")).agg(F.collect_list(F.struct("a", "m", "p", "anchor", "hash", "shard", "shards")).alias("runs"))
    joined = docs.join(lists, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("body") == F.col("w_body"))).select("text", "runs")

    def run(parts):
        for part in parts:
            for text, wanted_runs in zip(utf8(part.column(0)), part.column(1).to_pylist(), strict=True):
                rows = [(r["anchor"], r["hash"], r["shard"], r["shards"], r["m"], r["p"], text[r["a"] : r["a"] + r["m"] - 1 + length]) for r in wanted_runs]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "hash", "shard", "shards", "m", "p", "bytes"])

    return joined.mapInArrow(run, "anchor bigint, hash bigint, shard int, shards int, m int, p int, bytes binary")


def shared_parts(group: list[tuple]) -> list[tuple[int, int]]:
    """For fragments of one anchor (place of the anchor, bytes): the stretch that some other fragment may share.

    A repeated string holds the anchor, so it lies between the longest context to the
    left that any other fragment has too and the longest one to the right; these are
    found between neighbours in sorted order.
    """
    reach = []
    for sides in ([data[p::-1] for p, data in group], [data[p:] for p, data in group]):
        order = sorted(range(len(sides)), key=sides.__getitem__)
        near = [0] * len(sides)
        for i, j in zip(order, order[1:], strict=False):
            same = len(commonprefix([sides[i], sides[j]]))
            near[i], near[j] = max(near[i], same), max(near[j], same)
        reach.append(near)
    return [(p + 1 - left, p + right) for (p, _), left, right in zip(group, *reach, strict=True)]


def repeated(shard: list[tuple], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every fragment of a shard (anchor, hash, shards, m, p, bytes): which of its starts repeat in the shard,
    and which stand for their string when shards are merged: those that do not repeat, and one of each string that does."""
    flags, parts, starts, at = [np.zeros(row[3], bool) for row in shard], [], [], 0
    stand = [np.ones(row[3], bool) for row in shard]
    for _, rows in groupby(range(len(shard)), key=lambda i: shard[i][0]):
        rows = list(rows)
        for i, (low, high) in zip(rows, shared_parts([shard[i][4:] for i in rows]), strict=True):
            if high - low >= length:
                parts += [np.frombuffer(shard[i][5][low:high], np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
                starts.append((i, low, high, at))
                at += high - low + 1
    if starts:
        codes = np.concatenate(parts)
        order = suffix_array(codes)
        shared = common_prefixes(codes, order, length)
        flag, again = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        again[order] = shared >= length
        flag[order] = (shared >= length) | (np.append(shared[1:], 0) >= length)
        for i, low, high, at in starts:
            stop = min(high - length + 1, len(flags[i]))
            flags[i][low:stop] = flag[at : at + stop - low]
            stand[i][low:stop] = ~again[at : at + stop - low]
    return flags, stand


def sorted_shards(dealt: DataFrame, length: int) -> DataFrame:
    """Starts that repeat (``digest`` null), and of split anchors every other start and one of each that repeats, with its digest."""

    def intervals(shard, rolling):
        for (anchor, code, shards, _, _, data), flag, stand in zip(shard, *repeated(shard, length), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]])))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield anchor, code, s, e, None, None
            if shards > 1:
                digests = rolling(np.frombuffer(data, np.uint8), length).view(np.int64)
                for s in np.flatnonzero(stand).tolist():
                    yield anchor, code, s, s + 1, int(digests[s]), code

    def run(parts):
        rolling, shard, held, last = Rolling(), [], 0, None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

        def flush():
            found = list(intervals(shard, rolling))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["anchor", "hash", "s", "e", "digest", "source"])

        for part in parts:
            for anchor, code, number, shards, m, p, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                here = (anchor, number)
                if shard and here != last and held > SHARD_BYTES:
                    yield from flush()
                    shard, held = [], 0
                if last == here and shard and shard[-1][1] == code:
                    continue
                shard.append((anchor, code, shards, m, p, data))
                held, last = held + len(data), here
        if shard:
            yield from flush()

    return dealt.mapInArrow(run, "anchor bigint, hash bigint, s int, e int, digest bigint, source bigint")


def merged_shards(windows: DataFrame) -> DataFrame:
    """Starts of split anchors whose digest other fragments have too, by binary search in sorted digests.

    Partitions are by (anchor, part of the digest), sorted; each sorted block of
    digests is searched for the digests around it.
    """
    dealt = windows.withColumn("part", F.pmod("digest", F.lit(MERGE_PARTS))).repartition(
        partitions(windows.sparkSession), "anchor", "part").sortWithinPartitions("anchor", "digest", "hash", "s").select("anchor", "hash", "s", "digest")

    def run(parts):
        held = None

        def found(rows, last):
            keys = np.rec.fromarrays([rows[0], rows[3]]) if len(rows[0]) else None
            if keys is None:
                return rows, None
            change = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[3][1:] != rows[3][:-1]))
            group = np.flatnonzero(change)
            end = len(keys) if last else group[-1]
            sizes = np.diff(np.append(group, len(keys)))
            place = np.searchsorted(group, np.arange(end), side="right") - 1
            keep = np.flatnonzero(sizes[place] > 1)
            batch = pa.RecordBatch.from_arrays([pa.array(rows[0][keep]), pa.array(rows[1][keep]), pa.array(rows[2][keep]), pa.array(rows[2][keep] + 1)], ["anchor", "hash", "s", "e"])
            return [r[end:] for r in rows], batch

        for part in parts:
            rows = [np.asarray(c) for c in part.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            held, batch = found(rows, False)
            if batch is not None and batch.num_rows:
                yield batch
        if held is not None:
            _, batch = found(held, True)
            if batch is not None and batch.num_rows:
                yield batch

    return dealt.mapInArrow(run, "anchor bigint, hash bigint, s int, e int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes) and ``kept_sha256``."""
    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    found = stored(all_runs(frame, length), "runs")
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("n > 1")
    open_runs = stored(found.join(anchors.select("anchor", (F.col("lo") != F.col("hi")).alias("differ")), "anchor"), "open-runs")
    kinds = open_runs.groupBy("anchor", "hash", "differ").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "body", "a", "m", "p")).alias("one"))
    kinds = stored(kinds, "kinds")
    many = kinds.where("differ").groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / SHARD_FRAGMENTS).cast("int").alias("shards"))
    wanted = kinds.where("differ").join(many, "anchor").select(
        "one.*", "anchor", "hash", F.pmod("hash", F.col("shards")).cast("int").alias("shard"), "shards")
    dealt = fragments(frame, wanted, length).repartition(partitions(docs.sparkSession), "anchor", "shard").sortWithinPartitions("anchor", "shard", "hash")
    windows = stored(sorted_shards(dealt, length), "windows")
    whole = kinds.where("n > 1").select("anchor", "hash", F.lit(0).alias("s"), F.col("one.m").alias("e"))
    flagged = (whole.unionByName(windows.where("digest IS NULL").select("anchor", "hash", "s", "e"))
               .unionByName(merged_shards(windows.where("digest IS NOT NULL"))))
    per_doc = (open_runs.join(flagged, ["anchor", "hash"]).select("id", "body", (F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e") - 1 + length).alias("e"))
               .groupBy(F.col("id").alias("f_id"), F.col("body").alias("f_body")).agg(F.collect_set(F.struct("s", "e")).alias("cut")))
    joined = frame.join(per_doc, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("body") == F.col("f_body")), "left").select("id", "text", "cut")
    schema = f"id {frame.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"

    def run(parts):
        for part in parts:
            rows = []
            for text, cut in zip(utf8(part.column(1)), part.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for s, e in sorted((c["s"], c["e"]) for c in cut or []):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([
                part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(run, schema)
