"""Benchmark decontamination by SimHash of item-sized windows.

The benchmark is the stated query set.  It is measured, cut into blocks of bounded
size, and each block meets every document once, where the documents lie: no
exchange of texts.

In a document, windows as long as an item (in words) get a 64-bit SimHash of their
word shingles, repeated shingles counting as often.  Five Hamming blocks index the
items' fingerprints: within a distance of 17, one block differs in three bits at
most, and all such values are listed, so no fingerprint within the radius is missed.
A fingerprint may lie outside the radius although the shingles are similar; windows
beyond it that hold enough of an item's shingles to be similar are candidates too,
so the result is exact.  Candidates are verified by the exact weighted Jaccard similarity of the shingles.

A window can only verify if it holds a shingle of the item, so fingerprints are
made for windows around such shingles only; that loses nothing.

Words are split at ASCII white space and punctuation and compared in lower case.
Defined cases: null, empty and wordless texts or items match nothing; equal rows
and equal items give a row each; an item longer than the document is compared with
the whole document.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.shingles import WordHashes, shingle_sequence

BLOCKS, RADIUS = 5, 17
#: Items and characters that one pass over the documents takes along.
BLOCK_ITEMS, BLOCK_CHARS = 4096, 16_000_000
#: ASCII punctuation and control characters part words.
PARTING = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FILTER_BITS = 20
#: Window starts of a text that are looked at together.
STRETCH = 1 << 14


def hashes(text: str | None, known: WordHashes) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(PARTING).split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def simhashes(sequence: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the windows of ``width`` shingles at ``starts``."""
    low = int(starts.min())
    part = np.ascontiguousarray(sequence[low : int(starts.max()) + width])
    bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[starts - low + width] - sums[starts - low]
    return np.packbits(2 * ones > width, axis=1).view(np.uint64).ravel()


def starts_around(places: np.ndarray, width: int, n: int) -> np.ndarray:
    """Starts of the windows of ``width`` that hold one of the sorted ``places``, of ``n`` positions in all."""
    low, high = np.maximum(places - width + 1, 0), np.minimum(places, n - width)
    low = np.maximum(low, np.append(0, high[:-1] + 1))
    count = np.maximum(high - low + 1, 0)
    return np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def stretches(starts: np.ndarray, width: int):
    """Sorted starts in pieces whose windows lie together and span a bounded part of the text."""
    cut = np.append(True, (np.diff(starts) > width) | (np.diff(starts // STRETCH) > 0)) if len(starts) else np.zeros(0, bool)
    return np.split(starts, np.flatnonzero(cut)[1:]) if len(starts) else []


def overlaps(sequence: np.ndarray, starts: np.ndarray, width: int, item: np.ndarray) -> np.ndarray:
    """Sum of minima of the windows' and the item's shingle counts, for all ``starts`` at once.

    A shingle that the item holds k times counts in a window for its first k
    places there, so each place counts for an interval of starts: from behind the
    k-th place before it up to itself.
    """
    first = int(starts[0])
    part = sequence[first : int(starts[-1]) + width]
    kinds, held = np.unique(item, return_counts=True)
    kind = np.minimum(np.searchsorted(kinds, part), len(kinds) - 1)
    place = np.flatnonzero(kinds[kind] == part)
    order = np.argsort(kind[place], kind="stable")
    place, kind = place[order], kind[place][order]
    back = np.arange(len(place)) - held[kind]
    before = np.maximum(back, 0)
    same = (back >= 0) & (kind[before] == kind)
    low = np.maximum(np.where(same, place[before] + 1, 0), np.maximum(place - width + 1, 0))
    n = len(part) - width + 1
    high = np.minimum(place, n - 1)
    counts = low <= high
    change = np.bincount(low[counts], minlength=n + 1) - np.bincount(high[counts] + 1, minlength=n + 1)
    return np.cumsum(change)[starts - first]


class Items:
    """A block of the benchmark, indexed."""

    def __init__(self, rows: list[tuple], size: int):
        known = WordHashes()
        self.size = size
        found = [(i, h, *n) for i, t, *n in rows if len(h := hashes(t, known))]
        self.ids = [row[0] for row in found]
        self.words = [len(row[1]) for row in found]
        self.times = [row[2] if len(row) > 2 else 1 for row in found]
        self.sequences = [shingle_sequence(row[1], size) for row in found]
        self.width = np.array([len(s) for s in self.sequences], np.int64)
        owner = np.repeat(np.arange(len(found)), self.width)
        every = np.concatenate(self.sequences) if found else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.shingles, self.owner = every[order], owner[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[every & np.uint64((1 << FILTER_BITS) - 1)] = True
        self.prints = np.array([simhashes(s, np.array([0]), len(s))[0] for s in self.sequences], np.uint64)
        edges = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
        self.blocks = []
        for low, high in zip(edges, edges[1:], strict=False):
            bits, mask = high - low, np.uint64((1 << (high - low)) - 1)
            near = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(bits), k)], np.uint64)
            values = (((self.prints >> np.uint64(low)) & mask)[:, None] ^ near).ravel()
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << bits) + 1, dtype=np.uint64))
            self.blocks.append((np.uint64(low), mask, starts, np.repeat(np.arange(len(found)), len(near))[order]))

    def candidates(self, value: np.uint64) -> np.ndarray:
        """Items whose fingerprint may lie within the radius of ``value``, then those that do."""
        lists = []
        for low, mask, starts, items in self.blocks:
            v = int((value >> low) & mask)
            lists.append(items[starts[v] : starts[v + 1]])
        near = np.unique(np.concatenate(lists))
        return near[np.bitwise_count(self.prints[near] ^ value) <= RADIUS]

    def matches(self, text: str | None, known: WordHashes, percent: int) -> list[tuple]:
        """(item, start word, words, minima, maxima) of the best window for each item that verifies."""
        words = hashes(text, known)
        sequence = shingle_sequence(words, self.size)
        if not len(sequence) or not len(self.shingles):
            return []
        near = np.flatnonzero(self.filter[sequence & np.uint64((1 << FILTER_BITS) - 1)])
        if len(near):
            at = np.minimum(np.searchsorted(self.shingles, sequence[near]), len(self.shingles) - 1)
            near = near[self.shingles[at] == sequence[near]]
        if not len(near):
            return []
        lo, hi = np.searchsorted(self.shingles, sequence[near]), np.searchsorted(self.shingles, sequence[near], side="right")
        hits: dict[int, set] = {}
        for p, a, b in zip(near.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for width in set(self.width[self.owner[a:b]].tolist()):
                hits.setdefault(width, set()).add(p)
        best: dict[int, tuple] = {}
        for width, places in hits.items():
            w = min(width, len(sequence))
            for starts in stretches(starts_around(np.array(sorted(places)), w, len(sequence)), w):
                near_starts: dict[int, list] = {}
                for start, value in zip(starts.tolist(), simhashes(sequence, starts, w), strict=True):
                    for item in self.candidates(value).tolist():
                        if self.width[item] == width:
                            near_starts.setdefault(item, []).append(start)
                for item, at in near_starts.items():
                    self.verify(sequence, np.array(at), item, len(words), percent, best)
        self.beyond(sequence, near, lo, hi, len(words), percent, best)
        return [(item, *best[item]) for item in sorted(best)]

    def beyond(self, sequence: np.ndarray, near: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_words: int, percent: int, best: dict[int, tuple]) -> None:
        """Add to ``best`` what the radius misses: windows that hold as many of an item's shingles as similarity takes."""
        total = hi - lo
        owned = np.repeat(lo - np.cumsum(total) + total, total) + np.arange(total.sum())
        pairs = np.unique(self.owner[owned] * len(sequence) + np.repeat(near, total))
        item_of, place = np.divmod(pairs, len(sequence))
        items, first, counts = np.unique(item_of, return_index=True, return_counts=True)
        for item, at, count in zip(items.tolist(), first.tolist(), counts.tolist(), strict=True):
            w = min(int(self.width[item]), len(sequence))
            need = -(-percent * (int(self.width[item]) + w) // (100 + percent))
            if count < need:
                continue
            p = place[at : at + count]
            # Of the windows that are full enough, each starts at most a window before a place.
            starts = starts_around(p, w, len(sequence))
            starts = starts[np.searchsorted(p, starts + w) - np.searchsorted(p, starts) >= need]
            for piece in stretches(starts, w):
                far = piece[np.bitwise_count(simhashes(sequence, piece, w) ^ self.prints[item]) > RADIUS]
                if len(far):
                    self.verify(sequence, far, item, n_words, percent, best)

    def verify(self, sequence: np.ndarray, starts: np.ndarray, item: int, n_words: int, percent: int, best: dict[int, tuple]) -> None:
        """Put the most similar window (the first of equals) of ``starts`` into ``best`` if it is similar enough."""
        own = self.sequences[item]
        w = min(len(own), len(sequence))
        for piece in stretches(starts, w):
            low = overlaps(sequence, piece, w, own)
            at = int(low.argmax())
            start, most, total = int(piece[at]), int(low[at]), w + len(own)
            old = best.get(item)
            if 100 * most >= percent * (total - most) and (old is None or most > old[2] or (most == old[2] and start < old[0])):
                best[item] = (start, min(self.words[item], n_words), most, total - most)


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark in blocks that hold a bounded number of different items and characters each, with their numbers of equal rows."""
    rows = benchmark.groupBy(F.col(item_col).alias("item"), F.col(text_col).alias("text")).agg(F.count(F.lit(1)).alias("times"))
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).head()
    count = max(1, -(-2 * n // BLOCK_ITEMS) if n > BLOCK_ITEMS else 1, -(-2 * chars // BLOCK_CHARS) if chars > BLOCK_CHARS else 1)
    for b in range(count):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == b).collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = 5, percent: int = 80,
) -> DataFrame:
    """One row per document and item that it contains: ``id``, ``body``, ``item``, ``start``, ``n_words``, ``similarity``."""
    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = f"id {frame.schema['id'].dataType.simpleString()}, body bigint, item {item_type.simpleString()}, start bigint, n_words bigint, similarity double"
    parts = []
    for rows in blocks_of(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            items, known = Items(sent.value, size), WordHashes()
            for batch in batches:
                out, of = [], []
                for i, text in enumerate(batch.column(2)):
                    for item, start, n, low, high in items.matches(text.as_py(), known, percent):
                        out += [(items.ids[item], start, n, low / high)] * items.times[item]
                        of += [i] * items.times[item]
                if out:
                    columns, take = list(zip(*out, strict=True)), pa.array(of)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(columns[0]), pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], ["id", "body", "item", "start", "n_words", "similarity"])

        parts.append(frame.mapInArrow(run, schema))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents in which no item was found, in the columns of the input."""
    hit = contaminated(docs, benchmark, id_col, text_col, **how).select(F.col("id").alias("h_id"), F.col("body").alias("h_body")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("body") == F.col("h_body")), "left_anti").select("row.*")
