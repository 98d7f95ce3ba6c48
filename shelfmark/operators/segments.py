"""Segments of a stored index: whole texts, counted and scored together in one task with NumPy.

A segment holds the texts of about ``TERMS`` terms.  Its postings lie in blocks, one per field and term, and all of a
text lie in one segment, so blocks are what is exchanged and a segment's scores need nothing from outside.  Memory is
bounded by a segment, a block of queries (``CELLS``) and a chunk of matches (``MET``).  A block has a list of texts and
beside it their numbers (``COUNTS``) as bytes, which Spark moves as one value.

What runs in a task refers to nothing of this package, so that workers need not have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Terms of a segment, about; a longer text is a segment of its own.
TERMS = 1_000_000
#: Blocks handed on at once.
ROWS = 50_000
#: Scores (query slot by text) that a task holds at once, about.
CELLS = 2_000_000
#: Matches (posting by query slot) that a task looks at at once, about.
MET = 2_000_000
#: The numbers of a posting: documents that have the text, its terms in the field, and how often it has this one.
COUNTS = np.dtype([("copies", "<i8"), ("dl", "<i4"), ("tf", "<i4")])


def _reader(counts_type: np.dtype) -> Callable[[pa.BinaryArray], np.ndarray]:
    """The numbers of all postings of a column of blocks, in order."""

    def read(column: pa.BinaryArray) -> np.ndarray:
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(counts_type) if data else np.empty(0, counts_type)

    return read


def unpacker() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For blocks (bucket, tid, texts, counts): a row per posting (bucket, tid, text, copies, dl, tf)."""
    read = _reader(COUNTS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bucket, tid, texts, counts = part.columns
            of = pc.list_parent_indices(texts)
            numbers = read(counts)
            yield pa.RecordBatch.from_arrays(
                [bucket.take(of), tid.take(of), texts.flatten(), *(pa.array(np.ascontiguousarray(numbers[c])) for c in ("copies", "dl", "tf"))],
                ["bucket", "tid", "text", "copies", "dl", "tf"])

    return run


def largest_share(saturation: tuple[float, float], avgdl: dict[str, float], keywords: set[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For blocks (field, term, df, counts) with postings: (field, term, df, share), the largest part of its weight that the term has in one."""
    read, (k1, b) = _reader(COUNTS), saturation

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            field, term, df, counts = part.columns
            numbers, coded = read(counts), field.dictionary_encode()
            names = coded.dictionary.to_pylist()
            of = coded.indices.to_numpy()
            n = pc.binary_length(counts).to_numpy() // numbers.itemsize
            tf = numbers["tf"].astype(float)
            mean = np.repeat(np.array([avgdl[name] for name in names])[of], n)
            share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * numbers["dl"] / mean))
            most = np.maximum.reduceat(share, np.cumsum(n) - n)
            most[np.array([name in keywords for name in names])[of]] = 1.0
            yield pa.RecordBatch.from_arrays([field, term, df, pa.array(most)], ["field", "term", "df", "share"])

    return run


def counter(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (text, copies, field, terms) in order of text: blocks (segment, field, term, df, total, texts, counts).

    Rows with the same text, copies, field and length count as one, as documents that share an id do.  A field's own
    block has the empty term, no postings, the documents that have the field and their length (``total``).
    """
    counts_type, at_once = COUNTS, ROWS

    def codes(values: pa.Array) -> np.ndarray:
        return values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def first_part(table: pa.Table, lengths: np.ndarray) -> int:
        """Rows of about ``size`` terms that end with a text; 0 if the text may go on."""
        number = codes(table.column(0).combine_chunks())
        starts = np.flatnonzero(np.diff(number)) + 1
        if not len(starts):
            return 0
        before = np.cumsum(lengths)[starts - 1]
        return int(starts[max(0, np.searchsorted(before, size, "right") - 1)])

    def blocks(table: pa.Table, lengths: np.ndarray, segment: int) -> Iterator[pa.RecordBatch]:
        text, copies, field, terms = (c.combine_chunks() for c in table.columns)
        fields = field.dictionary_encode()
        in_field = fields.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = copies.to_numpy(zero_copy_only=False).astype(np.int64)
        group = codes(text)
        for more in (many, lengths):
            values, number = np.unique(more, return_inverse=True)
            group = np.unique(group * len(values) + number, return_inverse=True)[1]
        row_of, group = np.unique(group * len(fields.dictionary) + in_field, return_index=True, return_inverse=True)[1:]
        words = terms.flatten().dictionary_encode()
        key = np.repeat(in_field * len(words.dictionary), lengths)
        key += words.indices.to_numpy(zero_copy_only=False)
        words = words.dictionary
        key *= len(row_of)
        key += np.repeat(group, lengths)
        key.sort()
        at = np.append(0, np.flatnonzero(np.diff(key)) + 1)
        tf = np.diff(np.append(at, len(key)))
        key = key[at]
        owner = row_of[key % len(row_of)]
        key //= len(row_of)
        starts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
        of_field, of_word = np.divmod(key[starts], len(words))
        # The fields' own blocks come last and hold no postings.
        n_fields = len(fields.dictionary)
        ends = np.concatenate([starts, np.full(n_fields + 1, len(key))]).astype(np.int32)
        numbers = np.empty(len(key), counts_type)
        numbers["copies"], numbers["dl"], numbers["tf"] = many[owner], lengths[owner], tf
        own = lambda weights: np.bincount(in_field, weights, n_fields).astype(np.int64)
        total = pa.concat_arrays([pa.nulls(len(starts), pa.int64()), pa.array(own(many * lengths))])
        whole = pa.RecordBatch.from_arrays([
            pa.array(np.full(len(ends) - 1, segment, np.int64)),
            fields.dictionary.take(pa.array(np.append(of_field, np.arange(n_fields)))),
            pa.concat_arrays([words.take(pa.array(of_word)), pa.array([""] * n_fields, words.type)]),
            pa.array(np.append(np.add.reduceat(many[owner], starts), own(many))), total,
            pa.ListArray.from_arrays(pa.array(ends), text.take(pa.array(owner))),
            pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends * numbers.itemsize), pa.py_buffer(numbers.tobytes())])],
            ["segment", "field", "term", "df", "total", "texts", "counts"])
        del key, numbers, owner, tf, at, terms
        for first in range(0, whole.num_rows, at_once):
            yield whole.slice(first, at_once)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held = TaskContext.get().partitionId() << 32, None
        for part in parts:
            if not part.num_rows:
                continue
            new = pa.Table.from_batches([part])
            held = new if held is None else pa.concat_tables([held, new])
            lengths = pc.list_value_length(held.column(3)).to_numpy().astype(np.int64)
            while lengths.sum() > size and (cut := first_part(held, lengths)):
                yield from blocks(held.slice(0, cut), lengths[:cut], segment)
                segment, held, lengths = segment + 1, held.slice(cut), lengths[cut:]
            # The rest alone is kept, not the batch it is a slice of.
            held, part, new = held.take(pa.array(np.arange(held.num_rows))).combine_chunks(), None, None
            pa.default_memory_pool().release_unused()
        if held is not None and held.num_rows:
            yield from blocks(held, pc.list_value_length(held.column(3)).to_numpy().astype(np.int64), segment)

    return run


@dataclass(frozen=True)
class Wanted:
    """The query side as arrays."""

    #: (tid, slot, w, avgdl, keyword, leads) of every weighted term.
    terms: dict[str, np.ndarray]
    #: (slot, list, needed, boost): what a slot is to each list, a strategy on a query; the slots of a query stand together.
    slots: dict[str, np.ndarray]
    #: Slots whose other terms only complete what the leading ones find, and the least that a text must have from these.
    least: dict[int, float]
    #: Strategy and query of each list.
    strategy: pa.Array
    qid: pa.Array


def scorer(
    wanted: Wanted, size: int, saturation: tuple[float, float], slack: float, cells: int, met: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For blocks (segment, tid, texts, counts) in order of segment: (strategy, qid, text, text_score) of the texts that can
    be among the best ``size`` of a list, with those that rounding may make equal to the last."""
    read, (k1, b) = _reader(COUNTS), saturation
    strategy, qid = wanted.strategy, wanted.qid
    term, use, limit = wanted.terms, wanted.slots, wanted.least

    class Slots:
        """A block of queries: its slots in order, and their terms by number."""

        def __init__(self, first: int, last: int):
            self.use = {k: v[first:last] for k, v in use.items()}
            slots, self.at = np.unique(self.use["slot"], return_inverse=True)
            self.n = len(slots)
            mine = np.isin(term["slot"], slots)
            here = {k: v[mine] for k, v in term.items()}
            here["slot"] = np.searchsorted(slots, here["slot"])
            self.least = np.array([limit.get(int(s), np.nan) for s in slots])
            self.pruned = np.array([int(s) in limit for s in slots], bool)
            here["leads"] = here["leads"] | ~self.pruned[here["slot"]]
            self.leading, self.others = ({k: v[chosen] for k, v in here.items()} for chosen in (here["leads"], ~here["leads"]))
            for part in (self.leading, self.others):
                order = np.argsort(part["tid"], kind="stable")
                part.update({k: v[order] for k, v in part.items()})

    def blocks_of_queries(texts: int) -> list[Slots]:
        """Blocks of about ``cells`` scores; slots of one query are not parted."""
        if texts not in known:
            known.clear()
            known[texts], first = [], 0
            ends = np.append(np.flatnonzero(np.diff(use["query"])) + 1, len(use["query"]))
            while first < len(use["query"]):
                most = np.searchsorted(ends, first + max(1, cells // texts), "right") - 1
                last = int(ends[most]) if most >= 0 and ends[most] > first else int(ends[np.searchsorted(ends, first, "right")])
                known[texts].append(Slots(first, last))
                first = last
        return known[texts]

    known: dict[int, list[Slots]] = {}

    def add(sums: np.ndarray, counts: np.ndarray, part: dict[str, np.ndarray], tid: np.ndarray, doc: np.ndarray, dl: np.ndarray, tf: np.ndarray, texts: int) -> None:
        """What the postings give to the slots that ask for their terms."""
        low, high = (np.searchsorted(part["tid"], tid, side) for side in ("left", "right"))
        fan = high - low
        chosen = np.flatnonzero(fan)
        upto = np.cumsum(fan[chosen])
        first = 0
        while first < len(chosen):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + met, "right")))
            own = chosen[first:last]
            n = fan[own]
            ask = np.arange(n.sum()) + np.repeat(low[own] - np.append(0, np.cumsum(n)[:-1]), n)
            avgdl, count = part["avgdl"][low[own]], tf[own]
            share = count * (k1 + 1) / (count + k1 * (1 - b + b * dl[own] / avgdl))
            value = part["w"][ask] * np.where(part["keyword"][ask], 1.0, np.repeat(share, n))
            cell = part["slot"][ask] * texts + np.repeat(doc[own], n)
            sums += np.bincount(cell, value, len(sums))
            counts += np.bincount(cell, minlength=len(counts))
            first = last

    def score(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        each = table.column("texts").combine_chunks()
        n = pc.list_value_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = each.flatten().dictionary_encode(null_encoding="encode")
        doc, texts = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        numbers = read(table.column("counts").combine_chunks())
        dl, tf = numbers["dl"].astype(float), numbers["tf"].astype(float)
        tid = np.repeat(table.column("tid").to_numpy(), n)
        for block in blocks_of_queries(texts):
            sums, counts = np.zeros(block.n * texts), np.zeros(block.n * texts, np.int64)
            add(sums, counts, block.leading, tid, doc, dl, tf, texts)
            if len(block.others["tid"]):
                got, some = sums.reshape(block.n, texts), counts.reshape(block.n, texts)
                kept = (some > 0) & ~(got < block.least[:, None])
                kept[~block.pruned] = True
                found = kept[block.pruned].any(axis=0)
                active = kept.any(axis=1)[block.others["slot"]]
                if found.any():  # frequent terms are met only for texts that others found, by slots that found some
                    at = np.flatnonzero(found[doc])
                    add(sums, counts, {k: v[active] for k, v in block.others.items()}, tid[at], doc[at], dl[at], tf[at], texts)
                counts.reshape(block.n, texts)[~kept] = 0
            yield from best(block, sums.reshape(block.n, texts), counts.reshape(block.n, texts), coded.dictionary)

    def best(block: Slots, sums: np.ndarray, counts: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        number, texts, scores = [], [], []
        lists = block.use["list"]
        order = np.argsort(lists, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
            at = block.at[rows]
            matched = (counts[at] > 0) & (counts[at] >= block.use["needed"][rows][:, None])
            top = np.where(matched, sums[at] * block.use["boost"][rows][:, None], -np.inf).max(axis=0)
            hit = np.flatnonzero(matched.any(axis=0))
            if len(hit) > size:
                hit = hit[top[hit] >= np.partition(top[hit], len(hit) - size)[len(hit) - size] - slack]
            number.append(np.full(len(hit), lists[rows[0]]))
            texts.append(hit)
            scores.append(top[hit])
        number, texts = pa.array(np.concatenate(number)), pa.array(np.concatenate(texts))
        yield pa.RecordBatch.from_arrays(
            [strategy.take(number), qid.take(number), names.take(texts), pa.array(np.concatenate(scores))], ["strategy", "qid", "text", "text_score"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            segment = part.column("segment").to_numpy()
            cuts = np.flatnonzero(np.diff(segment)) + 1
            for first, last in zip(np.append(0, cuts), np.append(cuts, len(segment)), strict=True):
                if held and held[-1].column("segment")[0].as_py() != segment[first]:
                    yield from score(held)
                    held = []
                held.append(part.slice(int(first), int(last - first)))
        if held:
            yield from score(held)

    return run
