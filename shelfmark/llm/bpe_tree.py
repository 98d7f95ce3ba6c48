"""Byte-level BPE as a reduction over a monoid of encodings.

The elements are canonical encodings of byte strings, the product joins two
neighbours into the encoding of their concatenation.  A piece of text is halved
until its parts are short, the parts are encoded directly, and the products go up
the tree.

The product rests on one fact about merges in order of rank.  A token sequence is
the encoding of its bytes exactly if every two neighbours are *stable*, that is if
their two strings together encode to just these two tokens: the first merge that
crossed a boundary would have been made by the pair alone too, because up to then
nothing outside the pair has touched it.  Both halves are stable inside.  So if the
tokens at the seam are stable, the product is plain concatenation; otherwise a window
around the seam is encoded anew, and grows on the side whose edge is not yet stable.
As soon as both edges are, the tokens outside are proven unchanged.

Decoding is a homomorphism: the bytes of the tokens, concatenated up the tree.

Defined cases: a null text is empty and has no tokens; equal rows give equal rows; a
text without any boundary (one long run of letters) is one piece, and its tree keeps
the cost near linear; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.fst_tokens import pieces, slices

#: Byte strings up to this length are encoded directly; longer ones are halved.
LEAF = 24
#: The rank of a pair that is no token.
NONE = 1 << 40
#: Ids looked up at once at the leaves of a decoding tree.
DECODE_LEAF = 1 << 16
#: Bytes of memory for the pieces that a worker remembers, what one takes besides its own bytes, and the longest piece that it does.
REMEMBERED_BYTES, ENTRY_BYTES, LONGEST_REMEMBERED = 128 << 20, 200, 1024


class Ranks:
    """The tokens of a rank file with the product of their encodings."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(number) for token, number in map(bytes.split, lines)}
        self.token = {number: token for token, number in self.rank.items()}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a byte-level vocabulary needs every single byte")
        self.seams: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merge(self, data: bytes) -> list[int]:
        """Encode directly: the adjacent pair of lowest rank first, the leftmost of equals."""
        if len(data) > 4 * LEAF:
            return self.merge_long(data)
        get, cuts = self.rank.get, list(range(len(data) + 1))
        ranks = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) != NONE:
            at = ranks.index(best)
            del cuts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(data[cuts[at - 1] : cuts[at + 1]], NONE)
            if at < len(ranks):
                ranks[at] = get(data[cuts[at] : cuts[at + 2]], NONE)
        return [self.rank[data[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge_long(self, data: bytes) -> list[int]:
        """The same for a wide window, with a heap of candidate pairs over linked parts."""
        rank, n = self.rank, len(data)
        after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), [data[i : i + 1] for i in range(n)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                joined = part[i] + part[after[i]]
                if (r := rank.get(joined)) is not None:
                    heapq.heappush(heap, (r, i, len(joined)))

        while heap:
            _, i, size = heapq.heappop(heap)
            if not part[i] or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged since
            part[i] += part[j]
            part[j], after[i] = b"", after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [rank[p] for p in part if p]

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        key = a << 32 | b
        found = self.seams.get(key)
        if found is None:
            if len(self.seams) > 1_000_000:
                self.seams.clear()
            found = self.seams[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(self.decode(left[-i:]) + self.decode(right[:j]))
            settled = i == len(left) or self.stable(left[-i - 1], window[0])
            if settled and (j == len(right) or self.stable(window[-1], right[j])):
                return left[:-i] + window + right[j:]
            if not settled:
                i = min(len(left), 2 * i)
            if j < len(right) and not self.stable(window[-1], right[j]):
                j = min(len(right), 2 * j)

    def reduce(self, data: bytes, seen: dict[bytes, list[int]]) -> list[int]:
        """The encoding of a byte string from its halves; equal parts of one piece are encoded once."""
        if len(data) <= LEAF:
            return self.merge(data)
        if data not in seen:
            half = len(data) // 2
            seen[data] = self.join(self.reduce(data[:half], seen), self.reduce(data[half:], seen))
        return seen[data]

    def piece(self, text: str) -> bytes:
        """Ids of one match of the splitting pattern as 32-bit bytes; a piece that is a token is that token."""
        data = text.encode()
        whole = self.rank.get(data)
        found = array("i", self.reduce(data, {}) if whole is None else (whole,)).tobytes()
        if len(data) <= LONGEST_REMEMBERED:
            if self.held > REMEMBERED_BYTES:
                self.known.clear()
                self.held = 0
            self.known[text] = found
            self.held += len(data) + len(found) + ENTRY_BYTES
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        found, each = pieces(texts)
        emitted = list(map(self.known.get, found))
        if None in emitted:
            emitted = [self.known.get(p) or self.piece(p) if e is None else e for p, e in zip(found, emitted, strict=True)]
        ends = np.append(0, np.cumsum(np.fromiter(map(len, emitted), np.int64, len(emitted)) // 4))
        last = np.cumsum(each)
        return np.frombuffer(b"".join(emitted), np.int32), ends[last] - ends[last - each]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the tokens, concatenated up the tree."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@cache
def ranks_of(path: str) -> Ranks:
    """One table per worker process, kept from task to task."""
    return Ranks(path)


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (array of int) for every row, whole texts, without special tokens."""
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(parts):
        table = ranks_of(ranks)
        for part in parts:
            for first, texts in slices(part.column(1).to_pylist()):
                ids, counts = table.encode(texts)
                offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["id", "ids"])

    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """``id``, ``ids`` and ``decoded`` (bytes) for rows of ``id`` and ``ids``; no ids give no bytes."""
    frame = encoded.select("id", "ids")

    def run(parts):
        table = ranks_of(ranks)
        for part in parts:
            lists = part.column(1)
            ids, offsets = lists.values.to_numpy(), lists.offsets.to_pylist()
            decoded = [table.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")
