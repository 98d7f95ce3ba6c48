"""A byte-level BPE tokenizer compiled to finite-state transducers.

Two machines in series, both annotated with what a transition emits:

* The boundary machine: eight states over nine symbol classes replace the splitting
  pattern; a transition says whether a piece starts before its character.  Look-ahead
  (white space before a non-space, contractions) is folded into the classes.  A long
  run of text is cut into chunks; every chunk yields its state map (start state to
  end state), maps compose by a parallel prefix scan, and with the start states known
  all chunks emit their boundaries in step.
* The piece machine: an acyclic transducer from whole pieces to their emitted tokens.
  It is grown on demand from the library's own tokenizer, so results are exact, and
  its size is bounded.

Texts of a batch are laid end to end with a reset symbol between them, so documents,
short or very long, cost the same per character.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States: piece closed, letters, numbers, other marks, white space, one space before a word, contraction with one or two letters to come.
CLOSED, LETTER, NUMBER, MARK, WHITE, LEAD, ONE, TWO = range(8)
#: Symbols: the first three as the states; white space inside a run; its last, a space or another; apostrophes before 's' or 're'; end of text.
S_LETTER, S_NUMBER, S_MARK, S_INNER, S_SPACE, S_LAST, S_APOS1, S_APOS2, S_RESET = range(9)
CHUNK = 4096


@cache
def classes() -> np.ndarray:
    """Letter, number, mark or white space of every code point, as the splitter's own pattern engine knows them.

    An encoding whose tokens are single bytes returns exactly the bytes that its pattern
    matches, so one call per class lists the class; Python's tables are of another Unicode version.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, S_MARK, np.uint8)
    for pattern, symbol in ((r"\p{L}", S_LETTER), (r"\p{N}", S_NUMBER), (r"\s", S_INNER)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = symbol
    return table


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts, by (state, symbol)."""
    step, starts = np.zeros((8, 9), np.uint8), np.zeros((8, 9), bool)
    opened = {S_LETTER: LETTER, S_NUMBER: NUMBER, S_MARK: MARK, S_INNER: WHITE, S_SPACE: LEAD, S_LAST: CLOSED, S_APOS1: ONE, S_APOS2: TWO, S_RESET: CLOSED}
    for state in range(8):
        for symbol, target in opened.items():
            step[state, symbol], starts[state, symbol] = target, symbol != S_RESET
        for symbol in range(8):
            if state == TWO or state == ONE:
                step[state, symbol], starts[state, symbol] = ONE if state == TWO else CLOSED, False
    for state, symbol, target in [
        (LETTER, S_LETTER, LETTER), (NUMBER, S_NUMBER, NUMBER), (WHITE, S_INNER, WHITE), (LEAD, S_LETTER, LETTER), (LEAD, S_NUMBER, NUMBER),
        *((s, c, MARK) for s in (MARK, LEAD) for c in (S_MARK, S_APOS1, S_APOS2)),
    ]:
        step[state, symbol], starts[state, symbol] = target, False
    return step, starts


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of every character; ``ends`` are the positions of the separators between texts."""
    found = classes()[codes]
    found[ends] = S_RESET
    after = np.append(found[1:], np.uint8(S_RESET))
    last = (found == S_INNER) & (after != S_INNER) & (after != S_RESET)
    quote = np.flatnonzero((codes == 39) & (found == S_MARK))
    found[last] = np.where(codes[last] == 32, S_SPACE, S_LAST)
    if len(quote):
        near = np.append(codes, [0, 0])
        a, b = near[quote + 1], near[quote + 2]
        pair = lambda s: (a == ord(s[0])) & (b == ord(s[1]))
        found[quote[np.isin(a, [ord(c) for c in "stmd"])]] = S_APOS1
        found[quote[pair("re") | pair("ve") | pair("ll")]] = S_APOS2
    return found


def compose(maps: np.ndarray) -> np.ndarray:
    """Start state of every chunk: an exclusive prefix scan over state maps, in doubling steps."""
    total, width = maps.copy(), 1
    while width < len(total):
        later = total.copy()
        later[width:] = np.take_along_axis(total[width:], total[:-width], axis=1)
        total, width = later, 2 * width
    return np.concatenate([[CLOSED], total[:-1, CLOSED]]).astype(np.uint8)


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """Positions where pieces start."""
    step, starts = machine()
    chunk = min(CHUNK, max(64, len(symbol) // 1024))
    pad = -len(symbol) % chunk
    grid = np.ascontiguousarray(np.append(symbol, np.full(pad, S_RESET, np.uint8)).reshape(-1, chunk).T)
    flat, begin = step.ravel(), starts.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (grid.shape[1], 1))
    for i, row in enumerate(grid):
        maps = flat[maps * np.uint8(9) + row[:, None]]
        if (maps == maps[:, :1]).all():  # maps are constant by now, as is usual: go on with their only value
            state = maps[:, 0]
            for later in grid[i + 1:]:
                state = flat[state * np.uint8(9) + later]
            maps = np.repeat(state[:, None], 8, axis=1)
            break
    return emit(grid, compose(maps), flat, begin)[: len(symbol)].nonzero()[0]


def emit(grid: np.ndarray, state: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character, all chunks in step."""
    out = np.empty(grid.shape, bool)
    for i, row in enumerate(grid):
        at = state * np.uint8(9) + row
        out[i] = begin[at]
        state = flat[at]
    return out.T.ravel()


@cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Lexicon(dict):
    """Pieces to their token ids as little-endian 16-bit bytes, asked of the tokenizer's model once per piece."""

    def __init__(self, path: str, bound: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.bound, self.letters = tokenizer.model.tokenize, bound, byte_letters()
        self.special = {str(t.content): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids above 65,535 need wider emissions")

    def emitted(self, ids: list[int]):
        return array("H", ids).tobytes()

    def learn(self, piece: str):
        if len(self) >= self.bound:
            self.clear()
        found = self[piece] = self.emitted([t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        return found

    def look(self, found: list[str]) -> list:
        """What each piece emits."""
        out = list(map(self.get, found))
        for i, x in enumerate(out):
            if x is None:
                out[i] = self.get(found[i]) or self.learn(found[i])
        return out


class Counts(Lexicon):
    """Pieces to the number of their tokens."""

    def emitted(self, ids: list[int]):
        return len(ids)


@cache
def lexicon_of(kind: type[Lexicon], path: str) -> Lexicon:
    """One lexicon per worker process, kept from task to task."""
    return kind(path)


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts, and how many each text has."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    at = boundaries(symbols(codes, ends))
    stop = np.append(at[1:], len(codes))
    text_of = np.searchsorted(ends, at)
    stop = np.minimum(stop, ends[text_of])
    return [joined[a:b] for a, b in zip(at.tolist(), stop.tolist(), strict=True)], np.bincount(text_of, minlength=len(texts))


def split_special(texts: list[str], special: dict[str, int]) -> tuple[list[str], list[list[int]]]:
    """Ordinary stretches between special strings, and for each text the ids between its stretches."""
    if not special:
        return texts, [[] for _ in texts]
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
    parts = [pattern.split(t) if any(s in t for s in special) else [t] for t in texts]
    return [x for p in parts for x in p[::2]], [[special[x] for x in p[1::2]] for p in parts]


def count_tokens(texts: list[str], lexicon: Counts) -> list[int]:
    """Number of tokens of every text."""
    stretches, between = split_special(texts, lexicon.special)
    found, each = pieces(stretches)
    sums = np.append(0, np.cumsum(np.array(lexicon.look(found), np.int64)))
    last = np.cumsum(each)
    per_stretch = sums[last] - sums[last - each]
    out, k = [], 0
    for ids in between:
        out.append(int(per_stretch[k : k + len(ids) + 1].sum()) + len(ids))
        k += len(ids) + 1
    return out


def encode(texts: list[str], lexicon: Lexicon) -> list[bytes]:
    """Token ids of every text, as little-endian 16-bit bytes."""
    stretches, between = split_special(texts, lexicon.special)
    found, each = pieces(stretches)
    emitted, each, out, k, at = lexicon.look(found), each.tolist(), [], 0, 0
    for ids in between:
        parts = []
        for i in range(len(ids) + 1):
            parts += emitted[at : at + each[k]]
            at, k = at + each[k], k + 1
            if i < len(ids):
                parts.append(np.uint16(ids[i]).tobytes())
        out.append(b"".join(parts))
    return out


def slices(texts: list[str | None], chars: int = 500_000):
    """Runs of a batch's texts with a bounded number of characters (a longer text is a run of its own)."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held > chars or i + 1 == len(texts):
            yield first, [t or "" for t in texts[first : i + 1]]
            first, held = i + 1, 0


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row; a null text counts as empty."""
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {frame.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def run(parts):
        lexicon = lexicon_of(Counts, tokenizer)
        for part in parts:
            texts = part.column(1).to_pylist()
            counts = [n for _, run_ in slices(texts) for n in count_tokens(run_, lexicon)]
            sizes = pc.fill_null(pc.binary_length(part.column(1).cast(pa.large_binary())), 0)
            yield pa.RecordBatch.from_arrays([part.column(0), sizes.cast(pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return frame.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
