"""Encoding of texts with a byte-level BPE vocabulary, without a regular expression.

The vocabulary's pre-tokenisation pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
is run as a finite automaton over classes of characters (letters, numbers,
others, the blank, further white space, the apostrophe, and the letters that
contractions are made of).  A character is a function from states to states;
such functions compose associatively, so the state after every character of a
block comes from a scan: the functions of equal places of many chunks are
composed at once, then the chunks' functions one after the other, then every
chunk is run from the state it begins in.  Where slices begin follows from the
states of neighbours.

Slices between boundaries are hashed in arrays; each different slice of a
block is merged once, and a cache keeps merged slices across blocks.  Where
each token ends in its text's bytes can be kept beside the ids.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.functions.shingles import GOLD, U, mix

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Classes of characters; of the letters, those that end a contraction or begin one of two letters stand apart.
OTHER, LETTER, NUMBER, BLANK, WHITE, APOSTROPHE, ENDS, R, V, L, E = range(11)
# Unicode white space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: States: what the last character was part of.  In AFTER_* an apostrophe and that letter began a slice and may yet be a contraction.
START, WORD, DIGITS, MARKS, ONE_BLANK, SPACE, QUOTE, DONE, AFTER_R, AFTER_V, AFTER_L = range(11)
STATES = 11
#: Characters worked off at once; the arrays of a block stay in the processor's cache.
BLOCK_CHARS = 1 << 17
#: Characters of a chunk of the scan.
CHUNK = 128
CACHE_SLICES = 300_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    first = {"L": LETTER, "N": NUMBER}
    for cp in range(0x323B0):  # letters and numbers end here, but for none
        table[cp] = first.get(unicodedata.category(chr(cp))[0], OTHER)
    for ch in WHITE_SPACE:
        table[ord(ch)] = WHITE
    table[0x20] = BLANK
    for ch, cls in zip("'stmdrvle", (APOSTROPHE, ENDS, ENDS, ENDS, ENDS, R, V, L, E), strict=True):
        table[ord(ch)] = cls
    return table


@lru_cache(maxsize=1)
def transitions() -> np.ndarray:
    """The state after a character, by class and by state before it."""
    after = np.empty((11, STATES), np.uint8)
    for cls in range(11):
        for state in range(STATES):
            to = {OTHER: MARKS, NUMBER: DIGITS, BLANK: ONE_BLANK, WHITE: SPACE}.get(cls, WORD)
            if cls == APOSTROPHE:  # part of marks that began, with or without a blank before them
                to = MARKS if state in (MARKS, ONE_BLANK, QUOTE) else QUOTE
            elif state == QUOTE:
                to = {ENDS: DONE, R: AFTER_R, V: AFTER_V, L: AFTER_L}.get(cls, to)
            elif (state, cls) in ((AFTER_R, E), (AFTER_V, E), (AFTER_L, L)):
                to = DONE
            after[cls, state] = to
    return after


def states(code: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """The state after each character, by composing transition functions; every text begins in ``START``."""
    n = len(code)
    table = transitions()
    # a text's first character leads from any state to where it leads from START: one more class each
    constant = np.repeat(table[:, START][:, None], STATES, axis=1)
    functions = np.concatenate((table, constant))
    cls = classes()[code]
    cls[doc_start] += 11
    chunks = -(-n // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:n] = cls
    by_place = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    flat = functions.reshape(-1)
    # every chunk's function: for each state it may begin in, the state it ends in
    composed = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for place in by_place:
        composed = flat[(place.astype(np.int32) * STATES)[:, None] + composed]
    begins = np.empty(chunks, np.uint8)
    state = START
    for i in range(chunks):
        begins[i] = state
        state = composed[i, state]
    out = np.empty((CHUNK, chunks), np.uint8)
    now = begins
    for k, place in enumerate(by_place):
        now = flat[place.astype(np.int32) * STATES + now]
        out[k] = now
    return out.T.reshape(-1)[:n]


def boundaries(code: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each character.  ``doc_start``: places (not beyond the end) where a text begins."""
    n = len(code)
    if not n:
        return np.zeros(0, bool)
    now = states(code, doc_start)
    before = np.empty_like(now)
    before[0], before[1:] = START, now[:-1]
    before[doc_start] = START
    last = np.zeros(n, bool)
    last[-1] = True
    last[doc_start[doc_start > 0] - 1] = True
    after = np.empty_like(now)
    after[-1], after[:-1] = START, now[1:]
    # the kind of the run that a character stands in
    kind = np.array([START, WORD, DIGITS, MARKS, ONE_BLANK, ONE_BLANK, MARKS, DONE, WORD, WORD, WORD], np.uint8)
    run, run_before = kind[now], kind[before]
    white = run == ONE_BLANK
    start = run != run_before
    start &= before != ONE_BLANK  # a blank belongs to what follows it
    start |= now == QUOTE
    # a letter after an apostrophe that turns out to be no contraction begins a word; what completes one does not
    done = now == DONE
    start[done] = False
    tentative = (now >= AFTER_R) & (now <= AFTER_L)
    start[tentative] = last[tentative] | (after[tentative] != DONE)
    start |= (before == DONE) & ~white
    # of white space, all but the last character before a text stay together
    inner = white & ((before == ONE_BLANK) | (before == SPACE))
    ends = ~last & (kind[after] != ONE_BLANK)
    start = np.where(white, ~inner | ends, start)
    start[doc_start] = True
    return start


class Merger:
    """Slices as token ids: the pair of least rank is merged first, until no pair is in the vocabulary.  The cache is emptied when full."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            self._ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._bytes = {rank: raw for raw, rank in self._ranks.items()}
        self.sizes = np.zeros(max(self._bytes) + 1, np.int32)
        for rank, raw in self._bytes.items():
            self.sizes[rank] = len(raw)
        self._known: dict[str, tuple[int, ...]] = {}

    def __call__(self, piece: str) -> tuple[int, ...]:
        ids = self._known.get(piece)
        if ids is None:
            raw = piece.encode()
            one = self._ranks.get(raw)
            ids = (one,) if one is not None else self._merged(raw)
            if len(self._known) >= CACHE_SLICES:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def _merged(self, raw: bytes) -> tuple[int, ...]:
        """Parts are linked by where they end; a heap holds the ranks of neighbours, and an entry whose parts have changed is passed over."""
        rank, n = self._ranks.get, len(raw)
        end = list(range(1, n + 1)) + [n]  # of the part that begins at a place, 0 once it was merged away
        begin = [-1, *range(n)]  # of the part before the one that begins at a place
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                begin[stop] = i
                r = rank(raw[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            left = begin[i]
            if left >= 0:
                r = rank(raw[left:stop])
                if r is not None:
                    heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(self._ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merger(vocabulary: str) -> Merger:
    return Merger(vocabulary)


def encode_block(texts: list[str], merge: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, ids per text, slice starts in characters of the joined texts, ids per slice)."""
    whole = "".join(texts)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.cumsum(sizes) - sizes
    if not len(code):
        none = np.zeros(0, np.int64)
        return none.astype(np.int32), np.zeros(len(texts), np.int64), none, none
    starts = np.flatnonzero(boundaries(code, np.unique(at[sizes > 0])))
    ends = np.append(starts[1:], len(code))
    with np.errstate(over="ignore"):
        place = np.arange(len(code)) - np.repeat(starts, ends - starts)
        names = np.add.reduceat(mix(code.astype(U) * GOLD + place.astype(U)), starts) + (ends - starts).astype(U)
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    merged = [merge(whole[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    count = np.fromiter(map(len, merged), np.int64, len(merged))
    flat = np.fromiter((i for ids in merged for i in ids), np.int32, int(count.sum()))
    base = np.cumsum(count) - count
    per_slice = count[which]
    shift = np.cumsum(per_slice) - per_slice
    ids = flat[np.repeat(base[which] - shift, per_slice) + np.arange(int(per_slice.sum()))]
    owner = np.searchsorted(at[sizes > 0], starts, "right") - 1
    per_text = np.zeros(len(texts), np.int64)
    per_text[np.flatnonzero(sizes > 0)] = np.bincount(owner, weights=per_slice, minlength=int((sizes > 0).sum())).astype(np.int64)
    return ids, per_text, starts, per_slice


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, chars = [], 0
    for t in texts:
        block.append(t)
        chars += len(t)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def encode(texts: list[str | None], vocabulary: str = DEFAULT_VOCABULARY) -> list[list[int]]:
    """Token ids of each text, without special tokens.  Null and empty texts give an empty list."""
    merge, out = merger(vocabulary), []
    for block in _blocks([t or "" for t in texts]):
        ids, per_text, _, _ = encode_block(block, merge)
        cut = np.cumsum(per_text)[:-1]
        out += [x.tolist() for x in np.split(ids, cut)]
    return out


def encode_offsets(text: str, vocabulary: str = DEFAULT_VOCABULARY) -> list[tuple[int, int, tuple[int, ...]]]:
    """(first character, character after the last, ids) of each slice: what decoding a part of a text needs."""
    ids, _, starts, per_slice = encode_block([text], merger(vocabulary))
    ends = [*starts[1:].tolist(), len(text)]
    stop = np.cumsum(per_slice)
    return [(a, b, tuple(ids[s - k : s].tolist())) for a, b, s, k in zip(starts.tolist(), ends, stop.tolist(), per_slice.tolist(), strict=True)]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, offsets: bool = False) -> DataFrame:
    """(key, ids) of every row, with ``offsets`` also (ends): the byte of the text after each token, so that any range of tokens decodes to a known part.

    A map over partitions: no shuffle, memory bounded by a block and the cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(vocabulary)
        for b in batches:
            texts = [t or "" for t in b["_text"].to_pylist()]
            ids, per_text = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for block in _blocks(texts):
                x, n, _, _ = encode_block(block, merge)
                ids.append(x)
                per_text.append(n)
            flat, counts = np.concatenate(ids), np.concatenate(per_text)
            at = np.concatenate(([0], np.cumsum(counts)))
            places = pa.array(at.astype(np.int32))
            columns = [b["_key"], pa.ListArray.from_arrays(places, pa.array(flat))]
            if offsets:
                ends = np.concatenate(([0], np.cumsum(merge.sizes[flat], dtype=np.int64)))
                own = (ends[1:] - np.repeat(ends[at[:-1]], counts)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(places, pa.array(own)))
            yield pa.RecordBatch.from_arrays(columns, ["_key", "ids", "ends"][: len(columns)])

    kind = df.schema[key].dataType.simpleString()
    made = f"_key {kind}, ids array<int>" + (", ends array<int>" if offsets else "")
    return df.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text").mapInArrow(run, made).withColumnRenamed("_key", key)


def decode_column(df: DataFrame, key: str, ids: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text) back from token ids; a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(vocabulary)
        for b in batches:
            texts = [None if x is None else merge.decode(x) for x in b["_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(texts, pa.string())], ["_key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS _key", f"`{ids}` AS _ids").mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)
