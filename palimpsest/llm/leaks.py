"""Evaluation texts leaking into a corpus, wholly or in part.

Items are cut into windows of ``window`` words, the size of the passages to be
found, documents into windows of a few words less or more, as words may be left
out or added.  Equal windows are one from here on, so a passage that a third of
all documents hold is worked off once.

A window's words walk through a CGK embedding: at each step the current word is
written and, by a hashed coin of (step, word), the walk stays or moves on;
equal coins for all windows turn few edits into few differing places.  Windows
meet by keys over sampled places, in as many repetitions as the target recall
needs, each with a walk of its own, and every meeting is verified by the exact
edit distance.  Places are sampled before the walk ends, and a repetition in
which a window's places hold too few different words gives it no key: neither
padding nor one frequent word can key a window.  Equal windows have equal
walks, so what differs by no edit is always found.

A filter without loss goes first: an edit spoils at most two neighbouring word
pairs, so a document window with more than 2 * edits pairs that no item has
cannot be near any.  The pairs of all items sit in a bitmap sized from their
number, 2^20 to 2^24 bits (2 MB at most), the only thing that is broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.shingles import GOLD, U, mix, word_hashes
from palimpsest.sources.tables import stage

#: Words are runs of these; a parameter of ``leaks``.
WORD = r"[a-z0-9]+"
#: A bitmap has about this many cells a word pair of the items, within 2^20 and 2^24.
CELLS_A_PAIR, LEAST_BITS, MOST_BITS = 64, 20, 24
SAMPLED = 6
#: Different words a window's sampled places must hold.
LEAST_DIFFERENT = 3
#: Places that an edit sets apart, on average, of those before the walk ends.
APART = 4
#: Texts are worked off in blocks of about this many characters.
BLOCK_CHARS = 1 << 19
_END = U(0x1F83D9ABFB41BD6B)


def words_of(text: str | None, word: str = WORD) -> list[str]:
    """The longest runs of ``word`` in the lower-cased text, by default of a-z and 0-9; null gives none."""
    return re.findall(word, text.lower()) if text else []


def walked(window: int) -> int:
    """Steps of a walk that are sampled: few enough that a walk of ``window`` words seldom ends within them."""
    return max(SAMPLED, int(1.8 * window))


def cgk(windows: np.ndarray, steps: int | None = None, seed: int = 3) -> np.ndarray:
    """The embedding of each row of word hashes in ``steps`` places, by default three times as long as the row."""
    n, size = windows.shape
    padded = np.concatenate((windows, np.full((n, 1), _END)), axis=1)
    steps = 3 * size if steps is None else steps
    rows, at = np.arange(n), np.zeros(n, np.int64)
    out = np.empty((n, steps), U)
    for step in range(steps):
        word = padded[rows, at]
        out[:, step] = word
        coin = mix(word ^ U((step + 1) * 0x9E3779B97F4A7C15 + seed & (2**64 - 1))) >> U(63)
        at = np.minimum(at + coin.astype(np.int64), size)
    return out


def repetitions(window: int, max_edits: int, recall: float) -> int:
    """Repetitions that let a window at ``max_edits`` edits meet its item with probability ``recall``.

    An edit shifts the walk until it meets again, which sets about ``APART`` of
    the sampled steps apart.  Without edits one repetition would find all.
    """
    if not max_edits:
        return 1
    meet = (1 - min(0.9, APART * max_edits / walked(window))) ** SAMPLED
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def sampled_keys(windows: np.ndarray, steps: int, reps: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(key per window and repetition, whether it counts), over places sampled anew in each repetition from a walk of its own."""
    draw = np.random.default_rng(seed)
    keys = np.empty((len(windows), reps), U)
    counts = np.empty((len(windows), reps), bool)
    with np.errstate(over="ignore"):
        for r in range(reps):
            picked = cgk(windows, steps, 3 + r * 0xD1B54A32D192ED03)[:, np.sort(draw.choice(steps, SAMPLED, replace=False))]
            acc = np.full(len(windows), U(r + 1) * GOLD)
            for place in range(SAMPLED):
                acc = mix(acc + picked[:, place])
            keys[:, r] = acc
            ordered = np.sort(picked, axis=1)
            counts[:, r] = (ordered[:, 1:] != ordered[:, :-1]).sum(axis=1) + 1 >= LEAST_DIFFERENT
    # a window of few different words has to meet by what it has
    counts[~counts.any(axis=1)] = True
    return keys, counts


def _pair_cells(flat: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap cell of each word with the word after it (the last has none)."""
    with np.errstate(over="ignore"):
        return (mix(flat[:-1] * GOLD + flat[1:]) >> U(64 - bits)).astype(np.int64)


def _names(windows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        name = np.full(len(windows), U(windows.shape[1]) * GOLD)
        for place in range(windows.shape[1]):
            name = mix(name + windows[:, place])
    return name


def _windows(flat: np.ndarray, at: np.ndarray, window: int, strange: np.ndarray | None, max_edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, name, word hashes) of every different window of a text that may be near an item."""
    sizes = np.diff(at)
    full = np.maximum(sizes - window + 1, 0)
    total = int(full.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros((0, window), U)
    owner = np.repeat(np.arange(len(sizes)), full)
    begin = np.repeat(at[:-1], full) + np.arange(total) - np.repeat(np.cumsum(full) - full, full)
    if strange is not None:
        keep = strange[begin + window - 1] - strange[begin] <= 2 * max_edits
        owner, begin = owner[keep], begin[keep]
    found = flat[begin[:, None] + np.arange(window)]
    name = _names(found)
    with np.errstate(over="ignore"):
        _, first = np.unique(mix(name + (owner.astype(U) + U(1)) * GOLD), return_index=True)
    return owner[first], name[first], found[first]


_WINDOWS = "id bigint, name bigint, words array<bigint>"


def _windowed(sizes: range, max_edits: int, word: str, bits: int, bitmap):
    """Rows (id, name, words) of the different windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for b in batches:
            ids, texts = b["_id"].to_numpy(zero_copy_only=False), b["_text"].to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and chars < BLOCK_CHARS:
                    chars += len(texts[hi] or "")
                    hi += 1
                flat, at = word_hashes([words_of(t, word) for t in texts[lo:hi]])
                strange = None
                if known is not None:
                    strange = np.concatenate(([0], np.cumsum(~known[_pair_cells(flat, bits)]))) if len(flat) > 1 else np.zeros(1, np.int64)
                for window in sizes:
                    owner, name, win = _windows(flat, at, window, strange, max_edits)
                    if len(owner):
                        words = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32) * window), pa.array(win.reshape(-1).view(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][owner], pa.int64()), pa.array(name.view(np.int64)), words], ["id", "name", "words"])
                lo = hi

    return run


def _keyed(steps: int, reps: int):
    """Rows (key, name) of different windows; windows of one length at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, lists = b["name"].to_numpy(zero_copy_only=False), b["words"]
            size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(U)
            at = np.concatenate(([0], np.cumsum(size)))
            for window in np.unique(size).tolist():
                rows = np.flatnonzero(size == window)
                keys, counts = sampled_keys(flat[at[rows][:, None] + np.arange(window)], steps, reps)
                which, _ = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(keys[counts].view(np.int64)), pa.array(names[rows][which])], ["key", "name"])

    return run


def _pairs_of_items(word: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [np.zeros(0, np.int64)]
            for t in b["_text"].to_pylist():
                flat, _ = word_hashes([words_of(t, word)])
                if len(flat) > 1:
                    cells.append(_pair_cells(flat, bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(cells)))], ["cell"])

    return run


#: A bucket of Spark's bitmap aggregates.
_BUCKET = 8 * 4096


def _bitmap(item_rows: DataFrame, word: str) -> tuple[int, bytes]:
    """(bits, bitmap of the items' word pairs).  At most 2 MB reach the driver, whatever the number of items."""
    chars = item_rows.agg(F.sum(F.length("_text"))).first()[0] or 0  # no more words than half the characters
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(CELLS_A_PAIR * (chars / 4 + 1)))))
    cells = item_rows.mapInArrow(_pairs_of_items(word, bits), "cell bigint")
    # Spark's buckets and places count from one
    made = cells.select((F.col("cell") + 1).alias("c")).groupBy(F.expr("bitmap_bucket_number(c)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c))").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in made.toLocalIterator():
        at = (row.bucket - 1) * (_BUCKET // 8)
        out[at : at + _BUCKET // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits, out.tobytes()


def edits(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Insertions, deletions and substitutions between the rows of two arrays of words, all pairs at once; ``most + 1`` stands for more.

    Only places within ``most`` of the diagonal can count.
    """
    n, la, lb = len(a), a.shape[1], b.shape[1]
    if abs(la - lb) > most:
        return np.full(n, most + 1)
    far = most + 1
    row = np.broadcast_to(np.minimum(np.arange(lb + 1), far), (n, lb + 1)).astype(np.int64)
    for i in range(1, la + 1):
        nxt = np.full((n, lb + 1), far)
        if i <= most:
            nxt[:, 0] = i
        for j in range(max(1, i - most), min(lb, i + most) + 1):
            best = row[:, j - 1] + (a[:, i - 1] != b[:, j - 1])
            best = np.minimum(best, row[:, j] + 1)
            nxt[:, j] = np.minimum(np.minimum(best, nxt[:, j - 1] + 1), far)
        row = nxt
    return row[:, lb]


def within_edits(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether two word sequences are at most ``most`` insertions, deletions and substitutions apart."""
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a.tolist(), 1):
        nxt = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        left = i
        out = [i]
        for v in nxt.tolist():
            left = min(v, left + 1)
            out.append(left)
        row = np.array(out)
        if row.min() > most:
            return False
    return int(row[-1]) <= most


def _verified(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pa.compute.list_value_length(b["words"]).to_numpy(zero_copy_only=False)
            flat, other = (b[c].flatten().to_numpy(zero_copy_only=False) for c in ("words", "item_words"))
            at = np.concatenate(([0], np.cumsum(size)))
            theirs = other.reshape(b.num_rows, -1) if b.num_rows else other.reshape(0, 0)
            apart = np.full(b.num_rows, most + 1)
            for window in np.unique(size).tolist():
                rows = np.flatnonzero(size == window)
                apart[rows] = edits(flat[at[rows][:, None] + np.arange(window)], theirs[rows], most)
            near = pa.array(apart <= most)
            yield pa.RecordBatch.from_arrays([b["name"].filter(near), b["item_name"].filter(near), pa.array(apart[apart <= most].astype(np.int32))], ["name", "item_name", "edits"])

    return run


def near_leaks(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = 10, max_edits: int = 1, recall: float = 0.999, word: str = WORD
) -> DataFrame:
    """(doc_id, item_id, edits), each pair once: documents holding a window of the item's words, and the fewest edits it takes.

    An edit is a word added, left out or changed.  Null and empty texts, rows
    without an id, items under ``window`` words and documents under
    ``window - max_edits`` hold no window.  Items that share words each count.
    Windows at no edit are all found, others with probability ``recall`` or more
    per window, documents with several near windows accordingly surer.
    """
    item_rows = items.selectExpr(f"CAST(`{item_id}` AS BIGINT) AS _id", f"`{item_text}` AS _text").filter("_id IS NOT NULL")
    doc_rows = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS _id", f"`{text}` AS _text").filter(F.col("_id").isNotNull() & (F.length("_text") > 0))
    bits, cells = _bitmap(item_rows, word)
    bitmap = docs.sparkSession.sparkContext.broadcast(cells)
    sizes, steps, reps = range(max(1, window - max_edits), window + max_edits + 1), walked(window), repetitions(window, max_edits, recall)
    left = stage(doc_rows.mapInArrow(_windowed(sizes, max_edits, word, bits, bitmap), _WINDOWS), "document-windows")
    right = stage(item_rows.mapInArrow(_windowed(range(window, window + 1), 0, word, bits, None), _WINDOWS), "item-windows")
    ours, theirs = (x.dropDuplicates(["name"]).select("name", "words") for x in (left, right))
    keys = lambda x, name: x.mapInArrow(_keyed(steps, reps), "key bigint, name bigint").withColumnRenamed("name", name)
    met = keys(ours, "name").join(keys(theirs, "item_name"), "key").select("name", "item_name").distinct()
    told = met.join(ours, "name").join(theirs.select(F.col("name").alias("item_name"), F.col("words").alias("item_words")), "item_name")
    near = told.select("name", "item_name", "words", "item_words").mapInArrow(_verified(max_edits), "name bigint, item_name bigint, edits int")
    held = left.select(F.col("id").alias("doc_id"), "name").distinct()
    of_item = right.select(F.col("id").alias("item_id"), F.col("name").alias("item_name")).distinct()
    # windows are named by 64-bit hashes of their words
    by_window = near.join(of_item, "item_name").groupBy("name", "item_id").agg(F.min("edits").alias("edits"))
    return held.join(by_window, "name").groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def leaks(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = 10, max_edits: int = 0, recall: float = 0.999, word: str = WORD
) -> DataFrame:
    """(doc_id, item_id), each once: documents holding a window of the item's words within ``max_edits`` words added, left out or changed.

    The search always allows for an edit; with ``max_edits`` 0 only windows that
    turn out to be equal word for word are kept, of which none is missed.
    Nulls and short texts as in ``near_leaks``.
    """
    found = near_leaks(docs, doc_id, text, items, item_id, item_text, window, max(1, max_edits), recall, word)
    return found.filter(F.col("edits") <= max_edits).select("doc_id", "item_id")
