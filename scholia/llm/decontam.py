"""Benchmark decontamination with suffix arrays over the training text.

Every Arrow batch of documents is dealt into shards of bounded size; a long text
is cut into several, which overlap by a window less one word. A shard's words
become integer ids of the benchmark's vocabulary (0: a word that no item has).
Suffixes that start a run of known words long enough for the shortest window are
sorted by their first ``window`` words: that is the shard's suffix array, without
the suffixes that cannot match. All benchmark windows are then binary-searched in
it; ranges of the array are occurrences. Occurrences at consecutive places of the
text and of an item are one verbatim match: the longest, its place and its item
are reported (on ties the first place, then the least id as text, null last).

There is no shuffle: documents stream through one Arrow function. The benchmark
is sent in blocks of at most ``block_words`` words (an item that is longer is a
block of its own). A worker holds one block's index and one shard: where there are
several blocks, the rows are written to the checkpoint folder between them, and
hit spans merge on the rows themselves, without a join.

Defined results for odd input: null and word-less documents have no words and
no hits; null and word-less items have no windows; an item of fewer than
``window`` words is one window; repeated items count each under its id (rows
with one id count once); items without an id give hits and count as one item, but
have no name in the list of items; repeated documents give a row each; no other
columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import fresh, materialise, own_columns, small_batches

#: Bytes of words in lower case, everything else a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

WINDOW = 10
#: Words of the benchmark that one pass holds.
BLOCK_WORDS = 500_000
#: Words of a shard whose suffixes are sorted together.
SHARD_WORDS = 250_000
#: Bytes of a text whose words are split at a time.
_SPLIT_BYTES = 1 << 20
#: What is known of one document so far, as the passes hand it on.
STATE = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>,unnamed:boolean,longest:int,longest_at:int,longest_item:string>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Index:
    """Windows of a block of items, ready for binary search; bounded by the block.

    Words of items have running numbers, with a number left out between two
    items; ``places`` has the numbers where a window begins.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [k for k, _ in items]
        rows, places, lengths, at = [], [], [], 0
        starts = []
        for _, item in items:
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item], dtype=np.int64)
            n = min(len(own), window)
            if n:
                part = np.zeros((len(own) - n + 1, window), dtype=np.int64)
                part[:, :n] = np.lib.stride_tricks.sliding_window_view(own, n)
                rows.append(part)
                places.append(at + np.arange(len(part)))
                lengths.append(np.full(len(part), n, dtype=np.int64))
            starts.append(at)
            at += len(own) + 1
        self.starts = np.array(starts, dtype=np.int64)
        matrix = np.concatenate(rows) if rows else np.zeros((0, window), dtype=np.int64)
        low, first, of = np.unique(_keys(matrix), return_index=True, return_inverse=True)
        matrix = matrix[first]
        self.lengths = (matrix > 0).sum(axis=1)
        self.least = int(self.lengths.min()) if len(first) else 0
        self.low = low
        self.high = _keys(np.where(matrix > 0, matrix, len(self.vocabulary) + 1))
        order = np.argsort(of, kind="stable")
        self.places = (np.concatenate(places) if places else np.zeros(0, dtype=np.int64))[order]
        self.cut = np.searchsorted(of[order], np.arange(len(first) + 1))

    def begins(self, pattern: int) -> list[int]:
        return self.places[self.cut[pattern] : self.cut[pattern + 1]].tolist()

    def items_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings of the same order, without zero bytes."""
    n, m = matrix.shape
    digits = np.empty((n, m, 4), dtype=np.uint8)
    rest = matrix
    for k in (3, 2, 1, 0):
        digits[:, :, k] = rest % 255 + 1
        rest = rest // 255
    return digits.reshape(n, 4 * m).view(f"S{4 * m}").ravel()


def _search(index: Index, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, pattern) of all occurrences in a shard; ``bounds``: where its documents end."""
    none = np.empty(0, dtype=np.int64)
    if not len(index.low) or not len(ids):
        return none, none
    # The length of the run of known words from each position, not beyond its document.
    here = np.arange(len(ids))
    stops = np.r_[np.flatnonzero(ids == 0), len(ids)]
    run = np.minimum(stops[np.searchsorted(stops, here)], bounds[np.searchsorted(bounds, here, "right")]) - here
    at = np.flatnonzero(run >= index.least)
    if not len(at):
        return none, none
    offsets = np.arange(index.window)
    rows = np.where(offsets < np.minimum(run[at], index.window)[:, None], ids[np.minimum(at[:, None] + offsets, len(ids) - 1)], 0)
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    array, at = keys[order], at[order]
    lo, hi = np.searchsorted(array, index.low, "left"), np.searchsorted(array, index.high, "right")
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none, none
    counts = (hi - lo)[found]
    pattern = np.repeat(found, counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[found], counts)
    return at[place], pattern


def _longest(index: Index, at: np.ndarray, pattern: np.ndarray) -> tuple[int, int, str | None]:
    """(words, place, item) of the longest verbatim match; ``at`` increases.

    Beside every place of an item that the last word's windows begin at stands
    where its match began: memory is that of one window's places.
    """
    best, known = (0, 0, False, None), {}
    before, now, previous = {}, {}, -2
    for place, p in zip(at.tolist(), pattern.tolist(), strict=True):
        if place != previous:
            before, now, previous = (now if place == previous + 1 else {}), {}, place
        if p not in known:
            if len(known) > 10_000:
                known.clear()
            known[p] = index.begins(p)
        end = place + int(index.lengths[p])
        for g in known[p]:
            start = now[g] = min(before.get(g - 1, place), now.get(g, place))
            if end - start >= best[0]:
                k = index.ids[int(index.items_at(np.int64(g)))]
                rank = (start - end, start, k is None, k or "")
                if not best[0] or rank < (-best[0], *best[1:3], best[3] or ""):
                    best = (end - start, start, k is None, k)
    return best[0], best[1], best[3]


def _document(index: Index, at: np.ndarray, pattern: np.ndarray) -> tuple[list[int], list[int], set[str | None], int, int, str | None]:
    """Merged hit spans, items and the longest match of one document."""
    order = np.argsort(at, kind="stable")
    at, pattern = at[order], pattern[order]
    upto = np.maximum.accumulate(at + index.lengths[pattern])
    first = np.flatnonzero(np.r_[True, at[1:] > upto[:-1]])
    spans = at[first].tolist(), upto[np.r_[first[1:] - 1, len(at) - 1]].tolist()
    items: set[int] = set()
    for p in np.unique(pattern).tolist():
        items.update(np.unique(index.items_at(index.places[index.cut[p] : index.cut[p + 1]])).tolist())
    return *spans, {index.ids[i] for i in items}, *_longest(index, at, pattern)


def _ids(text: bytes | None, get) -> np.ndarray:
    """The ids of a text's words; its words are split a part at a time."""
    low, out, a = (text or b"").translate(_WORDS), [], 0
    while a < len(low):
        b = low.find(b" ", a + _SPLIT_BYTES)
        b = len(low) if b < 0 else b
        part = low[a:b].split()
        out.append(np.fromiter((get(w, 0) for w in part), dtype=np.int32, count=len(part)))
        a = b
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def _found(index: Index, shard: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Occurrences in each document of a shard."""
    bounds = np.cumsum([len(x) for x in shard])
    at, pattern = _search(index, np.concatenate(shard).astype(np.int64), bounds)
    document = np.searchsorted(bounds, at, "right")
    order = np.argsort(document, kind="stable")
    at, pattern, cut = at[order], pattern[order], np.searchsorted(document[order], np.arange(len(shard) + 1))
    return [(at[cut[n] : cut[n + 1]] - (bounds[n] - len(x)), pattern[cut[n] : cut[n + 1]]) for n, x in enumerate(shard)]


def scan(index: Index, texts: Iterable[bytes | None], shard_words: int = SHARD_WORDS) -> Iterator[tuple[int, tuple | None]]:
    """(number of words, what ``_document`` gives or None) for each text, in order."""

    def results(shard: list[np.ndarray]) -> Iterator[tuple[int, tuple | None]]:
        for own, (at, pattern) in zip(shard, _found(index, shard) if shard else [], strict=True):
            yield len(own), _document(index, at, pattern) if len(at) else None

    shard, total = [], 0
    for text in texts:
        own = _ids(text, index.vocabulary.get)
        if total + len(own) > shard_words and shard:
            yield from results(shard)
            shard, total = [], 0
        if len(own) <= shard_words:
            shard.append(own)
            total += len(own)
            continue
        ats, patterns = [], []
        for a in range(0, len(own), shard_words):
            at, pattern = _found(index, [own[a : a + shard_words + index.window - 1]])[0]
            mine = at < shard_words  # a start beyond is the next part's
            ats.append(at[mine] + a)
            patterns.append(pattern[mine])
        at, pattern = np.concatenate(ats), np.concatenate(patterns)
        yield len(own), _document(index, at, pattern) if len(at) else None
    yield from results(shard)


_NOTHING = {"n_words": 0, "starts": [], "ends": [], "items": [], "unnamed": False, "longest": 0, "longest_at": 0, "longest_item": None}


def merged(old: dict, new: tuple | None) -> dict:
    if new is None:
        return old
    starts, ends, items, *longest = new
    spans = sorted([*zip(old["starts"], old["ends"], strict=True), *zip(starts, ends, strict=True)])
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    rank = lambda n, at, item: (-n, at, item is None, item or "")
    n, at, item = min(longest, [old[k] for k in ("longest", "longest_at", "longest_item")], key=lambda x: rank(*x))
    return {
        "n_words": old["n_words"], "starts": [a for a, _ in out], "ends": [b for _, b in out], "items": sorted({*old["items"], *items} - {None}),
        "unnamed": old["unnamed"] or None in items, "longest": n, "longest_at": at, "longest_item": item,
    }


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark's items, in blocks of bounded size, streamed through the driver."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("k"), F.encode(F.col(text_col), "UTF-8").alias("t")).filter("t is not null")
    block: list[tuple[str | None, list[bytes]]] = []
    held = 0
    for row in rows.toLocalIterator():
        own = words(bytes(row.t))
        if held and held + len(own) > block_words:
            yield block
            block, held = [], 0
        if own:
            block.append((row.k, own))
            held += len(own)
    yield block


def _passes(shared):
    """The Arrow functions of a block's pass: the first one, and one that merges."""
    held: list[Index] = []

    def hits(texts: pa.Array, olds: pa.Array | None) -> pa.Array:
        if not held:
            held.append(pickle.loads(zlib.decompress(shared.value)))
        out = []
        each = (t.as_py() for t in texts.cast(pa.binary()))
        for i, (n_words, found) in enumerate(scan(held[0], each)):
            old = olds[i].as_py() if olds is not None else {**_NOTHING, "n_words": n_words}
            out.append(merged(old, found))
        return pa.array(out, type=_state_type())

    def first(texts: pa.Array) -> pa.Array:
        return hits(texts, None)

    def later(texts: pa.Array, olds: pa.Array) -> pa.Array:
        return hits(texts, olds)

    return first, later


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", state: str = "__hits", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a ``STATE`` column of hit spans, items and the longest match."""
    small_batches(docs)
    context = docs.sparkSession.sparkContext
    for n, block in enumerate(blocks(benchmark, block_words=block_words)):
        # Rows of one id are items of their own here and meet in the set of ids.
        packed = zlib.compress(pickle.dumps(Index(block, window)), 1)
        shared = context.broadcast(packed)  # bounded by block_words
        first, later = _passes(shared)
        if n:
            # A stage holds one block's index.
            docs = materialise(docs)
        column = F.arrow_udf(later, STATE)(F.col(text_col), F.col(state)) if n else F.arrow_udf(first, STATE)(F.col(text_col))
        docs = docs.withColumn(state, column)
    return docs


def _state_type() -> pa.DataType:
    return pa.struct(
        [("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("unnamed", pa.bool_()), ("longest", pa.int32()), ("longest_at", pa.int32()), ("longest_item", pa.string())]
    )


def n_hit(state: Column) -> Column:
    return F.aggregate(F.zip_with(state["ends"], state["starts"], lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: words, hit words, items, the longest match."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    hits = with_hits(rows, benchmark, "__text").select("doc_id", "__hits")
    state = F.col("__hits")
    return hits.select(
        "doc_id",
        state["n_words"].alias("n_words"),
        n_hit(state).alias("n_hit"),
        (F.size(state["items"]) + state["unnamed"].cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join(state["items"], ","), 256).alias("items_sha256"),
        (F.size(state["starts"]) > 0).alias("contaminated"),
        state["longest"].cast("long").alias("longest_match"),
        F.when(state["longest"] > 0, state["longest_at"].cast("long")).alias("longest_at"),
        state["longest_item"].alias("longest_item"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with their own columns only."""
    name = fresh("__hits", docs)
    return with_hits(docs, benchmark, text_col, name).filter(F.size(F.col(name)["starts"]) == 0).select(*own_columns(docs))
