"""Repeated passages by sparse suffix arrays.

A passage is repeated if ``LENGTH`` consecutive words of it stand at two places
or more, in one document or in several. Only some suffixes are kept:

1. The first ``PREFIX`` words of a suffix have a rolling 64-bit hash, its key.
   Of the ``LENGTH - PREFIX + 1`` suffixes that begin in a stretch of ``LENGTH``
   words and have their prefix inside it, the one with the least key is kept
   (the left-most on ties). The choice depends on content alone, so equal
   stretches keep equal suffixes: no repeat is missed, and about 2 suffixes in
   27 are kept.
2. The stretches that chose a suffix are its possible extensions, by 0 to
   ``LENGTH - PREFIX`` words to the left and the rest to the right. Suffixes with
   one key and equal extensions are one class.
3. Each task sorts the keys of its batch and collapses equal neighbours to the
   key, its count and its least and greatest class; grouped sums merge those
   arrays. Keys that occur once can start no repeat.
4. A second pass gives the suffixes whose key repeats. If a key has one class,
   all its extensions repeat, and nothing is compared. Where a key has several
   classes, these are counted first, so a passage of any number of copies is one
   row from there on, and extensions that occur twice or more are repeats.
5. Repeated stretches of a document are merged to maximal spans.

Grouped counts combine before their shuffle and all joins are equi-joins, which
Spark can split at a hot key; no group is gathered. The second pass leaves out
most suffixes early by a Bloom bitmap of fixed size (8 MB): it only saves
shuffling, the join that follows decides. A task holds one batch, and one
document at a time beyond it.

Defined results for odd input: null text counts as empty; texts of fewer than
``LENGTH`` words have no repeats; repeated rows repeat each other; null ids stay
null; ``first_doc_id`` is the least non-null id that shares a passage, the
document's own id included; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import fresh, materialise, own_columns, small_batches

LENGTH = 50
PREFIX = 25
#: Bits of the Bloom bitmap that spares the shuffle suffixes without a partner.
BLOOM_BITS = 1 << 26
#: Words whose hashes a task remembers.
HELD_WORDS = 100_000
#: Words of documents whose suffixes leave a task together.
OUT_WORDS = 400_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Suffixes:
    """The kept suffixes of documents, one after another."""

    def __init__(self, length: int = LENGTH, prefix: int = PREFIX):
        self.length, self.prefix = length, prefix
        self.hashes = _Hashes()
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _MULTIPLIER, dtype=np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _INVERSE, dtype=np.uint64)])
        return self.up[:n], self.down[:n]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(keys, classes, first stretches, hashes of all stretches): suffix k is that of the stretches from its first one up to the next suffix's."""
        n, length, prefix = len(words), self.length, self.prefix
        if n < length:
            return None
        h = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=n)
        up, down = self._powers(n)
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(h * up, dtype=np.uint64)]
            grams = _mixed((sums[prefix:] - sums[: n - prefix + 1]) * down[: n - prefix + 1])
            stretches = _mixed((sums[length:] - sums[: n - length + 1]) * down[: n - length + 1])
        # The place of the least key in each run of ``span`` keys, by doubling.
        span = length - prefix + 1
        least, place, reach = grams, np.arange(len(grams)), 1
        while reach < span:
            step = min(reach, span - reach)
            right = least[step:] < least[: len(least) - step]
            place = np.where(right, place[step:], place[: len(place) - step])
            least = np.where(right, least[step:], least[: len(least) - step])
            reach += step
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        keys = grams[place[first]]
        with np.errstate(over="ignore"):
            sizes = np.diff(np.r_[first, len(stretches)]).astype(np.uint64)
            classes = _mixed(np.add.reduceat(_mixed(stretches), first) + sizes * _MULTIPLIER) ^ keys
        return keys.view(np.int64), classes.view(np.int64), first, stretches.view(np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


# --- The passes over documents -----------------------------------------------


def key_counts(docs: DataFrame, text_col: str = "text", length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """(key, n, low, high): the sorted keys of every batch, equal neighbours collapsed; low and high are the least and greatest class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, found = Suffixes(length, prefix), 0, []

        def collapsed() -> pa.RecordBatch:
            keys, classes = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            order = np.lexsort((classes, keys))
            keys, classes = keys[order], classes[order]
            cut = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
            columns = keys[cut[:-1]], np.diff(cut), classes[cut[:-1]], classes[cut[1:] - 1]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n", "low", "high"])

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                got = own.of(words)
                if got:
                    found.append(got[:2])
                    held += len(words)
                if held >= OUT_WORDS:
                    yield collapsed()
                    held, found = 0, []
        if found:
            yield collapsed()

    texts = docs.select(F.encode(F.col(text_col), "UTF-8").alias("t"))
    return texts.mapInArrow(run, "key bigint, n bigint, low bigint, high bigint")


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = keys.view(np.uint64)
    return (k % np.uint64(BLOOM_BITS)).astype(np.int64), ((k >> np.uint64(32)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """A Bloom bitmap of the keys; at most BLOOM_BITS / 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_bits(b.column(0).to_numpy(zero_copy_only=False))))
            place, ones = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(at) else np.empty(0, dtype=np.int64)
            both = np.bitwise_or.reduceat(ones, cut) if len(at) else ones
            yield pa.RecordBatch.from_arrays([pa.array(place[cut]), pa.array(both.view(np.int64))], names=["k", "w"])

    got = keys.mapInArrow(run, "k bigint, w bigint").groupBy("k").agg(F.bit_or("w").alias("w")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    words[got.column("k").to_numpy()] = got.column("w").to_numpy()
    return words.view(np.uint64)


_SUFFIX = "r bigint, doc_id bigint, n_words int, o bigint, key bigint, c bigint, start int, w array<bigint>"


def suffixes(docs: DataFrame, likely: np.ndarray, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """Suffixes whose key the bitmap passes: row, document, occurrence, key, class, first stretch, hashes of its stretches."""
    shared = docs.sparkSession.sparkContext.broadcast(likely)  # BLOOM_BITS / 8 bytes at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits, own = shared.value, Suffixes(length, prefix)
        number = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            each = np.repeat(np.arange(len(out)), [len(x[3]) for x in out])  # the document of each suffix
            of = lambda k: pa.array(np.array([x[k] for x in out])[each])
            ids = pa.array([x[1] for x in out], pa.int64()).take(pa.array(each))
            o, keys, classes, start, sizes, stretches = (np.concatenate([x[k] for x in out]) for k in range(3, 9))
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), stretches)
            columns = [of(0), ids, of(2).cast(pa.int32()), pa.array(o), pa.array(keys), pa.array(classes), pa.array(start.astype(np.int32)), lists]
            return pa.RecordBatch.from_arrays(columns, names=["r", "doc_id", "n_words", "o", "key", "c", "start", "w"])

        for b in batches:
            for r, doc_id, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
                words = words_of(text.as_py())
                got = own.of(words)
                if not got:
                    continue
                keys, classes, first, stretches = got
                one, two = _bits(keys)
                held_both = ((bits[one >> 6] >> (one & 63).astype(np.uint64)) & (bits[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                keep = np.flatnonzero(held_both)
                if len(keep):
                    sizes = np.diff(np.r_[first, len(stretches)])
                    mask = np.repeat(held_both, sizes)
                    out.append((r.as_py(), doc_id.as_py(), len(words), number + keep, keys[keep], classes[keep], first[keep], sizes[keep], stretches[mask]))
                    held += len(words)
                number += len(keys)
                if held >= OUT_WORDS:
                    yield batch()
                    out.clear()
                    held = 0
        if out:
            yield batch()

    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("t"))
    return rows.mapInArrow(run, _SUFFIX)


# --- Comparing and extending -------------------------------------------------


def _classes(found: DataFrame) -> DataFrame:
    """(c, live, own, first, first_doc_id): for each class the stretches that repeat, and those whose first place is the class's own, as bits."""
    one = F.lit(1).cast("long")
    whole = F.call_function("shiftleft", one, F.max("k")) - 1
    alone = found.filter("not contested").groupBy("c").agg(whole.alias("live"), whole.alias("own"), F.min("o").alias("first"), F.min("doc_id").alias("first_doc_id"))
    classes = found.filter("contested").groupBy("c", "key", "w").agg(F.count("*").alias("n"), F.min("o").alias("o"), F.min("doc_id").alias("least"))
    several = materialise(classes.select("c", "key", "n", "o", "least", F.posexplode("w").alias("d", "h")))
    counted = several.groupBy("key", "h").agg(F.sum("n").alias("total"), F.min("o").alias("first"), F.min("least").alias("first_doc_id")).filter("total > 1")
    bit = F.call_function("shiftleft", one, F.col("d"))
    met = several.join(counted, ["key", "h"]).groupBy("c").agg(
        F.bit_or(bit).alias("live"),
        F.bit_or(F.when(F.col("first") == F.col("o"), bit).otherwise(F.lit(0).cast("long"))).alias("own"),
        F.min("o").alias("first"),
        F.min("first_doc_id").alias("first_doc_id"),
    )
    return alone.unionByName(met)


_MERGED = "struct<spans:array<struct<start:int,end:int>>,cut:array<struct<start:int,end:int>>>"


def _merge(parts: list[dict], name: str, length: int) -> list[dict]:
    out: list[dict] = []
    for p in parts:
        mask, d = p[name], p["start"]
        while mask:
            skip = (mask & -mask).bit_length() - 1
            mask >>= skip
            d += skip
            run = (~mask & (mask + 1)).bit_length() - 1
            if out and d <= out[-1]["end"]:
                out[-1]["end"] = d + run - 1 + length
            else:
                out.append({"start": d, "end": d + run - 1 + length})
            mask >>= run
            d += run
    return out


def _merged(length: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(parts: pa.Array) -> pa.Array:
        rows = [{k: _merge(own, name, length) for k, name in (("spans", "live"), ("cut", "more"))} for own in parts.to_pylist()]
        return pa.array(rows, type=pa.struct([("spans", span), ("cut", span)]))

    return F.arrow_udf(run, _MERGED)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """A row for each document with a repeated passage.

    r (the row's number in this pass), doc_id, n_words, spans (words that are
    repeated anywhere), cut (those whose passage has an earlier place, in the
    order of the table's parts) and first_doc_id.
    """
    if not 0 < prefix <= length <= prefix + 62:
        raise ValueError("a prefix is at least 1 and at most 62 words shorter than a passage")
    small_batches(docs)
    counts = key_counts(docs, text_col, length, prefix).groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    live = materialise(counts.filter("n > 1").select("key", (F.col("low") != F.col("high")).alias("contested")))
    likely = suffixes(docs, bitmap(live.select("key")), id_col, text_col, length, prefix)
    # Only contested suffixes keep the hashes of their stretches.
    found = likely.join(live, "key").select("r", "doc_id", "n_words", "start", "o", "key", "c", "contested", F.size("w").alias("k"), F.when(F.col("contested"), F.col("w")).alias("w"))
    found = materialise(found)
    # Read from a table of its own, so that both sides of the join are dealt alike and Spark can split a hot class.
    classes = materialise(_classes(found))
    marked = found.select("r", "doc_id", "n_words", "start", "o", "c").join(classes, "c")
    more = F.when(F.col("o") == F.col("first"), F.col("live").bitwiseAND(F.bitwise_not("own"))).otherwise(F.col("live"))
    parts = marked.select("r", "doc_id", "n_words", "first_doc_id", F.struct("start", "live", more.alias("more")).alias("part"))
    rows = parts.groupBy("r").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"), F.array_sort(F.collect_list("part")).alias("parts")
    )
    return rows.select("r", "doc_id", "n_words", "first_doc_id", _merged(length)(F.col("parts")).alias("m")).select("r", "doc_id", "n_words", "m.spans", "m.cut", "first_doc_id")


def covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_repeated, n_spans, spans (start:end in words, comma-joined) and first_doc_id of documents with repeats."""
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return repeats(docs, id_col, text_col).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).alias("n_repeated"), F.size("spans").cast("long").alias("n_spans"), shown.alias("spans"), "first_doc_id"
    )


# --- Removing what an earlier place already says ------------------------------

_WORD = re.compile(r"[^ \t-\r]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans; white space after a cut word goes with it."""
    if not spans:
        return text
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = starts[b]
    return "".join([*out, text[at:]])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every passage left at its first place only.

    Rows alike in id and text are one document here: one of them is returned.
    """
    name = fresh("__print", docs)
    rows = docs.withColumn(name, F.xxhash64(F.col(id_col), F.col(text_col))).dropDuplicates([id_col, name])
    rows = materialise(rows)
    cuts = repeats(rows.select(F.col(name).alias("p"), F.col(text_col).alias("t")), "p", "t").filter(F.size("cut") > 0)

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([t if t is None or not s else without(t, [(x["start"], x["end"]) for x in s]) for t, s in pairs], type=pa.string())

    own = fresh("__cut", docs)
    joined = rows.join(cuts.select(F.col("doc_id").alias(name), F.col("cut").alias(own)), name, "left")
    return joined.withColumn(text_col, F.arrow_udf(run, "string")(F.col(text_col), F.col(own))).select(*own_columns(docs))
