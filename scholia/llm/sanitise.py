"""Personal data and the terms that reveal it.

Base kinds are found by patterns: email, ip, card, phone. Each found value is a
protected entity. All words of a document that holds it are candidate terms, and
how strongly a term reveals an entity is estimated from the whole corpus by documents:

    PMI(e; t) = log(N * n_et / (n_e * n_t)),   IC(e) = log(N / n_e)

PMI never exceeds IC, which it reaches if the term occurs with the entity alone:
then the term discloses all of it. A term at ``REMOVE`` of IC or more is removed,
one at ``GENERALISE`` or more is generalised, at all its places in documents that
hold the entity. ``SUPPORT`` is the least number of documents that hold a pair:
with 1, entities of a single document are handled too.

Three passes: an Arrow pass finds entities and the words beside them (kept in a small
table; rows without entities are a few bytes); pairs are counted by grouped
sums; a second Arrow pass counts in how many documents each supported term
occurs. That pass is told the supported terms by a Bloom bitmap of fixed size.
The bitmap has no false negatives and false positives drop out in the join that
follows, so counts are exact at every size.

Defined results for odd input: null text counts as empty; texts without entities
have no spans; repeated rows count as documents of their own and give a row
each; null ids stay null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import materialise, small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "removed", "generalised")

#: Documents that must hold a pair; 1 leaves none out.
SUPPORT = 1
REMOVE = 0.97
GENERALISE = 0.8
#: Bits of the Bloom bitmap (2 MB) and its hashes.
BLOOM_BITS = 1 << 24
HASHES = 4
#: Terms that a task counts before it hands them on.
HELD_TERMS = 200_000

_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# A run is tried from its start only: a later start would meet the same end.
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++{_DOMAIN}")
_EMAIL_HERE = re.compile(rf"{_LOCAL}++{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while text.find("@", at) >= 0:
        # What follows a match may begin a run in the middle of its characters.
        m = (at and _EMAIL_HERE.match(text, at)) or _EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start."""
    out = [(0, *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return out
    # Leading zeros do not count: a part's length alone may not be turned into a number.
    small = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or 0) <= 255
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def entity(text: str, span: tuple[int, int, int]) -> str:
    return f"{KINDS[span[0]]}:{text[span[1] : span[2]].lower()}"


def words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words outside all spans."""
    merged: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    begins = [a for a, _ in merged]

    def free(a: int, b: int) -> bool:
        k = bisect_left(begins, b)
        return k == 0 or merged[k - 1][1] <= a

    return [(m[0].lower(), *m.span()) for m in _TERM.finditer(text) if free(*m.span())]


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of each entity with every word outside all spans."""
    own = words(text, spans)
    return [(e, *w) for e in dict.fromkeys(entity(text, s) for s in spans) for w in own]


_WORD = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = "struct<spans:array<struct<kind:int,start:int,end:int>>,entities:array<string>,words:array<struct<term:string,start:int,end:int>>>"


def _found(texts: pa.Array) -> pa.Array:
    spans, entities, near = [], [], []
    for t in texts.to_pylist():
        own = base_spans(t or "")
        spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
        entities.append(list(dict.fromkeys(entity(t, s) for s in own)))
        near.append([{"term": w, "start": a, "end": b} for w, a, b in words(t, own)] if own else [])
    return pa.StructArray.from_arrays([pa.array(spans, type=pa.list_(_SPAN)), pa.array(entities, type=pa.list_(pa.string())), pa.array(near, type=pa.list_(_WORD))], names=["spans", "entities", "words"])


def _positions(h: np.ndarray) -> np.ndarray:
    """(n, HASHES) bit positions of unsigned 64-bit hashes."""
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * (high[:, None] | np.uint64(1))) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A Bloom bitmap of a column of term hashes; at most BLOOM_BITS / 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_positions(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            place, ones = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(at) else np.empty(0, dtype=np.int64)
            both = np.bitwise_or.reduceat(ones, cut) if len(at) else ones
            yield pa.RecordBatch.from_arrays([pa.array(place[cut]), pa.array(both.view(np.int64))], names=["k", "w"])

    got = hashes.mapInArrow(run, "k bigint, w bigint").groupBy("k").agg(F.bit_or("w").alias("w")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    words[got.column("k").to_numpy()] = got.column("w").to_numpy()
    return words.view(np.uint64)


def _document_counts(docs: DataFrame, text_col: str, bitmap: np.ndarray) -> DataFrame:
    """(h, n_t): documents that hold a term, by its hash, for terms that the bitmap passes."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 MB at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = shared.value, Counter()

        def batch() -> pa.RecordBatch:
            h = np.fromiter(counts, dtype=np.uint64, count=len(counts)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(list(counts.values()), pa.int64())], names=["h", "n"])

        for b in batches:
            for text in b.column(0):
                own = {w.lower() for w in _TERM.findall(text.as_py() or "")}
                h = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in own], dtype=np.uint64)
                if len(h):
                    at = _positions(h)
                    held = ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
                    counts.update(h[held].tolist())
            if len(counts) >= HELD_TERMS:
                yield batch()
                counts.clear()
        yield batch()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h bigint, n bigint")
    return rows.groupBy("h").agg(F.sum("n").alias("n_t"))


def _held(bitmap: np.ndarray, docs: DataFrame, hashes: Column) -> Column:
    """Whether a term hash may be in the bitmap; the join that follows is exact."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 MB at every size

    def run(values: pa.Array) -> pa.Array:
        at = _positions(values.to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.array(((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1))

    return F.arrow_udf(run, "boolean")(hashes)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Materialised rows (row, doc_id, spans, entities, words[, text])."""
    small_batches(docs)
    text = [F.col(text_col).alias("text")] if keep_text else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(_found, _FOUND)(F.col(text_col)).alias("f"), *text)
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "f.spans", "f.entities", "f.words", *(["text"] if keep_text else [])))


def disclosure(rows: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, least: float | None = None) -> DataFrame:
    """(entity, term, n_et, n_e, n_t, disclosed): the share of an entity's information that a term gives, without most pairs under ``least``."""
    terms = F.array_distinct(F.transform("words", lambda w: w["term"]))
    some = rows.filter(F.size("words") > 0).select(F.explode("entities").alias("entity"), terms.alias("terms"))
    pairs = some.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support)
    held = some.groupBy("entity").agg(F.count("*").alias("n_e"))
    n = rows.count()
    of = lambda term: F.xxhash64(term).alias("h")
    counts = materialise(_document_counts(docs, text_col, _bitmap(some.select(F.explode("terms").alias("term")).select(of("term")))))
    pairs = pairs.select("*", of("term"))
    # As n_e is n_et or more, PMI at this share of IC or more bounds n_t.
    most = (1 + 1e-9) * float(n) ** (1 - least) if least is not None and n else None
    if most is not None:
        # Most pairs stand in one document, where only a rare term can reach the share: the others need not meet their counts.
        pairs = pairs.filter((F.col("n_et") > 1) | _held(_bitmap(counts.filter(F.col("n_t") <= most).select("h")), docs, F.col("h")))
    joined = pairs.join(counts, "h")
    if most is not None:
        joined = joined.filter(F.col("n_t") <= most * F.pow("n_et", F.lit(least)))
    joined = joined.join(held, "entity")
    pmi = F.log(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    ic = F.log(F.lit(float(n)) / F.col("n_e"))
    # An entity that every document holds has no information to disclose.
    share = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    return joined.select("entity", "term", "n_et", "n_e", "n_t", share.alias("disclosed"))


def _with_terms(rows: DataFrame, docs: DataFrame, text_col: str, remove: float, generalise: float) -> DataFrame:
    told = disclosure(rows, docs, text_col, least=generalise).filter(F.col("disclosed") >= generalise)
    told = materialise(told.select("entity", "term", F.when(F.col("disclosed") >= remove, F.lit(4)).otherwise(F.lit(5)).alias("kind")))
    each = rows.select("row", F.explode("entities").alias("entity"), "words").select("row", "entity", F.inline("words"))
    each = each.filter(_held(_bitmap(told.select(F.xxhash64("term"))), docs, F.xxhash64("term")))
    # A word beside two entities takes the stronger of its two treatments.
    marked = each.join(told, ["entity", "term"]).groupBy("row", "start", "end").agg(F.min("kind").alias("kind"))
    own = marked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("terms"))
    return rows.join(own, "row", "left").withColumn("all_spans", F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast("array<struct<kind:int,start:int,end:int>>")))))


def _joined(spans: str):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    rows = _with_terms(found(docs, id_col, text_col), docs, text_col, remove, generalise)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sha2(_joined("spans"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"),
        (F.size("all_spans") - F.size("spans")).cast("long").alias("n_terms"),
    )


def rewrite(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Entities become their kind, removed terms go, generalised ones become the class of their shape."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            continue
        out.append(text[at:a])
        if kind < len(BASE):
            out.append(f"[{KINDS[kind].upper()}]")
        elif kind == 5:
            out.append("[NAME]" if text[a].isupper() else "[TERM]")
        at = b
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(doc_id, text) with personal data replaced and revealing terms generalised or removed."""
    rows = _with_terms(found(docs, id_col, text_col, keep_text=True), docs, text_col, remove, generalise)

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([None if t is None else rewrite(t, [(s["kind"], s["start"], s["end"]) for s in own]) for t, own in pairs], type=pa.string())

    return rows.select("doc_id", F.arrow_udf(run, "string")(F.col("text"), F.col("all_spans")).alias("text"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
