"""Secret scans through a trigram inverted index, in plain column expressions.

1. Each rule's regex is analysed into a Boolean query of trigrams that every match
   must hold; a rule without a mandatory trigram scans every text fully.
2. One scan of the texts writes the index: a posting (trigram, row key) for each
   trigram of the rules that a lower-cased text holds. A row key is 128 bits of
   hash over id and text, so rows alike in both share it and their result.
3. Posting lists are merged by row key: the lists of a conjunction are intersected,
   those of a disjunction united. What is left are the candidates of each rule.
   Postings of a row come from one task, so they combine before the shuffle.
4. A second scan verifies candidates with the regex itself. Texts that are no
   candidate are left out by a bitmap of fixed size (8 MB, broadcast), which only
   spares shuffling: the join with the candidates decides.
5. A regex splits a text into gaps and matches; running sums of their lengths, by
   a window over one text's matches, are the spans. Work grows with the matches.

Only candidates' texts are shuffled. Positions are code points.

Defined results for odd input: null text counts as empty; empty texts have no
spans; repeated rows give a row each; null ids stay null; other columns are not read.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import materialise


@dataclass(frozen=True)
class Rule:
    """``least``: length of ``group`` below which a match is dropped, without a retry."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


#: The contract's kinds. ``access`` and ``hex`` runs cannot hold a longer match than
#: the run itself, so their least length stands in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Kinds that the method adds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_password", r"[a-z]{2,10}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.!$%&*+-]{6,64}@"),
)

RULES = BASE + MORE

# --- From a regex to a trigram query ----------------------------------------

#: A query: True (all texts), or ("and" | "or", parts), where a part is a query or a trigram.
Query = object

_MOST = 64  # strings of an exact set


def _and(*qs: Query) -> Query:
    parts = []
    for q in qs:
        if q is True:
            continue
        parts += q[1] if isinstance(q, tuple) and q[0] == "and" else [q]
    parts = list(dict.fromkeys(parts))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(qs: list[Query]) -> Query:
    if any(q is True for q in qs):
        return True
    parts = list(dict.fromkeys(qs))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_string(s: str) -> Query:
    return _and(*(s[i : i + 3] for i in range(len(s) - 2)))


def _of_set(exact: set[str]) -> Query:
    return _or([_of_string(s) for s in sorted(exact)]) if exact else True


def _charset(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 16:
            out |= {chr(x) for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return {c.lower() for c in out} if len(out) <= 16 else None


def _sequence(nodes: list) -> tuple[set[str] | None, Query]:
    """(all strings it can match, lower-cased, or None; what any match must hold)."""
    exact: set[str] | None = {""}
    whole, query = True, True
    for op, arg in nodes:
        part, q = _node(op, arg)
        query = _and(query, q)
        if part is not None and exact is not None and len(exact) * len(part) <= _MOST:
            exact = {a + b for a, b in product(exact, part)}
            continue
        # The run of known strings ends here; what it held stays mandatory.
        if exact is not None:
            query = _and(query, _of_set(exact))
        whole, exact = False, part
    if exact is not None and not whole:
        query = _and(query, _of_set(exact))
    return (exact, True) if whole and query is True else (exact if whole else None, query)


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, True
    if op is C.IN:
        return _charset(arg), True
    if op is C.SUBPATTERN:
        return _sequence(list(arg[3]))
    if op is C.BRANCH:
        parts = [_sequence(list(b)) for b in arg[1]]
        if all(e is not None for e, _ in parts):
            return set().union(*(e for e, _ in parts)), _or([q for _, q in parts])
        return None, _or([_and(q, _of_set(e) if e is not None else True) for e, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = arg
        exact, query = _sequence(list(body))
        if low == 0:
            return (exact | {""} if exact is not None and high == 1 else None), True
        if exact is not None and low == high == 1:
            return exact, query
        return None, _and(query, _of_set(exact) if exact is not None else True)
    return None, True


def trigram_query(pattern: str) -> Query:
    """The query of a regex over lower-cased text; True if no trigram is mandatory."""
    exact, query = _sequence(list(parser.parse(pattern)))
    return _and(query, _of_set(exact)) if exact is not None else query


def trigrams(query: Query) -> list[str]:
    if query is True:
        return []
    if isinstance(query, str):
        return [query]
    return list(dict.fromkeys(t for q in query[1] for t in trigrams(q)))


# --- The index ---------------------------------------------------------------

_WORD_BITS = 62  # trigrams whose postings one long holds
#: Bits of the candidates' bitmap, and those of one row of it.
MAYBE_BITS = 1 << 26
_CHUNK_BITS = 1 << 15


def _index(rules: tuple[Rule, ...]) -> tuple[dict[str, Query], list[str]]:
    found = {r.kind: trigram_query(r.pattern) for r in rules}
    return found, list(dict.fromkeys(t for q in found.values() for t in trigrams(q)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, a, b): the text and its row's key."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.select("*", *(F.xxhash64(F.lit(k), "doc_id", "t").alias(c) for k, c in enumerate("ab")))


def indexed(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, held, full): a row's postings as numbers of trigrams, and which rules without a trigram match, as bits."""
    queries, words = _index(rules)
    rows = _keyed(docs, id_col, text_col).select("*", F.lower("t").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(w), F.lit(k)) for k, w in enumerate(words)))) if words else F.array().cast("array<int>")
    full = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        if queries[r.kind] is True:
            full = full.bitwiseOR(F.when(F.col("t").rlike(r.java), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return rows.select("doc_id", "a", "b", held.alias("held"), full.alias("full"))


def _posted(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "a", "b", F.explode("held").alias("trigram"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index with trigrams as text: (trigram, doc_id), a row for each posting."""
    names = F.array(*(F.lit(w) for w in _index(rules)[1]))
    return _posted(indexed(docs, rules, id_col, text_col)).select(F.get(names, F.col("trigram")).alias("trigram"), "doc_id")


def _met(query: Query, words: list[str], maps: list[Column]) -> Column:
    """Whether merged postings satisfy a query."""
    kind, parts = ("and", (query,)) if isinstance(query, str) else query
    out = []
    for k, m in enumerate(maps):
        mask = sum(1 << n % _WORD_BITS for n in (words.index(p) for p in parts if isinstance(p, str)) if n // _WORD_BITS == k)
        if mask:
            both = m.bitwiseAND(F.lit(mask))
            out.append(both == mask if kind == "and" else both != 0)
    out += [_met(p, words, maps) for p in parts if not isinstance(p, str)]
    total = out[0]
    for c in out[1:]:
        total = total & c if kind == "and" else total | c
    return total


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(a, b, kinds): the rules whose posting lists meet at a row key, as bits; ``rows`` as ``indexed`` gives them."""
    queries, words = _index(rules)
    none, n_maps = F.lit(0).cast("long"), -(-len(words) // _WORD_BITS)
    own = lambda k: F.when(F.floor(F.col("trigram") / _WORD_BITS) == k, _bit(F.col("trigram") % _WORD_BITS)).otherwise(none)
    merged = _posted(rows).groupBy("a", "b").agg(*(F.bit_or(own(k)).alias(f"m{k}") for k in range(n_maps)))
    maps, kinds = [F.col(f"m{k}") for k in range(n_maps)], none
    for k, r in enumerate(rules):
        if queries[r.kind] is not True:
            kinds = kinds.bitwiseOR(F.when(_met(queries[r.kind], words, maps), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    found = merged.select("a", "b", kinds.alias("kinds")).unionByName(rows.select("a", "b", F.col("full").alias("kinds")))
    return found.filter("kinds <> 0").groupBy("a", "b").agg(F.bit_or("kinds").alias("kinds"))


def _likely(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The ``rows`` whose key may be one of ``found``: no false negatives."""
    place = F.pmod(F.col("a"), F.lit(MAYBE_BITS))
    chunk, within = F.floor(place / _CHUNK_BITS).cast("int"), (place % _CHUNK_BITS).cast("long")
    # MAYBE_BITS / _CHUNK_BITS rows of 4 KB at most, at every size.
    maps = F.broadcast(found.select(chunk.alias("c"), within.alias("w")).groupBy("c").agg(F.bitmap_construct_agg("w").alias("bits")))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("w") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.withColumns({"c": chunk, "w": within}).join(maps, "c").filter(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("w") % 8).cast("int"))) != 0).drop("c", "w", "bits")


# --- The scan ----------------------------------------------------------------


def _matches(text: Column, rule: Rule, kind: int, with_text: bool) -> Column:
    """A struct for each match of one rule, in order: what lies between it and the one before, and its length."""
    pattern = F.lit(rule.java)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.slice(F.split(text, rule.java, -1), 1, F.size(found))
    parts = F.arrays_zip(found.alias("m"), group.alias("g"), gaps.alias("gap"))
    return F.transform(
        parts,
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), (F.length(p["gap"]) + F.length(p["m"])).cast("long").alias("step"), F.length(p["m"]).alias("n"),
            (F.length(p["g"]) >= rule.least).alias("ok"), (p["m"] if with_text else F.lit(None).cast("string")).alias("secret"),
        ),
    )


_MATCHES = "array<struct<kind:int,i:int,step:bigint,n:int,ok:boolean,secret:string>>"


def _found(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, a, b), and (a, b, kind, start, end, secret) of every span of a key."""
    rows = materialise(indexed(docs, rules, id_col, text_col))
    some = materialise(candidates(rows, rules))
    texts = _likely(_keyed(docs, id_col, text_col).drop("doc_id"), some).join(some, ["a", "b"]).dropDuplicates(["a", "b"])
    each = [F.when(F.col("kinds").bitwiseAND(F.lit(1 << k)) != 0, _matches(F.col("t"), r, k, with_text)).otherwise(F.array().cast(_MATCHES)) for k, r in enumerate(rules)]
    matches = texts.select("a", "b", F.inline(F.concat(*each)))
    end = F.sum("step").over(Window.partitionBy("a", "b", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    spans = matches.withColumn("end", end.cast("int")).filter("ok").select("a", "b", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "secret")
    return rows.select("doc_id", "a", "b"), spans


def _joined(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of spans of each kind, and the base spans and all spans sorted by start and kind."""
    rows, spans = _found(docs, rules, id_col, text_col)
    own = spans.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    every = F.coalesce("s", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    rows = rows.join(own, ["a", "b"], "left").select("doc_id", every.alias("all_spans"))
    count = lambda k: F.size(F.filter("all_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("all_spans", lambda s: s["kind"] < n_base)
    return rows.select("doc_id", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules)), base.alias("base_spans"), "all_spans")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans as text."""
    kinds = [r.kind for r in RULES]
    return scan(docs, RULES, len(BASE), id_col, text_col).select(
        "doc_id",
        *(f"n_{r.kind}" for r in BASE),
        F.sha2(_joined(F.col("base_spans"), kinds), 256).alias("base_sha256"),
        _joined(F.col("all_spans"), kinds).alias("spans"),
    )


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each span: doc_id, kind, start, end and the matched text."""
    rows, spans = _found(docs, RULES, id_col, text_col, with_text=True)
    names = F.array(*(F.lit(r.kind) for r in RULES))
    return rows.join(spans, ["a", "b"]).select("doc_id", F.get(names, F.col("kind")).alias("kind"), "start", "end", "secret")
