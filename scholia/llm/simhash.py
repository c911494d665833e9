"""SimHash near-duplicates: fingerprints, a binary trie self-join, components.

1. One Arrow pass turns every whole text into a 64-bit fingerprint.
2. Fingerprints are grouped, so copies become one node however many there are.
3. Two fingerprints that differ in 3 bits or fewer agree on one of 4 blocks of
   16 bits. Each fingerprint goes to 4 groups, keyed by a block's number and
   value. In a group the binary trie over the remaining bits is joined with
   itself: node pairs go down together, differing bits add up, and a pair whose
   error exceeds the budget is pruned.
4. A group of more than ``GROUP`` fingerprints is dealt again by further blocks:
   its 48 free bits as 6 blocks of 8, of which 3 must agree (20 keys), then the
   24 free bits as 8 blocks of 3, of which 5 must agree (56 keys). What is left
   are 9 free bits, so no group has more than 512 members: the bound is proven
   and nothing is dropped to keep it. Above ``WIDE`` fingerprints, where nearly
   all groups of 16 bits would be too large, the first blocks are 5, of which 2
   must agree (10 keys of 25 bits or more), so few groups are dealt again.
5. A group gives only a spanning forest of its links, at most one link for each
   member, and alternating large-star and small-star steps join the links into
   components. Links stay distributed; the driver sees only counts.

Defined results for odd input: null and word-less texts have fingerprint 0 and
are linked like any other; repeated rows give a row each; a component without
any non-null id has a null component_id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import LOWER, fresh, materialise, own_columns, release, shuffle_partitions, small_batches

SHINGLE = 3
BITS = 3
SEED = 42
#: Most members of a trie group before its fingerprints are dealt by more bits.
GROUP = 512
#: Distinct fingerprints above which the first blocks are 5: then a group of 16 bits has half of ``GROUP`` on average.
WIDE = (GROUP // 2) << 16
#: The corpus stage: words of a shingle, and tenths of Jaccard similarity that make a near-duplicate.
WORDS = 5
TENTHS = 8
#: Most nodes of a block, and members of all sets in it: a key with more has several, and each two of them meet.
BLOCK = 1024
BLOCK_MEMBERS = 1 << 24
#: Most members of all sets of a block where whole sets are compared, 8 bytes each.
SET_MEMBERS = 1 << 20
#: Words of bitmaps that are compared at once.
WORDS_AT_ONCE = 1 << 18
#: Bands of a set's signature and minima in each: sets of similarity s share no band with odds of (1 - s ** 4) ** 32,
#: five in a hundred million at 0.8.
BANDS = 32
MINIMA = 4
#: Least and most bits of a bitmap of ids, of which there are sixteen for each id between.
MAYBE = 1 << 22
MAYBE_MOST = 1 << 27

_FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % k, SEED) | 1 for k in range(BANDS * MINIMA)], dtype=np.uint64)
_JOINED = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in LOWER)


def hashes(text: bytes | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; a shorter text is one run."""
    words = (text or b"").translate(_JOINED).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    if not words:
        return np.empty(0, dtype="<u8")
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.r_[0, ends[:-width]].tolist()
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def majority(own: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none, zero."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(own), 1 << 16):  # 64 bytes for each hash at a time
        part = own[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    return majority(hashes(text, shingle, seed))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed 64-bit column."""

    def run(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()], dtype="<u8")
        return pa.array(values.view("<i8"), type=pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- The trie self-join -----------------------------------------------------


def trie_links(values: np.ndarray, groups: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index pairs of ``values`` (uint64) within a group that differ in ``bits`` bits or fewer.

    ``groups`` are increasing runs and ``values`` increase in each: a range of
    rows with a common prefix is a trie node. All node pairs of all groups go
    down one bit at a time, together.
    """
    cut = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[cut[1:], len(groups)]
    big = ends - cut > 1
    a0, a1 = cut[big], ends[big]
    b0, b1, error = a0.copy(), a1.copy(), np.zeros(len(a0), dtype=np.int64)
    links = []
    for depth in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.r_[0, np.cumsum((values >> np.uint64(depth)) & np.uint64(1), dtype=np.int64)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = a0 != b0  # a node with itself has one mixed pair, two nodes have two
        a0, a1, b0, b1, error = (
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[other]),
                (am, a1, am, a1[other]),
                (b0, bm, bm, b0[other]),
                (bm, b1, b1, bm[other]),
                (error, error, error + 1, error[other] + 1),
            )
        )
        alive = (a1 > a0) & (b1 > b0) & (error <= bits) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, error = a0[alive], a1[alive], b0[alive], b1[alive], error[alive]
        # Two leaves need no further descent: their remaining bits are counted at once.
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            x, y = a0[leaves], b0[leaves]
            near = np.bitwise_count(values[x] ^ values[y]) <= bits
            links.append(np.stack([x[near], y[near]], axis=1))
            keep = ~leaves
            a0, a1, b0, b1, error = a0[keep], a1[keep], b0[keep], b1[keep], error[keep]
    if len(a0):  # equal values in a group, all bits seen
        for x0, x1, y0, y1 in zip(a0, a1, b0, b1, strict=True):
            links.append(np.array([[x0, k] for k in {*range(x0, x1), *range(y0, y1)} if k != x0], dtype=np.int64))
    return np.concatenate(links) if links else np.empty((0, 2), dtype=np.int64)


def forest(n: int, links: np.ndarray) -> np.ndarray:
    """(member, least member of its component) for members that are not the least."""
    label = np.arange(n)
    while len(links):
        low = np.minimum(label[links[:, 0]], label[links[:, 1]])
        before = label.copy()
        np.minimum.at(label, links[:, 0], low)
        np.minimum.at(label, links[:, 1], low)
        np.minimum.at(label, before[links[:, 0]], low)
        np.minimum.at(label, before[links[:, 1]], low)
        label = label[label]
        links = links[label[links[:, 0]] != label[links[:, 1]]]
        if not len(links) and (label[label] == label).all():
            break
    while not (label[label] == label).all():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], axis=1)


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, fp) sorted by key; a group may reach over batches and is bounded."""
    key, fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def joined(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        values = fp.view(np.uint64)
        order = np.lexsort((values, key))
        key, values = key[order], values[order]
        pairs = forest(len(values), trie_links(values, key))
        own = values.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[pairs[:, 0]]), pa.array(own[pairs[:, 1]])], names=["u", "v"])

    for batch in batches:
        key = np.r_[key, batch.column(0).to_numpy(zero_copy_only=False)]
        fp = np.r_[fp, batch.column(1).to_numpy(zero_copy_only=False)]
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if whole:
            yield joined(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
    if len(key):
        yield joined(key, fp)


# --- Dealing fingerprints into bounded groups -------------------------------


def _signatures(mask: int, blocks: int, budget: int) -> list[int]:
    """Masks of fixed bits: the bits of ``mask`` in ``blocks`` blocks, of which all but ``budget`` must agree."""
    free = [b for b in range(64) if mask >> b & 1]
    cuts = [len(free) * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - budget)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels(first: int = 4) -> list[dict[int, list[int]]]:
    """For each level, the fixed masks that a fixed mask of the level above leads to; ``first``: blocks of the first level."""
    whole = (1 << 64) - 1
    out, above = [], [0]
    for blocks in (first, 6, 8):
        level = {f: [f | s for s in _signatures(whole & ~f, blocks, BITS)] for f in above}
        out.append(level)
        above = sorted({m for ms in level.values() for m in ms})
    return out


def links(nodes: DataFrame, group: int = GROUP, wide: int = WIDE) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints ``fp``; ``nodes`` is materialised."""
    spark = nodes.sparkSession
    n, found = shuffle_partitions(spark), []
    rows = nodes.select("fp", F.lit(0).cast("long").alias("fixed"))
    for depth, level in enumerate(_levels(4 if nodes.count() <= wide else 5)):
        # Masks are a fixed table of at most 1 + 10 + 200 rows of masks.
        if depth == 0:
            masks = F.array(*(F.lit(_signed(m)) for m in level[0]))
            dealt = rows.select("fp", F.explode(masks).alias("fixed"))
        else:
            table = F.create_map(*(x for f, ms in level.items() for x in (F.lit(_signed(f)), F.array(*(F.lit(_signed(m)) for m in ms)))))
            dealt = rows.select("fp", F.explode(F.element_at(table, F.col("fixed"))).alias("fixed"))
        # The key holds the mask and the bits under it; a clash of keys only adds candidates.
        dealt = dealt.select("fp", "fixed", F.xxhash64("fixed", F.col("fp").bitwiseAND(F.col("fixed"))).alias("key")).distinct()
        last = depth == 2
        if not last:
            sizes = dealt.groupBy("key").count()
            large = materialise(sizes.filter(F.col("count") > group).select("key"))
            some = not large.isEmpty()
        small = dealt if last or not some else dealt.join(large, "key", "left_anti")
        found.append(small.select("key", "fp").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_join_runs, "u bigint, v bigint"))
        if last or not some:
            break
        rows = dealt.join(large, "key", "left_semi").select("fp", "fixed")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# --- Components -------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; a root is its component's least node.

    Alternating star contraction. Each step is a grouped minimum, which combines
    before its shuffle, and an equi-join, which Spark splits where a node is hot.
    """
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # Large star: neighbours above a node go to its least neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: neighbours below a node, and the node, go to the least of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = materialise(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _placed(prints: DataFrame) -> DataFrame:
    """Materialised rows (fp, root, z, id, n): a node, its root, its least id (z: null) and that id's rows."""
    counts = prints.groupBy("fp", "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), "n")).alias("s")
    nodes = materialise(counts.groupBy("fp").agg(least).select("fp", "s.*"))
    roots = components(links(nodes.select("fp")))
    # Only nodes with links have a row in roots; the others are their own component.
    return materialise(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row of ``docs``."""
    small_batches(docs)
    prints = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")))
    placed = _placed(prints)
    ids = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


# --- Near-duplicates by the similarity of their word sets --------------------


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run."""
    return np.unique(hashes(text, width))


def _node(own: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(own.tobytes(), SEED))


def parity(own: np.ndarray) -> bytes:
    """A bit for each place of a hash modulo the size: whether an odd number of the set is there."""
    m = max(64, 1 << max(len(own) - 1, 0).bit_length())
    return np.packbits(np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Two sets differ in this many members at least: bits that differ, the longer bitmap folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _held(ids: DataFrame, column: Column) -> Column:
    """Whether an id may be one of ``ids`` (column ``id``, materialised): a bitmap of bounded size, without false negatives."""
    most = min(MAYBE_MOST, max(MAYBE, 1 << (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(most))
    at = ids.select(place(F.col("id")).alias("p"))
    got = at.groupBy(F.shiftright("p", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w")).toArrow()
    words = np.zeros(most // 64, dtype=np.int64)
    words[got.column("k").to_numpy()] = got.column("w").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(words.view(np.uint64))  # 512 KB to 16 MB

    def run(places: pa.Array) -> pa.Array:
        p = places.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return F.arrow_udf(run, "boolean")(place(column))


def _minima(own: np.ndarray) -> np.ndarray:
    """The least value of each of the signature's multiplications over a set that is not empty."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(own), 1 << 12):  # 8 bytes for each hash and factor at a time
        np.minimum(out, (own[k : k + (1 << 12), None] * _FACTORS).min(axis=0), out=out)
    return out


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set's signature, signed; of the empty set none. A clash of keys only adds candidates."""
    if not len(own):
        return np.empty(0, dtype=np.int64)
    rows = _minima(own).reshape(BANDS, MINIMA) * _FACTORS[:MINIMA]
    return (rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _FACTORS[-1]).view(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, node, fp, size, bits, keys): a row's set, its fingerprint, parities and band keys."""

    def run(texts: pa.Array) -> pa.Array:
        nodes, fps, sizes, bits, keys = [], [], [], [], []
        for t in texts.cast(pa.binary()).to_pylist():
            every = hashes(t, width)
            own = np.unique(every)
            nodes.append(_node(own))
            fps.append(_signed(majority(every)))
            sizes.append(len(own))
            bits.append(parity(own))
            keys.append(band_keys(own))
        return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "fp", "size", "bits", "keys"])

    kind = "struct<node:bigint,fp:bigint,size:bigint,bits:binary,keys:array<bigint>>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(run, kind)(F.col(text_col)).alias("s"))
    return rows.select("doc_id", "s.*")


def _hopeful(pairs: DataFrame, nodes: DataFrame, tenths: int) -> DataFrame:
    """The pairs (u, v) that sizes and bitmaps leave possible."""

    def near(a: pa.Array, b: pa.Array, total: pa.Array) -> pa.Array:
        # J >= k / 10 means that the sets differ in (10 - k) / (10 + k) of their members at most.
        rows = zip(a.to_pylist(), b.to_pylist(), total.to_pylist(), strict=True)
        return pa.array([(10 + tenths) * _apart(x, y) <= (10 - tenths) * n for x, y, n in rows], type=pa.bool_())

    left, right = (nodes.select(F.col("node").alias(c), F.col("bits").alias(f"b{c}"), F.col("size").alias(f"s{c}")) for c in "uv")
    pairs = pairs.distinct().join(left, "u").join(right, "v").filter(10 * F.least("su", "sv") >= tenths * F.greatest("su", "sv"))
    return pairs.filter(F.arrow_udf(near, "boolean")("bu", "bv", F.col("su") + F.col("sv"))).select("u", "v")


def _whole_sets(some: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Materialised rows (node, own): the whole sets of ``some`` (distinct rows of a node)."""

    def run(texts: pa.Array) -> pa.Array:
        sets = [shingles(t, width) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "own"])

    ids = materialise(nodes.join(some, "node").select("id").distinct())
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter(_held(ids, F.col("doc")))
    # Written first, so that no plan can hash other rows than those that a pair needs.
    texts = materialise(rows.join(ids, F.col("doc").eqNullSafe(F.col("id")), "left_semi").select("text"))
    held = texts.select(F.arrow_udf(run, "struct<node:bigint,own:array<bigint>>")("text").alias("s"))
    return materialise(held.select("s.*").join(some, "node", "left_semi").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, tenths: int) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of ``tenths`` / 10 or more."""
    pairs = materialise(pairs.distinct())
    if pairs.isEmpty():
        return pairs
    some = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = _whole_sets(some, nodes, docs, id_col, text_col, width)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return materialise(both.filter(10 * common >= tenths * (F.size("a") + F.size("b") - common)).select("u", "v"))


def _units(keys: DataFrame, block: int = BLOCK, members: int = BLOCK_MEMBERS) -> DataFrame:
    """Materialised rows (key, x, y, side, node): the nodes of a key, or of two blocks ``x`` and ``y`` of a large key's.

    Rows (key, node, size) of keys that one node holds are left out; other columns
    stay. A node is in block ``side``; in a unit of two blocks only nodes of
    different blocks meet, in a unit of one block all do, so each two nodes of a
    key meet once.
    """
    own = [c for c in keys.columns if c not in ("key", "size")]
    dealt = keys.repartition("key")  # written once, read by both sides of the join
    counts = dealt.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("m")).filter("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("m") / members)).cast("int")
    rows = dealt.join(counts.select("key", blocks.alias("b")), "key").select("key", *own, F.pmod(F.xxhash64("node"), "b").cast("int").alias("side"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
    return materialise(rows.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", *own))


def _apart_at(words: np.ndarray, at: np.ndarray, wide: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_apart`` of the bitmaps of rows ``i`` and ``j``: ``wide`` words of ``words`` from ``at``, in i and j alike or twice as many in one."""
    i, j = np.where(wide[i] <= wide[j], i, j), np.where(wide[i] <= wide[j], j, i)
    out = np.empty(len(i), dtype=np.int64)
    for w, twice in {*zip(wide[i].tolist(), (wide[i] < wide[j]).tolist(), strict=True)}:
        of = np.flatnonzero((wide[i] == w) & ((wide[i] < wide[j]) == twice))
        step = max(1, WORDS_AT_ONCE // w)
        for k in range(0, len(of), step):
            part = of[k : k + step]
            here = np.arange(w)
            y = at[j[part], None] + here
            x = words[at[i[part], None] + here] ^ words[y]
            out[part] = np.bitwise_count(x ^ words[y + w] if twice else x).sum(axis=1, dtype=np.int64)
    return out


def near_rows(group: np.ndarray, side: np.ndarray, root: np.ndarray, size: np.ndarray, bits: list[bytes], tenths: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i and j, and how far apart they are at least, of one unit and different roots, which sizes and bitmaps leave possible.

    ``group`` are increasing runs, a unit each.
    """
    words, wide = np.frombuffer(b"".join(bits), dtype=np.uint64), np.array([len(b) // 8 for b in bits], dtype=np.int64)
    at = np.cumsum(wide) - wide
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.repeat(np.r_[cut[1:], len(group)], np.diff(np.r_[cut, len(group)]))
    two = np.logical_or.reduceat(side != side[cut][np.cumsum(np.r_[0, group[1:] != group[:-1]])], cut)
    two = np.repeat(two, np.diff(np.r_[cut, len(group)]))
    after = ends - np.arange(len(group)) - 1
    upto, got, k = np.cumsum(after), [], 0
    while k < len(group):
        # Rows from k on that have WORDS_AT_ONCE later rows in their units together, one row at least.
        to = max(k + 1, int(np.searchsorted(upto, upto[k] - after[k] + WORDS_AT_ONCE, "right")))
        n = after[k:to]
        i = np.repeat(np.arange(k, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        few, many = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        some = (root[i] != root[j]) & (10 * few >= tenths * many) & ~(two[i] & (side[i] == side[j]))
        i, j = i[some], j[some]
        apart = _apart_at(words, at, wide, i, j)
        near = (10 + tenths) * apart <= (10 - tenths) * (size[i] + size[j])
        got.append((i[near], j[near], apart[near]))
        k = to
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def nearest_forest(n: int, i: np.ndarray, j: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Indices of the links (i, j) between ``n`` rows that are a spanning forest of all, the least by ``order`` (last key first)."""
    rank, label, got = np.lexsort(order), np.arange(n), []
    a, b, at = i[rank], j[rank], np.arange(len(i))
    while True:
        x, y = label[a[at]], label[b[at]]
        other = x != y
        at, x, y = at[other], x[other], y[other]
        if not len(at):
            return rank[np.concatenate(got)] if got else rank[:0]
        least = np.full(n, len(i))
        np.minimum.at(least, x, at)
        np.minimum.at(least, y, at)
        least = np.unique(least[least < len(i)])
        got.append(least)
        moved = forest(n, np.stack([label[a[least]], label[b[least]]], axis=1))
        to = np.arange(n)
        to[moved[:, 0]] = moved[:, 1]
        label = to[label]


def similar_rows(i: np.ndarray, j: np.ndarray, root: np.ndarray, own: list[np.ndarray], tenths: int) -> list[tuple[int, int]]:
    """Of the pairs (i, j) of rows with sets ``own``, similar ones that join the roots as all similar ones do."""
    label, got = np.unique(root, return_inverse=True)[1], []
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    size = np.array([len(x) for x in own], dtype=np.int64)
    k = 0
    while k < len(i):
        # The next pairs of one row i, of SET_MEMBERS members of the others together, one pair at least.
        to = int(np.searchsorted(i, i[k], "right"))
        to = k + max(1, int(np.searchsorted(np.cumsum(size[j[k:to]]), SET_MEMBERS, "right")))
        a, others = int(i[k]), j[k:to]
        others, k = others[label[others] != label[a]], to
        if not len(others):
            continue
        x = np.concatenate([own[b] for b in others])
        at = np.minimum(np.searchsorted(own[a], x), len(own[a]) - 1)
        common = np.add.reduceat((own[a][at] == x).astype(np.int64), np.cumsum(size[others]) - size[others])
        for b in others[10 * common >= tenths * (size[a] + size[others] - common)].tolist():
            if label[a] != label[b]:
                got.append((a, b))
                label[label == label[b]] = label[a]
    return got


def _by_unit(rows):
    """An Arrow pass over rows sorted by (key, x, y): ``rows`` gets whole units and their numbers, increasing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if not len(held):
                continue
            unit = np.stack([held.column(c).to_numpy() for c in ("key", "x", "y")], axis=1)
            group = np.cumsum(np.r_[False, (unit[1:] != unit[:-1]).any(axis=1)])
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield rows(held.slice(0, whole), group[:whole])
                held = held.slice(whole)
        if held is not None and len(held):
            unit = np.stack([held.column(c).to_numpy() for c in ("key", "x", "y")], axis=1)
            yield rows(held, np.cumsum(np.r_[False, (unit[1:] != unit[:-1]).any(axis=1)]))

    return run


def _columns(t: pa.Table) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in ("side", "node", "root")]


def _joining(tenths: int):
    """An Arrow pass over units: a spanning forest of the rows that sizes and bitmaps leave possible, of the nearest.

    Of pairs as near the first in an order by hash is taken, so that the units of
    several keys take the same ones.
    """

    def pairs(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        side, node, root = _columns(t)
        i, j, apart = near_rows(group, side, root, t.column("size").to_numpy(), t.column("bits").to_pylist(), tenths)
        mixed = node.view(np.uint64) * _FACTORS[0]
        some = nearest_forest(len(node), i, j, (np.maximum(mixed[i], mixed[j]), np.minimum(mixed[i], mixed[j]), apart))
        u, v = np.maximum(node[i[some]], node[j[some]]), np.minimum(node[i[some]], node[j[some]])
        once = np.unique(np.stack([u, v], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["u", "v"])

    return _by_unit(pairs)


def _possible(tenths: int):
    """An Arrow pass over units: the rows to which sizes and bitmaps leave a similar one of another root possible."""

    def some(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        side, _, root = _columns(t)
        i, j, _ = near_rows(group, side, root, t.column("size").to_numpy(), t.column("bits").to_pylist(), tenths)
        at, names = np.unique(np.r_[i, j]), ["key", "node", "root", "size"]
        return pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[at]) for c in names], names=names)

    return _by_unit(some)


def _linking(tenths: int):
    """An Arrow pass over units with whole sets: links (u, v) of similar sets that join the roots as all of the units' do."""

    def pairs(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        side, node, root = _columns(t)
        lists = t.column("own").combine_chunks()
        cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        own = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        i, j, _ = near_rows(group, side, root, np.diff(cuts).astype(np.int64), [parity(x) for x in own], tenths)
        got = np.array(similar_rows(i, j, root, own, tenths), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[got[:, 0]]), pa.array(node[got[:, 1]])], names=["u", "v"])

    return _by_unit(pairs)


def _similar(nodes: DataFrame, units: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, tenths: int) -> DataFrame:
    """(node, root) of nodes that a chain of similar sets joins.

    Fingerprints of similar sets differ in about ten bits, beyond any budget that
    the trie join can prune by, so a set is also known by keys: the bands of a
    signature of minima. Links of the trie join, and of each key a spanning forest
    of the nodes that are near by sizes and bitmaps, are verified first. Then every
    two nodes of a key that are still in different components are compared by sizes
    and bitmaps, which never tell similar sets apart. To the nodes that have a
    possible partner go their whole sets, and each two of them in a key are compared
    again, on the sets where need be; of the links found there a spanning forest is
    given. So no pair of similar sets that shares a key stays apart, however many
    nodes the key has, and a unit gives a row for each of its nodes at most.
    """
    n, unit = shuffle_partitions(docs.sparkSession), ["key", "x", "y"]
    firsts = materialise(nodes.groupBy("fp").agg(F.min("node").alias("v")))
    near = links(firsts.select("fp"))
    by_print = near.join(firsts.select(F.col("fp").alias("u"), F.col("v").alias("a")), "u").join(firsts.select(F.col("fp").alias("v"), F.col("v").alias("b")), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    same_print = nodes.join(firsts, "fp").filter("node > v").select(F.col("node").alias("u"), "v")
    more = _hopeful(by_print.union(same_print), nodes, tenths)

    def met(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*unit, "side", "node", "root", *more).repartition(n, *unit).sortWithinPartitions(*unit)

    known = nodes.select("node", "size", "bits")
    first = met(units.withColumn("root", F.col("node")).join(known, "node"), "size", "bits").mapInArrow(_joining(tenths), "u bigint, v bigint")
    joined = components(_verified(first.union(more), nodes, docs, id_col, text_col, width, tenths))
    del near, by_print, same_print, more, first
    release(docs.sparkSession)
    rooted = materialise(units.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = rooted.groupBy(unit).agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select(unit)
    apart = met(rooted.join(several, unit, "left_semi").join(known, "node"), "size", "bits").mapInArrow(_possible(tenths), "key bigint, node bigint, root bigint, size bigint")
    apart = materialise(apart.distinct())
    if apart.isEmpty():
        return joined
    sets = _whole_sets(apart.select("node").distinct(), nodes, docs, id_col, text_col, width)
    found = met(_units(apart, members=SET_MEMBERS).join(sets, "node"), "own").mapInArrow(_linking(tenths), "u bigint, v bigint")
    found = materialise(found.distinct())
    if found.isEmpty():
        return joined
    return components(found.union(joined.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, tenths: int = TENTHS) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``: that of the least id.

    Near are texts whose sets of ``width``-word shingles have a Jaccard
    similarity of ``tenths`` / 10 or more; every link is verified on the sets. How
    candidates are found is told at ``_similar``. Texts without words have one
    set, the empty one.

    Ids may repeat or be null: a row is told by its id and set, and of rows alike
    in both, one stays. Rows are chosen by two bitmaps of ids, so texts are not
    shuffled, but for the few that both hold: these are told apart exactly.
    """
    small_batches(docs)
    prints = materialise(_sets(docs, id_col, text_col, width))
    attributes = [F.first(c).alias(c) for c in ("fp", "size", "bits", "keys")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))).alias("s")
    whole = materialise(prints.groupBy("node").agg(least, *attributes).select("node", "s.*", "fp", "size", "bits", "keys"))
    prints = materialise(prints.select("doc_id", "node"))
    nodes = materialise(whole.drop("keys"))
    units = _units(whole.select("node", "size", F.explode("keys").alias("key")))
    del whole
    release(docs.sparkSession)
    roots = _similar(nodes, units, docs, id_col, text_col, width, tenths)
    del units
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min(F.struct("z", "id", "node")).alias("s")).select(F.col("s.id").alias("id"), "s.node", F.lit(True).alias("kept"))

    # All rows by id and set; what is not kept once is in doubt.
    rows = prints.groupBy("doc_id", "node").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", "id")
    marked = rows.join(best, rows["id"].eqNullSafe(best["id"]) & (rows["node"] == best["node"]), "left")
    marked = materialise(marked.select(rows["id"], rows["node"], "n", F.coalesce("kept", F.lit(False)).alias("kept")))
    doubt = materialise(marked.filter("not kept or n > 1"))
    # Of ids that the bitmap of doubtful ones holds, few are kept all the same: only their texts are shuffled.
    still = materialise(marked.filter("kept").filter((F.col("n") > 1) | _held(doubt, F.col("id"))))
    in_doubt = _held(doubt, docs[f"`{id_col}`"])
    sure = docs.filter(~in_doubt)
    if still.isEmpty():
        return sure
    name, own, node = (fresh(x, docs) for x in ("__print", "__kept", "__node"))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_node(shingles(t, width)) for t in texts.cast(pa.binary()).to_pylist()], type=pa.int64())

    rest = materialise(docs.filter(in_doubt & _held(still, docs[f"`{id_col}`"])))
    rest = rest.withColumn(name, F.arrow_udf(run, "bigint")(F.col(f"`{text_col}`")))
    keys = still.select(F.col("id").alias(own), F.col("node").alias(node))
    rest = rest.join(keys, rest[f"`{id_col}`"].eqNullSafe(keys[own]) & (rest[name] == keys[node])).dropDuplicates([own, node])
    return sure.unionByName(rest.select(*own_columns(docs)))
