"""Mixing sources to target weights by capped water-filling.

Targets: every source gets ``weight`` shares of ``budget`` times all words. A
source whose share exceeds ``epochs`` times its size is clamped there and the
excess is dealt again by weight, until no source is above. Sources stand in the
order of cap / weight, in which they reach their caps: running sums of caps and
weights give the level of the water in one pass, however many rounds the dealing
would take.

Samples: a source with target t and size s repeats every document floor(t / s)
times and, for the rest, a seeded sample of whole documents. Documents stand in
the order of a hash (60 bits of an MD5 of seed, id and text), and the sample is a
prefix of that order whose words come nearest the rest. Large and small documents
(over and up to half the source's mean size) have a prefix each: small ones make
good what the last large one missed, so a source ends near its target however
uneven its documents are. The prefix's end is found by sums over 4,096 hash
buckets, then over 4,096 buckets of the one where it lies, so a source of any
size is never sorted in one task. The decision of a row is then ``hash < cut``,
and a small table of cuts by source is joined: broadcast up to ``BROADCAST_ROWS``
sources, by a shuffled join beyond.

Equal rows share a hash. Where several stand at the cut, as many of them as come
nearest the rest are taken: they are numbered within the parts of a materialised
table, so no group of copies is gathered in one task.

Defined results for odd input: null and word-less texts have size 0, take 0 and
are repeated as whole epochs only; a null source is a source of its own, last in
order; a source of size 0 has target 0 and gives no rows to the mix; which of
several rows alike in id and text are taken is left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import WORD, fresh, materialise, own_columns, shuffle_partitions

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
SEED = 17
BROADCAST_ROWS = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def _hash(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits that no rerun or partitioning changes."""
    part = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("z"))
    return F.conv(F.substring(F.md5(F.concat_ws(chr(31), F.lit(str(seed)), part(doc_id), part(text))), 1, 15), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """Sorts as the source does by code point, with null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("z"))


def _with_parts(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    c = lambda name: docs[f"`{name}`"]
    return [
        _key(c(source_col)).alias("k"),
        F.when(c(text_col).isNull(), F.lit(0)).otherwise(size_of(c(text_col))).cast("long").alias("size"),
        _hash(c(id_col), c(text_col), seed).alias("u"),
    ]


def _running(rows: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with ``<name>_before``, the sum of each of ``sums`` over the rows before, without one task that sorts all."""
    ranged = materialise(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("p", F.spark_partition_id()))
    offsets, total = {name: [] for name in sums}, dict.fromkeys(sums, 0)
    for row in ranged.groupBy("p").agg(*(F.sum(name).alias(name) for name in sums)).orderBy("p").collect():  # a row for each partition
        for name in sums:
            offsets[name] += [F.lit(row.p), F.lit(total[name])]
            total[name] += row[name]
    within = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for name in sums:
        before = F.coalesce(F.sum(name).over(within), F.lit(0))
        ranged = ranged.withColumn(f"{name}_before", F.element_at(F.create_map(*offsets[name]), F.col("p")) + before if offsets[name] else before)
    return ranged.drop("p")


def targets(per: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS) -> DataFrame:
    """(k, s, n, target) from the sources' sizes (k, s, n)."""
    placed = _running(per.select("k", "s", "n", F.lit(1).cast("long").alias("one")), ["k"], ["one"])
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("one_before") % len(weights) + 1).cast("int"))
    cap = F.col("s") * float(epochs)
    table = materialise(placed.select("k", "s", "n", w.alias("w"), cap.alias("cap"), (cap / w).alias("ratio")))
    all_words, shares = table.agg(F.sum("s"), F.sum("w")).first()
    # The first source, in order, whose share would stay below its cap; none: all are clamped.
    share = (F.lit(budget * (all_words or 0)) - F.col("cap_before")) / (F.lit(shares or 1.0) - F.col("w_before"))
    level = _running(table, ["ratio", "k"], ["cap", "w"]).select("ratio", "k", share.alias("level")).filter("level < ratio").agg(F.min(F.struct("ratio", "k", "level")).alias("x")).first().x
    clamped = F.col("cap") if level is None else F.least("cap", F.lit(level.level) * F.col("w"))
    return table.select("k", "s", "n", clamped.alias("target"))


def _cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(k, cut, some, many, took): hashes below ``cut`` are taken, and ``some`` of the ``many`` rows at it; ``took``: their words. For goals (k, g)."""

    def edge(rows: DataFrame, bucket: Column) -> DataFrame:
        sums = rows.groupBy("k", "g", bucket.alias("b")).agg(F.sum("size").alias("x"))
        upto = F.sum("x").over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        first = F.min(F.struct("b", F.col("before"))).alias("e")
        return sums.withColumn("upto", upto).filter("upto > g").withColumn("before", F.col("upto") - F.col("x")).groupBy("k", "g").agg(first)

    one = F.shiftright("u", 48)
    two = F.shiftright("u", 36)
    rows = rows.join(_hinted(goals), "k")
    e1 = edge(rows, one).select("k", F.col("e.b").alias("b1"), (F.col("g") - F.col("e.before")).alias("g"), F.col("e.before").alias("done"))
    e1 = materialise(e1)
    in1 = rows.drop("g").join(_hinted(e1), "k").filter(one == F.col("b1"))
    e2 = edge(in1.drop("b1", "done"), two)
    e2 = materialise(e2.join(_hinted(e1.select("k", "done")), "k").select("k", F.col("e.b").alias("b2"), (F.col("g") - F.col("e.before")).alias("g"), (F.col("done") + F.col("e.before")).alias("done")))
    in2 = rows.drop("g").join(_hinted(e2), "k").filter(two == F.col("b2"))
    sums = in2.groupBy("k", "g", "done", "u").agg(F.sum("size").alias("x"), F.count("*").alias("many"))
    before = F.sum("x").over(Window.partitionBy("k").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)) - F.col("x")
    # The hash where the goal is passed; of rows alike, those whose middle is not beyond it are taken.
    at = sums.withColumn("before", before).filter("before <= g and before + x > g").withColumn("each", F.col("x") / F.col("many"))
    some = F.floor((F.col("g") - F.col("before")) / F.col("each") + 0.5).cast("long")
    return at.select("k", F.col("u").alias("cut"), some.alias("some"), "many", (F.col("done") + F.col("before") + some * F.col("each").cast("long")).alias("took"))


def _hinted(small: DataFrame) -> DataFrame:
    """Broadcast if it is at most ``BROADCAST_ROWS`` rows of a few numbers; else Spark joins by shuffle."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


ALL = 1 << 60


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Materialised (doc_id, k, size, u): what the plan needs of every row, without its text."""
    return materialise(docs.select(docs[f"`{id_col}`"].alias("doc_id"), *_with_parts(docs, id_col, text_col, source_col, seed)))


def plan(rows: DataFrame, **how) -> DataFrame:
    """A row for each source: k, s, n, target, whole repeats, and for large and small documents cut, some and many; ``rows`` as ``_sized`` gives them."""
    per = rows.groupBy("k").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    goals = targets(per, **how)
    whole = F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(0).cast("long")
    goals = materialise(goals.withColumn("whole", whole).withColumn("g", F.col("target") - F.col("whole") * F.col("s")))
    # Documents without words have no share in a rest.
    rows = rows.filter("size > 0").join(_hinted(goals.select("k", "s", "n")), "k")
    large, small = (rows.filter(_large() if x else ~_large()).select("k", "size", "u") for x in (True, False))

    mass = large.groupBy("k").agg(F.sum("size").alias("mass"))
    first = materialise(goals.join(mass, "k").select("k", (F.col("g") * F.col("mass") / F.col("s")).alias("g"), "mass"))
    cut_large = materialise(_cuts(large, first.select("k", "g")))
    # No cut for a source means that its goal takes every large document.
    took = first.join(cut_large.select("k", "took"), "k", "left").select("k", F.coalesce("took", "mass").alias("took"))
    second = goals.join(took, "k", "left").select("k", F.greatest(F.lit(0.0), F.col("g") - F.coalesce("took", F.lit(0))).alias("g"))
    cut_small = _cuts(small, materialise(second))
    out = goals.select("k", "s", "n", "target", "whole", "g")
    for name, cuts in (("large", cut_large), ("small", cut_small)):
        # Where nothing is left to take, a source without a cut takes nothing.
        whole_range = F.when(F.col("g") > 0, F.lit(ALL)).otherwise(F.lit(-1)).cast("long")
        own = F.struct(F.coalesce("cut", whole_range).alias("cut"), F.coalesce("some", F.lit(0)).cast("long").alias("some"), F.coalesce("many", F.lit(0)).cast("long").alias("many"))
        out = out.join(cuts, "k", "left").withColumn(name, own).drop("cut", "some", "many", "took")
    return materialise(out.drop("g"))


def _large() -> Column:
    return F.col("size") * F.col("n") * 2 > F.col("s")


def _cut() -> Column:
    return F.when(_large(), F.col("large")).otherwise(F.col("small"))


def _copies() -> Column:
    """How often a row is taken; ``nth`` numbers the rows at a cut from 0."""
    own = _cut()
    more = (F.col("size") > 0) & ((F.col("u") < own["cut"]) | ((F.col("u") == own["cut"]) & (F.col("nth") < own["some"])))
    return F.col("whole") + more.cast("long")


def _numbered(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (k, size, u, ...) with their source's plan and ``nth``.

    Rows alike at a cut are numbered within the parts of a materialised table,
    and the parts by running sums, so a group of any size is dealt over tasks.
    """
    joined = rows.join(_hinted(cuts), "k")
    several = (F.col("large.many") > 1) | (F.col("small.many") > 1)
    if cuts.filter(several).isEmpty():
        return joined.withColumn("nth", F.lit(0).cast("long"))
    own = _cut()
    tied = (F.col("size") > 0) & (F.col("u") == own["cut"]) & (own["many"] > 1)
    ties = materialise(joined.filter(tied)).withColumn("p", F.spark_partition_id())
    counts = ties.groupBy("k", "u", "p").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("k", "u").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(counts.select("k", "u", "p", before.alias("before")))
    within = F.row_number().over(Window.partitionBy("k", "u", "p").orderBy(F.lit(0))) - 1
    nth = ties.withColumn("within", within).join(_hinted(offsets), ["k", "u", "p"]).withColumn("nth", (F.col("within") + F.col("before")).cast("long"))
    return joined.filter(~tied).withColumn("nth", F.lit(0).cast("long")).unionByName(nth.drop("p", "within", "before"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for each row of ``docs``."""
    rows = _sized(docs, id_col, text_col, source_col, seed)
    return _numbered(rows, plan(rows, **how)).select(
        "doc_id", "size", F.col("s").alias("source_size"), "target", (F.col("size") * _copies()).alias("taken"), _copies().alias("copies")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    cuts = plan(_sized(docs, id_col, text_col, source_col, seed), **how)
    own = fresh("__own", docs)
    rows = docs.select(F.struct(*own_columns(docs)).alias(own), *_with_parts(docs, id_col, text_col, source_col, seed))
    repeated = _numbered(rows, cuts).select(own, F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))))
    return repeated.select(f"{own}.*")
