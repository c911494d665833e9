"""Which comments are new: multiset anti-joins, exact and fuzzy.

Comments carry (file_ord, comment_ord), their place in the whole run; of equal
comments the earlier ones use up the old ones. A pool is a multiset of old norms:
(norm, n, pool_ord), where pool_ord tells which one is tried first.
"""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators.lineage import materialise

PLACE = ("file_ord", "comment_ord")


def norms(old: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The multiset of old norms in each group: (*keys, norm, n, first)."""
    return old.groupBy(*keys, "norm").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first"))


#: Files whose comments are ranked together where the whole run is one group.
SPAN = 1024


def _ranked(new: DataFrame, on: list[str], spread: bool) -> DataFrame:
    """``new`` with the rank ``nth`` of each row among those with equal ``on``, in order of place.

    ``spread``: a group may reach over all files. It is then ranked in spans of
    files, plus the rows of the spans before, so that no task sorts a whole group.
    """
    if not spread:
        return new.withColumn("nth", F.row_number().over(Window.partitionBy(*on).orderBy(*PLACE)))
    rows = new.withColumn("span", F.floor(F.col("file_ord") / SPAN).cast("long"))
    before = Window.partitionBy(*on).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*on, "span").agg(F.count("*").alias("k"))
    offsets = sums.select(*on, "span", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*on, "span").orderBy(*PLACE))
    return rows.withColumn("within", within).join(offsets, [*on, "span"]).withColumn("nth", F.col("within") + F.col("before")).drop("span", "within", "before")


def consume(new: DataFrame, pool: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(new rows that no old one is left for, the pool with what is left of it).

    A multiset difference that keeps row identity: the k-th of equal rows, in
    order of place, is covered if the pool holds k of them. Rows without any old
    one are not ranked.
    """
    on = [*keys, "norm"]
    counts = pool.select(*on, "n")
    met = _ranked(new.join(counts, on, "left_semi"), on, not keys)
    left = met.join(counts, on).filter(F.col("nth") > F.col("n")).select(*new.columns).unionByName(new.join(counts, on, "left_anti").select(*new.columns))
    used = new.groupBy(*on).agg(F.count("*").alias("used"))
    rest = pool.join(used, on, "left").withColumn("n", F.col("n") - F.coalesce("used", F.lit(0))).filter("n > 0").drop("used")
    return left, rest


def merged(*pools: DataFrame) -> DataFrame:
    """One pool of (norm, n, pool_ord) rows: counts add up, the first place of a norm stays its place."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out.groupBy("norm").agg(F.sum("n").alias("n"), F.min("pool_ord").alias("pool_ord"))


def similar(new: str, old: str, threshold: float) -> bool:
    """Sequence similarity, after two cheap upper bounds of it."""
    a, b = len(new), len(old)
    if not a or not b or min(a, b) < max(a, b) / 2 or 2 * min(a, b) < threshold * (a + b):
        return False
    if 2 * (Counter(new) & Counter(old)).total() < threshold * (a + b):
        return False
    return SequenceMatcher(None, new, old).ratio() >= threshold


def pairs(new: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """(norm, old, pool_ord, n) of distinct new norms and similar pool norms.

    Norms as similar as that have lengths within a fixed ratio, so both sides are
    dealt by bands of length, new ones to three bands: an equi-join, no cross join.
    """
    ratio = max(0.5, threshold / (2 - threshold)) if 0 < threshold < 2 else 0.5
    width = math.log(1 / ratio) if ratio < 1 else 1e-9
    band = lambda c: F.floor(F.log(F.length(c).cast("double")) / F.lit(width)).cast("long")
    left = new.select("norm").distinct().filter("norm <> ''").select("norm", F.explode(F.sequence(band("norm") - 1, band("norm") + 1)).alias("band"))
    right = pool.filter("norm <> ''").select(F.col("norm").alias("old"), "pool_ord", "n", band("norm").alias("band"))

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similar(x, y, threshold) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], type=pa.bool_())

    near = left.join(right, "band").filter(F.least(F.length("norm"), F.length("old")) >= ratio * F.greatest(F.length("norm"), F.length("old")) - 1e-6)
    return near.filter(F.arrow_udf(run, "boolean")(F.col("norm"), F.col("old"))).select("norm", "old", "pool_ord", "n")


def consume_fuzzy(new: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """New rows that find no similar pool entry.

    The rule is first come, first served: rows in order of place each take the
    first similar entry that has a count left. All entries prefer earlier rows,
    so this is the one stable matching, and deferred acceptance finds it in
    parallel rounds: every row asks its next entry, an entry keeps its ``n``
    earliest rows and turns the others away to ask further on.
    """
    found = materialise(pairs(new, pool, threshold))
    if found.isEmpty():
        return new
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("norm").orderBy("pool_ord")))
    rows = materialise(new.select(*PLACE, "norm").join(found.select("norm").distinct(), "norm", "left_semi").withColumn("rank", F.lit(1)))
    while True:
        asked = rows.join(ranked, ["norm", "rank"], "left")
        seat = F.row_number().over(Window.partitionBy("old").orderBy(*PLACE))
        kept = F.col("old").isNull() | (F.col("seat") <= F.col("n"))
        after = asked.withColumn("seat", seat).select(*PLACE, "norm", F.when(kept, F.col("rank")).otherwise(F.col("rank") + 1).alias("rank"), (~kept).alias("moved"))
        after = materialise(after)
        rows = after.drop("moved")
        if after.filter("moved").isEmpty():
            break
    served = rows.join(ranked.select("norm", "rank"), ["norm", "rank"], "left_semi").select(*PLACE)
    return new.join(served, list(PLACE), "left_anti")
