"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` adds document statistics as plain column expressions and
``compile_rules`` turns a table of (measure, lower bound, upper bound) rows into
one array of the names of failed rules. Nothing leaves the JVM: there is no
shuffle, no join and no user function, so the cost is one scan.

Defined results for odd input
-----------------------------
* null text counts as empty: every measure is 0 and the length rule fails;
* ratios over nothing are 0;
* repeated rows and repeated ids give one result row each;
* columns of the input with the names of measures are not read: the projection
  takes only ``id_col`` and ``text_col``, under internal names.

Repeated 5-word windows are found through 64-bit hashes of the windows, chained
word by word. A text whose windows are all distinct (nearly every text) costs
one hash-set pass; the others sort (hash, position) pairs, so a long text costs
n log n and never a quadratic search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import SPACE, WORD

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = sorted(
    set(
        "the of and to in a is that it was for on with as by at be this are from or an he not have which but they you his her we were had has all their there been one can if"
        " le la les un une des du et est en que qui dans pour par sur au aux avec ce il elle pas plus ne se son sa ses ou"
        " der die das den dem ein eine und ist von zu mit auf für nicht als auch es an werden aus er sie bei"
        " el los las una y es del por con para se su al lo como más pero sus o este esta".split()
    )
)

STOPS = sorted({*STOP_WORDS, *(w.title() for w in STOP_WORDS)})


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The contract's base failure; the verdict's own rules follow in ``VERDICT``.
BASE = (
    Rule("too_few_words", "n_words", least=10),
    Rule("repeated_windows", "repeat_percent", most=20),
)

VERDICT = (
    Rule("word_length", "mean_word_length", least=2, most=14),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("letters", "letter_ratio", least=0.6),
    Rule("shouting", "upper_ratio", most=0.5),
    Rule("stop_words", "stop_word_ratio", least=0.05),
    Rule("dup_lines", "dup_line_ratio", most=0.3),
    Rule("bullet_lines", "bullet_line_ratio", most=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", most=0.3),
)


def _kept_length(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def _over(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _element(array: Column, index: Column) -> Column:
    return F.get(array, index)


def _window_hashes(words: Column) -> Column:
    """64-bit hashes of all 5-word windows; () for fewer words.

    Hashes of 1, 2, 4 and 5 words are built from one another by zipping an array
    with its own tail, which costs four passes and no index lookups.
    """

    def bound(array: Column, f) -> Column:
        # Binds an intermediate array once: transform over a one-element array.
        return F.element_at(F.transform(F.array(array), f), 1)

    def zipped(a: Column, b: Column, size: Column, skip: int) -> Column:
        return F.zip_with(F.slice(a, 1, size), F.slice(b, skip + 1, size), lambda x, y: F.xxhash64(x, y))

    def over(one: Column) -> Column:
        n = F.size(one)
        return bound(
            zipped(one, one, n - 1, 1),
            lambda two: bound(zipped(two, two, n - 3, 2), lambda four: zipped(four, one, n - 4, 4)),
        )

    return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        bound(F.transform(words, lambda w: F.xxhash64(w)), over)
    )


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: the union of [i, i+5)."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # The sorted pairs are bound once, as a one-element array, and not evaluated again per element.
    flagged = F.flatten(
        F.transform(
            F.array(pairs),
            lambda p: F.transform(
                F.filter(
                    p,
                    lambda x, k: (F.coalesce(_element(p, k - 1)["h"] == x["h"], F.lit(False)) & (k > 0))
                    | F.coalesce(_element(p, k + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            ),
        )
    )
    # Over sorted starts, each window adds what reaches past the one before it.
    return F.aggregate(
        F.sort_array(flagged),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW).cast("long"), i - acc["last"])).cast("long").alias("n"), i.cast("long").alias("last")
        ),
        lambda acc: acc["n"],
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` as ``doc_id`` and every measure, one row for each row of ``docs``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    split = base.select(
        "doc_id",
        "__t",
        F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)).alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("__l"),
    )
    w = F.col("__w")
    hashed = split.select(
        "*",
        F.size("__w").cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("__n_lines"),
        _window_hashes(w).alias("__h"),
    )
    n = F.col("n_words")
    chars = F.length(F.array_join("__w", "")).cast("long")
    counted = hashed.select(
        "doc_id",
        "n_words",
        "__n_lines",
        chars.alias("word_chars"),
        _kept_length(F.col("__t"), f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.lit(0).cast("long"))
        .otherwise(_repeated_words(F.col("__h")))
        .alias("n_repeat_words"),
        _kept_length(F.col("__t"), r"\P{L}+").cast("long").alias("__letters"),
        _kept_length(F.col("__t"), "[^A-Z]+").cast("long").alias("__upper"),
        F.size(F.filter("__w", lambda x: x.isin(STOPS))).cast("long").alias("__stops"),
        F.size(F.filter("__l", lambda x: x.rlike(rf"^[{SPACE}]*[-*•]"))).cast("long").alias("__bullets"),
        F.size(F.filter("__l", lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE}]*$"))).cast("long").alias("__ellipses"),
    )
    lines = F.col("__n_lines")
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        _over(F.col("word_chars"), n).alias("mean_word_length"),
        _over(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        _over(F.col("__letters"), F.col("word_chars")).alias("letter_ratio"),
        _over(F.col("__upper"), F.col("__letters")).alias("upper_ratio"),
        _over(F.col("__stops"), n).alias("stop_word_ratio"),
        _over(F.col("n_dup_lines"), lines).alias("dup_line_ratio"),
        _over(F.col("__bullets"), lines).alias("bullet_line_ratio"),
        _over(F.col("__ellipses"), lines).alias("ellipsis_line_ratio"),
        # Exact in integers: over 20 just when 100 * repeats > 20 * words.
        _over(100 * F.col("n_repeat_words"), n).alias("repeat_percent"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """An array of the names of the rules that fail, in the table's order."""
    failed = []
    for rule in rules:
        if rule.least is not None:
            failed.append(F.when(F.col(rule.measure) < rule.least, F.lit(rule.name)))
        if rule.most is not None:
            failed.append(F.when(F.col(rule.measure) > rule.most, F.lit(rule.name)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = VERDICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed``, ``failed_rules`` and ``kept`` for each row."""
    measured = measures(docs, id_col, text_col)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.select("*", base.alias("base_failed"), compile_rules(rules).alias("failed_rules")).select(
        "*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept")
    )
