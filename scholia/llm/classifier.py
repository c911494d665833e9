"""A quality classifier: an additive model of feature tables and pairwise tables.

Features are numbers of the whole text alone. Each is cut into bins at quantiles
of the training rows. Boosting goes round the features in turn: a shallow tree on
one feature's bins, fitted to the current gradients, adds its leaf values to the
feature's lookup table. The strongest pairs, found on the residuals, then get
two-dimensional tables the same way. A score is the logistic of an intercept
plus one table entry for each feature and pair: integer lookups and additions.

Fitting takes at most ``max_rows`` labelled rows (a documented bound; the least
by a hash of the id), so what reaches the driver is bounded. Scoring streams all
texts through one Arrow function, without a shuffle; the model is a few KB.

Defined results for odd input: null text counts as empty and gets a score like
any other; labels with a null id or quality are ignored; several labels of one
id count as their mean, from one half on as 1; without training rows, or with
one class only, the score is the smoothed share of class 1; repeated rows give
a row each; other columns are never read by a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import own_columns, small_batches

MAX_ROWS = 20_000
THRESHOLD = 0.7

FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "upper", "digits", "symbols", "punctuation", "marks", "spaces", "lines_per_word",
    "mean_line", "dup_lines", "distinct_words", "top_word", "repeat_triples", "pipes", "exclamations", "non_ascii", "sentence_words",
    "one_letter_words", "symbol_words", "compressed", "commas", "upper_words",
)

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 other punctuation, 6 space, 7 non-ASCII lead, 8 non-ASCII rest
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[192:], _KIND[128:192] = 1, 2, 3, 7, 8
_KIND[list(b"#*$%&|<>@^~_=+/\\{}[]")] = 4
_KIND[list(b".,;:!?'\"()-`")] = 5
_KIND[_SPACES] = 6
#: Blocks of words for which the distinct share is taken, so that it does not fall with length alone.
_BLOCK = 400


def features(text: bytes | None) -> list[float]:
    text = text or b""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=9)
    chars = max(float(len(text) - kinds[8]), 1.0)
    letters = max(kinds[1] + kinds[2] + kinds[7], 1.0)
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    starts = range(0, max(len(words), 1), _BLOCK)
    blocks = [words[k : k + _BLOCK] for k in starts]
    distinct = sum(len(set(b)) for b in blocks)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    triples = [*zip(words, words[1:], words[2:], strict=False)]
    ends = counts[46] + counts[33] + counts[63]
    stripped = [w[-3:] for w in words]
    symbol_words = sum(1 for w in stripped if w[-1] in b"#*$%&|<>")
    return [
        np.log1p(chars), np.log1p(len(words)), float(lengths.mean()), float((lengths > 15).mean()), kinds[1] / letters, kinds[3] / chars,
        kinds[4] / chars, kinds[5] / chars, float(counts[33] + counts[63]) / n, kinds[6] / chars, len(lines) / n,
        np.log1p(chars / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), distinct / n, max(seen.values(), default=0) / n,
        1 - len(set(triples)) / max(len(triples), 1), counts[124] / n, counts[33] / n, kinds[7] / chars, np.log1p(n / (ends + 1.0)),
        float((lengths == 1).mean()), symbol_words / n, len(zlib.compress(text, 1)) / max(len(text), 1), counts[44] / n,
        sum(1 for w in words if w.isupper()) / n,
    ]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin of a feature -> coarse bin
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, ridge: float) -> np.ndarray:
    """Leaf values over the bins of a shallow tree: the best splits of an ordered axis, greedily."""
    G, H, N = (np.r_[0.0, np.cumsum(v)] for v in (g, h, n))
    cuts = [0, len(g)]
    value = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    while len(cuts) <= leaves:
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = value(a, m) + value(m, b) - value(a, b)
            gain[(N[m] - N[a] < least) | (N[b] - N[m] < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], int(m[k])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 80, rate: float = 0.2, pairs: int = 6, pair_rounds: int = 20, ridge: float = 2.0) -> Model:
    """Cyclic boosting of one-feature trees, then of tables on the strongest pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    width = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Model(intercept, [np.empty(0)] * width, [np.zeros(1)] * width)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for j in range(width)]
    model = Model(intercept, edges, [np.zeros(len(e) + 1) for e in edges])
    b = model.bins(x)
    least = max(2, min(20, len(y) // 50))
    total = np.full(len(y), intercept)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            g, h = (np.bincount(b[:, j], weights=v, minlength=len(table)) for v in (y - p, p * (1 - p)))
            step = rate * _tree(g, h, np.bincount(b[:, j], minlength=len(table)), 3, least, ridge)
            table += step
            total += step[b[:, j]]
    size = 6
    model.coarse = [np.minimum(np.arange(len(t)) * size // max(len(t), 1), size - 1) for t in model.tables]
    c = np.stack([model.coarse[j][b[:, j]] for j in range(width)], axis=1)
    p = 1 / (1 + np.exp(-total))
    gains = []
    for i in range(width):
        for j in range(i):
            cell = c[:, i] * size + c[:, j]
            g, h = (np.bincount(cell, weights=v, minlength=size * size) for v in (y - p, p * (1 - p)))
            gains.append((float((g**2 / (h + ridge)).sum()), j, i))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((size, size)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            cell = c[:, i] * size + c[:, j]
            g, h = (np.bincount(cell, weights=v, minlength=size * size) for v in (y - p, p * (1 - p)))
            step = rate * 0.5 * (g / (h + 4 * ridge)).reshape(size, size)
            table += step
            total += step[c[:, i], c[:, j]]
    return model


def feature_column(text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.cast(pa.binary()).to_pylist()], type=pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(text)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows (id, y): the least by a hash of the id, an even sample."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    one = known.filter(~held_out(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    return one.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    small_batches(docs)
    sample = training_labels(labels, label_col, max_rows)
    # At most max_rows pairs of numbers are broadcast: texts need no shuffle to meet their labels.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "id")
    # Repeated ids could pass the bound: one row for each id stays, the least by its features.
    found = rows.select("id", "y", feature_column(F.col("t")).alias("x")).groupBy("id").agg(F.min(F.struct("x", "y")).alias("s")).select("id", "s.*")
    got = found.toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable") if got.num_rows else np.empty(0, dtype=np.int64)
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))[order]
    return fit(x, got.column("y").to_numpy().astype(float)[order])


def score_column(model: Model, text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in texts.cast(pa.binary()).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        return pa.array(model.scores(x), type=pa.float64())

    return F.arrow_udf(run, "double")(text)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    small_batches(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), score_column(model, F.col(text_col)).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; texts stay in the JVM."""
    small_batches(docs)
    return docs.filter(score_column(model, docs[f"`{text_col}`"]) >= threshold).select(*own_columns(docs))
