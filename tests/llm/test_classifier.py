from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from scholia.llm import classifier as C


def corpus(n, seed=6):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "of", "the", "delta", "to", "epsilon"]
    texts, labels = [], []
    for _ in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        texts.append(" ".join(w) + "." if good else " ".join(x.upper() + rng.choice(["!!", "###", "%%"]) for x in w))
        labels.append(int(good))
    return texts, labels


def brute_score(m, row):
    b = [sum(1 for e in edges if e <= v) for edges, v in zip(m.edges, row, strict=True)]
    total = m.intercept + sum(t[k] for t, k in zip(m.tables, b, strict=True))
    total += sum(t[m.coarse[i][b[i]]][m.coarse[j][b[j]]] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
    return 1 / (1 + np.exp(-total))


def test_held_out_rows_are_told_apart_and_scores_are_sums_of_table_entries(spark, docs):
    texts, labels = corpus(600)
    df = docs(texts, extra=("score", "predicted", "quality"))
    rows = [(i, y) for i, y in enumerate(labels)] + [(None, 1), (3, None)]
    lab = spark.createDataFrame(rows, "doc_id bigint, quality int")
    model = C.train(df, lab)
    got = C.scored(df, model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in got[:40]:
        assert r.score == pytest.approx(brute_score(model, C.features(texts[r.doc_id].encode())), abs=1e-9)
    kept = C.accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_held_out_labels_change_nothing(spark, docs):
    texts, labels = corpus(120)
    df = docs(texts)
    out = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))]
    flipped = [1 - y if h else y for y, h in zip(labels, out, strict=True)]
    a, b = (C.train(df, spark.createDataFrame(list(enumerate(y)), "doc_id bigint, quality int")) for y in (labels, flipped))
    assert a.intercept == b.intercept and all((s == t).all() for s, t in zip(a.tables, b.tables, strict=True))


def test_the_bound_on_training_rows(spark):
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2, "doc_id bigint, quality int")
    assert C.training_labels(lab, "quality", 50).count() == 50


def test_odd_rows_and_tables(spark, docs):
    model = C.fit(np.zeros((0, len(C.FEATURES))), np.zeros(0))
    rows = C.scored(docs([None, "", "x" * 100_000, "a b", "a b"], ids=[None, 1, 2, 3, 3]), model).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == 5
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    texts, labels = corpus(100)
    df = docs(texts)
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    assert C.scored(df.limit(0), C.train(df, empty)).count() == 0
    trained = C.train(df, spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, quality int"))
    assert all(0 <= r.score <= 1 for r in C.scored(docs([None, "", "\n", "é" * 50]), trained).collect())
