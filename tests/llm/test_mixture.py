from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from scholia.llm import mixture
from scholia.llm.oracles import SQL


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, epochs=2):
    names = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, free, out = budget * sum(sizes.values()), set(names), {}
    while free:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] >= epochs * sizes[k]}
        if not over:
            out |= share
            break
        for k in over:
            out[k] = epochs * sizes[k]
            left -= out[k]
        free -= over
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, docs, seed):
    rng = random.Random(seed)
    texts, sources = [], []
    for s, n in (("b", 300), ("a", 40), (None, 60), ("é", 200), ("", 90), ("c", 5)):
        for _ in range(n):
            texts.append(rng.choice(["x ", "y\n"]) * int(rng.lognormvariate(3, 1.2)))
            sources.append(s)
    texts += [None, "", "  "]
    sources += ["a", "zero", "zero"]
    df = docs(texts, sources=sources, extra=("size", "k", "u", "copies"))
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += size(t)
    want = brute_targets(sizes)
    rows = mixture.mix(df).collect()
    assert len(rows) == len(texts)
    took = defaultdict(int)
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == size(texts[r.doc_id]) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken == r.copies * r.size <= 2 * r.size
        took[s] += r.taken
    for s, t in want.items():
        most = max(size(x) for x, y in zip(texts, sources, strict=True) if y == s)
        assert abs(took[s] - t) <= max(most / 2, 0.01 * t) + 1
        if len([y for y in sources if y == s]) >= 60:
            assert abs(took[s] - t) <= 0.02 * t + 10
    again = {r.doc_id: r.taken for r in mixture.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    copies = defaultdict(int)
    mixed = mixture.mixed(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        copies[r.doc_id] += 1
    assert {k: v for k, v in copies.items()} == {r.doc_id: r.copies for r in rows if r.copies}


def test_odd_tables(docs):
    assert mixture.mix(docs(["a b"]).limit(0)).count() == 0
    assert mixture.mixed(docs(["a b"]).limit(0)).count() == 0
    rows = mixture.mix(docs([None, "", " "], ids=[1, 1, None], sources=[None, "a", "a"])).collect()
    assert [(r.target, r.taken) for r in rows] == [(0.0, 0)] * 3
    same = mixture.mix(docs(["a b c"] * 6, ids=[1] * 3 + [None] * 3)).collect()
    assert {r.target for r in same} == {27.0} and sum(r.taken for r in same) == 27


@pytest.mark.parametrize("n", [200, 201, 1])
def test_part_of_rows_alike_is_taken(docs, n):
    """No multiple of a row's words is the target: as many copies are taken as come nearest."""
    texts, sources = ["w " * 10] * n + ["v " * 7] * 100, ["a"] * n + ["b"] * 100
    df = docs(texts, ids=[1] * n + [2] * 100, sources=sources)
    rows = mixture.mix(df.repartition(5)).collect()
    for s, words in (("a", 10), ("b", 7)):
        own = [r for r in rows if r.size == words]
        assert abs(sum(r.taken for r in own) - own[0].target) <= words / 2 and {r.copies for r in own} <= {0, 1, 2}
        assert sum(r.copies for r in own) == mixture.mixed(df.filter(df.source.isNotNull())).filter(f"source = '{s}'").count()


def test_wordless_rows_stay_within_the_epochs(docs):
    df = docs([*["a b c"] * 50, None, "", "  ", *["x"] * 400], sources=["a"] * 53 + ["b"] * 400)
    rows = [r for r in mixture.mix(df).collect() if r.source_size == 150]
    assert {r.copies for r in rows} == {2}


def test_a_ratio_is_reached_by_many_sources(docs):
    rng = random.Random(3)
    texts, sources = [], []
    for k in range(60):
        for _ in range(rng.randint(1, 6)):
            texts.append("w " * rng.randint(0, 60))
            sources.append(f"s{k:02}")
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += size(t)
    want = brute_targets(sizes)
    for r in mixture.mix(docs(texts, sources=sources)).collect():
        assert r.target == pytest.approx(want[sources[r.doc_id]])


def test_sql_agrees_on_odd_rows(docs):
    import duckdb

    rng = random.Random(8)
    texts = [rng.choice([None, "", "a b", "c " * rng.randint(1, 90), "d\te"]) for _ in range(300)]
    df = docs(texts, ids=[rng.choice([None, *range(40)]) for _ in texts], sources=[rng.choice([None, "x", "y", "é"]) for _ in texts])
    documents = df.toArrow()  # noqa: F841
    names = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    want = duckdb.sql(SQL["op2_mixture"]).select(*names).fetchall()
    got = [tuple(r) for r in mixture.mix(df).select(names).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_a_long_text(docs):
    rows = mixture.mix(docs(["w " * 2_000_000, "x y"], sources=["a", "b"])).collect()
    assert {r.size for r in rows} == {2_000_000, 2} and max(r.copies for r in rows) <= 2
