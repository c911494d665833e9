from __future__ import annotations

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from scholia.operators import match


def greedy(comments, pool, threshold):
    """First come, first served, one comment after the other."""
    pool, left = dict(pool), []
    for place, norm in comments:
        for old, n in pool.items():
            fits = old and norm and min(len(old), len(norm)) * 2 >= max(len(old), len(norm)) and SequenceMatcher(None, norm, old).ratio() >= threshold
            if n > 0 and fits:
                pool[old] -= 1
                break
        else:
            left.append(place)
    return left


def words(rng, base):
    out = list(rng.choice(base))
    for _ in range(rng.randint(0, 3)):
        out[rng.randrange(len(out))] = rng.choice(["red", "blue", "x"])
    return " ".join(out)


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.85), (2, 0.7)])
def test_fuzzy_is_first_come_first_served(spark, seed, threshold):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") * rng.randint(2, 6) for _ in range(7)] for _ in range(4)]
    comments = [((k // 5, k % 5), words(rng, base)) for k in range(40)] + [((9, 0), ""), ((9, 1), "zzz")]
    pool: dict = {}
    for _ in range(25):
        pool.setdefault(words(rng, base), rng.randint(1, 2))
    new = spark.createDataFrame([(*p, n) for p, n in comments], "file_ord int, comment_ord int, norm string")
    old = spark.createDataFrame([(n, k, i) for i, (n, k) in enumerate(pool.items())], "norm string, n long, pool_ord long")
    got = sorted((r.file_ord, r.comment_ord) for r in match.consume_fuzzy(new, old, threshold).collect())
    assert got == sorted(greedy(comments, pool, threshold))


def test_exact_consumption_keeps_later_rows(spark):
    rng = random.Random(3)
    rows = [(f"f{k % 3}", k % 3, k, rng.choice("abc")) for k in range(30)]
    new = spark.createDataFrame(rows, "path string, file_ord int, comment_ord int, norm string")
    olds = Counter((f"f{rng.randint(0, 3)}", rng.choice("abcd")) for _ in range(20))
    pool = spark.createDataFrame([(p, n, k) for (p, n), k in olds.items()], "path string, norm string, n long")
    left, rest = match.consume(new, pool, ("path",))
    want, counts = [], Counter(olds)
    for p, f, o, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if counts[p, n] > 0:
            counts[p, n] -= 1
        else:
            want.append((f, o))
    assert sorted((r.file_ord, r.comment_ord) for r in left.collect()) == sorted(want)
    assert {(r.path, r.norm): r.n for r in rest.collect()} == {k: v for k, v in counts.items() if v > 0}


def test_ranks_over_spans_of_files(spark, monkeypatch):
    monkeypatch.setattr(match, "SPAN", 3)
    rng = random.Random(5)
    rows = [(rng.randint(0, 20), k, rng.choice("ab")) for k in range(60)]
    new = spark.createDataFrame(rows, "file_ord int, comment_ord int, norm string")
    got = {(r.file_ord, r.comment_ord): r.nth for r in match._ranked(new, ["norm"], True).collect()}
    for norm in "ab":
        own = sorted((f, o) for f, o, n in rows if n == norm)
        assert [got[p] for p in own] == list(range(1, len(own) + 1))


def test_similarity_bounds():
    assert match.similar("keeps latency low", "keeps latncy low", 0.85)
    assert not match.similar("", "", 0.5) and not match.similar("a", "aaa", 0.1)
