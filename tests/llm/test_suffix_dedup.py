from __future__ import annotations

import random
from collections import Counter

import pytest

from scholia.llm import suffix_dedup as D


def brute(texts, ids, length):
    """Word spans and the least sharing id of each text, by comparing all stretches."""
    words = [(t or "").split() for t in texts]
    at, least = Counter(), {}
    for n, w in enumerate(words):
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            at[k] += 1
            if ids[n] is not None:
                least[k] = min(ids[n], least.get(k, ids[n]))
    out = {}
    for n, w in enumerate(words):
        spans, first = [], None
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if at[k] > 1:
                first = least.get(k) if first is None else min(first, least.get(k, first))
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        if spans:
            out[n] = (len(w), [tuple(s) for s in spans], first)
    return out


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, other = line(70), line(52)
    docs = [line(rng.randint(0, 200)) for _ in range(25)]
    docs += [line(rng.randint(0, 40)) + passage[rng.randint(0, 15) : 70 - rng.randint(0, 15)] + line(rng.randint(0, 40)) for _ in range(12)]
    docs += [other, line(3) + other + line(60) + other, ["a"] * 130, ["a", "b"] * 60, docs[3], docs[30], docs[30] + ["end"]]
    docs += [line(200)[:150] for _ in range(2)] + [other[:49], other[1:51]]
    return [" ".join(d) for d in docs] + [None, "", " \n "]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_match_brute_force(docs, seed):
    data = texts(seed)
    ids = [None if k % 9 == 4 else 3 * k for k in range(len(data))]
    want = brute(data, ids, D.LENGTH)
    rows = D.repeats(docs(data, ids=ids, extra=("r", "key", "w", "spans"))).collect()
    got = sorted((r.n_words, tuple((s.start, s.end) for s in r.spans), r.first_doc_id or -1, r.doc_id or -1) for r in rows)
    assert got == sorted((n, tuple(s), f if f is not None else -1, ids[k] or -1) for k, (n, s, f) in want.items())


def test_shorter_passages(docs):
    data = texts(3)
    ids = list(range(len(data)))
    for length, prefix in ((12, 5), (6, 6), (9, 1)):
        want = brute(data, ids, length)
        rows = D.repeats(docs(data), length=length, prefix=prefix).collect()
        assert {r.doc_id: (r.n_words, [(s.start, s.end) for s in r.spans], r.first_doc_id) for r in rows} == want


def test_every_passage_stays_once(docs):
    data = texts(4)
    kept = D.deduplicated(docs(data, extra=("__cut", "c"))).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "__cut", "c"}
    stretches = lambda ts: {tuple(w[i : i + D.LENGTH]) for t in ts for w in [(t or "").split()] for i in range(len(w) - D.LENGTH + 1)}
    left = [r.text for r in kept]
    assert len(left) == len(data)
    # A passage that stood whole somewhere is still whole at its first place.
    passage = brute(data, list(range(len(data))), D.LENGTH)
    assert sum(len((t or "").split()) for t in left) < sum(len((t or "").split()) for t in data)
    untouched = [k for k in range(len(data)) if k not in passage]
    by_id = {r.doc_id: r.text for r in kept}
    assert all(by_id[k] == data[k] for k in untouched)
    words = lambda ts: {x for t in ts for x in (t or "").split()}
    assert words(left) == words(data)
    assert stretches([by_id[k] for k in untouched]) == stretches([data[k] for k in untouched])


def test_odd_tables(docs):
    assert D.report(docs(["a"]).limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(60))
    rows = D.report(docs([long, long, long], ids=[7, 7, None])).collect()
    assert [(r.n_words, r.n_repeated, r.spans, r.first_doc_id) for r in rows] == [(60, 60, "0:60", 7)] * 3
    assert D.deduplicated(docs([long, long], ids=[7, 7])).count() == 1


def test_cutting_words():
    assert D.without("a  b\nc d", [(1, 3)]) == "a  d"
    assert D.without(" é b ", [(0, 2)]) == " "
    assert D.without("a b", []) == "a b"
