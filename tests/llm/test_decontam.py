from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import pytest

from scholia.llm import decontam


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(texts, items):
    patterns, names, bag = {}, [], [tokens(t) for _, t in items]
    for n, (k, _) in enumerate(items):
        names.append(None if k is None else str(k))
        for i in range(max(len(bag[n]) - 10, 0) + 1) if bag[n] else ():
            patterns.setdefault(tuple(bag[n][i : i + 10]), []).append((n, i))
    out = []
    for t in texts:
        w, hit, found, best = tokens(t), set(), set(), (0, 0, False, "")
        for p, places in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    for n, j in places:
                        found.add(names[n])
                        k = len(p)  # extended word by word
                        while len(bag[n]) >= 10 and i + k < len(w) and j + k < len(bag[n]) and w[i + k] == bag[n][j + k]:
                            k += 1
                        best = min(best, (-k, i, names[n] is None, names[n] or ""))
        named = sorted(found - {None})
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit), -best[0], best[1] if best[0] else None, best[3] or None))
    return out


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_matches_brute_force(spark, docs, block_words):
    rng = random.Random(4)
    vocabulary = ["Aa", "b", "c1", "é", "zz"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(n)) for k, n in enumerate((12, 25, 4, 9, 10, 11, 3))] + [(50, None), (51, "  "), (None, line(5)), (1, line(12)), (2, "Aa, b; C1 é")]
    texts = [None, "", "...", "b", line(400), "q " * 50]
    for _ in range(30):
        k, t = rng.choice(items)
        texts.append(f"{line(rng.randint(0, 15))} q. {t or ''}! {line(rng.randint(0, 5))}")
    texts += [texts[-1]] * 2
    df = docs(texts, extra=("n_words", "starts", "__HITS", "items"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontam.with_hits(df.select("doc_id", df.text), bench, "text", "state", block_words=block_words)
    got = {r.doc_id: r for r in decontam.report(df, bench).collect()}
    want = brute(texts, items)
    for n, w in enumerate(want):
        assert tuple(got[n][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at", "longest_item")) == w
    for r in rows.collect():
        assert r.state.n_words == want[r.doc_id][0] and sum(b - a for a, b in zip(r.state.starts, r.state.ends, strict=True)) == want[r.doc_id][1]
        assert len(r.state["items"]) + r.state.unnamed == want[r.doc_id][2] and r.state.longest == want[r.doc_id][5]
    clean = decontam.remove(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == [n for n, w in enumerate(want) if not w[4]]


def test_longest_match_and_place(spark, docs):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[:12]))], "item_id bigint, text string")
    text = "x y " + " ".join(words[3:30]) + " z " + " ".join(words[:11])
    row = decontam.report(docs([text]), bench).first()
    assert (row.longest_match, row.longest_at, row.longest_item, row.n_hit) == (27, 2, "7", 38)


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.report(docs(["a b"]), bench).first().contaminated is False
    assert decontam.report(docs(["a"]).limit(0), bench).count() == 0
    assert decontam.remove(docs(["a b", None]), bench).count() == 2


def test_long_texts_are_cut_into_shards():
    rng = random.Random(9)
    items = [(str(k), [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]) for k, n in enumerate((30, 12, 4))]
    index = decontam.Index(items)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c", b"q"] if n % 2 else [b"a", b"b", b"c"]) for _ in range(n)) for n in (0, 5, 60, 61, 200, 333, 1)]
    texts += [b"q " * 45 + b" ".join(items[0][1]) + b" q" * 20]
    whole = list(decontam.scan(index, texts))
    assert any(found for _, found in whole)
    for size in (10, 50, 64):
        assert list(decontam.scan(index, texts, shard_words=size)) == whole


def test_ten_million_words_in_bounded_memory(tmp_path):
    """Measured in a process of its own, whose peak is not that of the other tests."""
    import subprocess
    import sys

    code = """
import resource
from scholia.llm import decontam
index = decontam.Index([("1", [b"w%d" % k for k in range(40)])])
text = b"filler words here " * 3_333_333 + b" ".join(b"w%d" % k for k in range(40))
((n, found),) = decontam.scan(index, [text])
assert n == 10_000_039 and found[3:] == (40, 9_999_999, "1"), (n, found)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(Path(__file__).resolve().parents[2]))
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 1024


def test_every_block_is_a_stage_of_its_own(spark, docs):
    bench = spark.createDataFrame([(k, f"x{k} y z") for k in range(6)], "item_id bigint, text string")
    rows = decontam.with_hits(docs(["x1 y z", "x5 y z"]), bench, "text", "state", block_words=3)
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.state["items"] for r in rows.orderBy("doc_id").collect()] == [["1"], ["5"]]
