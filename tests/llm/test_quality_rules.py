from __future__ import annotations

import random
import re

import pytest

from scholia.llm import rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen: dict = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(x) for x in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": len(words) < 10 or 100 * len(hit) > 20 * len(words),
    }


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "of", "river", "stone", "é", "a*b", "#", "𝒳y", "word,", "|"]
    out = []
    for _ in range(60):
        n = rng.choice([0, 3, 9, 10, 11, 40, 120])
        out.append("".join(rng.choice(words[: rng.choice([1, 2, 10])]) + rng.choice([" ", " ", "\n", "\t", "\x0b", "\r\n", "  "]) for _ in range(n)))
    return [*out, None, "", " \n ", "x" * 100_000, "the cat sat on a mat " * 5000, "    \x85"]


def test_measures_match_brute_force(docs):
    data = texts(1)
    rows = Q.apply_rules(docs(data, extra=("n_words", "__t", "__w", "kept"))).collect()
    assert len(rows) == len(data)
    for r in rows:
        want = brute(data[r.doc_id])
        assert {k: r[k] for k in want} == want, data[r.doc_id][:80]
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_verdict(docs):
    good = "The river is wide and the stones of the old bridge are still there. It was built for the people of the town in a long winter."
    bad = {"symbols": "the ### of *** in $$$ to %%% and ||| is <<< a >>> the", "shouting": "THE RIVER IS WIDE AND THE STONES OF THE OLD BRIDGE ARE THERE", "dup_lines": "the line of it\n" * 3 + "and is a to that for\n" * 3, "stop_words": "river stones bridge winter garden meadow letter cloud harbour lantern"}
    rows = {r.doc_id: r for r in Q.apply_rules(docs([good, *bad.values()])).collect()}
    assert rows[0].kept and rows[0].failed_rules == []
    for k, name in enumerate(bad, 1):
        assert name in rows[k].failed_rules or (name == "dup_lines" and rows[k].base_failed), name


def test_rules_are_a_table(docs):
    own = (Q.Rule("short", "n_words", most=2),)
    assert [r.failed_rules for r in Q.apply_rules(docs(["a b c", "a"]), own).orderBy("doc_id").collect()] == [["short"], []]
    assert Q.apply_rules(docs(["a"]), ()).first().failed_rules == []
    assert Q.apply_rules(docs(["a"]).limit(0)).count() == 0


def test_plan_has_no_python_and_no_shuffle(docs):
    plan = Q.apply_rules(docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)


@pytest.mark.parametrize("ids", [[1, 1], [None, 2]])
def test_repeated_and_null_ids(docs, ids):
    assert Q.apply_rules(docs(["a b", "a b"], ids=ids)).count() == 2
