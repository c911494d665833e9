from __future__ import annotations

import hashlib
import random
import re

from scholia.llm import secret_scan as S


def brute(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.I | re.A if r.ignore_case else 0):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{S.RULES[k].kind}:{a}:{b}" for a, k, b in spans)


def test_queries_hold_for_every_match_and_skip_the_rest():
    assert S.trigram_query("[0-9a-f]{24,}") is True
    assert S.trigram_query("AKIA[A-Z0-9]{16,}") == ("and", ("aki", "kia"))
    assert set(S.trigrams(S.trigram_query("gh[pousr]_[A-Za-z0-9]{36,}"))) == {f"gh{c}" for c in "pousr"} | {f"h{c}_" for c in "pousr"}
    query = S.trigram_query(S.BASE[0].pattern)
    assert query[0] == "or" and {"pas", "tok", "api", "pi_"} <= set(S.trigrams(query))
    assert S.trigram_query("(abcd|x)yz") == ("or", (("and", ("abc", "bcd", "cdy", "dyz")), "xyz"))
    assert S.trigram_query("a?b*c") is True and S.trigram_query("(abc)*") is True and S.trigram_query("(abc)+") == "abc"

    def met(q, low):
        return True if q is True else q in low if isinstance(q, str) else (all if q[0] == "and" else any)(met(p, low) for p in q[1])

    for text in TEXTS:
        for r in S.RULES:
            if brute(text, [r]):
                assert met(S.trigram_query(r.pattern), (text or "").lower())


PIECES = [
    "password", "PassWd", "secret", "TOKEN", "api_key", "ApiKey", '"', "'", " ", "   ", ":", "=", "abcdef", "ab", "token=tok", "é𝒳", "\n",
    "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", "g", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "xoxb-123456789012",
    "sk_live_0123456789abcdef", "AIza" + "x" * 35, "https://me:hunter22@", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl",
]
_rng = random.Random(5)
TEXTS = [None, "", "nothing here", "secret=token: abcdef", "x" * 50_000 + "token=abcdef", "a" * 23, "a" * 24] + ["".join(_rng.choice(PIECES) for _ in range(_rng.randint(1, 25))) for _ in range(300)]


def test_report_matches_brute_force(spark, docs):
    df = docs(TEXTS, extra=("n_assign", "__t", "spans", "kind"))
    rows = {r.doc_id: r for r in S.report(df).collect()}
    assert len(rows) == len(TEXTS)
    for n, text in enumerate(TEXTS):
        base, every = brute(text, S.BASE), brute(text, S.RULES)
        r = rows[n]
        assert r.spans == joined(every), text
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
    got = {(r.doc_id, r.kind, r.start, r.end, r.secret) for r in S.secrets(df).collect()}
    assert got == {(n, S.RULES[k].kind, a, b, t[a:b]) for n, t in enumerate(TEXTS) for a, k, b in brute(t, S.RULES)}


def test_odd_tables(docs):
    assert S.report(docs(["a"]).limit(0)).count() == 0
    assert S.report(docs(["token=abcdef"] * 2, ids=[None, None])).count() == 2
    found = {(r.doc_id, r.trigram) for r in S.postings(docs(["AKIAx", None, "tok"])).collect()}
    assert found == {(0, "aki"), (0, "kia"), (2, "tok")}


def test_work_grows_with_the_matches_of_one_text(docs):
    import time

    run = "0123456789abcdef01234567 "
    S.report(docs([run * 10])).collect()
    began = time.perf_counter()
    row = S.report(docs([run * 64_000])).first()
    assert row.n_hex == 64_000 and row.spans.endswith(f"hex:{25 * 63_999}:{25 * 63_999 + 24}")
    assert time.perf_counter() - began < 10  # growing an array for each match took 48 s


def test_lists_are_intersected(docs):
    """Trigrams of a rule that stand in different texts make no candidate."""
    df = docs(["akikia", "aki only", "kia only", "AKIA", "AKIA", "deadbeef" * 3])
    rows = S.indexed(df)
    found = {r.doc_id: r.kinds for r in rows.join(S.candidates(rows), ["a", "b"]).collect()}
    bit = {r.kind: 1 << k for k, r in enumerate(S.RULES)}
    assert found == {0: bit["access"], 3: bit["access"], 4: bit["access"], 5: bit["hex"]}
