from __future__ import annotations

import hashlib
import math
import random
import re

import pytest

from scholia.llm import sanitise as S

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                k == 0
                or (k == 1 and all(int(x) <= 255 for x in m[0].split(".")))
                or (k == 2 and 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0)
                or (k == 3 and 8 <= len(digits) <= 15)
            ):
                out.append((k, m.start(), m.end()))
    return out


PIECES = ["a", "b.c", "@", ".", "x-y", "d.e", "%", " ", "\n", "1", "255", "256", ".", "+1", "(212) 555-0100", "4111111111111111", "4111 1111 1111 1111", "-", "é𝒳", "0" * 20, "999"]


def test_base_spans_match_brute_force():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert S.base_spans(text) == brute(text), text
    assert S.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


def brute_terms(texts):
    docs = [{m.lower() for m in S._TERM.findall(t or "")} for t in texts]
    found = [S.mentions(t or "", brute(t)) for t in texts]
    pairs, entities = {}, {}
    for n, ms in enumerate(found):
        for e, t, _, _ in ms:
            pairs.setdefault((e, t), set()).add(n)
            entities.setdefault(e, set()).add(n)
    out = {}
    for (e, t), held in pairs.items():
        if len(held) >= S.SUPPORT:
            n, ne, nt = len(texts), len(entities[e]), sum(t in d for d in docs)
            ic = math.log(n / ne)
            out[e, t] = math.log(n * len(held) / (ne * nt)) / ic if ic > 0 else 0.0
    return found, out


def texts():
    rng = random.Random(9)
    common = "river stone cloud meadow letter garden winter".split()
    line = lambda n: " ".join(rng.choice(common) for _ in range(n))
    out = [line(rng.randint(3, 30)) for _ in range(60)]
    out += [f"{line(4)} Zyxwv {line(2)} ann@ex.org {line(3)} qwerty 10.0.0.1" for _ in range(4)]
    out += [f"qwerty {line(5)}", f"{line(5)} bob@ex.org {line(2)}", None, "", "+1 212 555 0100"]
    return out


def test_report_matches_brute_force(spark, docs):
    data = texts()
    df = docs(data, ids=[None, *range(1, len(data))], extra=("row", "spans", "mentions", "h", "entity"))
    found, share = brute_terms(data)
    got = {r.doc_id: r for r in S.report(df).collect()}
    assert len(got) == len(data)
    some = 0
    for n, text in enumerate(data):
        base = brute(text)
        terms = {}
        for e, t, a, b in found[n]:
            if (e, t) in share and share[e, t] >= S.GENERALISE - 1e-12:
                kind = 4 if share[e, t] >= S.REMOVE else 5
                terms[a, b] = min(kind, terms.get((a, b), 9))
        every = sorted([*base, *((k, a, b) for (a, b), k in terms.items())])
        some += len(terms)
        r = got[n or None]
        assert r.spans == ",".join(f"{S.KINDS[k]}:{a}:{b}" for k, a, b in every)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
    assert some
    rows = S.found(df)
    for r in S.disclosure(rows, df).collect():
        assert r.disclosed == pytest.approx(share[r.entity, r.term])


def test_sanitised_text(spark, docs):
    data = texts()
    out = {r.doc_id: r.text for r in S.sanitised(docs(data)).collect()}
    assert "ann@ex.org" not in str(out) and "Zyxwv" not in str(out) and "[EMAIL]" in out[61] and out[0] == data[0]
    assert out[len(data) - 3] is None and out[len(data) - 1] == "[PHONE]"


def test_odd_tables(docs):
    assert S.report(docs(["a"]).limit(0)).count() == 0
    assert [r.spans for r in S.report(docs(["a@b.c"] * 2, ids=[1, 1])).collect()] == ["email:0:5"] * 2


def test_far_terms_and_entities_of_one_document(docs):
    far = " ".join(["river stone"] * 20)
    data = [f"Qwertz {far} ann@ex.org", f"ann@ex.org {far} qwertz", f"{far} Asdfg {far} asdfg bob@ex.org", *[far] * 30]
    out = {r.doc_id: r.text for r in S.sanitised(docs(data)).collect()}
    assert "wertz" not in out[0] + out[1] and "sdfg" not in out[2]
    assert out[2].count("river") == 40 and out[5] == far
