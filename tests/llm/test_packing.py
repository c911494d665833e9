from __future__ import annotations

import random

import numpy as np
import pytest

from scholia.llm import packing as P


def brute_best_fit(lengths, length):
    space, rows = [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [s for s in space if s >= lengths[k]]
        if fits:
            r = max(n for n, s in enumerate(space) if s == min(fits))
        else:
            r = len(rows)
            rows.append([])
            space.append(length)
        rows[r].append(k)
        space[r] -= lengths[k]
    return rows


def test_best_fit_is_best_fit():
    rng = random.Random(7)
    for length in (1, 7, 64, 100):
        lengths = [rng.randint(0, length) for _ in range(300)]
        rows = P.best_fit(lengths, length)
        assert sorted(k for r in rows for k in r) == list(range(300))
        assert all(sum(lengths[k] for k in r) <= length for r in rows)
        # Ties between equal spaces may fall otherwise: the fills are the same.
        fill = lambda rs: sorted(sum(lengths[k] for k in r) for r in rs)
        assert len(rows) == len(brute_best_fit(lengths, length)) and fill(rows) == fill(brute_best_fit(lengths, length))


TEXTS = [None, "", "one two", "  \n\n x\t y  ", "é 𝒳 ñ \x1c\x1d <|endoftext|> 123", "w0rd " * 4000, "same", "same"]


@pytest.mark.parametrize("length,block", [(16, 100), (2048, 10**6)])
def test_rows_are_whole_and_round_trip(spark, docs, length, block):
    df = docs(TEXTS, extra=("token_ids", "pack_id", "offsets"))
    packed = P.pack(df, length=length, block_tokens=block)
    rows = packed.collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    for r in rows:
        assert len(r.token_ids) == len(r.position_ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert set(r.token_ids[r.n_tokens :]) <= {P.PAD}
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert r.position_ids[a:b] == list(range(b - a))
    assert {r.doc_id: r.text for r in P.unpack(packed).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_matrices_hold_the_same_ids(spark, docs, tmp_path):
    packed = P.pack(docs(TEXTS), length=32)
    P.write_matrices(packed, str(tmp_path / "m"), rows=5)
    want = {r.pack_id: r for r in packed.collect()}
    seen = 0
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids = np.frombuffer(r.ids, dtype="<u4").reshape(r.n_rows, r.length)
        for k, name in enumerate(r.pack_ids):
            assert ids[k].tolist() == want[name].token_ids
            seen += 1
        resets = {int(x) for x in np.frombuffer(r.position_resets, dtype="<u8")}
        assert resets == {k * r.length + a for k, n in enumerate(r.pack_ids) for a in want[n].cu_seqlens[:-1]}
    assert seen == len(want)


def test_empty_table(docs):
    assert P.pack(docs(["a"]).limit(0)).count() == 0
