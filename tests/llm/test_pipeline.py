"""Each stage against a brute-force version of it, on the rows that the stage before kept."""

from __future__ import annotations

import importlib.util
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from scholia.llm import classifier, decontam, packing

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir() or importlib.util.find_spec("corpus_pipeline") is None, reason="needs the driver's tables and the pipeline")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out, [n for n, _ in corpus_pipeline.STAGES], docs


def test_names_and_columns(stages):
    out, names, _ = stages
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    for rows in out[1:5]:
        assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_classifier_stage(spark, stages):
    before, after = stages[0][0], stages[0][1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    import zlib

    known = [r for r in sorted(before, key=lambda r: r.doc_id) if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    x = np.array([classifier.features((r.text or "").encode()) for r in known])
    model = classifier.fit(x, np.array([labels[r.doc_id] for r in known], dtype=float))
    scores = model.scores(np.array([classifier.features((r.text or "").encode()) for r in before]))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, scores, strict=True) if s >= classifier.THRESHOLD)
    assert 0.4 * len(before) < len(after) < len(before)


def test_near_dedup_stage(stages):
    """The stage's contract: five words, a Jaccard similarity of 0.8 or more; all pairs compared."""
    before, after, sets = stages[0][1], stages[0][2], []
    for r in before:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(before)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(before)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for k, r in enumerate(before):
        groups[find(k)].append(r.doc_id)
    assert len(groups) < len(before)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())


def test_decontamination_stage(spark, stages):
    before, after = stages[0][2], stages[0][3]
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = decontam.words((r.text or "").encode())
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 10, 0) + 1)} if w else set()
    sizes = {len(w) for w in windows}
    clean = []
    for r in before:
        w = decontam.words((r.text or "").encode())
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(clean)


def test_mixing_stage(stages):
    before, after = stages[0][3], stages[0][4]
    size = lambda r: len([w for w in (r.text or "").split() if w])
    sizes, took, copies = defaultdict(int), defaultdict(int), Counter()
    for r in before:
        sizes[r.source] += size(r)
    for r in after:
        took[r.source] += size(r)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2 and {tuple(r) for r in after} <= {tuple(r) for r in before}
    left, free, target = 1.5 * sum(sizes.values()), sorted(sizes), {}
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(free)}
    while free:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if share[k] >= 2 * sizes[k]]
        for k in over or free:
            target[k] = 2 * sizes[k] if over else share[k]
            left -= target[k]
        free = [k for k in free if k not in over] if over else []
    for k, t in target.items():
        most = max(size(r) for r in before if r.source == k)
        assert abs(took[k] - t) <= max(most / 2, 0.01 * t) + 1


def test_packing_stage(stages):
    before, packed = stages[0][4], stages[0][5]
    tokenizer, pieces = packing.Tokenizer(), Counter()
    for row in packed:
        assert len(row.token_ids) == packing.LENGTH and row.cu_seqlens[-1] == row.n_tokens <= packing.LENGTH
        for k, (doc, offset) in enumerate(zip(row.doc_ids, row.offsets, strict=True)):
            a, b = row.cu_seqlens[k], row.cu_seqlens[k + 1]
            assert row.position_ids[a:b] == list(range(b - a))
            pieces[doc, offset, tuple(row.token_ids[a:b])] += 1
    want = Counter()
    for r in before:
        ids = tokenizer.encode(r.text or "").tolist()
        for a in range(0, max(len(ids), 1), packing.LENGTH):
            want[r.doc_id, a, tuple(ids[a : a + packing.LENGTH])] += 1
    assert pieces == want


def test_run_is_its_stages(spark, stages):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, rows)) == sorted(map(key, stages[0][5]))


def test_stages_take_odd_rows(spark, docs):
    """Nulls in every column, empty and repeated rows, empty tables, clashing names."""
    import corpus_pipeline

    texts = [None, "", "a b c", "a b c", "w " * 3000, *(f"plain words of document {k} stand here " * 4 for k in range(12))]
    odd = docs(texts, ids=[None, None, 3, 3, *range(4, 17)], sources=[None, "", *"ab" * 7, "c"], extra=("__n", "__hits", "__own", "k", "u", "size", "__kept", "n_words"))
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(DATA))
            if name != "token-ID / binary output":
                assert out.columns == odd.columns, name
            assert (out.count() == 0) == table.isEmpty() or name == "quality classifier", name
