from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scholia.llm import simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=3):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "One  two", "A b\x0bc", "É È ñ Z"]
    texts += [" ".join(rng.choice(["Ab", "cd", "é", "x\x00y"]) for _ in range(rng.randint(1, 40))) + "\n" for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_trie_finds_exactly_the_near_pairs():
    rng = random.Random(2)
    values, groups = [], []
    for g in range(6):
        base = rng.getrandbits(64)
        own = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
        values += sorted(own)
        groups += [g] * len(own)
    pairs = simhash.trie_links(np.array(values, dtype=np.uint64), np.array(groups))
    got = {tuple(sorted(p)) for p in pairs.tolist()}
    want = {(i, j) for j in range(len(values)) for i in range(j) if groups[i] == groups[j] and (values[i] ^ values[j]).bit_count() <= 3}
    assert got == want and len(pairs) == len(want)


def check(spark, prints, group, wide=simhash.WIDE):
    unique = sorted(set(prints))
    df = spark.createDataFrame([(simhash._signed(p),) for p in unique], "fp bigint")
    found = simhash.components(simhash.links(df, group, wide))
    roots = {r.node % 2**64: r.root for r in found.collect()}
    got = {}
    for p in unique:
        got.setdefault(roots.get(p, simhash._signed(p)), set()).add(p)
    want = {}
    for p, c in zip(unique, brute_components(unique), strict=True):
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_match_brute_force_with_hot_groups_dealt_again(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(3):
        p = rng.getrandbits(64)
        for _ in range(70):  # a chain that wanders far from its start
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.append(p)
    base = rng.getrandbits(64)
    prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(80)]
    for group, wide in ((512, simhash.WIDE), (8, simhash.WIDE), (1, simhash.WIDE), (512, 0), (1, 0)):
        check(spark, prints, group, wide)


def test_groups_have_a_proven_bound():
    for first in (4, 5):
        last = {m for masks in simhash._levels(first)[-1].values() for m in masks}
        assert all(64 - m.bit_count() <= 9 for m in last)


def test_rows_nulls_copies_and_clashing_columns(spark, docs):
    texts = ["a b c d e f", None, "a b c d e f", "", "A B C D E F", "other words stand here now", None]
    df = docs(texts, ids=[5, 7, 5, 3, 2, None, None], extra=("fp", "root", "n", "__print", "component_id", "__n", "__id", "__kept", "__NODE", "id", "node", "kept"))
    rows = sorted(simhash.near_duplicates(df).collect(), key=str)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert len(rows) == len(texts)
    copy = f"{brute_fingerprint('a b c d e f'):016x}"
    assert by[5, copy] == by[2, copy] == 2
    assert by[7, "0" * 16] == by[3, "0" * 16] == by[None, "0" * 16] == 3
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "A B C D E F"), (3, ""), (None, "other words stand here now")], key=str)
    same = docs(["x y z"] * 3 + [None] * 2, ids=[1, 1, 1, None, None])
    assert simhash.deduplicated(same).count() == 2
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicated(df.limit(0)).count() == 0


def test_dedup_finds_every_pair_of_similar_sets(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, texts = [word() for _ in range(60)], []
    for size in (7, 30, 60, 120, 240):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 2, 3, 4, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([*passage, *(word() for _ in range(40))]) for _ in range(30)]  # one passage, not similar
    texts += [None, "", "a b", "A  b", "a b c", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    label, far = list(range(len(texts))), 0
    for j in range(len(texts)):
        for i in range(j):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                far += (brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[j])).bit_count() > 3
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert far > 5  # pairs that three bits of a fingerprint miss
    assert sorted(r.doc_id for r in simhash.deduplicated(docs(texts)).collect()) == sorted({label.index(x) for x in label})


def test_parities_never_tell_sets_further_apart_than_they_are():
    rng = random.Random(5)
    for n, m in ((1, 1), (5, 70), (64, 65), (300, 320), (0, 3)):
        both = [rng.getrandbits(64) for _ in range(n)]
        a, b = ([*both, *(rng.getrandbits(64) for _ in range(m - n))] for _ in range(2))
        pa, pb = (simhash.parity(np.unique(np.array(x, dtype=np.uint64))) for x in (a, b[: n + (m - n) // 2]))
        assert simhash._apart(pa, pb) <= len(set(a) ^ set(b[: n + (m - n) // 2]))
        assert simhash._apart(pa, pa) == 0


def test_dedup_finds_a_pair_whose_only_key_has_many_nodes(spark, docs, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(120)]
    for k in range(0, 120, 4):  # one word of every fourth is another in a copy
        words = texts[k].split(" ")
        words[50] = "other"
        texts.append(" ".join(words))
    far = sum((brute_fingerprint(texts[k]) ^ brute_fingerprint(texts[120 + k // 4])).bit_count() > 3 for k in range(0, 120, 4))
    assert far > 5
    sets = simhash._sets
    monkeypatch.setattr(simhash, "_sets", lambda *a: sets(*a).withColumn("keys", F.array(F.lit(7).cast("long"))))
    assert sorted(r.doc_id for r in simhash.deduplicated(docs(texts)).collect()) == list(range(120))


def test_each_two_nodes_of_a_key_meet_in_one_unit(spark):
    rows = [(1, n, 10) for n in range(50)] + [(2, n, 10) for n in range(3)] + [(3, 9, 10), (4, 1, simhash.BLOCK_MEMBERS), (4, 2, 10)]
    met = {}
    units = {}
    for r in simhash._units(spark.createDataFrame(rows, "key bigint, node bigint, size bigint"), 8).collect():
        units.setdefault((r.key, r.x, r.y), []).append(r)
    for (key, x, y), own in units.items():
        for a, b in ((a, b) for a in own for b in own if a.node < b.node and (x == y or a.side != b.side)):
            met[key, a.node, b.node] = met.get((key, a.node, b.node), 0) + 1
    want = {(1, a, b) for b in range(50) for a in range(b)} | {(2, a, b) for b in range(3) for a in range(b)} | {(4, 1, 2)}
    assert set(met) == want and set(met.values()) == {1}


def test_rows_of_a_unit_are_compared_like_single_bitmaps(monkeypatch):
    rng = random.Random(7)
    group, side, root, own = [], [], [], []
    for g in range(6):
        base = [rng.getrandbits(64) for _ in range(66 << g)]
        for k in range(12):
            own.append(np.unique(np.array([x if rng.random() > 0.02 * k else rng.getrandbits(64) for x in base[: len(base) - 2 * k]], dtype=np.uint64)))
            group.append(g)
            side.append(k % 2 if g > 3 else 0)
            root.append(k // 2 if g else k)
    bits, size = [simhash.parity(x) for x in own], np.array([len(x) for x in own])
    want = set()
    for j in range(len(own)):
        for i in range(j):
            few, many = sorted((size[i], size[j]))
            if group[i] == group[j] and root[i] != root[j] and (group[i] <= 3 or side[i] != side[j]) and 10 * few >= 8 * many:
                if 18 * simhash._apart(bits[i], bits[j]) <= 2 * (size[i] + size[j]):
                    want.add((i, j, simhash._apart(bits[i], bits[j])))
    assert len(want) > 20 and len({len(bits[i]) != len(bits[j]) for i, j, _ in want}) == 2
    for most in (simhash.WORDS_AT_ONCE, 7):
        monkeypatch.setattr(simhash, "WORDS_AT_ONCE", most)
        i, j, apart = simhash.near_rows(np.array(group), np.array(side), np.array(root), size, bits, 8)
        assert set(zip(i.tolist(), j.tolist(), apart.tolist(), strict=True)) == want and len(i) == len(want)


def test_a_group_of_nearly_similar_texts_gives_rows_by_its_nodes_not_its_pairs(spark, docs, monkeypatch):
    rng = random.Random(8)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(100)], []
    for k in range(15):  # each two share 84 of 108 runs, 0.78, which bitmaps often leave possible
        words = list(base)
        words[6 * k + 5], words[6 * k + 6] = f"a{k}", f"b{k}"
        texts.append(" ".join(words))
    bits = [simhash.parity(simhash.shingles(t.encode(), 5)) for t in texts]
    assert sum(18 * simhash._apart(bits[i], bits[j]) <= 2 * 192 for j in range(15) for i in range(j)) > 60
    sets, verified, units, rows = simhash._sets, simhash._verified, simhash._units, []
    monkeypatch.setattr(simhash, "_sets", lambda *a: sets(*a).withColumn("keys", F.array(F.lit(7).cast("long"))))
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: rows.append(pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(simhash, "_units", lambda keys, *a, **b: rows.append(keys.count()) or units(keys, *a, **b))
    assert sorted(r.doc_id for r in simhash.deduplicated(docs(texts)).collect()) == list(range(15))
    assert sum(rows) <= 3 * 15  # the key's nodes, a forest of them, those with a possible partner


def test_second_pass_alone_joins_what_similar_sets_join(spark, docs, monkeypatch):
    rng = random.Random(9)
    texts, want = [], []
    for g in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        want.append(len(texts))
        for k in range(12):  # a chain: each similar to the one before
            texts.append(" ".join(words))
            words[8 * k + 4] = f"x{g}_{k}"
    sets = simhash._sets
    monkeypatch.setattr(simhash, "_sets", lambda *a: sets(*a).withColumn("keys", F.array(F.lit(7).cast("long"))))
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: pairs.limit(0))
    for members in (simhash.SET_MEMBERS, 900):  # one block, and several
        monkeypatch.setattr(simhash, "SET_MEMBERS", members)
        assert sorted(r.doc_id for r in simhash.deduplicated(docs(texts)).collect()) == want


def test_nearest_forest_is_least_and_spans():
    rng = random.Random(10)
    for n, m in ((1, 0), (5, 0), (30, 20), (30, 200), (60, 60)):
        links = [(i, j, rng.randrange(6), k) for k, (i, j) in enumerate(sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}))]
        label, want = list(range(n)), set()
        for i, j, _, k in sorted(links, key=lambda x: (x[2], x[3])):
            if label[i] != label[j]:
                label = [label[i] if x == label[j] else x for x in label]
                want.add(k)
        i, j, far, at = np.array(links, dtype=np.int64).reshape(-1, 4).T
        got = simhash.nearest_forest(n, i, j, (at, far))
        assert set(got.tolist()) == want and len(got) == len(want)


def test_similar_rows_join_as_all_similar_pairs_do(monkeypatch):
    rng = random.Random(11)
    own, root = [], []
    for g in range(5):
        base = [rng.getrandbits(64) for _ in range(80)]
        for k in range(8):
            base = [x if rng.random() > 0.06 else rng.getrandbits(64) for x in base]
            own.append(np.unique(np.array(base, dtype=np.uint64)))
            root.append(10 * g + k // 2)
    i, j = (np.array(x) for x in zip(*((a, b) for b in range(40) for a in range(b) if root[a] != root[b]), strict=True))

    def joined(pairs):
        label = list(root)
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {tuple(k for k in range(40) if label[k] == x) for x in label}

    like = [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if 10 * len(np.intersect1d(own[a], own[b])) >= 8 * len(np.union1d(own[a], own[b]))]
    for most in (simhash.SET_MEMBERS, 1):
        monkeypatch.setattr(simhash, "SET_MEMBERS", most)
        got = simhash.similar_rows(i, j, np.array(root), own, 8)
        assert set(got) <= set(like) and joined(got) == joined(like) and len(got) == 20 - len(joined(like)) > 3
