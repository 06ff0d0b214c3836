import random

import numpy as np
import xxhash

from lodestone.llm import simhash
from lodestone.llm.common import written as plain_written
from lodestone.llm.components import connected_components
from lodestone.llm.simhash import Tree, fingerprints, near_duplicates


def fingerprint(text, k):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(points, linked):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(points)
    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_fingerprints_are_bit_majorities(odd_rows):
    texts = [r[1] for r in odd_rows]
    got, *_ = fingerprints(texts, 3, 1)
    assert [int(x) for x in got[:, 0]] == [fingerprint(t, 3) for t in texts]


def test_a_tree_lets_every_close_pair_meet_once():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    near = base[:100] ^ (np.uint64(1) << r.integers(0, 64, 100).astype(np.uint64))
    points = np.concatenate([base, near]).reshape(-1, 1)
    tree = Tree(points[::3], None, 16, 2, None)
    at, leaf, own = tree.route(points, None)
    assert np.array_equal(np.sort(at[own]), np.arange(400))
    homes = dict(zip(at[own].tolist(), leaf[own].tolist(), strict=True))
    there = set(zip(at.tolist(), leaf.tolist(), strict=True))
    for i in range(400):
        for j in range(i):
            if int(points[i, 0] ^ points[j, 0]).bit_count() <= 2:
                assert ((i, homes[j]) in there) + ((j, homes[i]) in there) == (2 if homes[i] == homes[j] else 1)


def test_groups_are_those_of_brute_force(spark, odd_rows, odd_docs, clashing_docs, no_docs):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(150)] for _ in range(60)]
    rows = list(odd_rows)
    for i in range(600):
        text = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            text[r.randrange(150)] = r.choice(words)
        rows.append((100 + i, " ".join(text), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    fp = [fingerprint(t, 3) for _, t, *_ in rows]
    comp = components(set(fp), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for f, (i, *_) in zip(fp, rows, strict=True):
        if i is not None:
            first[comp[f]] = min(first.get(comp[f], i), i)
    want = sorted((str(i), f, str(first.get(comp[f]))) for f, (i, *_) in zip(fp, rows, strict=True))
    got = near_duplicates(docs, k=3, radius=2).collect()
    assert sorted((str(x.doc_id), x.fp[0] % 2**64, str(x.component_id)) for x in got) == want
    assert near_duplicates(clashing_docs, k=3, radius=2).count() == len(odd_rows)
    assert near_duplicates(no_docs, k=3, radius=2).count() == 0


def test_similarity_of_shingle_sets(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows, family = [], {}
    for i in range(40):
        text = [r.choice(words) for _ in range(300)]
        for k in range(3):
            copy = list(text)
            for _ in range(2 * k):
                copy[r.randrange(300)] = r.choice(words)
            rows.append((3 * i + k, " ".join(copy)))
            family[3 * i + k] = 3 * i
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5, radius=94, words=8, min_similarity=0.8).collect()
    assert {x.doc_id: x.component_id for x in got} == family


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_only_sets_of_the_similarity_are_linked(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(300)]
        for changes in (0, 3, 6, 7, 8, 10):
            copy = list(base)
            for j in range(changes):
                copy[20 * j + 10] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    for _ in range(12):  # unlike sizes
        longer = [r.choice(words) for _ in range(r.randrange(100, 200))]
        rows += [(len(rows), " ".join(longer)), (len(rows) + 1, " ".join(longer[:-10]))]
    sets = [shingles(t) for _, t in rows]
    want = components(range(len(rows)), lambda a, b: similar(sets[a], sets[b]))
    assert len(set(want.values())) > 12
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (900, rows[0][1])], "doc_id long, text string")
    for most, keys in ((simhash.BLOCK_SHINGLES, 10**6), (700, 0)):
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", most)
        monkeypatch.setattr(simhash, "BROADCAST_KEYS", keys)
        got = near_duplicates(docs, k=5, radius=136, words=8, min_similarity=0.8).collect()
        assert {x.doc_id: x.component_id for x in got} == want | {None: 0, 900: 0}


def test_repeated_lines_vote_once(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(50_000)]
    rows, want = [], {}
    for i in range(0, 40, 4):
        a, line, own = r.sample(words, 204), r.sample(words, 18), [r.sample(words, 154) for _ in range(2)]
        rows += [(i, a), (i + 1, a + line * 10), (i + 2, own[0] + line * 10), (i + 3, own[1] + line * 10)]
        want |= {i: i, i + 1: i, i + 2: i + 2, i + 3: i + 3}
    texts = [" ".join(t) for _, t in rows]
    fp, about, _ = fingerprints(texts, 5, 8, True)
    assert about[:, 0].tolist() == [len(shingles(t)) for t in texts]
    bits = lambda x, y: int(np.bitwise_count(fp[x] ^ fp[y]).sum())
    assert all(bits(i, i + 1) <= 136 < bits(i + 2, i + 3) for i in range(0, 40, 4))
    docs = spark.createDataFrame([(i, t) for (i, _), t in zip(rows, texts, strict=True)], "doc_id long, text string")
    got = near_duplicates(docs, k=5, radius=136, words=8, min_similarity=0.8).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_similar_sets_are_those_of_brute_force():
    r = random.Random(6)
    sets = [set(r.sample(range(30), r.randrange(8, 22))) for _ in range(40)]
    sets += [(s | {r.randrange(30)}) - {r.randrange(30)} for s in sets for _ in range(4)]
    flat = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    label = simhash.similar_sets(np.array([len(s) for s in sets]), flat, 0.8)
    want = components(range(len(sets)), lambda a, b: similar(sets[a], sets[b]))
    assert len({(label[i], c) for i, c in want.items()}) == len(set(label.tolist())) == len(set(want.values())) > 5


def test_finished_leaves_are_not_written_again(spark, monkeypatch):
    """One pass a level, whatever the number of heavy leaves, and only their rows go on."""
    r = np.random.default_rng(8)
    points = np.unique(r.integers(0, 2**63, 6000))
    routed = [(int(leaf), True, int(p), [int(p)], 0) for leaf, p in zip(np.minimum(r.integers(0, 60, len(points)), 40), points, strict=True)]
    monkeypatch.setattr(simhash, "LEAF_SAMPLE", 64)
    rows = []
    plain = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name, *a: (rows.append((name, (out := plain(df, name, *a)).count())), out)[1])
    for trees in (1024, 0):
        rows.clear()
        out = simhash.divided(spark.createDataFrame(routed, simhash.ROUTED).repartition(4), 2, 1, None, 600, trees)
        assert sorted(x.id for x in out.where("own").collect()) == points.tolist()
        levels = [n for name, n in rows if name == "routed"]
        heavy = sum(n for n in np.bincount([x[0] for x in routed]) if n > 600)
        assert levels[0] == len(points) and heavy <= levels[1] <= 3.5 * heavy and len(levels) == 2, (levels, heavy)


def test_large_components_are_compared_by_representatives_first(spark, monkeypatch):
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n, drift in ((60, False), (40, True), (1, False)):  # a crowd, a chain whose ends are unlike, a loner
        base = [r.choice(words) for _ in range(120)]
        for _ in range(n):
            copy = list(base)
            copy[r.randrange(120)] = r.choice(words)
            rows.append((len(rows), copy))
            base = copy if drift else base
    sets = [shingles(" ".join(t)) for _, t in rows]
    want = components(range(len(rows)), lambda a, b: similar(sets[a], sets[b]))
    numbers = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    table = spark.createDataFrame([(i, 7, 5, sorted(numbers[x] for x in s)) for i, s in enumerate(sets)], "id long, component long, blocks int, shingles array<long>").repartition(3)
    whole = simhash.similar_sets(np.array([len(s) for s in sets]), np.concatenate([np.array(sorted(numbers[x] for x in s), np.uint64) for s in sets]), 0.8)
    assert len(set(whole.tolist())) == len(set(want.values())) >= 3
    for most, representatives, rounds in ((2000, 2, 3), (100, 1, 1)):
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", most)
        found = {x.node: x.component for x in connected_components(simhash.large_links(plain_written(table, "sets"), 0.8, representatives, rounds)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(7, 7), (2001, 2000)]
    r = random.Random(1)
    r.shuffle(links)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(30)} | {2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_heavy_leaves_are_divided_and_no_link_is_lost(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 1500)
    flip = lambda x: x ^ (1 << r.integers(0, 60, len(x))) ^ (1 << r.integers(0, 60, len(x)))
    crowd = flip(np.full(300, base[0]))  # a cluster that no boundary divides well
    points = np.unique(np.concatenate([base, flip(base[:500]), flip(flip(base[500:700])), crowd]))
    table = spark.createDataFrame([(int(p), [int(p)], 0) for p in points], "id long, fp array<long>, size long").repartition(4)
    monkeypatch.setattr(simhash, "LEAST_LEAVES", 1)
    monkeypatch.setattr(simhash, "LEAF_SAMPLE", 128)
    want = components(points.tolist(), lambda a, b: (a ^ b).bit_count() <= 2)
    largest = []
    for most, trees in ((10**6, 1024), (700, 1024), (250, 0)):
        monkeypatch.setattr(simhash, "LEAF_ROWS", most)
        monkeypatch.setattr(simhash, "ROUND_LEAVES", trees)
        routed = simhash.divided(simhash.first_leaves(table, 2, 1, None), 2, 1, None)
        largest.append(routed.groupBy("leaf").count().agg({"count": "max"}).first()[0])
        assert routed.where("own").count() == len(points) == routed.where("own").select("id").distinct().count()
        found = {x.node: x.component for x in connected_components(simhash.linked_points(simhash.first_leaves(table, 2, 1, None), 2, 1, None)).collect()}
        assert {p: found.get(p, p) for p in points.tolist()} == want
    assert largest[0] == len(points) and largest[1] <= 700 and largest[2] < 0.25 * len(points)


def test_a_crowd_is_linked_as_by_whole_comparison():
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, 3).astype(np.uint64)
    points = np.concatenate([base[i] ^ (np.uint64(1) << r.integers(0, 64, 2500).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 2500).astype(np.uint64)) for i in range(3)] + [r.integers(0, 2**63, 200).astype(np.uint64)])[:, None]
    whole, quick = simhash.LeafJoin(points, None, 4, None), simhash.LeafJoin(points, None, 4, None)
    whole._whole(np.arange(len(points)), np.arange(len(points)))
    quick._pivots(np.arange(len(points)))
    whole.forest.reduce(), quick.forest.reduce()
    assert np.array_equal(whole.forest.label, quick.forest.label) and len(set(quick.forest.label.tolist())) > 100


def test_sets_of_the_similarity_meet_in_a_band():
    r = np.random.default_rng(7)
    lost = tried = 0
    for n in (5, 40, 400):
        sets = r.integers(0, 2**63, (600, n)).astype(np.uint64) * np.uint64(2)
        other = sets.copy()
        other[:, : n // 9] = r.integers(0, 2**63, (600, n // 9)).astype(np.uint64)  # Jaccard similarity 0.8 or a little more
        a, b = (simhash.band_keys(x.ravel(), np.full(600, n)) for x in (sets, other))
        lost += int((~(a == b).any(axis=1)).sum())
        tried += 600
        assert (a == np.roll(b, 1, axis=0)).sum() == 0
    assert lost <= 0.001 * tried
    assert simhash.band_keys(np.empty(0, np.uint64), np.zeros(2, np.int64)).shape == (2, simhash.BANDS)
