import hashlib
import random
import zlib
from bisect import bisect_right
from collections import defaultdict
from itertools import combinations

from lodestone.llm.sharding import RESULTS, Runs, assign_shards, even_cuts, minimax_boundaries


def smallest(sizes, shards):
    def fits(capacity):
        n, held = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if held + s > capacity:
                n, held = n + 1, 0
            held += s
        return n <= shards

    return next(c for c in sorted({sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)}) if fits(c))


def test_search_is_exact():
    r = random.Random(5)
    for case in range(60):
        shards = r.choice([1, 2, 3, 7])
        groups = sorted((hashlib.sha256(f"{case}.{i}".encode()).hexdigest(), r.choice([16, r.randint(16, 3000), r.randint(1, 20000)])) for i in range(r.choice([1, 2, 5, 40])))

        def runs(prefixes, digits):
            out = {}
            for k, s in groups:
                if prefixes is None or k.startswith(tuple(prefixes)):
                    n, size, most = out.get(k[:digits], (0, 0, 0))
                    out[k[:digits]] = (n + 1, size + s, max(most, s))
            return [(k, *v) for k, v in out.items()]

        capacity, begins = minimax_boundaries(Runs(runs(None, 1)), shards, lambda ps: [x for d in {len(p) for p in ps} for x in runs([p for p in ps if len(p) == d], d + 2)])
        assert capacity == smallest([s for _, s in groups], shards)
        sums = defaultdict(int)
        for k, s in groups:
            sums[bisect_right(begins, k)] += s
        assert max(sums.values()) == capacity and len(begins) < shards


def runs_of(groups):
    def runs(prefixes, digits):
        out = {}
        for k, s in groups:
            if prefixes is None or k.startswith(tuple(prefixes)):
                n, size, most = out.get(k[:digits], (0, 0, 0))
                out[k[:digits]] = (n + 1, size + s, max(most, s))
        return [(k, *v) for k, v in out.items()]

    return Runs(runs(None, 1)), lambda ps: [x for d in {len(p) for p in ps} for x in runs([p for p in ps if len(p) == d], d + 2)]


def test_the_least_shard_is_as_large_as_the_capacity_allows():
    r = random.Random(6)
    for case in range(150):
        shards, n = r.choice([1, 2, 3, 4]), r.choice([1, 2, 4, 7, 9])
        groups = sorted((hashlib.sha256(f"{case}/{i}".encode()).hexdigest(), r.choice([16, r.randint(16, 60), r.randint(1, 20000)])) for i in range(n))
        sizes = [s for _, s in groups]
        capacity, begins = minimax_boundaries(*((x := runs_of(groups))[0], shards, x[1]))
        used = min(shards, n)
        best = 0
        for cuts in combinations(range(1, n), used - 1):
            sums = [sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, n), strict=True)]
            if max(sums) <= capacity:
                best = max(best, min(sums))
        sums = defaultdict(int)
        for k, s in groups:
            sums[bisect_right(begins, k)] += s
        assert len(sums) == used and max(sums.values()) <= capacity and min(sums.values()) == best


def test_no_shard_stays_empty():
    groups = sorted((hashlib.sha256(f"equal {i}".encode()).hexdigest(), 100 + i % 2) for i in range(58))
    x = runs_of(groups)
    _, begins = minimax_boundaries(x[0], 40, x[1])
    counts = defaultdict(int)
    for k, _ in groups:
        counts[bisect_right(begins, k)] += 1
    assert sorted(counts.values()) == [1] * 22 + [2] * 18


def test_narrow_windows_still_give_even_shards():
    r = random.Random(4)
    groups = sorted((hashlib.sha256(f"narrow {i}".encode()).hexdigest(), r.randint(16, 400)) for i in range(3000))
    whole = sum(s for _, s in groups)
    runs, opened = runs_of(groups)
    capacity, exact = minimax_boundaries(runs, 7, opened)
    for most in (1, 2, 40):
        fine, cuts = even_cuts(runs, capacity + 2000, 7, opened, most)
        sums = [b - a for a, b in zip([0, *cuts], [*cuts, whole], strict=True)]
        assert len(sums) == 7 and max(sums) <= capacity + 2000
        assert most < 40 or min(sums) > whole / 7 - 800


def test_odd_rows(spark, odd_rows, odd_docs, clashing_docs, no_docs, unharmed):
    for docs, room in ((odd_docs, 10), (clashing_docs, 10), (odd_docs, 0)):
        rows = assign_shards(docs, 4, broadcast_runs=room).collect()
        assert docs is odd_docs or all(unharmed(r, set(RESULTS)) for r in rows)
        assert len(rows) == len(odd_rows)
        shard_of, slots, sizes = {}, defaultdict(list), defaultdict(int)
        for r in rows:
            raw = (r.text or "").encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
            assert shard_of.setdefault(raw, r.shard) == r.shard, "equal texts share a shard"
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
        by_text = defaultdict(int)
        for r in rows:
            by_text[r.text or ""] += r["size"]
        assert max(sizes.values()) >= max(by_text.values())
    assert assign_shards(no_docs, 4).count() == 0


def test_a_group_above_the_mean_is_a_shard_of_its_own(spark):
    docs = spark.createDataFrame([(i, "same" * 50 if i < 200 else f"text {i}") for i in range(400)], "doc_id long, text string")
    sizes = defaultdict(int)
    kinds = defaultdict(set)
    for r in assign_shards(docs, 5).collect():
        sizes[r.shard] += r["size"]
        kinds[r.shard].add(r.text.startswith("same"))
    assert len(sizes) == 5 and all(len(k) == 1 for k in kinds.values())
    rest = sorted(s for k, s in sizes.items() if kinds[k] == {False})
    assert rest[-1] - rest[0] < 100


def test_shards_are_contiguous_runs_and_the_largest_is_least(spark):
    r = random.Random(8)
    texts = ["t%d " % i * r.choice([1, 5, 40, 300]) for i in range(300)]
    docs = spark.createDataFrame([(i, r.choice(texts)) for i in range(900)], "doc_id long, text string").repartition(5)
    rows = assign_shards(docs, 7).collect()
    groups, shard = defaultdict(int), {}
    for x in rows:
        groups[x.text_sha] += x["size"]
        shard[x.text_sha] = x.shard
    order = sorted(groups)
    assert [shard[k] for k in order] == sorted(shard.values())
    sums = defaultdict(int)
    for k in order:
        sums[shard[k]] += groups[k]
    assert max(sums.values()) == smallest([groups[k] for k in order], 7)


def test_a_hot_text_without_identifiers(spark):
    docs = spark.createDataFrame([(None, "same")] * 300 + [(i, f"text {i}") for i in range(300)], "doc_id long, text string").repartition(6)
    rows = assign_shards(docs, 3).collect()
    for k in {r.shard for r in rows}:
        slots = [r.slot for r in rows if r.shard == k]
        assert sorted(slots) == list(range(len(slots)))
    assert len({r.shard for r in rows if r.text == "same"}) == 1
