import random
from fractions import Fraction

from pyspark.sql import functions as F

from lodestone.llm.mixing import Weights, budgets, divide, mix


def test_shares_are_whole_bounded_and_by_weight():
    r = random.Random(1)
    for _ in range(300):
        names = [f"n{i}" for i in range(r.randint(1, 6))]
        capacity = {n: r.choice([0, r.randint(1, 50), r.randint(1, 1000)]) for n in names}
        weight = {n: Fraction(r.choice([0, 1, 2, 5])) for n in names}
        budget = r.randint(0, 1500)
        share = divide(budget, dict.fromkeys(names), capacity, weight)
        assert sum(share.values()) == min(budget, sum(capacity.values())) and all(0 <= share[n] <= capacity[n] for n in names)
        # Of two nodes below their capacity neither has more for its weight than the other, but for rounding.
        free = [n for n in names if share[n] < capacity[n] and weight[n] > 0]
        for a in free:
            for b in free:
                assert share[a] * weight[b] <= (share[b] + 1) * weight[a] + weight[b]


def test_siblings_before_ancestors():
    tokens = {("a", "x", "s1"): 10, ("a", "x", "s2"): 1000, ("b", "x", "s3"): 1000}
    got = budgets(tokens, Weights(), 600, 1)
    assert got == {("a", "x", "s1"): 10, ("a", "x", "s2"): 290, ("b", "x", "s3"): 300}
    got = budgets(tokens | {("a", "x", "s2"): 50}, Weights(), 600, 1)
    assert got == {("a", "x", "s1"): 10, ("a", "x", "s2"): 50, ("b", "x", "s3"): 540}


def prefixes(rows, quota, seed):
    """rows: (identifier, text, leaf, tokens). The copies of each row, by sorting every leaf as a whole."""
    import xxhash

    def xx(values, h=42):  # Spark's xxhash64: each value is hashed with the last hash as its seed
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), h)
        return h

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    out = {}
    for leaf, q in quota.items():
        own = [(i, signed(xx([t])), n) for i, t, p, n in rows if p == leaf]
        total = sum(n for *_, n in own)
        full, rest = (q // total, q % total) if total else (3, 0)
        used = 0
        # Buckets follow the unsigned hash, rows of a bucket the signed one; within a bucket the sign is the same.
        for i, t, n in sorted(own, key=lambda r: (xx([seed.to_bytes(4, "little"), full, r[0], r[1]]), r[0] is not None, r[0] or 0, r[1])):
            used += n
            out.setdefault((i, leaf), []).append(full + (1 if rest and used <= rest else 0))
    return {k: sorted(v) for k, v in out.items()}


def test_copies_are_those_of_a_whole_sort(spark, odd_rows, odd_docs, clashing_docs, unharmed):
    weights = Weights(lang={"en": 2.0})
    for docs in (odd_docs, clashing_docs):
        for share in (0.1, 0.4, 0.9):
            rows = mix(docs, F.col("source"), weights, share=share, max_epochs=3).collect()
            have, got = {}, {}
            for r in rows:
                leaf = (r.domain, r.lang, r.source)
                have[leaf] = have.get(leaf, 0) + r.n_tokens
                got.setdefault((r.doc_id, leaf), []).append(r.copies)
            quota = budgets(have, weights, int(sum(have.values()) * share), 3)
            want = prefixes([(r.doc_id, r.text, (r.domain, r.lang, r.source), r.n_tokens) for r in rows], quota, 42)
            assert {k: sorted(v) for k, v in got.items()} == want
            if docs is clashing_docs:
                assert all(unharmed(r, {"domain", "n_tokens", "copies"}) for r in rows)


def test_results_can_be_renamed(clashing_docs, unharmed):
    rows = mix(clashing_docs, F.col("source"), Weights(), names=("x_d", "x_n", "x_c")).collect()
    assert all(unharmed(r, set()) and r.x_c == 1 for r in rows)


def test_prefixes_fill_budgets(spark, odd_rows, odd_docs, clashing_docs, no_docs):
    weights = Weights(lang={"en": 2.0})
    for docs in (odd_docs, clashing_docs):
        rows = mix(docs, F.col("source"), weights, share=0.4, max_epochs=3).collect()
        assert len(rows) == len(odd_rows)
        have, used = {}, {}
        for r in rows:
            leaf = (r.domain, r.lang, r.source)
            have[leaf] = have.get(leaf, 0) + r.n_tokens
            used[leaf] = used.get(leaf, 0) + r.n_tokens * r.copies
        quota = budgets(have, weights, int(sum(have.values()) * 0.4), 3)
        for leaf, q in quota.items():
            longest = max(r.n_tokens for r in rows if (r.domain, r.lang, r.source) == leaf)
            assert q - longest < used[leaf] <= q or used[leaf] == q
    assert mix(no_docs, F.col("source"), weights).count() == 0


def test_prefixes_nest_and_follow_the_seed(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", "s") for i in range(500)], "doc_id long, text string, lang string, source string")

    def taken(share, seed=1):
        return {r.doc_id for r in mix(docs, F.lit("d"), Weights(), share=share, seed=seed).where("copies > 0").collect()}

    some, more = taken(0.3), taken(0.6)
    assert some < more and taken(0.3) == some and taken(0.3, 2) != some
