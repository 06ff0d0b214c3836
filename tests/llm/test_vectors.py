"""Product codes and exact top-k search against slow versions that use Python's integers only."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import vector_codes
from lodestone.llm.top_k import LOWEST, Block, bounds, exact_kind, exact_top_k, search
from lodestone.llm.vector_codes import Codebooks, compress_vectors, fit_codebooks, intervals, nearest
from lodestone.llm.vectors import integer_vectors, largest_component

ROWS = "vec_id long, embedding array<float>, label int, score string, part string, n string, cell string, code string, first string, vector string"
NAN, INF = float("nan"), float("inf")


def made(r, n, dim, spread=0.5):
    return [(i, [r.uniform(-spread, spread) for _ in range(dim)], r.choice([0, 1, 2, None]), *["user's"] * 7) for i in range(n)]


def odd(r, dim):
    """Ties, repeated rows, nulls in every place, non-finite components, other lengths, one hot vector."""
    rows = made(r, 90, dim)
    same = [0.25] * dim
    rows += [(1000 + i, same, 7, *["user's"] * 7) for i in range(60)]
    rows += [rows[3], rows[3], (3, rows[4][1], 1, *[None] * 7), (None, rows[5][1], None, *[None] * 7)]
    rows += [(2000, None, 1, *[None] * 7), (2001, [None, *same[1:]], 1, *[None] * 7), (2002, [NAN, *same[1:]], 1, *[None] * 7), (2003, [-INF, *same[1:]], 1, *[None] * 7), (2100, [], 1, *[None] * 7), (2200, same[:-1], 1, *[None] * 7)]
    rows += [(5000, [-0.0] * dim, 0, *[None] * 7), (5100, [1e-30] * dim, 0, *[None] * 7), (5200, [-1e-30] * dim, 0, *[None] * 7), (5300, [30.0, *[-30.0] * (dim - 1)], 0, *[None] * 7)]
    return rows


def whole(rows, scale, dim):
    out = []
    for vec_id, x, label, *_ in rows:
        if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x):
            out.append((vec_id, [math.floor(scale * float(np.float32(c))) for c in x], label))
    return out


def coded(rows, dim, parts, entries, rounds):
    """The method in Python's integers: codes, errors, codebooks."""
    width = dim // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    ordered = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    books = [[cut(v)[p] for _, v, _ in ordered[:entries]] for p in range(parts)]

    def choose(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in rows:
            for p, x in enumerate(cut(v)):
                members[p, choose(x, p)[1]].append(x)
        for (p, e), xs in members.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], defaultdict(int)
    for vec_id, v, label in rows:
        chosen = [choose(x, p) for p, x in enumerate(cut(v))]
        error = sum(d for d, _ in chosen)
        out.append((vec_id, "".join(f"{e:02x}" for _, e in chosen), error, label))
        by_label[label] += error
    return sorted((str(i), c, e, by_label[x]) for i, c, e, x in out), books


@pytest.mark.parametrize("entries", [1, 5, 16])
def test_codes(spark, entries):
    r = random.Random(entries)
    rows = odd(r, 16)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    for labels in (100, 0):
        codes, books = compress_vectors(df, parts=4, entries=entries, rounds=3, scale=64, broadcast_labels=labels)
        want, want_books = coded(whole(rows, 64, 16), 16, 4, entries, 3)
        assert sorted((str(x.vec_id), x.code, x.error, x.label_error) for x in codes.collect()) == want
        assert books.entries.tolist() == want_books
        text = ",".join(str(c) for b in want_books for e in b for c in e)
        assert books.text() == text and books.sha256() == hashlib.sha256(text.encode()).hexdigest()


def test_a_code_names_its_vector():
    books = Codebooks(np.arange(2 * 3 * 2).reshape(2, 3, 2))
    assert books.decoded("0201") == [4, 5, 8, 9]


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], ROWS)
    assert compress_vectors(none)[0].collect() == [] and compress_vectors(none)[0].columns == ["vec_id", "code", "error", "label_error"]
    only_null = spark.createDataFrame([(1, None, 1, *[None] * 7)], ROWS)
    assert compress_vectors(only_null)[0].collect() == []
    hollow = spark.createDataFrame([(i, [], 1, *[None] * 7) for i in (100, 200, 300)], ROWS)
    assert compress_vectors(hollow)[0].collect() == [] and exact_top_k(hollow, hollow).collect() == []
    two = spark.createDataFrame([(1, [0.5] * 8, None, *[None] * 7), (2, [0.5] * 8, 3, *[None] * 7)], ROWS)
    assert [tuple(x) for x in compress_vectors(two)[0].orderBy("vec_id").collect()] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]
    assert exact_top_k(none, none).collect() == []
    assert exact_top_k(two, none).collect() == []
    assert [tuple(x) for x in exact_top_k(two, two).orderBy("query_id").collect()] == [(1, 1, 2, 8 * 512**2), (2, 1, 1, 8 * 512**2)]


def test_lengths_that_have_no_equal_parts_and_components_without_room(spark):
    three = spark.createDataFrame([(1, [0.5] * 3, 1, *[None] * 7)], ROWS)
    with pytest.raises(ValueError, match="equal parts"):
        compress_vectors(three)
    huge = spark.createDataFrame([(1, [1e30] * 8, 1, *[None] * 7)], ROWS)
    with pytest.raises(Exception, match="beyond"):
        compress_vectors(huge)
    with pytest.raises(ValueError, match="two hexadecimal digits"):
        fit_codebooks(huge, 8, entries=257)
    assert 64 * (2 * largest_component(64)) ** 2 < 2**63


def test_intervals_hold_and_screening_never_errs():
    r = np.random.default_rng(3)
    for size in (3, 2**11, 2**20, 2**27):
        for d in (1, 8, 64):
            points, entries = (r.integers(-size, size, (n, d)) for n in (400, 16))
            points[:50] = entries[r.integers(0, 16, 50)] + r.integers(-1, 2, (50, d))
            entries[7], entries[9] = entries[2], entries[2]
            exact = [[sum(int(c) ** 2 for c in e) - 2 * sum(int(a) * int(c) for a, c in zip(x, e, strict=True)) for e in entries] for x in points]
            low, high = intervals(points, entries)
            assert all(a <= v <= b for row in zip(low, exact, high, strict=True) for a, v, b in zip(*row, strict=True))
            best, error = nearest(points, entries)
            for x, row, e, off in zip(points, exact, best, error, strict=True):
                assert e == min(range(16), key=lambda j: (row[j], j)) and off == row[e] + sum(int(a) ** 2 for a in x)


def test_batches_do_not_matter(monkeypatch):
    r = np.random.default_rng(4)
    points, entries = r.integers(-50, 50, (333, 4)), r.integers(-50, 50, (16, 4))
    want = nearest(points, entries)
    monkeypatch.setattr(vector_codes, "AT_ONCE", 16)
    assert all((a == b).all() for a, b in zip(want, nearest(points, entries), strict=True))


def asked(rows, k, every):
    queries = {}
    for vec_id, v, _ in rows:
        if vec_id is not None and vec_id % every == 0:
            queries[vec_id] = min(queries.get(vec_id, v), v)
    out = []
    for q, x in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v, _ in rows if i is not None and i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("part_docs, group_queries, room", [(131_072, 8192, 1 << 20), (40, 7, 1 << 20), (40, 7, 0)])
def test_top_k(spark, part_docs, group_queries, room):
    rows = odd(random.Random(9), 6)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = exact_top_k(df, df.where("vec_id % 10 = 0"), 10, 64, block_docs=8, part_docs=part_docs, group_queries=group_queries, broadcast_bounds=room)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == asked(whole(rows, 64, 6), 10, 10)


def test_blocks_are_skipped_where_vectors_have_structure():
    r = np.random.default_rng(1)
    centres = r.integers(-1000, 1000, (40, 16))
    blocks = [Block(np.arange(i * 64, i * 64 + 64), c + r.integers(-20, 20, (64, 16))) for i, c in enumerate(centres)]
    queries = centres[:12] + r.integers(-20, 20, (12, 16))
    rows, ids, scores, scored = search(queries, np.full(12, -1), np.full(12, LOWEST), blocks, 10)
    every = np.concatenate([b.forward for b in blocks])
    for q in range(12):
        want = sorted((-int(x), i) for i, x in enumerate(queries[q] @ every.T))[:10]
        assert list(zip((-scores[rows == q]).tolist(), ids[rows == q].tolist(), strict=True)) == want
    assert scored < 12 * 40 / 4


def test_bounds_and_exact_products():
    r = np.random.default_rng(2)
    docs, queries = r.integers(-9, 9, (50, 7)), r.integers(-9, 9, (20, 7))
    reach = bounds(queries, docs.min(axis=0)[None], docs.max(axis=0)[None])
    assert (reach[:, 0] >= (queries @ docs.T).max(axis=1)).all()
    assert exact_kind(2**20, 2**20, 64) is np.float64 and exact_kind(2**27, 2**27, 64) is np.int64
    far = np.array([[2**27, -(2**27) + 1], [2**27 - 1, 2**27]])
    rows, ids, scores, _ = search(far, np.array([0, 1]), np.full(2, LOWEST), [Block(np.arange(2), far)], 3)
    assert list(zip(rows, ids, scores, strict=True)) == [(q, 1 - q, int(far[0, 0]) * int(far[1, 0]) + int(far[0, 1]) * int(far[1, 1])) for q in range(2)]


def test_ties_at_the_last_rank_go_to_the_smaller_identifier():
    same = np.full((30, 3), 5)
    blocks = [Block(np.arange(20, 30), same[:10]), Block(np.arange(0, 10), same[:10]), Block(np.arange(10, 20), same[:10])]
    _, ids, _, _ = search(same[:1], np.array([3]), np.array([LOWEST]), blocks, 4)
    assert ids.tolist() == [0, 1, 2, 4]


def test_integer_vectors_keep_other_columns(spark):
    rows, dim = integer_vectors(spark.createDataFrame(odd(random.Random(1), 4), ROWS).select("vec_id", "embedding", "label"), 10)
    assert dim == 4 and rows.columns == ["vec_id", "label", "vector"]
    by = {r.vec_id: r.vector for r in rows.collect()}
    assert by[5100] == [0] * 4 and by[5200] == [-1] * 4 and by[5000] == [0] * 4 and 2100 not in by and 2200 not in by
