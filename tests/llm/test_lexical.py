"""Ranked search against a slow version that scores every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import lexical
from lodestone.llm.lexical import Collection, DualSorted, ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def ranked(docs, items, k=10):
    """docs, items: (identifier, text). Rows of the result."""
    counted = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs if t]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms, holding = len(counted), sum(c.total() for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for place, (i, c) in enumerate(counted):
            m = 100 - 90 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(fold(text or ""))) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, place))
        out += [(item, rank, None if missing else i, -s) for rank, (s, missing, i, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["été", "Ünder", "x1", "THE", "a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = [" ".join(r.choices(words, weights, k=r.choice([1, 3, 10, 40, 200]))) for _ in range(150)]
    return out + [out[5]] * 40 + ["", " ", None, "\n.,-", "THE the ThE", "w1-w2_w3|w4\x7fw5 w6", "solo", "été ÉTÉ", " ".join(r.choices(words, weights, k=30_000))]


ITEMS = [(1, "w1 w2 w2 W3 the"), (2, "été x1"), (3, ""), (4, None), (5, "unknown words only"), (6, "solo w0 w59 a"), (7, "..."), (2, "w7 w8"), (6, "solo w0 w59 a"), (None, "w1"), (8, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("shard_docs, shard_postings, item_bytes", [(8192, 1 << 20, 16 << 20), (3, 1 << 20, 16 << 20), (1, 1, 16 << 20), (50, 90, 100)])
def test_search(spark, texts, shard_docs, shard_postings, item_bytes):
    docs = [(i if i % 31 else None, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[8])]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], "doc_id long, text string, score string, terms string, item_id string").repartition(4)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = ranked_search(df, items, 10, item_bytes=item_bytes, shard_docs=shard_docs, shard_postings=shard_postings)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in ranked_search(docs, items).collect()] == ranked([(1, "a b")], [(1, "a")])


def test_pieces_end_between_terms(monkeypatch):
    text = ("word été " * 40 + "x" * 100 + " end").encode()
    want = [t for some in terms_of(text) for t in some]
    for size in (1, 7, 64):
        monkeypatch.setattr(lexical, "PIECE_BYTES", size)
        assert [t for some in terms_of(text) for t in some] == want
    assert want == [w.encode() for w in TERM.findall(text.decode())]


@pytest.fixture(params=[(128, 1024, 1 << 22), (1, 2, 1 << 22), (4, 4, 0)], ids=["many", "few", "deepest"])
def walk(request, monkeypatch):
    for name, value in zip(("FEW", "MANY", "IN_HAND"), request.param, strict=True):
        monkeypatch.setattr(lexical, name, value)


@pytest.mark.parametrize("n_docs", [1, 2, 3, 64, 100])
def test_the_tree_gives_what_a_scan_gives(n_docs, walk):
    r = np.random.default_rng(n_docs)
    held = [(d, t, int(r.integers(1, 50))) for d in range(n_docs) for t in range(12) if r.random() < (t + 1) / 20]
    docs, terms, impacts = (np.array(x, np.int64) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 3
    tree = DualSorted(docs, terms, impacts, n_docs, 12)
    for chosen in ([3], [0, 5], list(range(12)), [11, 2, 7]):
        weights = r.integers(0, 9, len(chosen))
        scores = defaultdict(int)
        for d, t, x in held:
            if t in chosen:
                scores[d] += int(weights[chosen.index(t)]) * x
        want = sorted(((-s, d) for d, s in scores.items() if s > 0))[:4]
        got, points, _ = tree.top(np.array(chosen), weights, 4)
        assert list(zip((-points).tolist(), got.tolist(), strict=True)) == want


def test_few_nodes_are_opened_where_scores_differ():
    r = np.random.default_rng(6)
    docs, impacts = np.arange(4096), r.permutation(4096) + 1
    _, scores, opened = DualSorted(docs, np.zeros(4096, np.int64), impacts, 4096, 1).top(np.array([0]), np.array([1]), 5)
    assert scores.tolist() == [4096, 4095, 4094, 4093, 4092] and opened < 2500


def test_length_factors_of_huge_collections():
    about = Collection(10**11, 10**14, {})
    lengths = np.array([1, 10**7, 10**9])
    assert about.length_factors(lengths).tolist() == [10 + 90 * int(n) * 10**11 // 10**14 for n in lengths]
