import hashlib
import random
from collections import defaultdict

import numpy as np

from lodestone.llm.line_dedup import PerfectHash, Shard, dedup_lines


def brute(rows, chars, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= chars:
                held[key(line)].add(i)
    often = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if often.get(key(x), i) == i and not (i is None and key(x) in often)]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_perfect_hash_numbers_every_key_and_prints_keep_strangers_out():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    assert sorted(PerfectHash.build(keys).rank(keys).tolist()) == list(range(len(keys)))
    order = np.arange(len(keys), dtype=np.int64)
    shard = Shard.unpack(Shard.build(keys, keys + np.uint64(1), order, order * 2).pack())
    member, last = shard.last_document(keys, keys + np.uint64(1))
    assert member.all() and np.array_equal(last, order * 2)
    assert not shard.last_document(keys + np.uint64(3), keys)[0].any()
    empty = Shard.unpack(Shard.build(keys[:0], keys[:0], order[:0], order[:0]).pack())
    assert not empty.last_document(keys, keys)[0].any()


def test_lines_of_both_ways_are_those_of_brute_force(spark, odd_rows, clashing_docs, no_docs):
    r = random.Random(3)
    common = [f"  Common LINE number {i} with enough letters é" for i in range(6)]
    rows = [(i, t) for i, t, *_ in odd_rows]
    rows += [(100 + i, "\n".join(r.choice([*common, "own line %d %d" % (i, j), "", common[0].upper()]) for j in range(r.randint(0, 8)))) for i in range(80)]
    rows += [(None, common[0]), (100, rows[-80][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 40, 5)
    for room, probes in ((1 << 20, 200_000), (0, 200_000), (0, 30)):
        got = dedup_lines(docs, broadcast_bytes=room, copy_probes=probes).collect()
        assert sorted((str(x.doc_id), x.n_lines, x.n_dropped, x.kept_sha256) for x in got) == want
        assert all(hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256 for x in got)
    assert dedup_lines(clashing_docs, 5, 2).count() == len(odd_rows)
    assert dedup_lines(no_docs).count() == 0


def test_large_identifiers_and_missing_ones_agree_on_both_ways(spark):
    line = "a line of more than forty characters, which stands in many documents"
    rows = [(2**53 + 3 + i, f"{line}\nown {i}") for i in range(8)] + [(None, line), (None, None), (-(2**62), line), (-(2**63), "x\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 40, 5)
    for room in (1 << 20, 0):
        got = dedup_lines(docs, broadcast_bytes=room).collect()
        assert sorted((str(x.doc_id), x.n_lines, x.n_dropped, x.kept_sha256) for x in got) == want
        assert sum(line in x.kept for x in got) == 1
