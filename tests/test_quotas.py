"""Sequential decisions in rounds, against processes that look at one row after another."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import audit, corpus, dialogs, quotas

RECORDS = "case int, bucket int, turn int, id string, scope string, fp long"


def in_sequence(rows, quota_of, distance):
    kept, ids, given, out = {}, set(), {}, []
    for case, bucket, turn, name, scope, fp in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        if given.get((case, bucket), 0) >= quota_of(case, bucket) or name in ids or any((fp ^ g).bit_count() <= distance for g in kept.get((case, scope), [])):
            continue
        given[case, bucket] = given.get((case, bucket), 0) + 1
        ids.add(name)
        kept.setdefault((case, scope), []).append(fp)
        out.append((case, bucket, turn, name, scope, fp))
    return sorted(out)


def test_quotas_equal_a_sequential_process(spark):
    r = random.Random(3)
    rows = set()
    for case in range(40):
        centres = [r.getrandbits(63) for _ in range(r.choice([1, 3, 8]))]
        for i in range(r.choice([1, 5, 40])):
            fp = r.choice(centres)
            for _ in range(r.choice([0, 0, 1, 2, 3, 9])):
                fp ^= 1 << r.randrange(63)
            rows.add((case, r.randrange(4), i, f"{case}.{r.randrange(30)}", r.choice("ab"), fp))
    df = spark.createDataFrame(sorted(rows), RECORDS).repartition(3)
    goals = spark.createDataFrame([(case, b, (case * 7 + b * 3) % 6) for case in range(40) for b in range(4)], "case int, bucket int, quota int")
    got = quotas.first_within_quotas(df, ["case", "bucket"], ["turn"], goals, ["case", "scope"], 2, allow_short=True)
    assert sorted(map(tuple, got.collect())) == in_sequence(rows, lambda case, b: (case * 7 + b * 3) % 6, 2)


def made(spark, rows):
    return spark.createDataFrame([(name, split, category, turn, f"s{turn}", "call", "q", "[]", "{}", fault, fp, f"k{turn}") for name, split, category, turn, fault, fp in rows], dialogs.RECORDS)


def test_a_record_beyond_its_quota_blocks_nobody(spark):
    rows = [("a", "train", "valid_call", 0, None, 0), ("b", "train", "valid_call", 1, None, 0xFFFF << 20), ("c", "test", "valid_call", 0, None, (0xFFFF << 20) ^ 1)]
    assert sorted(x.id for x in dialogs.accepted_records(made(spark, rows), 1).collect()) == ["a", "c"]
    assert sorted(x.id for x in dialogs.accepted_records(made(spark, rows), 2, allow_short=True).collect()) == ["a", "b"]


def test_buckets_get_exactly_their_quota_or_say_so(spark):
    rows = [(f"{s}{c}{i}", s, c, i, "odd" if i % 5 == 4 else None, random.Random(f"{s}{c}{i}").getrandbits(63)) for s in ("train", "test") for c in ("valid_call", "schema_constraints") for i in range(30)]
    df = made(spark, rows)
    goals = spark.createDataFrame([("train", "valid_call", 20), ("test", "valid_call", 3), ("train", "schema_constraints", 24)], "split string, category string, quota int")
    kept = dialogs.accepted_records(df, goals).collect()
    assert {k: sum((x.split, x.category) == k for x in kept) for k in {(x.split, x.category) for x in kept}} == {("train", "valid_call"): 20, ("test", "valid_call"): 3, ("train", "schema_constraints"): 24}
    assert all(x.round <= 24 and x.fault is None for x in kept if x.category == "valid_call")
    with pytest.raises(quotas.QuotaShort, match="24 of 25"):
        dialogs.accepted_records(df, 25)
    with pytest.raises(quotas.QuotaShort, match="0 of 1"):
        dialogs.accepted_records(df, spark.createDataFrame([("validation", "valid_call", 1)], "split string, category string, quota int"))
    with pytest.raises(ValueError, match="an id"):
        dialogs.accepted_records(made(spark, [(None, "train", "valid_call", 0, None, 1)]), 1)


def test_records_are_made_once(spark):
    """However costly records are and however long their texts: what is placed and joined are keys."""
    made_rows = spark.sparkContext.accumulator(0)

    def make(batches):
        for part in batches:
            made_rows.add(len(part))
            yield part

    rows = [(0, i % 3, i, f"{i}", "s", i << 8) for i in range(300)]
    df = spark.createDataFrame(rows, RECORDS)
    got = quotas.first_within_quotas(df.mapInPandas(make, RECORDS), ["case", "bucket"], ["turn"], 20, ["scope"], 2, allow_short=True)
    assert sorted(map(tuple, got.collect())) == in_sequence(rows, lambda *_: 20, 2)
    assert made_rows.value == 300


def test_many_copies_in_one_class(spark):
    rows = [(0, b, i, f"{b}.{i}", "s", 7 if i % 2 else i << 8) for b in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, RECORDS)
    got = quotas.first_within_quotas(df, ["case", "bucket"], ["turn"], 150, ["scope"], 2, allow_short=True)
    assert sorted(map(tuple, got.collect())) == in_sequence(rows, lambda *_: 150, 2)


DOCS = "source string, doc_id long, key string, n_tokens long"


def scheduled(rows, weights):
    """(source, doc_id, accepted) in the order of reading."""
    left = {s: sorted((x for x in rows if x[0] == s), key=lambda x: x[1]) for s in weights}
    written, seen, out = dict.fromkeys(weights, 0), set(), []
    while any(left.values()):
        source = min((s for s in weights if left[s]), key=lambda s: (written[s] / weights[s], s))
        _, doc, key, n = left[source].pop(0)
        out.append((source, doc, key not in seen))
        if key not in seen:
            seen.add(key)
            written[source] += n
    return out


def test_the_coupled_schedule_equals_a_greedy_builder(spark):
    r = random.Random(9)
    rows, weights, want = [], {}, {}
    for case in range(25):
        names = [f"{case:02}{c}" for c in "abcde"[: r.choice([1, 2, 3, 5])]]
        own = {s: r.choice([0.25, 1.0, 1.5, 3.0]) for s in names}
        some = [(s, i, f"{case}.{r.randrange(r.choice([4, 30, 1000]))}", r.choice([1, 5, 5, r.randint(1, 90)])) for s in names for i in range(r.choice([1, 6, 30]))]
        rows, weights = rows + some, weights | own
        want[case] = scheduled(some, own)
    df = spark.createDataFrame([*rows, (None, 1, "x", 1), ("00a", None, "x", 1), ("00a", 10_000, None, 1)], DOCS).repartition(4)
    got = quotas.coupled_schedule(df, spark.createDataFrame(list(weights.items()), "source string, weight double")).orderBy("turn", "source", "doc_id").collect()
    for case, order in want.items():
        assert [(x.source, x.doc_id, x.accepted) for x in got if int(x.source[:2]) == case] == order
    assert len(got) == len(rows)


def test_schedules_refuse_sources_without_weights(spark):
    df = spark.createDataFrame([("a", 1, "x", 3), ("b", 1, "y", 3)], DOCS)
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    with pytest.raises(ValueError, match="without a weight: b"):
        quotas.coupled_schedule(df, weights)
    with pytest.raises(ValueError, match="without a weight: b"):
        corpus.fair_order(df, weights)
    with pytest.raises(ValueError, match="must have tokens"):
        quotas.coupled_schedule(spark.createDataFrame([("a", 1, "x", 0)], DOCS), weights)


def test_null_sources_are_a_source_of_their_own(spark):
    text = "enough words to be a document " * 8
    other = "another text that is long enough " * 8
    rows = [(0, None, text), (1, None, text), (2, "a", text), (3, "a", other), (4, None, None), (5, "a", "short"), (6, None, other), (7, None, "short")]
    docs = spark.createDataFrame([(*x, "mit") for x in rows], "doc_id long, source string, text string, license string").repartition(3)
    audited = {x.source: (x.emitted, x.accepted, x.short, x.duplicate) for x in audit.capacity_audit(docs).collect()}
    assert audited == {None: (5, 2, 1, 1), "a": (3, 2, 1, 0)}
    reasons = {x.doc_id: x.reason for x in corpus.rejection_reasons(docs, None, 0.0).collect()}
    assert reasons == {0: None, 1: "duplicate", 2: None, 3: None, 4: "not_text", 5: "short", 6: None, 7: "short"}
    counters = {x.source: (x.read, x.accepted, x.rejected_duplicate) for x in corpus.reason_counters(corpus.rejection_reasons(docs, None, 0.0)).collect()}
    assert counters == {None: (5, 2, 1), "a": (3, 2, 0)}
    firsts = corpus.first_wins(docs.where("text IS NOT NULL"), ["source", "text"], "doc_id")
    assert sorted(x.doc_id for x in firsts.collect()) == [0, 2, 3, 5, 6, 7]
    cut = corpus.budget_cut(docs.where("length(text) > 9"), ["source"], "doc_id", F.lit(10), 15)
    assert {(x.source, x.doc_id): x.kept for x in cut.collect()} == {(None, 0): 10, (None, 1): 5, ("a", 2): 10, ("a", 3): 5}
    slices = {x.source: x.documents for x in corpus.slice_counts(docs, 0.0).where("split = 'train'").collect()}
    assert slices == {None: 2, "a": 2}


def test_a_budgeted_corpus_has_the_bytes_of_its_rule(spark, tmp_path):
    texts = ["a", "", "two\nlines\r\n", "süß", None, "end" * 50, "\n", "last"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for budget in (0, 16, 31, 120, 10_000):
        want = b""
        for t in texts:
            if t is None:
                continue  # no record: it takes nothing of the budget
            record = f"{t}\n<|endoftext|>\n".encode()
            if len(want) + len(record) > budget:
                break
            want += record
        folder = tmp_path / str(budget)
        corpus.write_budgeted(docs.where("text IS NOT NULL"), "doc_id", budget, str(folder), 3)
        assert b"".join(p.read_bytes() for p in sorted(folder.glob("part-*"))) == want
    with pytest.raises(ValueError):
        corpus.write_budgeted(docs, "doc_id", 1, str(tmp_path / "x"), mark="|")
