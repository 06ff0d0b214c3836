import hashlib
import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import schemas
from lodestone.operators import audit, corpus, dialogs, near_dup, tokens
from lodestone.operators.ordered import global_position, prefix_sum
from lodestone.sources import jsonl, shards
from lodestone.streaming import build


def test_budget_is_cut_exactly_and_shards_fill(spark):
    docs = spark.createDataFrame([(0, "s", 3), (1, "s", 9), (2, "s", 5)], "doc_id long, source string, n long")
    cut = corpus.budget_cut(docs, ["source"], "doc_id", F.col("n"), 11)
    assert sorted((r.doc_id, r.start, r.kept) for r in cut.collect()) == [(0, 0, 3), (1, 3, 8)]
    sizes = corpus.shard_manifest(corpus.shard_pieces(cut, 4), ["source"]).orderBy("shard").collect()
    assert [r.tokens for r in sizes] == [4, 4, 3]


def test_prefix_sums_cross_buckets(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", None]), i, r.randint(0, 9)) for i in r.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    want, held = {}, {}
    for g, i, v in sorted(rows, key=lambda x: x[1]):
        want[i] = held.get(g, 0)
        held[g] = want[i] + v
    assert {x.i: x.before for x in prefix_sum(df, ["g"], "i", F.col("v"), span=64).collect()} == want
    places = global_position(df, ["v", "i"]).collect()
    assert [x.i for x in sorted(places, key=lambda x: x.position)] == [i for _, i, _ in sorted(rows, key=lambda x: (x[2], x[1]))]


def test_interleave_is_the_heap_merge(spark):
    groups = {"a": 7, "b": 3, "c": 1}
    rows = [(g, i) for g, n in groups.items() for i in range(n)]
    heap, want = [(0.0, g, 0) for g in groups], []
    heapq.heapify(heap)
    while heap:
        _, g, i = heapq.heappop(heap)
        want.append((g, i))
        if i + 1 < groups[g]:
            heapq.heappush(heap, ((i + 1) / groups[g], g, i + 1))
    got = corpus.interleaved(spark.createDataFrame(rows, "g string, i long"), "g", "i").orderBy("turn", "g", "i").collect()
    assert [(r.g, r.i) for r in got] == want


def test_paragraph_chunks_pack_greedily(spark):
    text = "aaaa\n\nbbb\n\n\n" + "c" * 25 + "\n\nd"
    got = corpus.paragraph_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), 10, 1).collect()
    assert [(r.doc_id, r.part, r.chunk) for r in sorted(got, key=lambda r: r.part)] == [(1, 0, "aaaa\nbbb"), (1, 1, "c" * 10), (1, 2, "c" * 10), (1, 3, "ccccc\nd")]


def test_allocation_golden_values(spark):
    from lodestone.plans.catalog import ALLOCATION, TRAIN_TOKENS

    rows = audit.cap_and_fill(spark.createDataFrame(ALLOCATION, "pos int, source string, weight double, finite boolean, usable long, fill double"), TRAIN_TOKENS).orderBy("pos").collect()
    assert [r.cap for r in rows] == [2404701043, 601175261, 400783507, 400783507, 200391754]
    assert [r.allocation for r in rows] == [2632512585, 658128146, 400783507, 197553288, 118857546] and rows[0].shortfall == 284764427


def test_greedy_verdicts_are_sequential(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = [(i, r.choice(base) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) for i in range(150)]
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in prints]
    kept = []
    for i, p in prints:
        if all((p ^ q).bit_count() > 3 for _, q in kept):
            kept.append((i, p))
    got = near_dup.greedy_accepted(spark.createDataFrame(signed, "id long, fp long"), 3).where("accepted").collect()
    assert {x.id for x in got} == {i for i, _ in kept}


def test_token_shards_round_trip(spark, tmp_path):
    stream = spark.range(23).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("token"))
    shards.write_shards(stream, str(tmp_path), 10, 100)
    assert [f.size for f in shards.shard_files(str(tmp_path))] == [20, 20, 6]
    back = spark.read.format("token_shards").load(str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.token) for r in back] == [(i, 3 * i) for i in range(23)]
    assert shards.verify_shards(spark, str(tmp_path)).where("NOT ok").count() == 0
    (tmp_path / "shard_00001.bin").write_bytes(b"abc")
    with pytest.raises(shards.ShardError):
        shards.shard_files(str(tmp_path))


def test_range_reads_cross_shards(spark):
    table = spark.createDataFrame([("a", 7, list(range(7))), ("b", 8, list(range(7, 15)))], "path string, tokens long, values array<int>")
    assert [r.token for r in tokens.read_range(table, 5, 6).orderBy("pos").collect()] == list(range(5, 11))
    with pytest.raises(tokens.CorpusExhausted):
        tokens.read_range(table, 10, 6)
    rows = tokens.training_rows(tokens.read_range(table, 0, 15), 4).orderBy("block").collect()
    assert [(r.inputs, r.targets) for r in rows][1] == ([5, 6, 7, 8], [6, 7, 8, 9]) and len(rows) == 3


def test_torn_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a"')
    assert sorted(r.a for r in jsonl.read_tolerant(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    assert jsonl.count_rows(spark, str(tmp_path / "x.jsonl")) == 3 and jsonl.count_rows(spark, str(tmp_path / "no")) == 0
    (tmp_path / "y.jsonl").write_text('{"a"\n{"a": 2}\n')
    with pytest.raises(Exception, match="bad line"):
        jsonl.read_tolerant(spark, str(tmp_path / "y.jsonl"), "a int").collect()


def test_stream_resumes_and_refuses_other_configurations(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 2}", "word " * 40 + str(i % 7)) for i in range(30)], "doc_id long, source string, text string")
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    docs.where("doc_id < 15").coalesce(1).write.parquet(source)
    first = build.build(spark, source, docs.schema, folder, 250).count()
    docs.where("doc_id >= 15").coalesce(1).write.mode("append").parquet(source)
    got = build.build(spark, source, docs.schema, folder, 250).collect()
    assert 0 < first <= len(got) and len({(r.source, r.key) for r in got}) == len(got)
    assert all(sum(r.kept for r in got if r.source == s) <= 250 for s in ("s0", "s1"))
    with pytest.raises(build.ConfigChanged):
        build.build(spark, source, docs.schema, folder, 300)


def test_a_batch_takes_the_first_documents_and_runs_again_alike(spark, tmp_path):
    text = lambda k: f"text {k} " + "word " * 40
    schema = "doc_id long, source string, text string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(9, "a", text(1)), (3, "a", text(1)), (5, "b", text(1)), (4, "a", "short"), (6, None, text(2))], schema).coalesce(1).write.parquet(source)
    got = build.build(spark, source, schema, folder, 10**6).collect()
    assert sorted((r.doc_id, str(r.source), r.batch) for r in got) == [(3, "a", 0), (5, "b", 0), (6, "None", 0)]
    spark.createDataFrame([(1, "a", text(1)), (2, "a", text(2)), (7, None, text(2))], schema).coalesce(1).write.mode("append").parquet(source)
    got = build.build(spark, source, schema, folder, 10**6)
    assert sorted((r.doc_id, str(r.source), r.batch) for r in got.collect()) == [(2, "a", 1), (3, "a", 0), (5, "b", 0), (6, "None", 0)]
    # A batch whose marker is missing is written anew, with the sums of the batch before it.
    fs, marker = build._fs(spark, f"{folder}/done/1")
    fs.delete(marker, True)
    build.accept_batch(spark.createDataFrame([("a", "k", 2, 43)], build.FIRST), 1, folder, 10**6)
    assert sorted(r.doc_id for r in build.committed(spark, folder).collect()) == [2, 3, 5, 6]


def test_the_streaming_query_takes_first_documents_however_files_are_cut(spark, tmp_path):
    import duckdb

    from lodestone.queries import ORACLES, QUERIES

    docs = spark.createDataFrame([(i, f"text {i // 3} " + "word " * 300, "en", f"src{i % 2}") for i in range(60)], "doc_id long, text string, lang string, source string")
    for begin in range(54, -1, -6):  # files of the first documents come last
        docs.where(f"doc_id >= {begin} AND doc_id < {begin + 6}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = "source, doc_id, key, tokens, kept, batch"
    got = QUERIES["stream_build"](spark, str(tmp_path)).select(*columns.split(", "))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(ORACLES["stream_build"]).project(columns).fetchall())


def best_by_hand(rows, k, similar=True):
    """The k best others of each item by comparing all pairs; ties by the hash of the other."""
    out = {}
    for i, name, words, split in rows:
        found = {}
        for j, other, held, scope in rows:
            if scope == split and other != name and i != j:
                key = ((-1 if similar else 1) * len(set(words) & set(held)), hashlib.sha256(j.encode()).hexdigest(), j)
                found[other] = min(found.get(other, key), key)
        out[i] = [(x[2], abs(x[0])) for x in sorted(found.values())[:k]]
    return out


@pytest.mark.parametrize("frequent", [1000, 4])
def test_partners_are_those_of_comparing_all_pairs(spark, frequent):
    """Hot words, rare words, equal word sets, equal names, and two scopes, in each of which all items are in every sample."""
    r = random.Random(4)
    hot, rare = [f"h{i}" for i in range(4)], [f"r{i}" for i in range(30)]
    rows = [(f"i{i}", f"n{i % 50}", sorted({*(w for w in hot if r.random() < 0.6), *r.sample(rare, r.choice([0, 0, 1, 2]))}), "ab"[i % 2]) for i in range(140)]
    items = spark.createDataFrame(rows, "id string, name string, words array<string>, split string").repartition(3)
    for similar in (True, False):
        got = {}
        for x in sorted(dialogs.partners(items, ["split"], 5, similar, frequent).collect(), key=lambda x: x["rank"]):
            got.setdefault(x.id, []).append((x.other, x.overlap))
        assert got == best_by_hand(rows, 5, similar)
    assert dialogs.partners(items.limit(0), ["split"], 5).count() == 0


def test_large_and_small_sets_of_frequent_words_meet(spark, monkeypatch):
    """Sets of more frequent words than have their subsets listed, beside such of fewer."""
    monkeypatch.setattr(dialogs, "SUBSETS", 2)
    r = random.Random(6)
    rows = [(f"i{i}", f"n{i % 40}", sorted({*(f"h{j}" for j in range(6) if r.random() < 0.4), *r.sample([f"r{j}" for j in range(30)], i % 2)}), "ab"[i % 2]) for i in range(140)]
    items = spark.createDataFrame(rows, "id string, name string, words array<string>, split string")
    got = {}
    for x in sorted(dialogs.partners(items, ["split"], 5, True, 4).collect(), key=lambda x: x["rank"]):
        got.setdefault(x.id, []).append((x.other, x.overlap))
    assert got == best_by_hand(rows, 5)


def shuffled(spark):
    """Rows written to exchanges by each stage of the session."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


def test_no_row_of_a_sample_passes_an_exchange(spark):
    """300 items ask 100 others each: 30,000 rows, of which none travels where the items are few; the other way gives the same."""
    r = random.Random(8)
    rows = [(f"i{i}", f"n{i % 90}", r.sample([f"w{j}" for j in range(12)], 4), "a") for i in range(300)]
    items = dialogs.numbered(spark.createDataFrame(rows, "id string, name string, words array<string>, split string"), ["split"])
    before = shuffled(spark)
    near = dialogs.sampled(items, 4)
    assert 300 <= sum(n for stage, n in shuffled(spark).items() if stage not in before) < 2_000
    assert sorted(map(str, near.collect())) == sorted(map(str, dialogs.sampled(items, 4, sides_bytes=0).collect()))


def test_tasks_that_pair_fingerprints_are_not_put_together(spark):
    """Spark would go by the bytes of the keys, not by the pairs that come of them."""
    prints = spark.createDataFrame([(i, i % 7) for i in range(50)], "id long, fp long")
    plan = near_dup.near_pairs(near_dup.classes(prints), 3)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_neighbours_are_a_sample_of_the_scope(spark):
    items = spark.createDataFrame([(f"i{i}", "a" if i < 300 else "b") for i in range(330)], "id string, split string")
    got = {}
    for x in dialogs.neighbours(items, ["split"], 1).collect():
        got.setdefault(x.id, []).append(x.other)
    assert all(len(v) == len(set(v)) == (100 if int(k[1:]) < 300 else 29) and k not in v for k, v in got.items())


def tool(name, **fields):
    return {"name": name, "description": f"Do {name}", "parameters": {"properties": fields, "required": [k for k, v in fields.items() if v.get("must")]}}


def test_seeds_are_checked_in_order():
    a, b = tool("a", x={"type": "int", "must": True}), tool("b", y={"type": "str"})
    one = [{"name": " a ", "arguments": json.dumps({"x": 1})}]
    cases = [("", [a], one, "empty_query"), (None, "[", one, "empty_query"), ("q", "[", one, "unparseable_tools_or_answers"), ("q", [a], {"name": "a"}, "unparseable_tools_or_answers"), ("q", [a], one * 2, "not_single_call"), ("q", [a], [], "not_single_call"), ("q", [a], ["a"], "invalid_answer"), ("q", [a, a], one, "called_tool_not_unique"), ("q", [b], one, "called_tool_not_unique"), ("q", [a, b], [{"name": "a", "arguments": {}}], "invalid_arguments"), ("q", [a], [{"name": "a"}], "invalid_arguments"), ("q", [a], [{"name": "a", "arguments": {"x": True}}], "invalid_arguments")]
    for query, tools, answers, fault in cases:
        text = lambda v: v if isinstance(v, str) else json.dumps(v)
        assert dialogs.seed_of(query, text(tools), text(answers)) == (fault, None, None)
    fault, found, given = dialogs.seed_of("q", json.dumps([b, a]), json.dumps(one))
    assert fault is None and found["name"] == "a" and given == {"x": 1}


def case(category, turn, fields, given, similar=4, unlike=7):
    seed = {"source_id": "s", "source_position": 3, "query": "do it", "tool": schemas.tidy_tool(tool("own", **fields)), "arguments": given}
    others = [schemas.tidy_tool(tool(f"t{i}", z={"type": "str"})) for i in range(8)]
    return dialogs.Case(category, seed, turn, others[:similar], others[:unlike])


def test_every_category_makes_sound_records():
    fields, given = {"city": {"type": "str", "must": True}, "days": {"type": "int"}}, {"city": "Bonn", "days": 3}
    for turn in range(12):
        made = {c: dialogs.make_candidate(case(c, turn, fields, given)) for c in dialogs.CATEGORIES}
        for c, parts in made.items():
            assert schemas.target_fault(parts.target, parts.tools) is None, c
            assert len({t["name"] for t in parts.tools}) == len(parts.tools) <= 6
            assert dialogs.rendered_fault(schemas.canonical(parts.target), parts.target) is None
        names = {c: {t["name"] for t in p.tools} for c, p in made.items()}
        assert len(names["valid_call"]) == 1 + min(5, turn % 6) and len(names["confusable_tools"]) == 5
        assert "own" not in names["no_applicable_tool"] and len(names["no_applicable_tool"]) == 2 + turn % 5
        assert (made["no_applicable_tool"].request in dialogs.CHATTER) == (turn % 3 == 0)
        gap = made["missing_required_fields"]
        (gone,) = gap.target["missing_required_fields"]
        assert gone not in gap.target["arguments"] and next(t for t in gap.tools if t["name"] == "own")["parameters"]["required"] == sorted({"city", gone})
        assert made["schema_constraints"].about["constraint_fields"] == ["days"] and ('{"city":"Bonn","days":3}' in made["schema_constraints"].request) == bool(turn % 2)
        assert sum(t["description"].startswith(tuple(dialogs.INTRUSIONS)) for t in made["injection_resistance"].tools) == 1
    plain = dialogs.make_candidate(case("schema_constraints", 0, {"city": {"type": "str", "must": True}}, {"city": "Bonn"}))
    shown = next(t for t in plain.tools if t["name"] == "own")
    assert "Bonn" in shown["parameters"]["properties"]["city"]["enum"] and plain.target["arguments"] == {"city": "Bonn"}
    assert [dialogs.make_candidate(case(c, 0, fields, {}, 0, 0)) is None for c in dialogs.CATEGORIES] == [False, True, True, True, True, True]


def test_rendered_targets():
    target = {"decision": "no_call", "tool_name": None, "arguments": {}, "missing_required_fields": []}
    text = schemas.canonical(target)
    assert [dialogs.rendered_fault(t, target) for t in (text, text + " ", text.replace("no_call", "call"), "[]", None)] == [None, "not canonical", "another target", "not an object", "not an object"]


def test_context_limits_and_identifiers(spark):
    talk = spark.createDataFrame([(i, 0, "user", f"please handle request number{i} quickly today") for i in range(12)], "conv_id long, turn long, role string, text string")
    seeds = dialogs.synthetic_seeds(spark, talk)
    wide, tight = (dialogs.candidates(seeds, 2, context=c).collect() for c in (2048, 12))
    assert {x.fault for x in wide} == {None} and all(x.id.startswith("tc_sft_v1_") and len(x.id) == 34 for x in wide)
    assert {x.fault for x in tight} == {"over_context"} and len(tight) == len(wide)


def test_audit_sample_looks_back_at_recent_rows_only(spark):
    from lodestone.functions.hashing import simhash_shingles

    texts = [f"text number {i % 40} of the sample with several words" for i in range(400)]
    docs = spark.createDataFrame([(i, f"s{i % 3}", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").repartition(3)
    prints = {x.text: x.f for x in docs.select("text", simhash_shingles(F.col("text")).alias("f")).distinct().collect()}
    got = {x.source: (x.sampled, x.near_duplicates) for x in near_dup.audit_sample(docs, simhash_shingles(F.col("text")), 1.0, 90, 3, recent=4).collect()}
    want = {}
    for s in ("s0", "s1", "s2"):
        held, near, n = {}, 0, 0
        for i in range(400):
            if f"s{i % 3}" != s or n == 90:
                continue
            f, n = prints[texts[i]] % 2**64, n + 1
            bands = [(b, f >> 16 * b & 0xFFFF) for b in range(4)]
            near += any((f ^ g).bit_count() <= 3 for b in bands for g in held.get(b, [])[-4:])
            for b in bands:
                held.setdefault(b, []).append(f)
        want[s] = (n, near)
    assert got == want
