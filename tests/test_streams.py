"""Streams that stop and go on: lines, budgets, sessions, shards."""

import hashlib
import io
import json
import os
import shutil
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as arrow
from pyspark.sql import functions as F

from lodestone.operators import tokens
from lodestone.sources import files, line_stream, shard_sink, shards
from lodestone.sources.retry import GaveUp, Limits
from lodestone.streaming import shards as build
from lodestone.streaming.build import ConfigChanged
from lodestone.streaming.session import run_session

TEXT = b"first\n\nthird line\n" + "süß ".encode() * 30 + b"\nno feed at the end"


def test_every_cut_of_a_file_gives_each_line_once():
    want = [(0, b"first"), (6, b""), (7, b"third line"), (18, "süß ".encode() * 30), (TEXT.rindex(b"\n") + 1, b"no feed at the end")]
    for data, lines in ((TEXT, want), (TEXT + b"\n", want), (b"\n\n", [(0, b""), (1, b"")]), (b"", [])):
        for chunk in (1, 3, 1 << 20):
            for cut in range(len(data) + 1):
                got = [x for a, b in ((0, cut), (cut, len(data))) if a < b for x in line_stream.lines_between(io.BytesIO(data), a, b, chunk)]
                assert got == lines


class Flaky:
    """A store whose files fail after some reads."""

    def __init__(self, data: bytes, fail_after: list[int]):
        self.data, self.fail_after, self.opened = data, fail_after, 0

    def open_input_file(self, path):
        left, self.opened = (self.fail_after.pop(0) if self.fail_after else 10**9), self.opened + 1
        data = self.data

        class File(io.BytesIO):
            def read(self, n=-1):
                nonlocal left
                left -= 1
                if left < 0:
                    raise ConnectionError("the store is away")
                return super().read(3)

        return File(data)


def test_reading_goes_on_after_failures():
    want = list(line_stream.lines_between(io.BytesIO(TEXT), 0, len(TEXT)))
    waited = []
    store = Flaky(TEXT, [0, 2, 9, 1, 5])
    assert list(line_stream.steady_lines(store, "", 0, len(TEXT), Limits(), sleep=waited.append)) == want
    assert store.opened == 6 and len(waited) == 5 and waited[0] == 2.0
    with pytest.raises(GaveUp):
        list(line_stream.steady_lines(Flaky(TEXT, [0] * 50), "", 0, len(TEXT), Limits(in_a_row=3), sleep=waited.append))


def test_offsets_cover_all_bytes_once():
    there = [arrow.FileInfo(f"/x/{n}", arrow.FileType.File, size=s) for n, s in (("a", 10), ("b", 0), ("c", 25), ("d", 1))]
    for most in (1, 7, 10, 36, 1000, 0):
        at, read = {"file": "", "at": 0}, defaultdict(list)
        for _ in range(60):
            end = line_stream.planned(there, at, most)
            parts = line_stream.stretches(there, at, end, 4)
            assert all(p.end - p.begin <= 4 for p in parts) and (not most or sum(p.end - p.begin for p in parts) <= most)
            for p in parts:
                read[p.name] += range(p.begin, p.end)
            at = end
        assert {k: v for k, v in read.items() if v} == {"a": list(range(10)), "c": list(range(25)), "d": [0]}
        assert line_stream.stretches(there, at, at, 4) == []


def lines_folder(path, n=120):
    """Documents of three sources, with copies, in files that end anywhere; the last one of each is short."""
    os.makedirs(path)
    docs = [{"source": f"s{i % 3}", "doc_id": i, "text": f"document {i if i % 4 else i // 8} " + " ".join(f"w{(i * j) % 17}" for j in range(40 + i % 9))} for i in range(n)]
    for k in range(4):
        with open(f"{path}/part-{k}.jsonl", "w") as f:
            f.write("\n".join(json.dumps(d) for d in docs[k * n // 4 : (k + 1) * n // 4]) + ("\n" if k % 2 else ""))
    return docs


def expected(docs, target):
    """Tokens of each source as a builder would take them."""
    out, seen = defaultdict(list), set()
    for d in docs:
        if len(d["text"]) >= 120 and (d["source"], d["text"]) not in seen and len(out[d["source"]]) < target:
            seen.add((d["source"], d["text"]))
            words = [int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 31996 + 4 for w in d["text"].split()]
            out[d["source"]] += [*words, 3]
    return {s: t[:target] for s, t in out.items()}


def shard_bytes(folder, source):
    return {f.base_name: files.read(f"{folder}/{source}/{f.base_name}") for f in files.listed(f"{folder}/{source}", "")}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stream"))
    docs = lines_folder(f"{root}/lines")
    size = sum(os.path.getsize(f"{root}/lines/{x}") for x in os.listdir(f"{root}/lines"))
    first = build.stream_session(spark, f"{root}/lines", f"{root}/out", 700, batch_bytes=size // 8, batches=2, part_bytes=1000)
    second = build.stream_session(spark, f"{root}/lines", f"{root}/out", 700, batch_bytes=size // 8, part_bytes=1000)
    return root, docs, first, second, size


def test_two_sessions_give_the_rows_of_one(spark, built):
    root, docs, first, second, _ = built
    assert first.batches[:2] == [0, 1] and second.batches[0] == first.batches[-1] + 1 and first.rows + second.rows == len(docs)
    manifests = shard_sink.assembled(spark, f"{root}/out", 100, 32_000)
    want = expected(docs, 700)
    assert set(manifests) == set(want) == {"s0", "s1", "s2"}
    for source, tokens_of in want.items():
        raw = b"".join(files.read(f"{root}/out/{source}/{f['file']}") for f in manifests[source])
        assert np.frombuffer(raw, "<u2").tolist() == tokens_of
        assert all(f["tokens"] == 100 and f["sha256"] == hashlib.sha256(files.read(f"{root}/out/{source}/{f['file']}")).hexdigest() for f in manifests[source][:-1])
    assert all(files.read_object(f"{root}/out/{s}/manifest.json")["tokens"] == len(t) for s, t in want.items())


def test_a_batch_that_dies_before_its_commit_is_run_again(spark, built, tmp_path):
    """The last batch lost its commit, once with and once without its transaction: shards are the same, byte for byte."""
    root, _, _, _, size = built
    shard_sink.assembled(spark, f"{root}/out", 100, 32_000)
    want = {s: shard_bytes(f"{root}/out", s) for s in ("s0", "s1", "s2")}
    for lost in ([], ["transaction"]):
        copy = f"{tmp_path}/{len(lost)}"
        shutil.copytree(root, copy)
        # The configuration names the folder of lines, so the copy goes on reading that one.
        last = max(int(x) for x in os.listdir(f"{copy}/out/checkpoint/commits") if x.isdigit())
        for name in (f"{last}", f".{last}.crc"):
            if os.path.exists(f"{copy}/out/checkpoint/commits/{name}"):
                os.remove(f"{copy}/out/checkpoint/commits/{name}")
        before = {f.base_name for f in files.listed(f"{copy}/out/partials", ".bin")}
        if lost and os.path.exists(f"{copy}/out/transactions/transaction_{last:09d}.json"):
            os.remove(f"{copy}/out/transactions/transaction_{last:09d}.json")
        again = build.stream_session(spark, f"{root}/lines", f"{copy}/out", 700, batch_bytes=size // 8, part_bytes=1000)
        assert not again.batches or again.batches == [last]
        if not lost:
            assert {f.base_name for f in files.listed(f"{copy}/out/partials", ".bin")} == before
        shard_sink.assembled(spark, f"{copy}/out", 100, 32_000)
        assert {s: shard_bytes(f"{copy}/out", s) for s in want} == want


def test_partials_must_be_what_their_transaction_says(spark, built, tmp_path):
    root = built[0]
    shutil.copytree(f"{root}/out", f"{tmp_path}/out")
    some = next(p for t in shard_sink.transactions(f"{tmp_path}/out") for p in t["partials"])
    files.write(f"{tmp_path}/out/partials/unnamed.bin", b"nobody reads this")
    shard_sink.assembled(spark, f"{tmp_path}/out", 100)
    path = f"{tmp_path}/out/partials/{some['file']}.bin"
    data = files.read(path)
    files.write(path, bytes([data[0] ^ 1]) + data[1:])
    with pytest.raises(Exception, match="isn't what its transaction says"):
        shard_sink.assembled(spark, f"{tmp_path}/out", 100)
    files.write(path, data)
    with pytest.raises(Exception, match="outside the vocabulary"):
        shard_sink.assembled(spark, f"{tmp_path}/out", 100, 10)


def test_gaps_and_other_configurations_are_refused(spark, built, tmp_path):
    root, _, _, _, size = built
    shutil.copytree(f"{root}/out", f"{tmp_path}/out")
    first = sorted(os.listdir(f"{tmp_path}/out/transactions"))[0]
    os.remove(f"{tmp_path}/out/transactions/{first}")
    with pytest.raises(Exception, match="gap"):
        shard_sink.assembled(spark, f"{tmp_path}/out", 100)
    with pytest.raises(ConfigChanged):
        build.stream_session(spark, f"{root}/lines", f"{root}/out", 701, batch_bytes=size)


def test_a_session_ends_when_its_time_is_up(spark, tmp_path):
    docs = lines_folder(f"{tmp_path}/lines")
    line_stream.register(spark)

    def start():
        rows = build.line_frames(spark, f"{tmp_path}/lines", f"{tmp_path}/cursor", 800)
        return build.documents_of(rows).select("doc_id").writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/checkpoint").start()

    sessions = [run_session(spark, start, f"{tmp_path}/cursor", seconds=s) for s in (0.0, 4.0)]
    done = spark.read.schema("doc_id long").parquet(f"{tmp_path}/rows").count() if os.path.exists(f"{tmp_path}/rows") else 0
    assert done == sum(s.rows for s in sessions) < len(docs)
    sessions.append(run_session(spark, start, f"{tmp_path}/cursor"))
    assert sorted(x.doc_id for x in spark.read.parquet(f"{tmp_path}/rows").collect()) == list(range(len(docs)))
    assert sum(s.rows for s in sessions) == len(docs) and not os.path.exists(f"{tmp_path}/cursor/pause")


def test_lines_as_a_table(spark, tmp_path):
    docs = lines_folder(f"{tmp_path}/lines")
    line_stream.register(spark)
    read = spark.read.format("line_stream").options(path=f"{tmp_path}/lines", part_bytes=300).load()
    assert sorted(json.loads(x.value)["doc_id"] for x in read.collect()) == list(range(len(docs)))
    os.makedirs(f"{tmp_path}/none")
    assert spark.read.format("line_stream").option("path", f"{tmp_path}/none").load().count() == 0


def test_broken_lines_end_the_stream(spark, tmp_path):
    files.write(f"{tmp_path}/lines/a.jsonl", b'{"source": "s", "doc_id": 1, "text": "x"}\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        build.stream_session(spark, f"{tmp_path}/lines", f"{tmp_path}/out", 10)


@pytest.fixture(scope="module")
def corpus_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shards"))
    shards.write_shards(spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") * 7 % 501).alias("token")), folder, 90, 501)
    return folder


def test_ranges_open_only_their_files(spark, corpus_folder):
    for start, end in ((0, None), (0, 1), (89, 91), (500, 640), (999, 1000), (1000, 1200), (300, 300)):
        rows = shards.read_tokens(spark, corpus_folder, start, end)
        want = range(start, min(1000, 1000 if end is None else end))
        assert sorted((x.pos, x.token) for x in rows.collect()) == [(i, i * 7 % 501) for i in want]
        touched = {i // 90 for i in want}
        assert rows.rdd.getNumPartitions() == len(touched) or not touched
    other = spark.read.format("token_shards").load(corpus_folder).where("pos = 450 AND token = 144 AND shard LIKE 'shard%'")
    assert [(x.pos, x.token) for x in other.collect()] == [(450, 450 * 7 % 501)] and 450 * 7 % 501 == 144


@pytest.mark.parametrize("limit", [200_000, 3])
def test_windows_return_their_tokens(spark, corpus_folder, limit, monkeypatch):
    monkeypatch.setattr(tokens, "BROADCAST_SHARDS", limit)
    starts = [0, 5, 85, 89, 90, 260, 800, 400, 400]
    windows = spark.createDataFrame(list(enumerate(starts)), "window long, start long")
    opened = spark.sparkContext.accumulator(0)
    got = {x.window: x.tokens for x in shards.read_windows(spark, corpus_folder, windows, 200, opened).collect()}
    assert got == {i: [(s + j) * 7 % 501 for j in range(200)] for i, s in enumerate(starts)}
    one = spark.sparkContext.accumulator(0)
    assert shards.read_windows(spark, corpus_folder, spark.createDataFrame([(0, 100), (1, 120), (2, 175)], "window long, start long"), 10, one).count() == 3
    assert one.value <= 2, "two of twelve shards"
    with pytest.raises(tokens.CorpusExhausted):
        shards.read_windows(spark, corpus_folder, spark.createDataFrame([(0, 801)], "window long, start long"), 200)


def test_packed_tokens(spark):
    row = spark.range(1).select(build.packed(F.array(*map(F.lit, [0, 1, 255, 256, 31999, 65535]))).alias("x")).first()
    assert np.frombuffer(bytes(row.x), "<u2").tolist() == [0, 1, 255, 256, 31999, 65535]


def test_partials_of_one_writer(tmp_path):
    sink = shard_sink._Sink(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"source": ["a", "b", "a"], "start": [0, 0, 2], "tokens": [b"\x01\x00\x02\x00", b"\x05\x00", b"\x03\x00"]})
    message = sink.write(iter([batch]))
    assert sorted((f["source"], f["documents"], f["bytes"]) for f in message.files) == [("a", 2, 6), ("b", 1, 2)]
    sink.commit([message, None], 4)
    sink.commit([sink.write(iter([batch]))], 4)
    assert len(files.listed(f"{tmp_path}/partials", ".bin")) == 2 and len(shard_sink.transactions(str(tmp_path))) == 1
    sink.abort([sink.write(iter([batch]))], 5)
    assert len(files.listed(f"{tmp_path}/partials", ".idx")) == 2
    with pytest.raises(shards.ShardError):
        sink.write(iter([pa.RecordBatch.from_pydict({"source": ["a"], "start": [0], "tokens": [b"\x01"]})]))


def test_commands_of_streams_and_studies(spark, tmp_path, capsys):
    from lodestone.operators import audit
    from lodestone.plans import cli

    docs = lines_folder(f"{tmp_path}/lines", 60)
    assert cli.main(["stream", f"{tmp_path}/lines", f"{tmp_path}/out", "--target", "300"]) == 0
    assert cli.main(["shards", f"{tmp_path}/out", "--shard_tokens", "100"]) == 0
    want = expected(docs, 300)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {s: len(t) for s, t in want.items()}
    files.write(f"{tmp_path}/sources.json", json.dumps({s: f"{tmp_path}/out/{s}" for s in want}).encode())
    assert cli.main(["assemble", f"{tmp_path}/sources.json", f"{tmp_path}/whole"]) == 0
    told = files.read_object(f"{tmp_path}/whole/manifest.json")["shards"]
    assert [x["source"] for x in told[:3]] == ["s0", "s1", "s2"] and sum(x["tokens"] for x in told) == sum(map(len, want.values()))
    spark.createDataFrame(docs, "source string, doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    assert cli.main(["validation", f"{tmp_path}/docs", "--fraction", "0.5", "--output", f"{tmp_path}/validation"]) == 0
    assert 0 < spark.read.json(f"{tmp_path}/validation").count() < 60
    audit.study_runs(spark).select("run", "tier", "parameters", "tokens", "loss").coalesce(1).write.option("header", True).csv(f"{tmp_path}/results")
    assert cli.main(["analyze", f"{tmp_path}/results", "--output", f"{tmp_path}/study.md"]) == 0
    assert [x for x in files.read(f"{tmp_path}/study.md").decode().splitlines() if x.startswith("# ")] == ["# Best runs", "# Costs", "# Fitted law"]


def test_files_of_lines_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    from lodestone.plans import streams

    rows = spark.createDataFrame([(i, f"text {i} " + "word " * 100, "en", f"src{i % 2}") for i in range(400)], "doc_id long, text string, lang string, source string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(streams, "FILE_BYTES", 20_000)
    folder, batch = streams._lines(spark, str(tmp_path), str(tmp_path))
    names = sorted(p for p in (tmp_path / "lines").glob("*.txt"))
    lines = [json.loads(x)["doc_id"] for p in names for x in p.read_text().splitlines()]
    assert len(names) >= 10 and max(p.stat().st_size for p in names) < 60_000 and lines == list(range(400))
    got = streams.resumed_lines(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
