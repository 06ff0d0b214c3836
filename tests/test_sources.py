import hashlib
import http.client
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import audit, config, generate, pages, tokens
from lodestone.plans import cli
from lodestone.sources import files, jsonl, retry, runs, shards
from lodestone.streaming import build


def test_reading_goes_on_after_errors_that_may_pass():
    waits, calls = [], []

    def rows_from(cursor):
        calls.append(cursor)
        for i in range(cursor, 20):
            if i in (5, 6) and calls.count(i) < 3:
                try:
                    raise http.client.IncompleteRead(b"")
                except http.client.IncompleteRead as e:
                    raise ValueError("wrapped") from e
            yield i

    assert list(retry.steady(rows_from, sleep=waits.append)) == list(range(20))
    assert waits == [2.0, 4.0, 8.0] * 2 and calls == [0, 5, 5, 5, 6, 6, 6]
    assert list(retry.steady(lambda c: range(c, 9), 4)) == [4, 5, 6, 7, 8]
    assert [retry.Limits().delay(n) for n in (0, 1, 2, 9)] == [2.0, 2.0, 4.0, 60.0]


def test_reading_gives_up():
    def always(cursor):
        raise TimeoutError
        yield

    waits = []
    with pytest.raises(retry.GaveUp):
        list(retry.steady(always, limits=retry.Limits(in_a_row=3), sleep=waits.append))
    assert len(waits) == 3
    with pytest.raises(ZeroDivisionError):
        list(retry.steady(lambda c: (1 // 0 for _ in range(1)), sleep=waits.append))
    named = type("ReadTimeoutError", (Exception,), {})
    assert retry.may_pass(named()) and not retry.may_pass(ValueError())


def test_files_and_folders(spark, tmp_path):
    files.write(f"file:{tmp_path}/a/x.json", b'{"k": 1}')
    files.write(f"{tmp_path}/a/y.json", b"[1]")
    assert files.read_object(f"{tmp_path}/a/x.json") == {"k": 1}
    with pytest.raises(files.FileError):
        files.read_object(f"{tmp_path}/a/y.json")
    assert [f.base_name for f in files.listed(f"{tmp_path}/a", ".json")] == ["x.json", "y.json"] and files.listed(f"{tmp_path}/none", "") == []
    both = files.found(spark, [f"{tmp_path}/a/*.json", f"{tmp_path}/*/x.json"])
    assert [p.rsplit("/", 1)[1] for p in both] == ["x.json", "y.json"]
    assert files.only(spark, [f"{tmp_path}/a/x*"]).endswith("x.json")
    with pytest.raises(files.FileError):
        files.only(spark, [f"{tmp_path}/a/*"])


def test_folders_of_others_are_not_overwritten(spark, tmp_path):
    own, other = str(tmp_path / "own"), str(tmp_path / "other")
    files.cleared(spark, own, False)
    files.write(f"{own}/data", b"x")
    with pytest.raises(files.FileError):
        files.cleared(spark, own, False)
    files.cleared(spark, own, True)
    assert files.listed(own, "data") == []
    files.write(f"{other}/data", b"x")
    with pytest.raises(files.FileError):
        files.cleared(spark, other, True)


def test_lines_are_read_written_and_counted(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"b": 1, "a": "é"}\n{"b": null, "a": "x"}\n')
    rows = jsonl.read_strict(spark, str(tmp_path / "x.jsonl"), "b int, a string")
    jsonl.write_canonical(rows, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":"x","b":null}', '{"a":"é","b":1}']
    (tmp_path / "y.jsonl").write_text('{"b": "text"\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        jsonl.read_strict(spark, str(tmp_path / "y.jsonl"), "b int, a string").collect()


def test_appended_metrics_can_be_followed(spark, tmp_path):
    folder = str(tmp_path / "metrics")
    rows = lambda *steps: spark.createDataFrame([("train", s, 1.0 / (s + 1)) for s in steps], "type string, step long, loss double")
    jsonl.append_metrics(rows(1, 2), folder)
    query = jsonl.live_tail(spark, folder, "type string, step long, loss double, timestamp string", "tail")
    try:
        query.processAllAvailable()
        assert spark.table("tail").count() == 2
        jsonl.append_metrics(rows(3), folder)
        query.processAllAvailable()
        assert sorted(r.step for r in spark.table("tail").collect()) == [1, 2, 3]
        assert all(r.timestamp[:2] == "20" for r in spark.table("tail").collect())
    finally:
        query.stop()


def shard_build(spark, folder, n, start):
    shards.write_shards(spark.range(n).select(F.col("id").alias("pos"), (F.col("id") + start).alias("token")), folder, 10, 1000)


def test_planned_shards_are_assembled_and_verified(spark, tmp_path):
    a, b, out = (str(tmp_path / x) for x in "abc")
    shard_build(spark, a, 23, 0)
    shard_build(spark, b, 15, 500)
    plan = spark.createDataFrame([("b", 0, 0), ("a", 0, 1), ("a", 1, 2), ("b", 1, 3), ("a", 2, 4)], "source string, shard long, position long")
    done = shards.assemble(spark, {"a": a, "b": b}, plan, out)
    assert [(x["file"], x["source"], x["tokens"]) for x in done] == [("shard_00000.bin", "b", 10), ("shard_00001.bin", "a", 10), ("shard_00002.bin", "a", 10), ("shard_00003.bin", "b", 5), ("shard_00004.bin", "a", 3)]
    assert shards.verify_shards(spark, out).where("NOT ok").count() == 0
    tokens_of = [r.token for r in spark.read.format("token_shards").load(out).orderBy("pos").collect()]
    assert tokens_of == [*range(500, 510), *range(20), *range(510, 515), *range(20, 23)]
    assert shards.assemble(spark, {"a": a, "b": b}, plan, out) == done, "a second run changes nothing"
    files.write(f"{a}/shard_00001.bin", b"xx")
    files.write(f"{out}/shard_00002.bin", b"xx")
    with pytest.raises(Exception, match="manifest says"):
        shards.assemble(spark, {"a": a, "b": b}, plan, out)


def test_token_streams(spark):
    stream = generate.random_tokens(spark.range(500).withColumnRenamed("id", "pos"), 100, 7)
    row = tokens.token_range(stream, 100).first()
    assert row.within and 0 <= row.least <= row.most < 100 and not tokens.token_range(stream, 50).first().within
    starts = [[r.start for r in tokens.random_windows(spark, 1000, 8, 65, 3).orderBy("window").collect()] for _ in range(2)]
    assert starts[0] == starts[1] and all(0 <= s < 935 for s in starts[0]) and len(set(starts[0])) > 4


def test_positions_find_their_shards_however_many_there_are(spark, monkeypatch):
    sizes = spark.createDataFrame([(f"s{i:03}", 1 + 7 * i % 40) for i in range(60)], "path string, tokens long")
    offsets = tokens.shard_offsets(sizes)
    at = spark.range(0, 1100, 7).withColumnRenamed("id", "pos")
    some = sorted(map(tuple, tokens.locate(at, offsets).collect()))
    monkeypatch.setattr(tokens, "BROADCAST_SHARDS", 5)
    assert sorted(map(tuple, tokens.locate(at, offsets).collect())) == some and len(some) > 100


def test_older_sources(spark):
    rows = spark.createDataFrame([("r", "a.py", "MIT", "x = 1", False), ("r", "b.py", "mit", "y", True), ("r", "c.py", "gpl-3.0", "z", None), ("r", "d.py", " ", "w", None), ("r", "e.py", None, "", None)], "repo string, path string, license string, content string, autogenerated boolean")
    assert [r.text for r in generate.code_documents(rows, ["mit"]).orderBy("path").collect()] == ["Repository: r\nPath: a.py\nx = 1", "Repository: r\nPath: d.py\nw"]
    assert generate.web_documents(spark.createDataFrame([("a",), ("",), (None,)], "text string")).count() == 1
    specs = spark.createDataFrame([("a.json", "{}"), ("b.YML", "x"), ("c.txt", "")], "path string, text string")
    assert sorted(r.text for r in generate.spec_documents(specs, 1).collect()) == ["# API description: a.json\n{}", "# API description: b.YML\nx"]
    order = [[r.path for r in generate.shuffled(spark.createDataFrame([(f"p{i}",) for i in range(30)], "path string"), s).collect()] for s in (1, 1, 2)]
    assert order[0] == order[1] != order[2] and sorted(order[0]) == sorted(order[2])
    source = spark.createDataFrame([(0, 5), (1, 4)], "i long, n_tokens long")
    got = generate.filled(source, spark.createDataFrame([(0, 6), (1, 6)], "i long, n_tokens long"), "i", 17).orderBy("start").collect()
    assert [(r.kept, r.filled) for r in got] == [(5, False), (4, False), (6, True), (2, True)]


def test_specs_are_found_below_a_folder(spark, tmp_path):
    for name in ("a/openapi.json", "b/c/swagger.yaml", "b/notes.json"):
        files.write(f"{tmp_path}/{name}", b"{}")
    assert sorted(r.path.rsplit("/", 2)[-1] for r in jsonl.scan_specs(spark, str(tmp_path)).collect()) == ["openapi.json", "swagger.yaml"]


def test_runs(spark, tmp_path):
    for run, done in (("r1", True), ("r2", False)):
        files.write(f"{tmp_path}/{run}/config.json", b'{"width": 8}')
        if done:
            files.write(f"{tmp_path}/{run}/summary.json", b'{"loss": 2.5}')
        lines = [{"type": "train", "step": s, "loss": 3.0 - s, "tokens_seen": 1_500_000 * s, "tokens_per_second": 10.0 * s, "step_seconds": 45.0} for s in (1, 2)]
        files.write(f"{tmp_path}/{run}/metrics.jsonl", "\n".join(map(json.dumps, [*lines, {"type": "validation", "step": 9}])).encode())
    found = runs.scan_configs(spark, str(tmp_path)).select("run", F.col("summary").isNull().alias("open")).collect()
    assert sorted((r.run, r.open) for r in found) == [("r1", False), ("r2", True)]
    log = runs.scan_metrics(spark, str(tmp_path))
    row = runs.run_table(log).where("run = 'r1'").first()
    assert (row.file, row.loss, row.tokens_text, row.tokens_per_second, row.time_text) == ("r1.json", 1.0, "3.0M", 15.0, "1.5m")
    runs.export_dashboard(log, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("run = 'r2'").count() == 3
    table = spark.createDataFrame([("a", 1), ("b", None)], "source string, n int")
    runs.write_csv(table, str(tmp_path / "csv"))
    assert sorted(r.source for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == ["a", "b"]
    assert "| a | 1 |" in runs.markdown(table, "T") and runs.data_card(table, "Parts", table).count("# ") == 2
    with pytest.raises(ValueError):
        runs.markdown(table, "T", 1)


def test_exported_runs_are_one_file_each(spark, tmp_path):
    """Written by tasks under the names that Spark reads partitions by; an export replaces the one before."""
    names = ["r1", "a b", "50%", "x/y:z=1", "r[2]"]
    for rows in ([(n, i) for n in ["gone", *names] for i in range(2)], [(n, i) for n in names for i in range(3)]):
        runs.export_dashboard(spark.createDataFrame(rows, "run string, step long"), f"{tmp_path}/out")
    assert sorted(f.name for folder in (tmp_path / "out").iterdir() for f in folder.iterdir()) == ["part-00000.json"] * 5
    back = spark.read.schema("step long, run string").json(f"{tmp_path}/out")
    assert sorted((r.run, r.n) for r in back.groupBy("run").agg(F.count("step").alias("n")).collect()) == sorted((n, 3) for n in names)


def test_logs_of_runs_are_read_once(spark):
    from lodestone.plans.pieces import run_folders

    plan = run_folders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" json") == 1


def test_planned_runs_are_matched_with_results(spark, tmp_path):
    names = [c.split()[0] for c in jsonl.RUN_RESULTS.split(", ")]
    files.write(f"{tmp_path}/r.csv", (",".join(names) + "\nx,low,completed,5,9,9,1.5,4,1,2,1,1,67000,0.5,3\ny,low,failed,5,9,9,1.5,4,1,2,1,1,1,1,1\n").encode())
    results = jsonl.read_results(spark, f"{tmp_path}/r.csv").select("run_name", "status", "final_general_loss").withColumnRenamed("run_name", "run")
    both, missing = runs.matrix_results(spark.createDataFrame([("x",), ("y",), ("z",)], "run string"), results)
    assert {r.run: r.final_general_loss for r in both.collect()} == {"x": 1.5, "y": None, "z": None} and sorted(r.run for r in missing.collect()) == ["y", "z"]


def test_checkpoints(spark):
    paths = ["a/checkpoint_step_9.pt", "a/checkpoint_step_10.pt", "a/checkpoint_step_11.tmp", "b/checkpoint_step_99.pt", "b/checkpoint_final.pt", "c/notes.txt"]
    rows = spark.createDataFrame([(p[0], p) for p in paths], "run string, path string")
    assert {r.run: r.path for r in runs.latest_checkpoint(rows, "run").collect()} == {"a": paths[1], "b": paths[4]}


CONFIG = {"train_tokens": 1000, "validation_tokens": 10, "shard_tokens": 100, "max_document_tokens": 50, "vocab_size": 500, "validation_fraction": 0.1, "category_weights": {"x": 0.3, "y": 0.7}, "sources": [{"name": "a", "category": "x", "kind": "huggingface", "weight": 0.1}, {"name": "b", "category": "x", "kind": "openapi_raw", "weight": 0.2}, {"name": "c", "category": "y", "kind": "openapi_docs", "weight": 0.7}]}


def test_configurations():
    config.validate(CONFIG)
    a, b, c = CONFIG["sources"]
    wrong = [{"train_tokens": 0}, {"vocab_size": 70_000}, {"validation_fraction": 1}, {"sources": []}, {"sources": [a, a, c]}, {"sources": [a, b | {"kind": "odd"}, c]}, {"sources": [a, b, c | {"weight": 0.6}]}, {"category_weights": {"x": 0.300000001, "y": 0.7}}]
    for change in wrong:
        with pytest.raises(config.ConfigError):
            config.validate(CONFIG | change)
    approval = {"status": "approved", "config_sha256": config.fingerprint(CONFIG), "tokenizer_sha256": "t", "allocations": {"a": 100, "b": 200, "c": 700}}
    config.approve(CONFIG, approval, "t")
    for change in ({"status": "draft"}, {"config_sha256": "x"}, {"tokenizer_sha256": "u"}, {"allocations": {"a": 1000}}, {"allocations": {"a": 100, "b": 200, "c": 701}}):
        with pytest.raises(config.ConfigError):
            config.approve(CONFIG, approval | change, "t")
    small = config.scaled_down(CONFIG, 400_000)
    assert (small["train_tokens"], small["validation_tokens"], small["shard_tokens"]) == (400_000, 20_000, 100_000)
    assert config.source_signature(CONFIG) != config.source_signature(CONFIG | {"sources": [a, b, c | {"weight": 0.8}]}) and config.split_targets(124) == {"train": 111, "validation": 6, "test": 7}


def test_reports_are_merged_or_missed(spark):
    plan = spark.createDataFrame([(0, "a", 0.5, False, 1.0), (1, "b", 0.5, True, None)], "pos int, source string, weight double, finite boolean, fill double")
    reports = lambda *rows: spark.createDataFrame(list(rows), "source string, status string, config_sha string, usable long")
    merged = audit.merge_reports(plan, reports(("b", "complete", "s", 30), ("a", "complete", "s", 5)), "s")
    assert {r.source: r.allocation for r in audit.cap_and_fill(merged, 100).collect()} == {"a": 70, "b": 30}
    for row in (("b", "running", "s", 30), ("b", "complete", "other", 30), ("c", "complete", "s", 30)):
        with pytest.raises(audit.MissingReport, match="b"):
            audit.merge_reports(plan, reports(row), "s")
    with pytest.raises(ValueError):
        audit.merge_reports(plan.withColumn("fill", F.lit(0.7)), reports(("b", "complete", "s", 30)), "s")


def test_scaling_law_finds_planted_exponents(spark):
    law = lambda n, d: 1.7 + 400.0 * n**-0.34 + 900.0 * d**-0.28
    rows = [(n, d, law(n, d)) for n in (10**7, 3 * 10**7, 10**8) for d in (10**8, 3 * 10**8, 10**9, 3 * 10**9)]
    r = audit.scaling_fit(spark.createDataFrame(rows, "parameters long, tokens long, loss double")).first()
    assert abs(r.alpha - 0.34) < 0.01 and abs(r.beta - 0.28) < 0.01 and abs(r.E - 1.7) < 0.05 and r.rmse < 1e-3 and r.runs == 12


def test_stateful_deduplication_never_forgets(spark, tmp_path):
    rows = lambda *texts: spark.createDataFrame([("s", t) for t in texts], "source string, text string").coalesce(1)
    source = str(tmp_path / "in")
    rows("a", "b", "a").write.parquet(source)
    query = build.first_seen(spark.readStream.schema("source string, text string").parquet(source)).writeStream.format("memory").queryName("seen").outputMode("append").start()
    try:
        query.processAllAvailable()
        rows("b", "c").write.mode("append").parquet(source)
        query.processAllAvailable()
        assert sorted(r.text for r in spark.table("seen").collect()) == ["a", "b", "c"]
    finally:
        query.stop()


def test_spam_scores(spark):
    varied = " ".join(f"word{i}" for i in range(60))
    texts = [varied, "buy now " * 40, "same line of six words here\n" * 12, "short text", None]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(pages.spam_score(F.col("t")).alias("s")).collect()]
    assert got[0] < 0.05 and got[1] > 0.9 and got[2] > 0.9 and got[3:] == [0.0, 0.0]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli.Commands, "spark", spark)
    sf = "/root/testdata/sf0.001"
    assert cli.main(["list"]) == 0 and "capacity_audit" in capsys.readouterr().out
    assert cli.main(["run", "language_filter", "--sf", sf, "--output", str(tmp_path / "q")]) == 0 and spark.read.parquet(str(tmp_path / "q")).count() > 0
    assert cli.main(["audit", f"{sf}/documents.parquet", "--output", str(tmp_path / "reports")]) == 0
    plan = [{"source": r.source, "weight": 0.05, "finite": True, "fill": None} for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().orderBy("source").collect()]
    plan[0] |= {"finite": False, "fill": 1.0}
    files.write(f"{tmp_path}/plan.json", json.dumps({"train_tokens": 10_000, "sources": plan}).encode())
    assert cli.main(["merge", f"{tmp_path}/plan.json", str(tmp_path / "reports"), "--output", str(tmp_path / "allocation")]) == 0
    assert spark.read.json(str(tmp_path / "allocation")).agg(F.sum("allocation")).first()[0] == 10_000
    assert cli.main(["build", f"{sf}/documents*.parquet", str(tmp_path / "b"), "--target", "300"]) == 0 and cli.main(["status", str(tmp_path / "b"), "--target", "300"]) == 0
    shard_build(spark, str(tmp_path / "s"), 23, 0)
    assert cli.main(["verify", str(tmp_path / "s")]) == 0 and '"ok": true' in capsys.readouterr().out
    files.write(f"{tmp_path}/s/shard_00001.bin", b"xxxx")
    assert cli.main(["verify", str(tmp_path / "s")]) == 1
    assert cli.main(["sft", f"{sf}/conversations.parquet", "--rounds", "2", "--quota", "5", "--allow_short", "1", "--output", str(tmp_path / "sft")]) == 0
    assert 0 < spark.read.json(str(tmp_path / "sft")).count() <= 3 * 6 * 5
    files.write(f"{tmp_path}/config.json", json.dumps(CONFIG).encode())
    assert cli.main(["preflight", f"{tmp_path}/config.json", str(tmp_path / "s")]) == 1 and '"shards": false' in capsys.readouterr().out
    shard_build(spark, str(tmp_path / "t"), 1000, 0)
    assert cli.main(["preflight", f"{tmp_path}/config.json", str(tmp_path / "t")]) == 0
    files.write(f"{tmp_path}/r.csv", b"run,tier,parameters,tokens,loss\nx,low,10000000,100000000,3.5\ny,low,30000000,30000000,3.4\n")
    assert cli.main(["matrix", f"{tmp_path}/r.csv"]) == 1 and cli.main(["report", f"{tmp_path}/r.csv", "--output", f"{tmp_path}/report.md"]) == 0
    assert b"| low | y |" in files.read(f"{tmp_path}/report.md")


def test_token_ids_are_those_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.functions import tokenizers as X

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["", None, "Hello  wörld\n", "word " * 300, "<|endoftext|>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = rows.select(X.token_ids(F.col("t"), path, 100, 50256).alias("ids"), X.token_count(path)(F.col("t")).alias("n"), X.decoded(X.token_ids(F.col("t"), path), path).alias("back")).collect()
    for text, r in zip(texts, got, strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert r.n == len(ids) and r.ids == [*(ids if len(ids) < 100 else ids[:99]), 50256] and r.back == (text or "")
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert rows.select(X.decoded(X.token_ids(F.col("t"), model), model).alias("b")).collect()[3].b.strip() == ("word " * 300).strip()
    assert X.counter_of(None)(" a  b ") == 2 and X.counter_of(path)("a b") == 2


def test_parameter_counts_and_formats(spark):
    from lodestone.functions import text as T
    from lodestone.functions import training as R

    assert R.decoder_parameters(10, 4, 1, 2, 1, 8) == 10 * 4 + (4 * 4 * 2 + 2 * 4 * 2 * 1 + 3 * 4 * 8 + 2 * 4) + 4
    row = spark.range(1).select(*(T.format_tokens(F.lit(x)).alias(f"t{i}") for i, x in enumerate((None, 12, 4500, 2.5e6, 3e9))), *(T.format_duration(F.lit(x)).alias(f"d{i}") for i, x in enumerate((None, 12, 90, 7200)))).first()
    assert list(row) == ["—", "12", "4.5K", "2.5M", "3.00B", "—", "12s", "1.5m", "2.00h"]


def test_hashes_of_manifest_rows(spark):
    rows = spark.createDataFrame([("a", "mit", hashlib.sha256(bytes([i])).hexdigest()[:32], 5) for i in range(3)], "source string, license string, key string, n long")
    one, two = (shards.manifest_rows(x, "n", "train", "s", ["clean"]).first() for x in (rows, rows.orderBy(F.desc("key"))))
    assert one == two and (one.document_count, one.estimated_tokens, one.processing_steps) == (3, 15, ["clean"]) and len(one.sha256) == 64

