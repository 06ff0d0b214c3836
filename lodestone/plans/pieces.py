"""Queries of single functions, sources and sinks: each is put to work on a table, so that SQL can say what is right."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lodestone.functions import hashing as H
from lodestone.functions import schemas
from lodestone.functions import text as T
from lodestone.functions import training as R
from lodestone.operators import audit, config, corpus, dialogs, generate, metrics, tokens
from lodestone.plans.catalog import _REASONS, _t, docs, query
from lodestone.operators.ordered import global_position
from lodestone.sources import files, jsonl, runs, shards
from lodestone.sources.scratch import scratch_dir


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- JSON lines, CSV, runs ---

_REGION = "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"


@query(_REGION)
def jsonl_round_trip(spark, d):
    """Canonical JSON lines, written and read strictly."""
    folder = _folder(spark, "jsonl")
    jsonl.write_canonical(_t(spark, d, "region").select(F.col("r_regionkey").cast("long"), "r_name"), folder)
    return jsonl.read_strict(spark, folder, "r_regionkey long, r_name string")


@query("SELECT '{\"k\":' || r_regionkey || ',\"n\":\"' || r_name || '\",\"z\":null}' AS line FROM region")
def canonical_lines(spark, d):
    folder = _folder(spark, "lines")
    jsonl.write_canonical(_t(spark, d, "region").select(F.col("r_name").alias("n"), F.lit(None).cast("int").alias("z"), F.col("r_regionkey").alias("k")), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query(_REGION)
def jsonl_torn_tail(spark, d):
    """A log whose last line was cut off."""
    folder = _folder(spark, "torn")
    rows = [json.dumps({"r_regionkey": r.r_regionkey, "r_name": r.r_name}) for r in _t(spark, d, "region").collect()]  # a handful of rows
    files.write(f"{folder}/log.jsonl", "\n".join([*rows, '{"r_regionkey": 9, "r_na']).encode())
    return jsonl.read_tolerant(spark, folder, "r_regionkey long, r_name string")


@query("SELECT count(*) AS lines, 0::BIGINT AS missing FROM nation")
def jsonl_counts(spark, d):
    folder = _folder(spark, "counts")
    jsonl.write_canonical(_t(spark, d, "nation"), folder)
    return spark.createDataFrame([(jsonl.count_rows(spark, folder), jsonl.count_rows(spark, f"{folder}-none"))], "lines long, missing long")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def csv_round_trip(spark, d):
    folder = _folder(spark, "csv")
    runs.write_csv(_t(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_name"), folder)
    return spark.read.csv(folder, header=True, schema="n_nationkey long, n_name string")


@query("SELECT event_type, count(*) AS n, true AS stamped FROM events GROUP BY 1")
def appended_logs(spark, d):
    """Two appends to a metric log, read as one."""
    folder = _folder(spark, "appended")
    rows = _t(spark, d, "events").select("event_id", "event_type")
    for part in (rows.where("event_id % 5 < 2"), rows.where("event_id % 5 >= 2")):
        jsonl.append_metrics(part, folder)
    log = spark.read.schema("event_id long, event_type string, timestamp string").json(folder)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("timestamp").rlike("^2[0-9]{3}-")).alias("stamped"))


def _log(spark, d):
    """Events as the metric logs of runs, in one folder for each user."""
    root = _folder(spark, "runs")
    e = _t(spark, d, "events")
    rows = e.select(F.concat(F.lit("run"), "user_id").alias("run"), F.when(F.col("event_type") == "purchase", "validation").otherwise("train").alias("type"), F.col("event_id").alias("step"), F.col("value").cast("double").alias("loss"), (F.col("event_id") * 1000).alias("tokens_seen"), F.col("value").cast("double").alias("tokens_per_second"), F.lit(1.5).alias("step_seconds"))

    def write(batches):
        """Each run's log, bounded by its steps, as its folder."""
        for batch in batches:
            for run, lines in zip(batch["run"], batch["lines"], strict=True):
                files.write(f"{root}/{run}/metrics.jsonl", "\n".join(lines).encode())
                files.write(f"{root}/{run}/config.json", json.dumps({"name": run}).encode())
            yield batch[["run"]]

    lines = rows.select("run", F.to_json(F.struct("type", "step", "loss", "tokens_seen", "tokens_per_second", "step_seconds")).alias("line"))
    logs = lines.groupBy("run").agg(F.collect_list("line").alias("lines")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run")
    logs.mapInPandas(write, "run string").write.format("noop").mode("overwrite").save()
    return root


@query("""SELECT 'run' || user_id AS run, 'run' || user_id || '.json' AS file, arg_max(value::DOUBLE, event_id) AS loss, max(event_id) * 1000 AS tokens, median(value::DOUBLE) AS tokens_per_second, count(*) * 1.5::DOUBLE AS seconds FROM events WHERE event_type <> 'purchase' GROUP BY user_id""")
def run_folders(spark, d):
    """Folders of runs: their logs, and what a dashboard shows of each."""
    root = _log(spark, d)
    shown = runs.run_table(runs.scan_metrics(spark, root)).join(runs.scan_configs(spark, root).select("run"), "run")
    return shown.select("run", "file", "loss", "tokens", "tokens_per_second", "seconds")


@query("SELECT 'run' || user_id AS run, count(*) AS records FROM events GROUP BY 1")
def dashboard_export(spark, d):
    folder = _folder(spark, "dashboard")
    runs.export_dashboard(runs.scan_metrics(spark, _log(spark, d)), folder)
    return spark.read.schema(f"{runs.METRIC}, run string").json(folder).groupBy("run").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT n_name AS run, CASE WHEN n_regionkey <> 2 THEN n_nationkey::DOUBLE END AS loss, n_regionkey = 2 AS missing FROM nation")
def planned_runs(spark, d):
    """A matrix of runs against results, of which some are unfinished."""
    n = _t(spark, d, "nation")
    matrix = n.select(F.col("n_name").alias("run"))
    results = n.select(F.col("n_name").alias("run"), F.when(F.col("n_regionkey") == 2, "failed").otherwise("completed").alias("status"), F.col("n_nationkey").cast("double").alias("loss"))
    both, missing = runs.matrix_results(matrix, results)
    return both.join(missing.withColumn("missing", F.lit(True)), "run", "left").select("run", "loss", F.coalesce("missing", F.lit(False)).alias("missing"))


@query("SELECT s_name AS run, '{\"name\":\"' || s_name || '\"}' AS text FROM supplier")
def spec_scan(spark, d):
    """API descriptions found below a folder; other files are left alone."""
    folder = _folder(spark, "specs")

    def write(batches):
        for batch in batches:
            for name in batch["s_name"]:
                files.write(f"{folder}/{name}/openapi.json", json.dumps({"name": name}, separators=(",", ":")).encode())
                files.write(f"{folder}/{name}/notes.json", b"{}")
            yield batch

    _t(spark, d, "supplier").select("s_name").mapInPandas(write, "s_name string").write.format("noop").mode("overwrite").save()
    return jsonl.scan_specs(spark, folder).select(F.regexp_replace(F.element_at(F.split("path", "/"), -2), "%20", " ").alias("run"), "text")


# --- scalar functions ---


def _fixed_sql(x: str, digits: int) -> str:
    return f"CASE WHEN ({x}) * {2 ** (digits + 1)} % 2 = 1 THEN printf('%.{digits}f', {x} + {10.0 ** -(digits + 1)}::DOUBLE) ELSE printf('%.{digits}f', {x}) END"


@query(f"""WITH o AS (SELECT o_orderkey AS id, (o_orderkey * 997)::DOUBLE AS n, o_orderkey::DOUBLE AS s FROM orders)
SELECT id, CASE WHEN n < 1000 THEN n::BIGINT::VARCHAR WHEN n < 1000000 THEN {_fixed_sql("n / 1000.0::DOUBLE", 1)} || 'K' WHEN n < 1000000000 THEN {_fixed_sql("n / 1000000.0::DOUBLE", 1)} || 'M' ELSE {_fixed_sql("n / 1000000000.0::DOUBLE", 2)} || 'B' END AS tokens,
CASE WHEN s < 60 THEN printf('%.0f', s) || 's' WHEN s < 3600 THEN {_fixed_sql("s / 60.0::DOUBLE", 1)} || 'm' ELSE {_fixed_sql("s / 3600.0::DOUBLE", 2)} || 'h' END AS time FROM o""")
def number_formats(spark, d):
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), T.format_tokens(F.col("o_orderkey") * 997).alias("tokens"), T.format_duration(F.col("o_orderkey")).alias("time"))


@query("SELECT p_partkey AS id, p_size::INT AS layers, (32000 * 256 + p_size * (256 * 256 * 2 + 2 * 256 * 32 * 4 + 3 * 256 * 704 + 2 * 256) + 256)::BIGINT AS parameters FROM part")
def parameter_counts(spark, d):
    """Models of as many layers as parts have sizes."""
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("layers"), R.decoder_parameters(32000, 256, F.col("p_size").cast("long"), 8, 4, 704).alias("parameters"))


@query("SELECT n_nationkey::INT AS id, greatest(0.001::DOUBLE, 2.0::DOUBLE * 16384 / (1000000 * (n_nationkey + 1))) AS tolerance FROM nation")
def mixture_tolerances(spark, d):
    return _t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), R.mixture_tolerance(F.lit(16384), (F.col("n_nationkey") + 1) * 1_000_000).alias("tolerance"))


@query("SELECT doc_id, b AS band, (('0x' || substr(sha256(text), 1, 15))::BIGINT >> (16 * b)) & 65535 AS value, bit_count(xor(('0x' || substr(sha256(text), 1, 15))::BIGINT, doc_id))::INT AS distance FROM documents, range(4) r(b)")
def bands_and_distances(spark, d):
    fp = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    rows = docs(spark, d).select("doc_id", fp.alias("fp"))
    return rows.select("doc_id", "fp", F.inline(H.band_values(F.col("fp")))).select("doc_id", F.col("band").cast("long").alias("band"), "value", H.hamming(F.col("fp"), F.col("doc_id")).alias("distance"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('7' || chr(31) || doc_id)) - 1 AS place FROM documents")
def seeded_places(spark, d):
    """A reproducible random order."""
    from lodestone.operators.ordered import global_position

    rows = docs(spark, d).select("doc_id", H.seeded_order(F.lit("7"), F.col("doc_id").cast("string")).alias("turn"))
    return global_position(rows, ["turn"]).select("doc_id", F.col("position").alias("place"))


#: Written type names, and what they mean.
_TYPES = [("int", "integer"), ("Optional, str", "string"), ("str, optional", "string"), ("List[int]", "array"), ("Dict[str, int]", "object"), ("tuple", "array"), (" float | ", "number"), ("weird", "weird"), ("", "string"), ("bool,int", "boolean"), ("map<a,b>", "object")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TYPES) + ") v(said, meant)")
def type_names(spark, d):
    rows = spark.createDataFrame([(a,) for a, _ in _TYPES], "said string")
    return rows.select("said", schemas.json_function(lambda x: schemas.type_name(x["t"]))(F.to_json(F.struct(F.col("said").alias("t")))).alias("meant"))


@query("SELECT p_partkey AS id, p_partkey % 5 IN (0, 3) AS needed FROM part")
def required_parameters(spark, d):
    """Parameters of the older convention, by a remainder: plain, optional by type, with a default, said so, said otherwise."""
    kinds = F.array(*(F.lit(json.dumps(x)) for x in ({"type": "int"}, {"type": "int, optional"}, {"type": "int", "default": 1}, {"type": "optional", "required": "True"}, {"type": "int", "required": False})))
    rows = _t(spark, d, "part").withColumn("said", F.get(kinds, (F.col("p_partkey") % 5).cast("int")))
    return rows.select(F.col("p_partkey").alias("id"), schemas.json_function(schemas.needed, "boolean")(F.col("said")).alias("needed"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '{\"properties\":{\"a\":{\"type\":\"integer\"},\"b\":{\"type\":\"string\"}},\"required\":[\"a\"],\"type\":\"object\"}' WHEN 1 THEN '{\"items\":{\"type\":\"number\"},\"minLength\":' || p_size || ',\"type\":\"array\"}' WHEN 2 THEN '{\"description\":\"' || p_name || '\",\"enum\":[' || p_size || '],\"type\":\"string\"}' ELSE '{\"type\":\"string\"}' END AS kept FROM part")
def tidied_schemas(spark, d):
    said = F.when(F.col("p_partkey") % 4 == 0, '{"properties": {"b": {}, "a": {"type": "int", "odd": 1}}, "required": ["gone", "a"]}').when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('{"type": "list", "items": {"type": "float"}, "minLength": '), F.col("p_size").cast("string"), F.lit("}")))
    said = said.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit('{"description": " '), "p_name", F.lit(' ", "enum": ['), F.col("p_size").cast("string"), F.lit("]}"))).otherwise("3")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), schemas.schema_json(said).alias("kept"))


@query("SELECT p_partkey AS id, p_size BETWEEN 10 AND 12 AS whole, p_size IN (10, 12) AS chosen, true AS listed, false AS flag FROM part")
def fitting_values(spark, d):
    size = F.col("p_size").cast("string")
    fits = schemas.json_function(lambda v, s: schemas.fits(v["v"], s), "boolean")

    def of(value, schema: dict):
        return fits(F.concat(F.lit('{"v": '), value, F.lit("}")), F.lit(json.dumps(schema)))

    whole = F.when(F.col("p_size").between(10, 12), size).otherwise(F.concat(size, F.lit(".5")))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), of(whole, {"type": "integer"}).alias("whole"), of(size, {"type": ["integer", "null"], "enum": [10, 12]}).alias("chosen"), of(F.concat(F.lit("["), size, F.lit(", 0.5]")), {"type": "array", "items": {"type": "number"}}).alias("listed"), of(F.lit("true"), {"type": "number"}).alias("flag"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '\"fallback\"' ELSE '{\"k\":' || (props->>'$.k') || '}' END AS value FROM events")
def parsed_or_fallback(spark, d):
    """JSON texts, of which every third is broken."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}{"))).otherwise(F.col("props"))
    parse = schemas.json_function(lambda row: schemas.canonical(schemas.parse_or(row["t"], "fallback")))
    return _t(spark, d, "events").select("event_id", parse(F.to_json(F.struct(said.alias("t")))).alias("value"))


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not canonical' WHEN 2 THEN 'another target' WHEN 3 THEN 'not an object' END AS fault FROM conversations")
def rendered_targets(spark, d):
    """Renderings broken on purpose, by a remainder."""
    target = {"decision": "no_call", "tool_name": None, "arguments": {}, "missing_required_fields": []}
    text = schemas.canonical(target)
    said = F.get(F.array(*map(F.lit, (text, text + " ", text.replace("no_call", "call"), "[1]", text))), ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    check = schemas.json_function(lambda row: dialogs.rendered_fault(row["t"], target))
    return _t(spark, d, "conversations").select("conv_id", "turn", check(F.to_json(F.struct(said.alias("t")))).alias("fault"))


# --- rows ---


@query(f"{_REASONS.replace('THEN ' + chr(39) + 'split' + chr(39), 'THEN NULL ELSE ' + chr(39) + 'split' + chr(39))} SELECT doc_id, reason FROM r")
def reject_reasons_validation(spark, d):
    """The same checks where the validation part is built."""
    rows = docs(spark, d).withColumn("license", F.coalesce(corpus.text_license(F.col("text")), F.lit("MIT")))
    return corpus.rejection_reasons(rows, corpus.ALLOWED_LICENSES, 0.05, "validation").select("doc_id", "reason")


@query("SELECT 'nation/' || n_nationkey AS path, 'Repository: ' || n_name || chr(10) || 'Path: nation/' || n_nationkey || chr(10) || n_name AS text FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 1")
def code_files(spark, d):
    """Code under a header; generated files and unlisted licenses go, blank licenses stay."""
    n = _t(spark, d, "nation")
    rows = n.select(F.col("n_name").alias("repo"), F.concat(F.lit("nation/"), "n_nationkey").alias("path"), F.when(F.col("n_nationkey") % 3 == 1, "gpl-3.0").when(F.col("n_nationkey") % 3 == 2, " ").otherwise("MIT").alias("license"), F.col("n_name").alias("content"), (F.col("n_nationkey") % 4 == 0).alias("autogenerated"))
    return generate.code_documents(rows, ["mit"])


@query("WITH s AS (SELECT o_orderkey AS i, (o_orderkey % 50 + 1)::BIGINT AS n_tokens, o_orderkey % 9 = 0 AS filled FROM orders), p AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY filled, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s) SELECT i, filled, least(n_tokens, (SELECT sum(n_tokens) * 95 // 100 FROM s) - start)::BIGINT AS kept FROM p WHERE start < (SELECT sum(n_tokens) * 95 // 100 FROM s)")
def budget_filled(spark, d):
    """A source that lacks tokens, filled up by another; every ninth order stands for the other."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 50 + 1).alias("n_tokens"))
    target = o.agg(F.sum("n_tokens")).first()[0] * 95 // 100
    return generate.filled(o.where("i % 9 <> 0"), o.where("i % 9 = 0"), "i", target).select("i", "filled", "kept")


def _order_shards(spark, d, shard_tokens):
    folder = f"{scratch_dir(spark)}/windows-{uuid.uuid4().hex}"
    stream = global_position(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).select(F.col("position").alias("pos"), (F.col("o_orderkey") % 32000).alias("token"))
    shards.write_shards(stream, folder, shard_tokens, 32000)
    return folder


@query("""WITH t AS (SELECT o_orderkey % 32000 AS token, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), w AS (SELECT i AS window, (('0x' || substr(sha256('5:' || i), 1, 12))::BIGINT % (n - 65))::BIGINT AS start FROM range(40) r(i), (SELECT count(*) AS n FROM orders))
SELECT w.window, start, string_agg(token::VARCHAR, ' ' ORDER BY pos) AS tokens FROM w JOIN t ON pos >= start AND pos < start + 65 GROUP BY ALL""")
def token_windows(spark, d):
    """Random windows of 65 tokens, read from the shards that hold them."""
    windows = tokens.random_windows(spark, _t(spark, d, "orders").count(), 40, 65, 5)
    read = shards.read_windows(spark, _order_shards(spark, d, 500), windows, 65)
    return read.select("window", "start", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


@query("WITH t AS (SELECT (o_orderkey % 32000)::INT AS token, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) SELECT pos, token FROM t WHERE pos >= n // 3 AND pos < n // 3 + n // 5")
def token_shard_range(spark, d):
    """A fifth of the stream from its first third on; other shards aren't opened."""
    n = _t(spark, d, "orders").count()
    return shards.read_tokens(spark, _order_shards(spark, d, 700), n // 3, n // 3 + n // 5).select("pos", "token")


@query("SELECT min(l_orderkey % 32000)::INT AS least, max(l_orderkey % 32000)::INT AS most, max(l_orderkey % 32000) < 20000 AS within FROM lineitem")
def token_ranges(spark, d):
    return tokens.token_range(_t(spark, d, "lineitem").select((F.col("l_orderkey") % 32000).cast("int").alias("token")), 20000)


@query("SELECT lang, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def first_per_category(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))


@query("SELECT source, 'only expected' AS side FROM (SELECT 'src' || i AS source FROM range(25) r(i)) WHERE source NOT IN (SELECT source FROM documents WHERE lang <> 'xx')")
def name_differences(spark, d):
    """Names that one side has and the other lacks."""
    have, want = docs(spark, d).select("source").distinct(), spark.range(25).select(F.concat(F.lit("src"), "id").alias("source"))
    return want.exceptAll(have).withColumn("side", F.lit("only expected")).unionByName(have.exceptAll(want).withColumn("side", F.lit("only found")))


@query("SELECT n_nationkey::INT AS id, CASE n_nationkey % 5 WHEN 1 THEN 'vocab_size' WHEN 2 THEN 'weights must sum to 1' WHEN 3 THEN 'source names must be unique' WHEN 4 THEN 'category x: 0.5 instead of 0.6' END AS fault FROM nation")
def config_faults(spark, d):
    """Configurations broken on purpose."""
    sound = {"train_tokens": 10, "validation_tokens": 1, "shard_tokens": 5, "max_document_tokens": 4, "vocab_size": 9, "validation_fraction": 0.5, "category_weights": {"x": 0.5}, "sources": [{"name": "a", "category": "x", "kind": "openapi_raw", "weight": 0.5}, {"name": "b", "category": "y", "kind": "openapi_docs", "weight": 0.5}]}
    a, b = sound["sources"]
    cases = [{}, {"vocab_size": 70_000}, {"sources": [a, b | {"weight": 0.4}]}, {"sources": [a, b | {"name": "a"}]}, {"category_weights": {"x": 0.6}}]

    def fault(change: dict) -> str | None:
        try:
            config.validate(sound | change)
        except config.ConfigError as e:
            return str(e)
        return None

    faults = F.array(*(F.lit(fault(c)).cast("string") for c in cases))
    return _t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.get(faults, (F.col("n_nationkey") % 5).cast("int")).alias("fault"))


@query("SELECT o_orderkey AS tokens, greatest(10000, o_orderkey // 20) AS validation, greatest(10000, o_orderkey // 4) AS shard FROM orders")
def scaled_configs(spark, d):
    """The sizes of builds scaled down to as many tokens as orders have keys."""
    sizes = config.scaled_sizes(F.col("o_orderkey"))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("tokens"), sizes["validation_tokens"].alias("validation"), sizes["shard_tokens"].alias("shard"))


@query("SELECT user_id, median(value) AS median, max(value) AS most, round(sum(value), 6) AS total FROM events GROUP BY 1")
def run_statistics(spark, d):
    """Median, peak and sum of each run's column."""
    return _t(spark, d, "events").groupBy("user_id").agg(F.median("value").alias("median"), F.max("value").alias("most"), F.round(F.sum("value"), 6).alias("total"))


#: A grid of runs of a planted law, and its exponents.
_PLANTED = [(n, k, 1.7 + 400.0 * n**-0.34 + 900.0 * k**-0.28) for n in (10**7, 3 * 10**7, 10**8) for k in (10**8, 3 * 10**8, 10**9, 3 * 10**9)]


@query("SELECT 0.34::DOUBLE AS alpha, 0.28::DOUBLE AS beta, 1.7::DOUBLE AS floor, 12::BIGINT AS runs")
def scaling_recovered(spark, d):
    """The fit finds the law that made its runs."""
    fit = audit.scaling_fit(spark.createDataFrame(_PLANTED, "parameters long, tokens long, loss double"))
    return fit.select(F.round("alpha", 2).alias("alpha"), F.round("beta", 2).alias("beta"), F.round("E", 1).alias("floor"), "runs")


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' AND user_id LIKE '1%'".replace("user_id LIKE", "user_id::VARCHAR LIKE"))
def record_filters(spark, d):
    """Records by type and by prefix."""
    return _t(spark, d, "events").where((F.col("event_type") == "purchase") & F.col("user_id").cast("string").startswith("1")).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM events")
def short_averages(spark, d):
    rows = _t(spark, d, "events")
    return metrics.moving_average(rows, "user_id", ["ts", "event_id"], "value", 3).select("user_id", "event_id", F.round("moving_average", 6).alias("moving_average"))
