"""Queries of the reference operators: name -> (function of spark and sf_dir, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import hashing as H
from lodestone.functions import text as T
from lodestone.functions import training as R
from lodestone.operators import audit, corpus, dialogs, metrics, pages, tokens
from lodestone.operators.ordered import global_position, prefix_sum
from lodestone.sources.scratch import bounded_batches

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


#: A file of fewer bytes may be one row group, which one task reads; if it is the whole table, its rows are dealt out
#: before costly work.
SPREAD_BYTES = 64 << 20


def spread_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores; a table of some files or some size is read by many tasks anyway, and is not shuffled."""
    rows = docs(spark, sf_dir)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    about = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where)
    return rows.repartition(spark.sparkContext.defaultParallelism) if about.getFileCount() <= 1 and about.getLength() < SPREAD_BYTES else rows


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.measured(spread_docs(spark, sf_dir), ["source", "doc_id"]).withColumn("key", F.lower(F.hex("key")))


# Pieces of SQL that queries share.
_SPACE = r"\t\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NORM = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '\r\n?', chr(10), 'g'), '[{_SPACE}]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{_SPACE}\n]+|[{_SPACE}\n]+$', '', 'g')"
N = f"WITH n AS (SELECT doc_id, source, lang, {_NORM} AS text FROM documents)"
TOK = r"len(regexp_extract_all(text, '\S+'))"
LICENSE = "CASE WHEN lower(text) LIKE '%mit license%' THEN 'mit' WHEN lower(text) LIKE '%apache license%' THEN 'apache-2.0' WHEN lower(text) LIKE '%gnu general public license%' THEN 'gpl-3.0' WHEN lower(text) LIKE '%cc by%' THEN 'cc-by-4.0' END"
ALLOWED = ", ".join(f"'{x}'" for x in corpus.ALLOWED_LICENSES)
F05, F10 = H.fraction_bound(0.05), H.fraction_bound(0.10)


@query(rf"{N}, k AS (SELECT *, substr(sha256(text), 1, 32) AS key FROM n WHERE length(text) >= 120), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY doc_id) = 1) SELECT source, CASE WHEN substr(sha256(text), 1, 16) < '{F05}' THEN 'validation' ELSE 'train' END AS split, count(*) AS documents, sum({TOK} + 1)::BIGINT AS tokens FROM f GROUP BY ALL")
def corpus_slice(spark, d):
    return corpus.slice_counts(spread_docs(spark, d))


@query(f"{N} SELECT doc_id, text FROM n")
def normalize_documents(spark, d):
    return corpus.normalized(spread_docs(spark, d)).select("doc_id", "text")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), E' \t\n') AS text FROM documents")
def normalize_tokenizer(spark, d):
    return spread_docs(spark, d).select("doc_id", T.normalize_tokenizer(F.col("text")).alias("text"))


@query(f"{N} SELECT doc_id, length(text) AS chars FROM n WHERE length(text) >= 120")
def min_length_filter(spark, d):
    return corpus.normalized(spread_docs(spark, d)).where(F.length("text") >= 120).select("doc_id", F.length("text").cast("long").alias("chars"))


@query(f"SELECT doc_id, {LICENSE} AS license FROM documents WHERE coalesce({LICENSE}, 'none') IN ({ALLOWED})")
def license_filter(spark, d):
    rows = docs(spark, d).withColumn("license", corpus.text_license(F.col("text")))
    return rows.where(corpus.license_allowed(F.col("license"), corpus.ALLOWED_LICENSES)).select("doc_id", "license")


@query(f"SELECT doc_id FROM documents WHERE coalesce({LICENSE}, '') IN ('', 'mit', 'mpl-2.0')")
def license_filter_blank(spark, d):
    return docs(spark, d).where(corpus.license_allowed_or_blank(corpus.text_license(F.col("text")), ["mit", "mpl-2.0"])).select("doc_id")


@query(f"{N} SELECT min(doc_id) AS doc_id, substr(sha256(text), 1, 32) AS key FROM n GROUP BY 2")
def exact_dedup_first_wins(spark, d):
    return corpus.first_wins(_keys(spark, d).select("doc_id", "key"), ["key"], "doc_id")


@query(f"{N} SELECT source, min(doc_id) AS doc_id, substr(sha256(text), 1, 32) AS key FROM n GROUP BY source, 3")
def dedup_per_source(spark, d):
    return corpus.first_wins(_keys(spark, d).select("source", "doc_id", "key"), ["source", "key"], "doc_id")


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def incremental_dedup(spark, d):
    """Documents whose text an earlier run (every third document) hasn't stored."""
    rows = docs(spark, d).select("doc_id", H.content_hash(F.col("text")).alias("key"))
    return corpus.without_seen(rows, rows.where("doc_id % 3 = 0"), "key").select("doc_id")


@query(f"SELECT doc_id, substr(sha256(text), 1, 16) < '{F10}' AS validation FROM documents")
def hash_split_fraction(spark, d):
    return docs(spark, d).select("doc_id", H.in_fraction(F.col("text"), 0.10).alias("validation"))


_905 = "CASE WHEN ('0x' || substr(sha256(text), 1, 12))::BIGINT % 10000 < 9000 THEN 'train' WHEN ('0x' || substr(sha256(text), 1, 12))::BIGINT % 10000 < 9500 THEN 'validation' ELSE 'test' END"


@query(f"SELECT doc_id, {_905} AS split FROM documents")
def hash_split_90_5_5(spark, d):
    return docs(spark, d).select("doc_id", H.split_90_5_5(H.content_hash(F.col("text"))).alias("split"))


@query(f"SELECT sha256(text) AS key, count(DISTINCT {_905}) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {_905}) > 1")
def split_leakage_check(spark, d):
    rows = docs(spark, d).select(H.content_hash(F.col("text")).alias("key"), H.split_90_5_5(H.content_hash(F.col("text"))).alias("split"))
    return dialogs.split_leaks(rows, "key")


def _licensed(spark, d):
    return spread_docs(spark, d).withColumn("license", F.coalesce(corpus.text_license(F.col("text")), F.lit("MIT")))


_REASONS = rf"""WITH n AS (SELECT doc_id, source, coalesce({LICENSE}, 'mit') AS license, {_NORM} AS text FROM documents),
e AS (SELECT *, CASE WHEN license NOT IN ({ALLOWED}) THEN 'license' WHEN length(text) < 120 THEN 'short' WHEN substr(sha256(text), 1, 16) < '{F05}' THEN 'split' END AS early FROM n),
f AS (SELECT *, min(doc_id) FILTER (WHERE early IS NULL) OVER (PARTITION BY source, sha256(text)) AS first FROM e),
r AS (SELECT doc_id, source, coalesce(early, CASE WHEN doc_id <> first THEN 'duplicate' END) AS reason FROM f)"""


@query(f"{_REASONS} SELECT doc_id, source, reason FROM r")
def reject_reason_cascade(spark, d):
    return corpus.rejection_reasons(_licensed(spark, d), corpus.ALLOWED_LICENSES, 0.05).select("doc_id", "source", "reason")


@query(f"{_REASONS} SELECT source, count(*) AS read, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason = 'license') AS rejected_license, count(*) FILTER (WHERE reason = 'not_text') AS rejected_not_text, count(*) FILTER (WHERE reason = 'short') AS rejected_short, count(*) FILTER (WHERE reason = 'split') AS rejected_split, count(*) FILTER (WHERE reason = 'duplicate') AS rejected_duplicate FROM r GROUP BY source")
def source_counters_pivot(spark, d):
    return corpus.reason_counters(corpus.rejection_reasons(_licensed(spark, d), corpus.ALLOWED_LICENSES, 0.05))


@query(rf"""{N}, s AS (SELECT source, doc_id, sha256(text) AS key, length(text) AS chars, {TOK} + 1 AS tokens FROM n),
f AS (SELECT *, min(doc_id) FILTER (WHERE chars >= 120) OVER (PARTITION BY source, key) AS first FROM s), g AS (SELECT *, chars >= 120 AND doc_id = first AS good FROM f)
SELECT source, count(*) AS emitted, count(*) FILTER (WHERE good) AS accepted, count(*) FILTER (WHERE chars < 120) AS short, count(*) FILTER (WHERE chars >= 120 AND doc_id <> first) AS duplicate, count(*) FILTER (WHERE good AND tokens > 16384) AS truncated,
coalesce(sum(chars) FILTER (WHERE good), 0)::BIGINT AS characters, coalesce(sum(tokens) FILTER (WHERE good), 0)::BIGINT AS tokens_before, coalesce(sum(least(tokens, 16384)) FILTER (WHERE good), 0)::BIGINT AS tokens_after,
round((count(*) FILTER (WHERE chars >= 120 AND doc_id <> first))::DOUBLE / nullif(count(*) FILTER (WHERE chars >= 120), 0), 9) AS duplicate_fraction, round((sum(least(tokens, 16384)) FILTER (WHERE good))::DOUBLE / nullif(count(*) FILTER (WHERE good), 0), 6) AS tokens_per_document FROM g GROUP BY source""")
def capacity_audit(spark, d):
    return audit.capacity_audit(spread_docs(spark, d))


#: Sources of the approved mixture: weight, finite, audited tokens, share of the shortfall. Fixed values.
ALLOCATION = [
    (0, "general_fineweb_edu", 0.60, False, None, 0.8),
    (1, "codeparrot_clean_permissive", 0.15, False, None, 0.2),
    (2, "structured_openapi", 0.10, True, 636325158, None),
    (3, "api_tool_docs", 0.10, True, 197553288, None),
    (4, "synthetic_tool_actions", 0.05, True, 118857546, None),
]
TRAIN_TOKENS = 4_007_835_072


@query(f"""WITH n AS (SELECT substr(source, 4)::INT AS pos, source, 0.05::DOUBLE AS weight, substr(source, 4)::INT % 3 <> 0 AS finite, (count(*) * 1000000)::BIGINT AS usable FROM documents GROUP BY ALL),
s AS (SELECT pos, source, weight, finite, CASE WHEN finite THEN usable END AS usable, CASE WHEN NOT finite THEN 1.0::DOUBLE / sum(NOT finite) OVER () END AS fill FROM n), c AS (SELECT *, round_even({TRAIN_TOKENS}::DOUBLE * weight, 0)::BIGINT AS cap FROM s),
b AS (SELECT *, CASE WHEN finite THEN least(cap, usable) ELSE cap END AS base FROM c), t AS (SELECT *, (sum(cap - base) OVER ())::BIGINT AS shortfall FROM b),
r AS (SELECT *, round_even(shortfall * fill, 0)::BIGINT AS part, row_number() OVER (PARTITION BY fill IS NOT NULL ORDER BY pos) AS place, count(*) OVER (PARTITION BY fill IS NOT NULL) AS n FROM t),
a AS (SELECT *, base + CASE WHEN fill IS NULL THEN 0 WHEN place = n THEN shortfall - coalesce(sum(part) OVER (PARTITION BY fill IS NOT NULL ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE part END AS given FROM r),
z AS (SELECT *, given + CASE WHEN fill IS NOT NULL AND place = 1 THEN {TRAIN_TOKENS} - sum(given) OVER () ELSE 0 END AS allocation FROM a)
SELECT pos, source, finite, cap, usable, shortfall, allocation::BIGINT AS allocation, allocation::BIGINT / {TRAIN_TOKENS}::DOUBLE AS fraction FROM z""")
def allocation_cap_and_fill(spark, d):
    """Twenty sources of equal weight; two thirds have a million tokens for each of their documents, the rest fill up."""
    n = F.substring("source", 4, 9).cast("int")
    counts = docs(spark, d).groupBy("source").agg((F.count(F.lit(1)) * 1_000_000).alias("usable"))
    open_ = counts.where(n % 3 == 0).count()  # one row for each source
    rows = counts.select(n.alias("pos"), "source", F.lit(0.05).alias("weight"), (n % 3 != 0).alias("finite"), F.when(n % 3 != 0, F.col("usable")).alias("usable"), F.when(n % 3 == 0, F.lit(1.0) / open_).alias("fill"))
    return audit.cap_and_fill(rows, TRAIN_TOKENS)


@query("WITH p AS (SELECT source, count(*)::DOUBLE AS share FROM documents GROUP BY 1), t AS (SELECT *, floor(1000000::DOUBLE * (share / sum(share) OVER ()))::BIGINT AS t FROM p) SELECT source, share, (t + CASE WHEN source = 'src0' THEN 1000000 - sum(t) OVER () ELSE 0 END)::BIGINT AS target FROM t")
def mixture_targets(spark, d):
    return audit.mixture_targets(docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("share")), 1_000_000, "src0")


_CUT = rf"{N}, p AS (SELECT source, doc_id, {TOK} + 1 AS n_tokens, coalesce(sum({TOK} + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n), c AS (SELECT *, least(n_tokens, greatest(0, 5000 - start)) AS kept FROM p)"


def _cut(spark, d):
    return corpus.budget_cut(corpus.measured(spread_docs(spark, d), ["source", "doc_id"]), ["source"], "doc_id", F.col("n_tokens"), 5000)


@query(f"{_CUT} SELECT source, doc_id, n_tokens, start, kept FROM c WHERE kept > 0")
def token_budget_cut(spark, d):
    return _cut(spark, d).select("source", "doc_id", "n_tokens", "start", "kept")


_PIECES = f"{_CUT}, e AS (SELECT *, unnest(range(start // 1000, (start + kept - 1) // 1000 + 1)) AS shard FROM c WHERE kept > 0), s AS (SELECT source, shard, doc_id, greatest(start, shard * 1000) - shard * 1000 AS shard_offset, least(start + kept, (shard + 1) * 1000) - greatest(start, shard * 1000) AS tokens, greatest(start, shard * 1000) - start AS doc_offset FROM e)"


@query(f"{_PIECES} SELECT * FROM s")
def shard_plan(spark, d):
    return corpus.shard_pieces(_cut(spark, d), 1000).select("source", "shard", "doc_id", "shard_offset", "tokens", "doc_offset")


@query(f"{_PIECES} SELECT source, shard, sum(tokens)::BIGINT AS tokens, (sum(tokens) * 2)::BIGINT AS bytes, count(*) AS pieces, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM s GROUP BY ALL")
def shard_manifest(spark, d):
    return corpus.shard_manifest(corpus.shard_pieces(_cut(spark, d), 1000), ["source"])


@query(f"{_CUT} SELECT source, doc_id FROM c WHERE kept > 0 AND (start + kept) // 1000 > start // 1000")
def commit_points(spark, d):
    return corpus.commits(_cut(spark, d), 1000).select("source", "doc_id")


def _weights(spark):
    return spark.createDataFrame([(f"src{i}", 1.0 + i % 4) for i in range(20)], "source string, weight double")


@query(r"WITH n AS (SELECT source, doc_id, len(regexp_extract_all(text, '\S+')) + 1 AS t FROM documents), w AS (SELECT source, doc_id, coalesce(sum(t) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (1.0 + substr(source, 4)::INT % 4)::DOUBLE AS turn FROM n) SELECT source, doc_id, row_number() OVER (ORDER BY turn, source, doc_id) - 1 AS position FROM w")
def weighted_fair_schedule(spark, d):
    rows = docs(spark, d).select("source", "doc_id", (T.whitespace_tokens(F.col("text")) + 1).alias("n_tokens"))
    return global_position(corpus.fair_order(rows, _weights(spark)).select("source", "doc_id", "turn"), ["turn", "source", "doc_id"]).select("source", "doc_id", "position")


@query(f"{_PIECES}, m AS (SELECT source, shard, sum(tokens) AS tokens FROM s GROUP BY ALL), t AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(tokens) OVER (PARTITION BY source)::DOUBLE AS turn FROM m) SELECT source, shard, row_number() OVER (ORDER BY turn, source, shard) - 1 AS position FROM t")
def weighted_shard_plan(spark, d):
    plan = corpus.fair_shard_plan(corpus.shard_manifest(corpus.shard_pieces(_cut(spark, d), 1000), ["source"]))
    return global_position(plan.select("source", "shard", "turn"), ["turn", "source", "shard"]).select("source", "shard", "position")


@query("WITH t AS (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / (count(*) OVER (PARTITION BY lang))::DOUBLE AS turn FROM documents) SELECT lang, doc_id, row_number() OVER (ORDER BY turn, lang, doc_id) - 1 AS position FROM t")
def weighted_interleave(spark, d):
    rows = corpus.interleaved(docs(spark, d).select("lang", "doc_id"), "lang", "doc_id")
    return global_position(rows.select("lang", "doc_id", "turn"), ["turn", "lang", "doc_id"]).select("lang", "doc_id", "position")


@query(rf"WITH s AS (SELECT source, sum({TOK} + 1)::BIGINT AS tokens FROM documents GROUP BY 1) SELECT source, tokens, tokens / (sum(tokens) OVER ())::DOUBLE AS fraction FROM s")
def realized_mixture(spark, d):
    return corpus.realized_mixture(docs(spark, d), "source", T.whitespace_tokens(F.col("text")) + 1)


@query(rf"WITH s AS (SELECT source, sum({TOK} + 1)::DOUBLE AS tokens FROM documents GROUP BY 1), r AS (SELECT source, tokens / sum(tokens) OVER () AS realized FROM s) SELECT source, realized, 0.05::DOUBLE AS expected, CASE WHEN abs(realized - 0.05) > 0.01 THEN 'off' ELSE 'ok' END AS status FROM r")
def mixture_tolerance_check(spark, d):
    real = corpus.realized_mixture(docs(spark, d), "source", T.whitespace_tokens(F.col("text")) + 1)
    return corpus.mixture_check(real, spark.createDataFrame([(f"src{i}", 0.05) for i in range(20)], "source string, fraction double"), 0.01)


@query("WITH p AS (SELECT doc_id, source, text, greatest(1, ceil(length(text) / 2000.0)::INT) AS n FROM documents), e AS (SELECT *, unnest(range(1, n + 1))::INT AS part FROM p) SELECT doc_id, part, source || CASE WHEN n = 1 THEN '' ELSE chr(10) || 'Part ' || part || ' of ' || n END || chr(10) || substr(text, (part - 1) * 2000 + 1, 2000) AS chunk FROM e")
def chunk_document(spark, d):
    return corpus.chunked(docs(spark, d), 2000, F.col("source")).select("doc_id", "part", "chunk")


@query("WITH p AS (SELECT doc_id, strlen(text) + 15 AS b, sum(strlen(text) + 15) OVER (ORDER BY doc_id) AS upto FROM documents) SELECT doc_id, (upto - b)::BIGINT AS start FROM p WHERE upto <= 200000")
def tokenizer_byte_budget(spark, d):
    return corpus.byte_budget(docs(spark, d), "doc_id", 200_000).select("doc_id", "start")


@query(rf"WITH t AS (SELECT lang, {TOK} AS n FROM documents), g AS (SELECT lang, list_sort(list(n)) AS v, median(n) AS median FROM t GROUP BY 1) SELECT lang, v[1] AS least, median, v[1 + floor(0.95::DOUBLE * (len(v) - 1))::INT] AS p95, v[1 + floor(0.99::DOUBLE * (len(v) - 1))::INT] AS p99, v[len(v)] AS most, len(v) AS n FROM g")
def token_length_stats(spark, d):
    return audit.length_stats(docs(spark, d).select("lang", T.whitespace_tokens(F.col("text")).alias("n_tokens")), ["lang"], "n_tokens")


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, count(DISTINCT lower(text)) AS texts FROM conversations GROUP BY role")
def distinct_counts(spark, d):
    return _t(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.count_distinct(F.lower("text")).alias("texts"))


@query("WITH c AS (SELECT conv_id, count(*) AS turns, max(role) AS last FROM conversations GROUP BY 1) SELECT turns, last, count(*) AS n FROM c GROUP BY ALL")
def category_decision_counts(spark, d):
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("role").alias("last")).groupBy("turns", "last").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) AS dialog FROM conversations GROUP BY 1")
def dialog_render(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text").alias("said"))))
    return _t(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["said"]), "\n").alias("dialog"))


@query("SELECT a.conv_id, a.turn, a.text AS request, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def single_turn_pairs(spark, d):
    c = _t(spark, d, "conversations")
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("request")).join(b, ["conv_id", "turn"]).select("conv_id", "turn", "request", "answer")


@query("SELECT role AS category, (n * 90 // 100)::INT AS train, (n * 5 // 100)::INT AS validation, (n - n * 90 // 100 - n * 5 // 100)::INT AS test FROM (SELECT role, count(*) AS n FROM conversations GROUP BY 1)")
def category_split_targets(spark, d):
    """Targets of three splits for each kind of turn, by how many there are."""
    rows = _t(spark, d, "conversations").groupBy(F.col("role").alias("category")).agg(F.count(F.lit(1)).alias("total"))
    train, held = F.floor(F.col("total") * 90 / 100), F.floor(F.col("total") * 5 / 100)
    return rows.select("category", train.cast("int").alias("train"), held.cast("int").alias("validation"), (F.col("total") - train - held).cast("int").alias("test"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props_extract(spark, d):
    return _t(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def language_filter(spark, d):
    return docs(spark, d).where("lang = 'en'").select("doc_id")


_SECRETS = r"(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:(api[_-]?key|secret|token|password)\s*[:=]\s*[''\x22]?[A-Za-z0-9_\-/+]{16,}))"


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_SECRETS}')")
def secret_filter(spark, d):
    """Documents that hold what looks like a key or password."""
    return docs(spark, d).where(F.col("text").rlike(_SECRETS.replace("''", "'"))).select("doc_id")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|header|footer|aside)\b.*?</(script|style|nav|header|footer|aside)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages")
def boilerplate_html_strip(spark, d):
    return _t(spark, d, "pages").select("page_id", pages.main_text(F.col("html")).alias("body"))


@query("SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0")
def quality_join(spark, d):
    good = _t(spark, d, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return docs(spark, d).join(good, "doc_id", "left_semi").select("doc_id", "source")


_EV = ["ts", "event_id"]


@query("WITH l AS (SELECT user_id, list(value::DOUBLE ORDER BY ts, event_id) AS v FROM events GROUP BY 1) SELECT user_id, round(list_reduce(v, lambda a, x: 0.98::DOUBLE * a + (1.0::DOUBLE - 0.98::DOUBLE) * x), 6) AS ema, len(v) AS n FROM l")
def metrics_ema(spark, d):
    return metrics.ema(_t(spark, d, "events"), "user_id", _EV, "value").withColumn("ema", F.round("ema", 6))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM events")
def metrics_moving_avg(spark, d):
    return metrics.moving_average(_t(spark, d, "events"), "user_id", _EV, "value", 10).select("event_id", F.round("moving_average", 6).alias("moving_average"))


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def metrics_running_best(spark, d):
    return metrics.running_best(_t(spark, d, "events"), "user_id", _EV, "value").select("event_id", "best")


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def metrics_first_last(spark, d):
    return metrics.first_last(_t(spark, d, "events"), "user_id", _EV, "value")


@query("SELECT user_id, coalesce(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase'), arg_max(value, (ts, event_id)) FILTER (WHERE event_type LIKE 'c%')) AS last_validation FROM events GROUP BY 1")
def metrics_last_validation(spark, d):
    return metrics.last_validation(_t(spark, d, "events"), "user_id", _EV, "event_type", "value", "purchase", "c")


#: Events as results of runs: a type is a tier, a value a loss.
_RUNS = "SELECT 'e' || event_id AS run, event_type AS tier, user_id + 1 AS parameters, event_id + 1 AS tokens, value AS loss FROM events"


def _runs(spark, d):
    return _t(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("run"), F.col("event_type").alias("tier"), (F.col("user_id") + 1).alias("parameters"), (F.col("event_id") + 1).alias("tokens"), F.col("value").alias("loss"))


@query(f"WITH r AS ({_RUNS}) SELECT tier, arg_min(run, (loss, run)) AS run, min(loss) AS loss FROM r GROUP BY 1")
def argmin_per_group(spark, d):
    return audit.best_runs(_runs(spark, d))


@query(f"WITH r AS ({_RUNS}), c AS (SELECT tier, 6.0::DOUBLE * parameters * tokens AS cost FROM r) SELECT tier, round((max(cost) - min(cost)) / avg(cost), 9) AS spread, count(*) AS runs, (max(cost) - min(cost)) / avg(cost) <= 0.05 AS within FROM c GROUP BY 1")
def isoflop_spread(spark, d):
    return audit.iso_flop_spread(_runs(spark, d)).withColumn("spread", F.round("spread", 9))


@query()
def scaling_fit(spark, d):
    return audit.scaling_fit(audit.study_runs(spark))


@query(f"WITH r AS ({_RUNS}) SELECT run, round(exp(least(loss, 20.0)), 3) AS perplexity, 6 * parameters::BIGINT * tokens AS flops, round(least(tokens / 8000.0::DOUBLE, 1.0), 9) AS progress, round(greatest(8000 - tokens, 0) / 670.0::DOUBLE / 3600.0, 6) AS hours_left FROM r")
def run_arithmetic(spark, d):
    target, speed = F.lit(8000), F.lit(670.0)
    return _runs(spark, d).select("run", F.round(R.safe_perplexity(F.col("loss")), 3).alias("perplexity"), R.training_flops(F.col("parameters"), F.col("tokens")).alias("flops"), F.round(R.progress(F.col("tokens"), target), 9).alias("progress"), F.round(R.hours_left(F.col("tokens"), target, speed), 6).alias("hours_left"))


@query("SELECT event_id AS step, round(CASE WHEN event_id < 100 THEN 0.001::DOUBLE * (event_id + 1) / 100 ELSE 0.0001::DOUBLE + 0.5 * (0.001::DOUBLE - 0.0001::DOUBLE) * (1 + cos(pi() * least(1.0, greatest(0.0, (event_id - 100) / 7900.0::DOUBLE)))) END, 12) AS rate FROM events")
def learning_rates(spark, d):
    """The rate of each step, where events are steps."""
    return _t(spark, d, "events").select(F.col("event_id").alias("step"), F.round(R.cosine_rate(F.col("event_id"), 0.001, 0.0001, 100, 8000), 12).alias("rate"))


@query(f"WITH s AS (SELECT source, sum({TOK} + 1)::BIGINT AS n FROM documents GROUP BY 1) SELECT source, n // 136 AS steps, n // 136 * 128 AS trained_tokens, n // 136 * 136 AS source_tokens_used, n % 136 AS source_tokens_unused, ceil((n // 136) / 50.0)::BIGINT AS checkpoint_every_steps FROM s")
def token_plan(spark, d):
    """Whole optimizer steps of eight sequences of 16 tokens (and one more each) that the tokens of each source allow."""
    sums = docs(spark, d).groupBy("source").agg(F.sum(T.whitespace_tokens(F.col("text")) + 1).alias("n"))
    return sums.select("source", *(c.alias(k) for k, c in R.token_plans(F.col("n"), 16, 2, 2, 2).items()))


@query("SELECT o_custkey AS id, count(*)::INT AS attempt, least(60.0::DOUBLE, 2.0::DOUBLE * pow(2, greatest(0, count(*) - 1))) AS delay FROM orders GROUP BY 1")
def retry_delays(spark, d):
    """The delay after as many failures as a customer has orders."""
    failures = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("attempt"))
    return failures.select("id", "attempt", R.retry_delay(F.col("attempt"), 2.0, 60.0).alias("delay"))


@query(r"SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), 120), ''), 'tool') AS slug, regexp_replace(regexp_replace('run ' || source || '/a', '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') || '.json' AS file FROM documents")
def slugs(spark, d):
    return docs(spark, d).select("doc_id", T.safe_slug(F.col("text")).alias("slug"), T.run_filename(F.concat(F.lit("run "), "source", F.lit("/a"))).alias("file"))


def _shards(spark, d):
    """Every 100 orders as a shard of their keys' low bits."""
    o = _t(spark, d, "orders").select("o_orderkey")
    placed = global_position(o, ["o_orderkey"])
    return placed.groupBy(F.floor(F.col("position") / 1000).alias("s")).agg(F.array_sort(F.collect_list(F.struct("position", (F.col("o_orderkey") % 32000).cast("int").alias("token")))).alias("v")).select(F.format_string("shards/shard_%05d.bin", "s").alias("path"), F.size("v").cast("long").alias("tokens"), F.transform("v", lambda x: x["token"]).alias("values"))


_STREAM = "WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, (o_orderkey % 32000)::INT AS token FROM orders)"


@query(f"{_STREAM} SELECT pos, token FROM p WHERE pos BETWEEN 990 AND 1489")
def token_range_read(spark, d):
    return tokens.read_range(_shards(spark, d), 990, 500)


@query(f"{_STREAM}, b AS (SELECT pos // 65 AS block, list(token ORDER BY pos) AS t FROM p GROUP BY 1 HAVING count(*) = 65) SELECT block, array_to_string(t[1:64], ',') AS inputs, array_to_string(t[2:65], ',') AS targets FROM b")
def packed_batches(spark, d):
    stream = tokens.read_range(_shards(spark, d), 0, _t(spark, d, "orders").count())
    return tokens.training_rows(stream, 64).select("block", F.array_join("inputs", ",").alias("inputs"), F.array_join("targets", ",").alias("targets"))


@query("SELECT o_orderkey AS block, ((o_orderkey // 2) % 4)::INT AS rank, (o_orderkey // 2) // 4 AS step FROM orders")
def rank_slices(spark, d):
    """Orders as blocks of a packed corpus, dealt to four ranks."""
    return tokens.rank_slices(_t(spark, d, "orders").select(F.col("o_orderkey").alias("block")), 4, 2)


@query(f"{_STREAM}, s AS (SELECT 'shards/shard_' || lpad((pos // 1000)::VARCHAR, 5, '0') || '.bin' AS path, count(*) AS tokens FROM p GROUP BY 1) SELECT sha256(string_agg(path || ':' || tokens, chr(10) ORDER BY path || ':' || tokens)) AS fingerprint, count(*) AS shards, sum(tokens)::BIGINT AS tokens, min(path) AS first, max(path) AS last FROM s")
def corpus_fingerprint(spark, d):
    return tokens.corpus_fingerprint(_shards(spark, d))


@query("SELECT source, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY 1")
def source_probe(spark, d):
    from lodestone.sources.jsonl import probe

    return probe(docs(spark, d).withColumn("license", F.lit("mit")), corpus.ALLOWED_LICENSES)




@query("SELECT p.source, coalesce(t.tokens, 0)::BIGINT AS tokens, 20000 AS target, least(1.0::DOUBLE, coalesce(t.tokens, 0) / 20000.0::DOUBLE) AS fraction, coalesce(t.tokens, 0) >= 20000 AS complete FROM (SELECT 'src' || i AS source FROM range(21) r(i)) p LEFT JOIN (SELECT source, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS tokens FROM documents GROUP BY 1) t USING (source)")
def build_status(spark, d):
    targets = spark.range(21).select(F.concat(F.lit("src"), "id").alias("source"), F.lit(20000).alias("target"))
    have = docs(spark, d).groupBy("source").agg(F.sum(T.whitespace_tokens(F.col("text"))).alias("tokens"))
    return audit.status_table(targets, have)


@query("SELECT source, audited, approved FROM (SELECT source, count(*) AS audited FROM documents GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS approved FROM documents WHERE lang <> 'fr' GROUP BY 1) b USING (source) WHERE audited IS DISTINCT FROM approved")
def approval_differences(spark, d):
    rows = docs(spark, d)
    count = lambda df: df.groupBy("source").agg(F.count(F.lit(1)).alias("allocation"))
    return audit.approval_differences(count(rows), count(rows.where("lang <> 'fr'")))


@query("WITH s AS (SELECT 'o' || lpad((o_orderkey // 1000)::VARCHAR, 6, '0') AS path, count(*) AS tokens FROM orders GROUP BY 1), o AS (SELECT *, sum(tokens) OVER (ORDER BY path) AS upto FROM s) SELECT pos, path, (pos - (upto - tokens))::BIGINT AS off FROM (SELECT o_orderkey // 3 AS pos FROM orders) r JOIN o ON pos >= upto - tokens AND pos < upto")
def token_location(spark, d):
    """Positions of a token stream to their shard and offset."""
    parts = _t(spark, d, "orders").groupBy(F.concat(F.lit("o"), F.lpad(F.floor(F.col("o_orderkey") / 1000).cast("string"), 6, "0")).alias("path")).agg(F.count(F.lit(1)).alias("tokens"))
    asked = _t(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 3).alias("pos"))
    return tokens.locate(asked, tokens.shard_offsets(parts)).select("pos", "path", F.col("offset").alias("off"))


@query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 9) AS mean FROM events GROUP BY 1")
def reduced_metrics(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 9).alias("mean"))
