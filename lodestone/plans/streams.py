"""Queries of streams that stop and go on: lines, budgets as state, and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.builds import _folder
from lodestone.plans.catalog import N, TOK, docs, query
from lodestone.sources import shard_sink
from lodestone.streaming import shards
from lodestone.streaming.budget import CUT, budget_stream
from lodestone.streaming.session import run_session

#: Micro-batches that a run takes, about, whatever the table's size.
BATCHES = 5
#: Bytes of a file of lines, about; one task sorts and writes it.
FILE_BYTES = 32 << 20


def _lines(spark, d, folder):
    """The documents as JSON lines, and the bytes that make about BATCHES micro-batches of them."""
    rows = docs(spark, d).select("source", "doc_id", "text")
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("source", "doc_id", "text"))) + 1)).first()[0] or 0
    shards.write_lines(rows, f"{folder}/lines", ["doc_id"], max(3, -(-size // FILE_BYTES)))
    return f"{folder}/lines", size // BATCHES + 1


def _sessions(spark, folder, start):
    """One batch, then another session for the rest."""
    first = run_session(spark, start, f"{folder}/cursor", batches=1)
    second = run_session(spark, start, f"{folder}/cursor")
    if first.batches and second.batches and second.batches[0] != first.batches[-1] + 1:
        raise RuntimeError(f"the second session began with batch {second.batches[0]} after {first.batches}")


@query("SELECT doc_id, source, strlen(text) AS bytes FROM documents")
def resumed_lines(spark, d):
    """Documents as lines, read by a stream that is stopped inside a file and goes on in another session."""
    folder = _folder(spark, "resumed")
    lines, batch = _lines(spark, d, folder)

    def start():
        rows = shards.documents_of(shards.line_frames(spark, lines, f"{folder}/cursor", batch, suffix=".txt"))
        sized = rows.select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"))
        return sized.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").start()

    _sessions(spark, folder, start)
    return spark.read.schema("doc_id long, source string, bytes long").parquet(f"{folder}/out")


@query(f"""WITH t AS (SELECT source, doc_id, {TOK} + 1 AS n_tokens FROM documents), p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t)
SELECT source, doc_id, n_tokens, start, least(n_tokens, 5000 - start)::BIGINT AS kept FROM p WHERE start < 5000""")
def stream_budget(spark, d):
    """Budgets of 5,000 tokens as the state of a stream of several batches and two sessions: the rows of token_budget_cut."""
    folder = _folder(spark, "budget")
    lines, batch = _lines(spark, d, folder)

    def start():
        rows = shards.documents_of(shards.line_frames(spark, lines, f"{folder}/cursor", batch, suffix=".txt"))
        sized = rows.select("source", "doc_id", F.lit(None).cast("string").alias("key"), (T.whitespace_tokens(F.col("text")) + 1).cast("long").alias("n_tokens"), F.lit(None).cast("binary").alias("tokens"))
        return budget_stream(sized, 5000).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").start()

    _sessions(spark, folder, start)
    return spark.read.schema(CUT).parquet(f"{folder}/out").drop("tokens")


@query(rf"""{N}, f AS (SELECT * FROM n WHERE length(text) >= 120 QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1),
w AS (SELECT source, doc_id, list_append(list_transform(regexp_extract_all(text, '\S+'), lambda x: ('0x' || substr(sha256(x), 1, 8))::BIGINT % 31996 + 4), 3) AS t FROM f),
u AS (SELECT source, doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM w), p AS (SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS pos FROM u)
SELECT source, 'shard_' || lpad((pos // 1000)::VARCHAR, 5, '0') || '.bin' AS file, count(*) AS tokens, sha256(unhex(string_agg(printf('%02x%02x', (t % 256)::INT, (t // 256)::INT), '' ORDER BY pos))) AS sha256 FROM p WHERE pos < 5000 GROUP BY source, pos // 1000""")
def stream_shards(spark, d):
    """Shards of 1,000 tokens that a stream of several batches and two sessions has written, by their bytes' digests."""
    folder = _folder(spark, "stream-shards")
    lines, batch = _lines(spark, d, folder)
    shards.stream_session(spark, lines, folder, 5000, batch_bytes=batch, batches=1, suffix=".txt")
    shards.stream_session(spark, lines, folder, 5000, batch_bytes=batch, suffix=".txt")
    found = shard_sink.assembled(spark, folder, 1000, 32_000)
    return spark.createDataFrame([(s, f["file"], f["tokens"], f["sha256"]) for s, told in found.items() for f in told], "source string, file string, tokens long, sha256 string")
