"""A resumable corpus build as a stream: filter, deduplicate for ever, cut at a token budget, commit by batch.

Texts are normalized and measured as they come; which keys were seen is the stream's state, one entry for each source
and key, kept with the checkpoint and looked up for the keys of a batch only. Each micro-batch writes its accepted
documents and its token sums under its batch id and then a marker; a batch that runs again after a failure replaces
what it wrote, since state goes back with it. A changed configuration refuses to resume."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.hashing import dedup_key
from lodestone.functions.text import normalize_corpus, whitespace_tokens
from lodestone.operators.corpus import MIN_CHARS
from lodestone.operators.ordered import prefix_sum
from lodestone.sources.scratch import table

COLUMNS = "source string, doc_id long, key string, tokens long, kept long, batch long"


class ConfigChanged(ValueError):
    """The folder holds a build of another configuration."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def guard(spark: SparkSession, folder: str, config: dict) -> None:
    """Stores the configuration's fingerprint beside the build, or compares it."""
    fs, where = _fs(spark, f"{folder}/config")
    if fs.exists(where):
        if spark.read.text(f"{folder}/config").first()[0] != fingerprint(config):
            raise ConfigChanged(folder)
    else:
        spark.createDataFrame([(fingerprint(config),)], "value string").coalesce(1).write.text(f"{folder}/config")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all batches whose marker is there."""
    fs, where = _fs(spark, f"{folder}/done")
    if not fs.exists(where):
        return spark.createDataFrame([], COLUMNS)
    batches = [s.getPath().getName() for s in fs.listStatus(where)]  # one marker for each micro-batch
    return spark.read.schema(COLUMNS).parquet(*[f"{folder}/batches/{b}" for b in batches]) if batches else spark.createDataFrame([], COLUMNS)


FIRST = "source string, key string, doc_id long, tokens long"


def first_documents(stream: DataFrame) -> DataFrame:
    """For each source and key of a batch: the least doc_id so far, the tokens of its text, and the times of the first and
    the last batch that had it (`new_documents` are those of one batch). Short texts don't count."""
    text = F.col("_normal")
    rows = stream.withColumn("_normal", normalize_corpus(F.col("text"))).select("source", F.col("doc_id").cast("long").alias("doc_id"), dedup_key(text).alias("key"), F.length(text).alias("chars"), (whitespace_tokens(text) + 1).alias("tokens"))
    # In a stream, the current time is that of the batch, also when the batch runs again.
    timed = rows.where(F.col("chars") >= MIN_CHARS).withColumn("time", F.current_timestamp())
    return timed.groupBy("source", "key").agg(F.min("doc_id").alias("doc_id"), F.min("tokens").alias("tokens"), F.min("time").alias("first"), F.max("time").alias("last"))


def new_documents(batch: DataFrame) -> DataFrame:
    """Of a batch's rows of `first_documents`, those whose key no earlier batch had."""
    return batch.where(F.col("first") == F.col("last")).select("source", "key", "doc_id", "tokens")


def accept_batch(new: DataFrame, batch_id: int, folder: str, target: int) -> None:
    """new: rows of `new_documents`. What the budgets of their sources still take of them, in the order of documents."""
    spark = new.sparkSession
    fs, marker = _fs(spark, f"{folder}/done/{batch_id}")
    if fs.exists(marker):
        return
    # Sums are carried from batch to batch.
    _, sums = _fs(spark, f"{folder}/sums")
    earlier = sorted((int(s.getPath().getName()) for s in fs.listStatus(sums)), reverse=True) if fs.exists(sums) else []  # one for each micro-batch
    last = next((i for i in earlier if i < batch_id and fs.exists(_fs(spark, f"{folder}/done/{i}")[1])), None)
    written = spark.createDataFrame([], "source string, written long") if last is None else spark.read.parquet(f"{folder}/sums/{last}")
    placed = prefix_sum(table(new, "batch"), ["source"], "doc_id", F.col("tokens"), "ahead").join(F.broadcast(written), "source", "left")  # one row for each source
    start = F.coalesce("written", F.lit(0)) + F.col("ahead")
    kept = F.least(F.col("tokens"), F.greatest(F.lit(0), F.lit(target) - start)).cast("long")
    placed.withColumn("kept", kept).where("kept > 0").select("source", "doc_id", "key", "tokens", "kept", F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{folder}/batches/{batch_id}")
    added = spark.read.schema(COLUMNS).parquet(f"{folder}/batches/{batch_id}").select("source", F.col("kept").alias("written"))
    added.unionByName(written).groupBy("source").agg(F.sum("written").alias("written")).write.mode("overwrite").parquet(f"{folder}/sums/{batch_id}")
    fs.mkdirs(marker)


def remaining(rows: DataFrame, ordinal: str, read: int) -> DataFrame:
    """A finite source from where an earlier run stopped: rows whose ordinal (from 0, without gaps) was not read yet."""
    return rows.where(F.col(ordinal) >= read)


def build(spark: SparkSession, source: str, schema, folder: str, target: int, files_per_batch: int | None = 4) -> DataFrame:
    """Runs over all files that are there now and stops; call again to go on where it stopped.

    Batches take their files as they come, and budgets go by batch before they go by document: the first documents of a
    source fill its budget, however its files are cut and dated, only where all that is there makes one batch
    (files_per_batch=None)."""
    guard(spark, folder, {"target": target, "min_chars": MIN_CHARS, "source": source})
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    query = first_documents(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: accept_batch(new_documents(df), i, folder, target)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return committed(spark, folder)


def first_seen(stream: DataFrame) -> DataFrame:
    """Stateful deduplication that never forgets, as a streaming frame."""
    return stream.withColumn("key", dedup_key(F.col("text"))).dropDuplicates(["source", "key"])
