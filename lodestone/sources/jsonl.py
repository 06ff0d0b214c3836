"""JSON lines and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BadLine(ValueError):
    """A line that is no JSON object, with its file."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line that isn't blank is an object of the schema, or reading fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A torn last line of a file is left out; an earlier bad line fails."""
    rows = _lines(spark, path).withColumn("_id", F.monotonically_increasing_id())
    # A row for each file goes back to the lines, so a log of any size is read by many tasks.
    last = rows.groupBy(F.col("file").alias("_of")).agg(F.max("_id").alias("_last"))
    parsed = rows.withColumn("_json", F.try_parse_json("value")).join(F.broadcast(last), F.col("file") == F.col("_of"))
    broken = F.col("_json").isNull() & (F.col("_id") < F.col("_last"))
    checked = parsed.withColumn("value", F.when(broken, F.raise_error(F.concat(F.lit("bad line in "), F.col("file")))).otherwise(F.col("value")))
    return checked.where(F.col("_json").isNotNull() | broken).select(F.from_json("value", schema).alias("r")).select("r.*")


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank; 0 where there is no file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return 0
    return _lines(spark, path).count()


def write_canonical(df: DataFrame, path: str) -> None:
    """One canonical JSON object a line: sorted keys, no blanks, nulls kept."""
    from lodestone.functions.schemas import canonical_json

    df.select(canonical_json(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).alias("value")).write.text(path)


RUN_RESULTS = "run_name string, tier string, status string, parameter_count long, target_tokens long, tokens_seen long, final_general_loss double, final_general_perplexity double, final_structured_loss double, final_structured_perplexity double, best_general_loss double, final_train_loss_ema double, median_tokens_per_second double, training_hours double, peak_gpu_memory_gib double"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RUN_RESULTS)


def scan_specs(spark: SparkSession, path: str) -> DataFrame:
    """API descriptions below a folder, as path and text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.where(F.col("path").rlike(r"/(openapi|swagger)\.(json|ya?ml)$"))
    return named.select("path", F.decode("content", "UTF-8").alias("text"))


def probe(rows: DataFrame, allowed: list[str] | None) -> DataFrame:
    """The first usable row of each source."""
    from lodestone.operators.corpus import license_allowed

    usable = rows.where(license_allowed(F.col("license"), allowed) & (F.trim("text") != ""))
    return usable.groupBy("source").agg(F.min("doc_id").alias("doc_id"))


def append_metrics(records: DataFrame, folder: str) -> None:
    """Records as canonical JSON lines with the time at which they are written, appended as new files: a reader sees all
    of an append or nothing."""
    from lodestone.functions.schemas import canonical_json

    stamped = records.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    stamped.select(canonical_json(F.to_json(F.struct(*sorted(stamped.columns)))).alias("value")).coalesce(1).write.mode("append").text(folder)


def live_tail(spark: SparkSession, folder: str, schema: str, name: str):
    """What is there now, and, as a query that goes on, what is appended: the table `name` in memory."""
    return spark.readStream.schema(schema).json(folder).writeStream.format("memory").queryName(name).outputMode("append").start()
