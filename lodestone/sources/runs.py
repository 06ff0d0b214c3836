"""Folders of training runs: scans, exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import format_duration, format_tokens, run_filename
from lodestone.sources import files

METRIC = "type string, split string, step long, max_steps long, tokens_seen long, target_tokens long, loss double, loss_ema double, learning_rate double, gradient_norm double, tokens_per_second double, step_seconds double, perplexity double, batches long, tokens_evaluated long"


def _few_listings(spark: SparkSession) -> None:
    """Folders are listed by tasks, up to 10,000 of them unless told otherwise, for a folder or a few each."""
    name, most = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 8 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def scan_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Records of all runs below a folder; `run` is the folder of the log."""
    _few_listings(spark)
    # Folders are listed by tasks; a pattern in the path would be followed on the driver.
    rows = spark.read.schema(METRIC).option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.jsonl").json(root)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"), "*")


def scan_configs(spark: SparkSession, root: str) -> DataFrame:
    """One row for each folder with config.json, its text as variant, and the summary's where there is one."""
    _few_listings(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{config,summary}.json").load(root)  # listed once for both

    def texts(name: str, column: str) -> DataFrame:
        return found.where(F.element_at(F.split("path", "/"), -1) == name).select(F.element_at(F.split("path", "/"), -2).alias("run"), F.try_parse_json(F.decode("content", "UTF-8")).alias(column))

    return texts("config.json", "config").join(texts("summary.json", "summary"), "run", "left")


def matrix_results(matrix: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planned runs with their finished results, and the planned runs that lack one."""
    done = results.where("status = 'completed'")
    return matrix.join(done, "run", "left"), matrix.join(done, "run", "left_anti")


def run_table(log: DataFrame) -> DataFrame:
    """What a dashboard shows of each run."""
    train = log.where("type = 'train'").groupBy("run").agg(F.max_by("loss", "step").alias("loss"), F.max("tokens_seen").alias("tokens"), F.median("tokens_per_second").alias("tokens_per_second"), F.sum("step_seconds").alias("seconds"))
    return train.select("run", run_filename(F.col("run")).alias("file"), "loss", "tokens", format_tokens(F.col("tokens")).alias("tokens_text"), "tokens_per_second", "seconds", format_duration(F.col("seconds")).alias("time_text"))


def _folder_of(run: str | None) -> str:
    """The folder of a run as Spark names that of a partition."""
    if not run:
        return "run=__HIVE_DEFAULT_PARTITION__"
    return "run=" + "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in run)


def export_dashboard(log: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each run, whose log is bounded by its steps.

    Tasks write the files where they stay: a partitioned write of Spark's opens, moves and commits one for each run,
    which takes ten times as long, in part on the driver."""
    where, path = files.hadoop(log.sparkSession, folder)
    where.delete(path, True)
    where.mkdirs(path)

    def write(batches):
        for batch in batches:
            for run, lines in zip(batch["run"], batch["lines"], strict=True):
                files.write(f"{folder}/{_folder_of(run)}/part-00000.json", "".join(f"{x}\n" for x in lines).encode())
            yield batch[["run"]]

    lines = log.select("run", F.to_json(F.struct(*(c for c in log.columns if c != "run"))).alias("line")).groupBy("run").agg(F.collect_list("line").alias("lines"))
    lines.mapInPandas(write, "run string").write.format("noop").mode("overwrite").save()


def write_csv(table: DataFrame, folder: str) -> None:
    """A report table as one CSV part; reports have a row for each source or run."""
    table.coalesce(1).write.option("header", True).mode("overwrite").csv(folder)


def markdown(table: DataFrame, title: str, most: int = 200) -> str:
    """A small report table as Markdown; more than `most` rows are refused, not cut."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report is for aggregates")
    lines = [f"# {title}", "", f"| {' | '.join(table.columns)} |", f"|{' --- |' * len(table.columns)}"]
    return "\n".join([*lines, *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows), ""])


def latest_checkpoint(paths: DataFrame, by: str, path: str = "path") -> DataFrame:
    """The final checkpoint of each group, else the one of the highest step; other files don't count."""
    name = F.element_at(F.split(path, "/"), -1)
    step = F.when(name == "checkpoint_final.pt", F.lit(2**62)).otherwise(F.nullif(F.regexp_extract(name, r"^checkpoint_step_([0-9]+)\.pt$", 1), F.lit("")).cast("long"))
    return paths.withColumn("_step", step).where("_step IS NOT NULL").groupBy(by).agg(F.max_by(path, "_step").alias(path))


def data_card(parts: DataFrame, title: str, splits: DataFrame) -> str:
    """A data card: what the corpus is made of, and how it is split."""
    return "\n".join([markdown(parts, title), markdown(splits, "Splits")])
