"""Helpers that the operators of this subpackage share: words, row keys and written tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that are neither digits nor letters: word separators of `ascii_words`.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: White space of the contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def ascii_words(text: Column) -> Column:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text as an array; null and empty texts have none.

    One pass of `translate` lower-cases A-Z and turns every separator into a blank, so that splitting needs no
    regular expression."""
    flat = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS))
    return F.array_remove(F.split(flat, " "), "")


def text_hash(text: Column) -> Column:
    """Tells texts of one identifier apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def rolling_hashes(hashes: Column, k: int) -> Column:
    """64-bit hashes of all k consecutive elements of an array of word hashes; element i starts at word i."""
    n = F.size(hashes)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for an operator's own columns that no column of the frame has, in whichever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; where it is unset, one beside the warehouse's
    tables, which is shared wherever tables are. A folder of one machine is refused where there are several."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/lodestone-scratch"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        scheme = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
        if scheme == "file" and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"name a folder that all executors share in spark.checkpoint.dir; {folder} is one of this machine")
        spark.sparkContext.setCheckpointDir(folder)
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended, and its folder with it
        pass


def written(df: DataFrame, name: str, codec: str = "zstd", group_rows: int | None = None) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and any executor can read it again.

    group_rows: rows of a row group at most, for rows of megabytes, since readers and writers hold a group at a time.
    Tables are deleted when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of `written` that nothing will read again."""
    _forget(df.sparkSession, df.written_path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are no longer referenced; a hint, results never depend on it."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A file of fewer bytes may be one row group, which one task reads; if it is the whole table, its rows are dealt out.
SPREAD_BYTES = 64 << 20


def spread_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet table, over all cores; one of some files or some size is read by many tasks anyway, and is not shuffled."""
    rows = spark.read.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    about = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where)
    return rows.repartition(spark.sparkContext.defaultParallelism) if about.getFileCount() <= 1 and about.getLength() < SPREAD_BYTES else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, f"{sf_dir}/documents.parquet")
