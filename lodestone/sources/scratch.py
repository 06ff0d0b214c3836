"""Tables written to the folder that a cluster shares, so that lineage ends there."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder beside the warehouse's tables, which is shared
    wherever tables are. A folder of one machine is refused where there are several."""
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


#: Bytes of rows that Spark sends to a Python worker at a time. Its own bound counts rows (10,000), so that what a worker
#: holds would follow how long texts are and how many lie in a file.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds batches for Python by bytes, unless the session has a lower bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended, and its folder with it
        pass


def table(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in that folder; it is deleted when the driver's Python ends."""
    path = f"{scratch_dir(df.sparkSession)}/core-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
