"""Ordered computations that stay distributed: prefix sums by an explicit ordinal, and global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import table

#: Ordinals that share a bucket of a prefix sum.
SPAN = 1 << 16


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which missing keys match each other; the keys are those of the left side."""
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return left.join(right.withColumnsRenamed({c: f"_of_{c}" for c in keys}), match, how).drop(*(f"_of_{c}" for c in keys))


def prefix_sum(df: DataFrame, by: list[str], ordinal: str, value: Column, name: str = "before", span: int = SPAN) -> DataFrame:
    """Adds the sum of `value` over earlier rows of the group (`ordinal`: unique bigint within the group).

    Sums of buckets of ordinals come first, then running sums inside each bucket, so a group that holds most rows is
    still summed by many tasks."""
    rows = df.withColumns({"_value": value, "_bucket": F.floor(F.col(ordinal) / span).cast("long")})
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    match = F.col("_bucket") == F.col("_of")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(offsets, match)
    return out.withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).drop("_value", "_bucket", "_of", "_offset", "_inside", *(f"_by_{c}" for c in by))


def global_position(df: DataFrame, order: list, name: str = "position", partitions: int | None = None) -> DataFrame:
    """Adds each row's place, from 0, in a total order: range partitions are sorted apart and counted."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_global_part": F.spark_partition_id(), "_global_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    held = table(ranged, "ranged")  # the bounds of ranges are sampled: rows and counts must come from one run
    counts = held.groupBy("_global_part").agg(F.count(F.lit(1)).alias("_global_n"))
    before = Window.orderBy("_global_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = counts.select("_global_part", F.coalesce(F.sum("_global_n").over(before), F.lit(0)).alias("_global_start"))
    return held.join(F.broadcast(starts), "_global_part").withColumn(name, (F.col("_global_start") + F.col("_global_at")).cast("long")).drop("_global_part", "_global_at", "_global_start")


def place_in_group(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each row's place, from 0, within its group: its global position less the group's first. No task holds a group."""
    placed = table(global_position(df, [*by, *order], name), "placed")
    first = placed.groupBy(*(F.col(c).alias(f"_group_by_{c}") for c in by)).agg(F.min(name).alias("_group_first"))
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_group_by_{c}"))
    return placed.join(first, match).withColumn(name, F.col(name) - F.col("_group_first")).drop("_group_first", *(f"_group_by_{c}" for c in by))
