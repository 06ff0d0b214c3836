"""Analytics over metric logs: a series of steps for each run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import place_in_group
from lodestone.sources.scratch import table


def ema(log: DataFrame, series: str, order: list[str], value: str, keep: float = 0.98) -> DataFrame:
    """The last exponential moving average of each series, seeded with its first value; a fold in order, bit for bit sequential.

    A series is one training run's log, bounded by its steps."""
    points = log.groupBy(series).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_p"))
    fold = F.aggregate(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), F.get("_p", 0)[value].cast("double"), lambda a, x: F.lit(keep) * a + F.lit(1.0 - keep) * x[value])
    return points.select(series, fold.alias("ema"), F.size("_p").cast("long").alias("n"))


def ema_spread(log: DataFrame, series: str, order: list[str], value: str, keep: float = 0.98, span: int = 1 << 12) -> DataFrame:
    """The same for series of any length, equal but for the last bits: a run of `span` points turns an average a into
    f a + s, whatever a is, so runs are folded by many tasks, and only their pairs (f, s) are gone through in order."""
    placed = place_in_group(log.select(series, *order, F.col(value).cast("double").alias("_value")), [series], order, "_place")
    points = placed.withColumn("_run", F.floor(F.col("_place") / span))
    runs = points.groupBy(series, "_run").agg(F.array_sort(F.collect_list(F.struct("_place", "_value"))).alias("_p"))
    start = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("s"))
    # The first point of all is the seed: it forgets what stands before it.
    first = lambda a, x: F.when(x["_place"] == 0, F.struct(F.lit(0.0).alias("f"), x["_value"].alias("s"))).otherwise(F.struct((F.lit(keep) * a["f"]).alias("f"), (F.lit(keep) * a["s"] + F.lit(1.0 - keep) * x["_value"]).alias("s")))
    folded = runs.select(series, "_run", F.aggregate("_p", start, first).alias("_a"), F.size("_p").alias("_n"))
    whole = folded.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("_run", "_a"))).alias("_r"), F.sum("_n").alias("n"))
    return whole.select(series, F.aggregate("_r", F.lit(0.0), lambda a, r: r["_a"]["f"] * a + r["_a"]["s"]).alias("ema"), "n")


def moving_average(log: DataFrame, series: str, order: list[str], value: str, width: int) -> DataFrame:
    """Mean of the last `width` values; fewer at the head."""
    return log.withColumn("moving_average", F.avg(value).over(Window.partitionBy(series).orderBy(*order).rowsBetween(1 - width, 0)))


def running_best(log: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    return log.withColumn("best", F.min(value).over(Window.partitionBy(series).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def first_last(log: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    key = F.struct(*order)
    return log.groupBy(series).agg(F.min_by(value, key).alias("first_value"), F.max_by(value, key).alias("last_value"), F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def last_validation(log: DataFrame, series: str, order: list[str], kind: str, value: str, final: str, prefix: str) -> DataFrame:
    """The last record of kind `final`, else the last whose kind begins with `prefix`."""
    key = F.struct(*order)
    return log.groupBy(series).agg(F.coalesce(F.max_by(F.when(F.col(kind) == final, F.col(value)), F.when(F.col(kind) == final, key)), F.max_by(F.when(F.col(kind).startswith(prefix), F.col(value)), F.when(F.col(kind).startswith(prefix), key))).alias("last_validation"))


def decimated(log: DataFrame, series: str, order: list[str], value: str, points: int = 1000) -> DataFrame:
    """At most `points` records of a series: of each of as many equal runs the one farthest from the run's mean."""
    rows = log.withColumn("_run", F.ntile(points).over(Window.partitionBy(series).orderBy(*order)))
    # Rounded, so that points equally far but for the last bits tie; of those the last in order counts.
    far = F.round(F.abs(F.col(value) - F.avg(value).over(Window.partitionBy(series, "_run"))), 9)
    best = rows.withColumn("_far", far).groupBy(series, "_run").agg(F.max(F.struct("_far", *order, value)).alias("b"))
    return best.select(series, *(F.col(f"b.{c}").alias(c) for c in (*order, value)))


def hull(points: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """points: (x, y, place). Those that can be the first of the farthest ones from any line: corners of the convex hull,
    and of the leftmost and the rightmost points the first in place; of equal points the first in place."""
    firsts: dict[tuple[int, int], int] = {}
    for x, y, place in points:
        firsts[x, y] = min(place, firsts.get((x, y), place))
    ordered = sorted((x, y, place) for (x, y), place in firsts.items())
    corners = set()
    for side in (ordered, ordered[::-1]):
        chain: list[tuple[int, int, int]] = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        corners |= set(chain)
    for x in (ordered[0][0], ordered[-1][0]):
        corners.add(min((p for p in ordered if p[0] == x), key=lambda p: p[2]))
    return sorted(corners, key=lambda p: p[2])


def largest_triangles(log: DataFrame, series: str, order: list[str], x: Column, y: Column, points: int = 1000, span: int = 1 << 16) -> DataFrame:
    """`points` records of each series that keep its shape, or all where it has no more: the first, the last, and of each
    equal run between them the one that makes the largest triangle with the one chosen before and the next run's mean;
    of equal ones the first. x, y: whole numbers, x never falling in the order. Adds place, from 0.

    What a run offers does not depend on what was chosen before it, but for a line: the largest triangle lies at a corner
    of the run's convex hull. So stretches of `span` points are cut down to hulls by many tasks, whatever a run's size, and
    only hulls are gone through in order. All of it is whole numbers, so no rounding decides."""
    if points < 3:
        raise ValueError("a series keeps three points at least")
    n_cols = [series, *order]
    placed = table(place_in_group(log.select(*n_cols, x.cast("long").alias("_x"), y.cast("long").alias("_y")), [series], order, "place"), "series")
    sizes = placed.groupBy(F.col(series).alias("_series")).agg(F.count(F.lit(1)).alias("_n"))
    rows = placed.join(sizes, F.col(series).eqNullSafe(F.col("_series"))).drop("_series")
    inner = F.floor((F.col("place") - 1) * F.lit(points - 2) / (F.col("_n") - 2)) + 1
    runs = rows.where(F.col("_n") > points).withColumn("_run", F.when(F.col("place") == 0, 0).when(F.col("place") == F.col("_n") - 1, points - 1).otherwise(inner).cast("long"))
    means = runs.groupBy(series, "_run").agg(F.sum("_x").cast("decimal(38,0)").alias("sx"), F.sum("_y").cast("decimal(38,0)").alias("sy"), F.count(F.lit(1)).alias("n"))

    def corners(some: pd.DataFrame) -> pd.DataFrame:
        """The hulls of the runs, or parts of runs, in a stretch of a series."""
        by: dict[int, list] = {}
        for run, *p in zip(*(some[c].tolist() for c in ("_run", "_x", "_y", "place")), strict=True):
            by.setdefault(run, []).append(tuple(p))
        held = [(run, *p) for run, points in by.items() for p in hull(points)]
        out = pd.DataFrame(held, columns=["_run", "_x", "_y", "place"])
        out.insert(0, series, some[series].iloc[0])
        return out

    kind = log.schema[series].dataType.simpleString()
    schema = f"`{series}` {kind}, _run long, _x long, _y long, place long"
    # A run of several stretches has several hulls, whose points together hold every corner of its own.
    hulls = runs.select(series, "_run", "_x", "_y", "place").groupBy(series, F.floor(F.col("place") / span)).applyInPandas(corners, schema)

    def fold(some: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list] = {}
        for run, px, py, place, sx, sy, n in zip(*(some[c] for c in ("_run", "_x", "_y", "place", "sx", "sy", "n")), strict=True):
            by.setdefault(int(run), []).append((int(px), int(py), int(place), int(sx), int(sy), int(n)))
        ax, ay, at = by[0][0][:3]
        chosen = [at]
        for run in range(1, points - 1):
            _, _, _, sx, sy, n = by[run + 1][0]
            ax, ay, at = max(((px, py, place) for px, py, place, *_ in by[run]), key=lambda p: (abs((ax * n - sx) * (p[1] - ay) - (ax - p[0]) * (sy - ay * n)), -p[2]))  # noqa: B023
            chosen.append(at)
        chosen.append(by[points - 1][0][2])
        return pd.DataFrame({series: [some[series].iloc[0]] * len(chosen), "place": chosen})

    told = hulls.join(means.withColumnsRenamed({series: "_series", "_run": "_of"}), F.col(series).eqNullSafe(F.col("_series")) & (F.col("_run") == F.col("_of"))).drop("_series", "_of")
    chosen = told.groupBy(series).applyInPandas(fold, f"`{series}` {kind}, place long").select(F.col(series).alias("_series"), F.col("place").alias("_place"))
    kept = rows.join(chosen, F.col(series).eqNullSafe(F.col("_series")) & (F.col("place") == F.col("_place")), "left_semi")
    return rows.where(F.col("_n") <= points).unionByName(kept).select(*n_cols, "place")
