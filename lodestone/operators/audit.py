"""Capacity audit, statistics, allocation and planning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import whitespace_tokens
from lodestone.operators.corpus import MIN_CHARS, measured
from lodestone.operators.ordered import null_safe_join


def capacity_audit(docs: DataFrame, longest: int = 16384, tokens: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """One row for each source: what was read, accepted, short or duplicate, characters, and tokens before and after cutting.

    tokens: how many a text has, its end not included."""
    slim = measured(docs, ["source", "doc_id"], tokens)
    firsts = slim.where(F.col("chars") >= MIN_CHARS).groupBy("source", "key").agg(F.min("doc_id").alias("_first"))
    state = null_safe_join(slim, firsts, ["source", "key"], "left")
    good = (F.col("chars") >= MIN_CHARS) & (F.col("doc_id") == F.col("_first"))
    kept = F.least(F.col("n_tokens"), F.lit(longest))
    out = state.groupBy("source").agg(
        F.count(F.lit(1)).alias("emitted"), F.count_if(good).alias("accepted"), F.count_if(F.col("chars") < MIN_CHARS).alias("short"), F.count_if((F.col("chars") >= MIN_CHARS) & (F.col("doc_id") != F.col("_first"))).alias("duplicate"),
        F.count_if(good & (F.col("n_tokens") > longest)).alias("truncated"), F.coalesce(F.sum(F.when(good, F.col("chars"))), F.lit(0)).alias("characters"),
        F.coalesce(F.sum(F.when(good, F.col("n_tokens"))), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum(F.when(good, kept)), F.lit(0)).alias("tokens_after"),
    )
    return out.withColumns({"duplicate_fraction": F.round(F.try_divide(F.col("duplicate"), F.col("accepted") + F.col("duplicate")), 9), "tokens_per_document": F.round(F.try_divide(F.col("tokens_after"), F.col("accepted")), 6)})


def cap_and_fill(sources: DataFrame, total: int) -> DataFrame:
    """sources: pos (order), source, weight, finite, usable (tokens, for finite ones), fill (share of the shortfall or null).

    Caps are rounded half to even; finite sources give what they have; the shortfall goes to the fill sources by
    share, the last of which takes the remainder, and a residue of rounding goes to the first. A handful of rows."""
    all_rows = Window.partitionBy()
    cap = F.bround(F.lit(float(total)) * F.col("weight")).cast("long")
    rows = sources.withColumn("cap", cap).withColumn("base", F.when(F.col("finite"), F.least(F.col("cap"), F.col("usable"))).otherwise(F.col("cap")))
    rows = rows.withColumn("shortfall", F.sum(F.col("cap") - F.col("base")).over(all_rows))
    by_fill = Window.partitionBy(F.col("fill").isNotNull()).orderBy("pos")
    place, count = F.row_number().over(by_fill), F.count(F.lit(1)).over(Window.partitionBy(F.col("fill").isNotNull()))
    rounded = F.bround(F.col("shortfall") * F.col("fill")).cast("long")
    rows = rows.withColumns({"_place": place, "_count": count, "_rounded": rounded})
    earlier = F.coalesce(F.sum("_rounded").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.when(F.col("fill").isNull(), 0).when(F.col("_place") == F.col("_count"), F.col("shortfall") - earlier).otherwise(F.col("_rounded"))
    rows = rows.withColumn("allocation", F.col("base") + extra)
    residue = F.lit(total) - F.sum("allocation").over(all_rows)
    first = F.col("fill").isNotNull() & (F.col("_place") == 1)
    rows = rows.withColumn("allocation", F.col("allocation") + F.when(first, residue).otherwise(0))
    return rows.withColumn("fraction", F.col("allocation") / F.lit(total)).select("pos", "source", "finite", "cap", "usable", "shortfall", "allocation", "fraction")


def mixture_targets(parts: DataFrame, total: int, rest: str) -> DataFrame:
    """parts: source, share. Shares are normalized, targets rounded down, and `rest` takes what is left."""
    share = F.col("share") / F.sum("share").over(Window.partitionBy())
    rows = parts.withColumn("_t", F.floor(F.lit(float(total)) * share).cast("long"))
    left = F.lit(total) - F.sum("_t").over(Window.partitionBy())
    return rows.withColumn("target", (F.col("_t") + F.when(F.col("source") == rest, left).otherwise(0)).cast("long")).drop("_t")


def length_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, median (mean of the middle two), p95, p99 and max by group.

    Values are counted first, so what a group gathers is bounded by the number of distinct lengths, not of rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*by))})

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_upto") > index, F.col(value)))

    n = F.col("_all")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0
    return rows.groupBy(*by).agg(F.min(value).alias("least"), middle.alias("median"), at(F.floor(F.lit(0.95) * (n - 1))).alias("p95"), at(F.floor(F.lit(0.99) * (n - 1))).alias("p99"), F.max(value).alias("most"), F.max("_all").alias("n"))


def iso_flop_spread(runs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(max - min) / mean of the training costs of each tier, and whether it is within the tolerance."""
    cost = F.lit(6.0) * F.col("parameters") * F.col("tokens")
    out = runs.groupBy("tier").agg(((F.max(cost) - F.min(cost)) / F.avg(cost)).alias("spread"), F.count(F.lit(1)).alias("runs"))
    return out.withColumn("within", F.col("spread") <= tolerance)


def best_runs(runs: DataFrame) -> DataFrame:
    """The run of least loss in each tier; of equal ones the first by name."""
    return runs.groupBy("tier").agg(F.min(F.struct("loss", "run")).alias("b")).select("tier", F.col("b.run").alias("run"), F.col("b.loss").alias("loss"))


def scaling_fit(runs: DataFrame, grid: int = 24) -> DataFrame:
    """L = E + A N^-alpha + B D^-beta over (parameters, tokens, loss) of finished runs, by variable projection: the
    exponents are sought on a grid that is refined around its best point, the three factors follow by least squares.

    Runs are few (a row for each training run), so one task fits them."""

    def fit(rows):
        import numpy as np
        import pandas as pd

        n, d, y = (rows[c].to_numpy(float) for c in ("parameters", "tokens", "loss"))

        def solve(a: float, b: float):
            x = np.stack([np.ones_like(y), (n / 1e6) ** -a, (d / 1e6) ** -b], axis=1)
            free = [0, 1, 2]
            while True:  # factors are not negative: drop what would be
                c = np.zeros(3)
                c[free] = np.linalg.lstsq(x[:, free], y, rcond=None)[0]
                if (c >= 0).all() or len(free) == 1:
                    break
                free.remove(min(free, key=lambda i: c[i]))
            return float(np.sqrt(np.mean((x @ c - y) ** 2))), c

        low, high = np.array([0.01, 0.01]), np.array([2.0, 2.0])
        best = None
        for _ in range(8):
            for a in np.linspace(low[0], high[0], grid):
                for b in np.linspace(low[1], high[1], grid):
                    rmse, c = solve(a, b)
                    if best is None or rmse < best[0]:
                        best = (rmse, c, a, b)
            width = (high - low) / 6
            low, high = np.maximum([best[2], best[3]] - width, 0.01), np.minimum([best[2], best[3]] + width, 2.0)
        rmse, c, a, b = best
        spread = float(np.sum((y - y.mean()) ** 2))
        return pd.DataFrame({"E": [c[0]], "A": [c[1] * 1e6**a], "alpha": [a], "B": [c[2] * 1e6**b], "beta": [b], "rmse": [rmse], "r2": [1 - rmse**2 * len(y) / spread if spread else 1.0], "runs": [len(y)]})

    return runs.select("parameters", "tokens", "loss", F.lit(1).alias("all")).dropna().groupBy("all").applyInPandas(fit, "E double, A double, alpha double, B double, beta double, rmse double, r2 double, runs long")


#: Published runs of the scaling study: run, family, tier, parameters, tokens seen, final general loss. Fixed values.
STUDY_RUNS = [
    ("m13_low_120m", "m13", "low", 12913920, 120012800, 3.753549424931407),
    ("m13_medium_230m", "m13", "medium", 12913920, 230014976, 3.3647325409110636),
    ("m13_high_460m", "m13", "high", 12913920, 460013568, 3.0837205993011594),
    ("m30_low_50m", "m30", "low", 29990784, 50003968, 4.098571785725653),
    ("m30_medium_100m", "m30", "medium", 29990784, 100007936, 3.4811212439090014),
    ("m30_high_200m", "m30", "high", 29990784, 200015872, 3.105861349031329),
    ("m60_low_25m", "m60", "low", 60439040, 25001984, 4.239541466115043),
    ("m60_medium_50m", "m60", "medium", 60439040, 50003968, 3.807208606507629),
    ("m60_high_100m", "m60", "high", 60439040, 100007936, 3.362825159681961),
]


def study_runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STUDY_RUNS, "run string, family string, tier string, parameters long, tokens long, loss double")


def status_table(targets: DataFrame, written: DataFrame) -> DataFrame:
    """Tokens of each source against its target."""
    both = targets.join(written, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return both.select("source", "tokens", "target", F.least(F.lit(1.0), F.col("tokens") / F.col("target")).alias("fraction"), (F.col("tokens") >= F.col("target")).alias("complete"))


def approval_differences(audited: DataFrame, approved: DataFrame) -> DataFrame:
    """Sources whose audited and approved allocations differ, or that only one side has."""
    a, b = audited.select("source", F.col("allocation").alias("audited")), approved.select("source", F.col("allocation").alias("approved"))
    return a.join(b, "source", "full_outer").where(~F.col("audited").eqNullSafe(F.col("approved")))


class MissingReport(ValueError):
    """A finite source has no complete audit report of this configuration."""


def merge_reports(config: DataFrame, reports: DataFrame, config_sha: str) -> DataFrame:
    """config: pos, source, weight, finite, fill; reports: source, status, config_sha, usable. The rows that
    `cap_and_fill` takes; a finite source without a complete report of the same configuration is an error."""
    mine = reports.where((F.col("status") == "complete") & (F.col("config_sha") == config_sha)).select("source", "usable")
    lacking = [r.source for r in config.where("finite").join(mine, "source", "left_anti").orderBy("pos").select("source").collect()]  # a row for each source
    if lacking:
        raise MissingReport(", ".join(lacking))
    if abs((config.agg(F.sum("fill")).first()[0] or 0) - 1) > 1e-9:
        raise ValueError("shares of the shortfall must sum to 1")
    return config.join(F.broadcast(mine), "source", "left").withColumn("usable", F.when(F.col("finite"), F.col("usable")))  # a row for each source
