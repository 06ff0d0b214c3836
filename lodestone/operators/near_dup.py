"""Near-duplicates by 64-bit SimHash: candidate pairs by composite keys, the greedy sequential verdict, the audit's sample."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import band_values, hamming, in_fraction
from lodestone.operators.ordered import null_safe_join, place_in_group
from lodestone.sources.scratch import table

#: Blocks of bits that agree in a candidate pair, at least; a key joins so many.
AGREEING = 3


def agreeing_keys(fingerprint: Column, distance: int, agreeing: int = AGREEING) -> Column:
    """array<struct<key, value>>: the bits of every choice of `agreeing` blocks out of distance + agreeing.

    Two fingerprints within the distance differ in `distance` blocks at most, so some choice agrees. A value has about
    64 * agreeing / (distance + agreeing) bits: 32 at distance 3, so chance agreement stays rare among billions."""
    n = distance + agreeing
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def signed(x: int) -> int:
        return x - 2**64 if x >= 2**63 else x

    return F.array(*(F.struct(F.lit(i).alias("key"), fingerprint.bitwiseAND(F.lit(signed(sum(masks[j] for j in chosen))).cast("long")).alias("value")) for i, chosen in enumerate(combinations(range(n), agreeing))))


def near_pairs(prints: DataFrame, distance: int, scope: list[str] | None = None) -> DataFrame:
    """prints: id, fp and the columns of `scope`, with few copies of each fp (see `classes`). a < b of the scope within `distance` bits."""
    scope = scope or []
    # A number of partitions is named, since Spark would put many into one task by their bytes before rows meet.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select(*scope, "id", "fp", F.inline(agreeing_keys(F.col("fp"), distance))).repartition(tasks, *scope, "key", "value")
    a, b = (rows.select(*scope, F.col("id").alias(i), F.col("fp").alias(f), "key", "value") for i, f in (("a", "fa"), ("b", "fb")))
    near = (F.col("a") < F.col("b")) & (hamming(F.col("fa"), F.col("fb")) <= distance)
    return a.join(b, [*scope, "key", "value"]).where(near).select(*scope, "a", "b").distinct()


def classes(prints: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Equal fingerprints as one row: fp, id (the smallest) and n. Pairs are sought between classes, never inside one."""
    return prints.groupBy(*(scope or []), "fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def greedy_accepted(prints: DataFrame, distance: int, scope: list[str] | None = None) -> DataFrame:
    """id, accepted: a row is accepted if no accepted row of its scope and of smaller id lies within `distance` bits. Ids are unique.

    The verdicts of the sequential process are those of the lexicographically first maximal independent set, found
    in rounds: what only has rejected earlier neighbours is accepted, what has an accepted one is rejected. Only the
    first row of a class can be accepted, so only classes take part."""
    scope = scope or []
    firsts = table(classes(prints, scope), "classes")
    edges = table(near_pairs(firsts.select(*scope, "id", "fp"), distance, scope).select(F.col("a").alias("early"), F.col("b").alias("late")), "pairs")
    verdict = table(firsts.select("id").join(edges.select(F.col("late").alias("id")), "id", "left_anti").withColumn("accepted", F.lit(True)), "verdicts")
    left = edges
    while not left.isEmpty():
        known = verdict.select(F.col("id").alias("early"), "accepted")
        seen = left.join(known, "early", "left")
        state = seen.groupBy(F.col("late").alias("id")).agg(F.max(F.coalesce("accepted", F.lit(False))).alias("hit"), F.min(F.col("accepted").isNotNull()).alias("all_known"))
        new = table(state.where("hit OR all_known").select("id", (~F.col("hit")).alias("accepted")), "round")
        verdict = table(verdict.unionByName(new), "verdicts")
        left = table(left.join(new.select(F.col("id").alias("late")), "late", "left_anti"), "left")
    return prints.select("id").join(verdict, "id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def audit_sample(docs: DataFrame, fingerprint: Column, rate: float, most: int, distance: int, recent: int = 64) -> DataFrame:
    """The audit's estimate by source: of a deterministic sample (first `most` rows) how many lie near one of the
    `recent` last sampled rows that share a band.

    Places within sources and bands are ranges of global positions; a row meets the rows of its band in its own
    stretch of `recent` places and the one before, whichever share of all rows the band has."""
    chosen = table(docs.where(in_fraction(F.col("text"), rate)).select("source", "doc_id", fingerprint.alias("fp")), "sample")
    rows = table(place_in_group(chosen, ["source"], ["doc_id"], "_n").where(F.col("_n") < most).drop("_n"), "sample")
    banded = place_in_group(rows.select("source", "doc_id", "fp", F.inline(band_values(F.col("fp")))), ["source", "band", "value"], ["doc_id"], "rank")
    banded = table(banded.withColumn("stretch", F.floor(F.col("rank") / recent)), "bands")
    a = banded.select("source", "band", "value", F.explode(F.array("stretch", F.col("stretch") + 1)).alias("stretch"), F.col("fp").alias("fa"), F.col("rank").alias("ra"))
    near = (F.col("rank") - F.col("ra")).between(1, recent) & (hamming(F.col("fp"), F.col("fa")) <= distance)
    hits = null_safe_join(banded, a, ["source", "band", "value", "stretch"], "inner").where(near).select("source", "doc_id").distinct().withColumn("near", F.lit(1))
    return null_safe_join(rows, hits, ["source", "doc_id"], "left").groupBy("source").agg(F.count(F.lit(1)).alias("sampled"), F.count("near").alias("near_duplicates")).withColumn("fraction", F.col("near_duplicates") / F.col("sampled"))
