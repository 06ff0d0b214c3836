"""Sequential decisions that depend on earlier ones, settled in rounds: quotas in sequence, and schedules with deduplication.

Both operators give exactly what a process would that looks at one row after another. Each keeps, for every row, what is
certain whatever becomes of the rows that are still open, and settles all rows for which that is enough. The first open
row of the process is always settled, so rounds come to an end; as a rule a round settles most of what is open. Rows
travel by keys and numbers only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.near_dup import classes, near_pairs
from lodestone.operators.ordered import global_position, prefix_sum
from lodestone.sources.scratch import table


class QuotaShort(ValueError):
    """Buckets that end before their quota."""


def _adjacent(nodes: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """fp_class, near: classes of equal fingerprints of a scope within `distance` bits of each other, each also of itself; and the class of each."""
    firsts = table(classes(nodes.select("scope", "fp", F.col("place").alias("id")), ["scope"]), "classes")
    pairs = near_pairs(firsts.select("scope", "id", "fp"), distance, ["scope"])
    own = firsts.select(F.col("id").alias("fp_class"), F.col("id").alias("near"))
    both = pairs.select(F.col("a").alias("fp_class"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("fp_class"), F.col("a").alias("near"))).unionByName(own)
    return table(both, "adjacent"), firsts.select("scope", "fp", F.col("id").alias("fp_class"))


def settled_in_sequence(rows: DataFrame, quotas: DataFrame, distance: int) -> DataFrame:
    """Places of the rows that a process accepts which takes them by `place`.

    rows: place (unique), bucket, scope, fp, id; the places of a bucket lie together. quotas: bucket, quota; a bucket
    without a quota has none to fill. A row is accepted unless its bucket is full, an accepted row has its id, or an
    accepted row of its scope lies within `distance` bits. What a full bucket turns away blocks nobody.

    Rows of one bucket, scope, fingerprint and id share their fate with the first of them, which alone can be accepted;
    what such groups do to others goes by the least place of each id and each class of fingerprints, so copies make no
    pairs. A row is free where no open or accepted row that comes earlier has its id or lies near, and where the open
    and accepted rows before it leave room in its bucket; it is out where an accepted one does, or where those accepted
    before it fill the bucket."""
    nodes = table(rows.groupBy("bucket", "scope", "fp", "id").agg(F.min("place").alias("place")), "nodes")
    near, of_class = _adjacent(nodes, distance)
    room = quotas.select("bucket", "quota")
    alive = table(nodes.join(of_class, ["scope", "fp"]).join(room, "bucket").select("place", "bucket", "id", "fp_class", "quota", F.lit(False).alias("accepted")), "alive")
    done = F.when(F.col("accepted"), F.col("place"))
    while not alive.where("NOT accepted").isEmpty():
        by_class = alive.groupBy(F.col("fp_class").alias("near")).agg(F.min("place").alias("first"), F.min(done).alias("taken"))
        around = near.join(by_class, "near").groupBy("fp_class").agg(F.min("first").alias("near_first"), F.min("taken").alias("near_taken"))
        by_id = alive.groupBy("id").agg(F.min("place").alias("id_first"), F.min(done).alias("id_taken"))
        counted = prefix_sum(prefix_sum(alive, ["bucket"], "place", F.col("accepted").cast("long"), "before"), ["bucket"], "place", F.lit(1), "at_most")
        told = counted.join(around, "fp_class").join(by_id, "id")
        out = (F.coalesce("near_taken", "place") < F.col("place")) | (F.coalesce("id_taken", "place") < F.col("place")) | (F.col("before") >= F.col("quota"))
        free = (F.col("near_first") >= F.col("place")) & (F.col("id_first") >= F.col("place")) & (F.col("at_most") < F.col("quota"))
        alive = table(told.where(F.col("accepted") | ~out).select("place", "bucket", "id", "fp_class", "quota", (F.col("accepted") | free).alias("accepted")), "alive")
    return alive.select("place", "bucket", "quota")


def first_within_quotas(records: DataFrame, bucket: list[str], turn: list[str], quotas: DataFrame | int, scope: list[str], distance: int, id_col: str = "id", fp_col: str = "fp", allow_short: bool = False) -> DataFrame:
    """The records that fill the buckets one after another, in the order of `bucket` and, inside, of `turn`.

    Of equal turns the lesser id comes first. quotas: a number for every bucket, or a table of the bucket's columns and
    `quota`. Records without an id or a fingerprint are refused. Short buckets raise QuotaShort, unless they are allowed."""
    held = table(records.withColumn("_row", F.monotonically_increasing_id()), "records")  # made once; from here on only keys travel
    if held.where(F.col(id_col).isNull() | F.col(fp_col).isNull()).take(1):
        raise ValueError("records need an id and a fingerprint")
    keys = dict.fromkeys([*bucket, *turn, *scope, id_col, fp_col])
    placed = table(global_position(held.select("_row", *keys), [*bucket, *turn, id_col], "_place"), "places")
    named = F.to_json(F.struct(*bucket), {"ignoreNullFields": "false"})
    rows = placed.select(F.col("_place").alias("place"), named.alias("bucket"), F.to_json(F.struct(*scope), {"ignoreNullFields": "false"}).alias("scope"), F.col(fp_col).alias("fp"), F.col(id_col).cast("string").alias("id"))
    if isinstance(quotas, int):
        goals = rows.select("bucket").distinct().withColumn("quota", F.lit(quotas).cast("long"))
    else:
        goals = quotas.select(named.alias("bucket"), F.col("quota").cast("long").alias("quota"))
    goals = table(goals, "quotas")
    accepted = table(settled_in_sequence(rows, goals, distance), "accepted")
    if not allow_short:
        counts = accepted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        short = goals.join(counts, "bucket", "left").where(F.coalesce("n", F.lit(0)) < F.col("quota")).orderBy("bucket").take(20)
        if short:
            raise QuotaShort("; ".join(f"{r.bucket}: {r.n or 0} of {r.quota}" for r in short))
    chosen = placed.join(accepted.select(F.col("place").alias("_place")), "_place", "left_semi").select("_row")
    return held.join(chosen, "_row", "left_semi").drop("_row")


def coupled_schedule(docs: DataFrame, weights: DataFrame, ordinal: str = "doc_id") -> DataFrame:
    """The schedule of a builder that reads several sources at once and keeps the first copy of each text.

    docs: source, ordinal (unique in its source), key, n_tokens (positive); weights: source, weight (positive). The
    builder takes its next document from the source that has written least for its weight, of equal ones from the first
    by name, and passes over documents whose key it has accepted before, from whichever source. Adds `accepted` and
    `turn`: tokens that the source has written before over its weight. Ascending turn, source and ordinal is the order
    in which documents are read. A source without a weight raises an error; documents without a key, a source or an
    ordinal are never read and are left out.

    Which copy survives depends on the turns, and turns on what has survived: a copy's loss brings all later documents
    of its source forward. Sums of what is certainly written and of what can be written at most give each copy two
    turns between which its own lies. A copy is out once another one's latest turn comes before its earliest, and is
    accepted when no other is left. Only copies that stand in several sources take part; all others count in advance."""
    rows = docs.where(F.col("source").isNotNull() & F.col(ordinal).isNotNull() & F.col("key").isNotNull()).join(weights.select("source", F.col("weight").cast("double").alias("_weight")), "source", "left")
    rows = table(rows, "scheduled")
    if unknown := rows.where("_weight IS NULL OR _weight <= 0").select("source").distinct().orderBy("source").take(5):
        raise ValueError(f"sources without a weight: {', '.join(r.source for r in unknown)}")
    if rows.where(F.coalesce("n_tokens", F.lit(0)) <= 0).take(1):
        raise ValueError("documents must have tokens")
    # Of a source's own copies only the first can be accepted, whatever the others' turns are.
    own = rows.groupBy("source", "key").agg(F.min(ordinal).alias("_ordinal"), F.min_by("n_tokens", ordinal).alias("n_tokens"), F.first("_weight").alias("weight"))
    counted = table(own.join(own.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("contested")), "key"), "firsts")
    placed = prefix_sum(counted, ["source"], "_ordinal", F.when(F.col("contested"), 0).otherwise(F.col("n_tokens")), "sole")
    alive = table(placed.where("contested").select("source", "key", F.col("_ordinal").alias("ordinal"), "n_tokens", "weight", "sole", F.lit(False).alias("accepted")), "copies")
    while not alive.where("NOT accepted").isEmpty():
        least = prefix_sum(alive, ["source"], "ordinal", F.when(F.col("accepted"), F.col("n_tokens")).otherwise(0), "surely")
        both = prefix_sum(least, ["source"], "ordinal", F.col("n_tokens"), "at_most")
        turns = table(both.withColumns({"early": F.struct(((F.col("sole") + F.col("surely")) / F.col("weight")).alias("t"), "source"), "late": F.struct(((F.col("sole") + F.col("at_most")) / F.col("weight")).alias("t"), "source")}), "turns")
        # No copy is early after its own latest turn, so the least of all does where the least of the others is meant.
        left = table(turns.join(turns.groupBy("key").agg(F.min("late").alias("soonest")), "key").where("early <= soonest").select(*alive.columns), "left")
        alone = left.groupBy("key").agg((F.count(F.lit(1)) == 1).alias("alone"))
        alive = table(left.drop("accepted").join(alone, "key").withColumnRenamed("alone", "accepted").select(*alive.columns), "copies")
    kept = counted.where("NOT contested").select("source", F.col("_ordinal").alias(ordinal)).unionByName(alive.select("source", F.col("ordinal").alias(ordinal))).withColumn("accepted", F.lit(True))
    out = rows.drop("accepted").join(kept, ["source", ordinal], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    written = prefix_sum(out, ["source"], ordinal, F.when(F.col("accepted"), F.col("n_tokens")).otherwise(0), "_written")
    return written.withColumn("turn", F.col("_written") / F.col("_weight")).drop("_written", "_weight")
