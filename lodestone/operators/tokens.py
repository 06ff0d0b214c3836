"""Packed token corpora: offsets, range reads, training batches, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import global_position, prefix_sum

#: Rows of a list of shard files that is broadcast, at most.
BROADCAST_SHARDS = 200_000


class CorpusExhausted(ValueError):
    """A read went beyond the last token."""


def shard_offsets(shards: DataFrame) -> DataFrame:
    """shards: path, tokens (one row for each file). Adds start and end in the global stream, in path order."""
    placed = global_position(shards, ["path"], "_file")
    return prefix_sum(placed.withColumn("_all", F.lit(0)), ["_all"], "_file", F.col("tokens"), "start").withColumn("end", F.col("start") + F.col("tokens")).drop("_all", "_file")


def locate(positions: DataFrame, offsets: DataFrame) -> DataFrame:
    """positions: pos. The shard of each and the offset inside it, by a range join.

    A list of at most `BROADCAST_SHARDS` files is broadcast. A longer one is dealt into stretches of the stream, in which
    positions meet the shards that reach into them."""
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    out = [*positions.columns, "path", (F.col("pos") - F.col("start")).alias("offset")]
    if offsets.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS:
        return positions.join(F.broadcast(offsets), inside).select(*out)
    longest = max(1, offsets.agg(F.max(F.col("end") - F.col("start"))).first()[0])
    spread = offsets.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("start") / longest), F.floor((F.col("end") - 1) / longest))))
    return positions.withColumn("_stretch", F.floor(F.col("pos") / longest)).join(spread, "_stretch").where(inside).select(*out)


def overlapping(windows: DataFrame, offsets: DataFrame, length: int) -> DataFrame:
    """windows: window, start. A row for each shard that holds some of the `length` tokens from there: window, path, place
    (in the window), offset (in the shard) and n tokens. Joined like `locate`."""
    begin, end = F.greatest(F.col("_from"), F.col("start")), F.least(F.col("_from") + length, F.col("end"))
    asked = windows.select("window", F.col("start").cast("long").alias("_from"))
    meets = (F.col("_from") < F.col("end")) & (F.col("_from") + length > F.col("start"))
    out = ["window", "path", (begin - F.col("_from")).alias("place"), (begin - F.col("start")).alias("offset"), (end - begin).alias("n")]
    if offsets.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS:
        return asked.join(F.broadcast(offsets), meets).select(*out)
    longest = max(1, offsets.agg(F.max(F.col("end") - F.col("start"))).first()[0])

    def stretches(first, last) -> Column:
        return F.explode(F.sequence(F.floor(first / longest), F.floor(last / longest)))

    spread = offsets.withColumn("_stretch", stretches(F.col("start"), F.col("end") - 1))
    met = asked.withColumn("_stretch", stretches(F.col("_from"), F.col("_from") + length - 1)).join(spread, "_stretch").where(meets)
    # A window and a shard may share several stretches; the one where their common part begins counts.
    return met.where(F.col("_stretch") == F.floor(begin / longest)).select(*out)


def read_range(shards: DataFrame, start: int, count: int) -> DataFrame:
    """shards: path, tokens, values (array<int>). The tokens start .. start + count - 1 as rows of pos and token."""
    total = shards.agg(F.sum("tokens")).first()[0] or 0
    if start < 0 or start + count > total:
        raise CorpusExhausted(f"{start} + {count} tokens of {total}")
    rows = shard_offsets(shards).where((F.col("start") < start + count) & (F.col("end") > start))
    cut = F.slice("values", F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int") + 1, (F.least(F.col("end"), F.lit(start + count)) - F.greatest(F.col("start"), F.lit(start))).cast("int"))
    return rows.select(F.greatest(F.col("start"), F.lit(start)).alias("_from"), F.posexplode(cut).alias("_i", "token")).select((F.col("_from") + F.col("_i")).alias("pos"), "token")


def training_rows(stream: DataFrame, length: int) -> DataFrame:
    """stream: pos, token. Rows of `length` inputs and the targets one further; a remainder is left out."""
    blocks = stream.groupBy(F.floor(F.col("pos") / (length + 1)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    values = F.transform("t", lambda x: x["token"])
    return blocks.where(F.size("t") == length + 1).select("block", F.slice(values, 1, length).alias("inputs"), F.slice(values, 2, length).alias("targets"))


def rank_slices(blocks: DataFrame, world: int, per_step: int) -> DataFrame:
    """Blocks dealt to ranks: each step gives each rank `per_step` consecutive blocks."""
    group = F.floor(F.col("block") / per_step)
    return blocks.withColumns({"rank": (group % world).cast("int"), "step": F.floor(group / world).cast("long")})


def corpus_fingerprint(shards: DataFrame) -> DataFrame:
    """One hash over all names and sizes in order; names are gathered, not data (a gigabyte for ten million files)."""
    lines = F.array_sort(F.collect_list(F.concat("path", F.lit(":"), F.col("tokens").cast("string"))))
    return shards.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("shards"), F.sum("tokens").alias("tokens"), F.min("path").alias("first"), F.max("path").alias("last"))


def random_windows(spark: SparkSession, total: int, windows: int, length: int, seed: int) -> DataFrame:
    """window, start: reproducible windows of a stream of `total` tokens; the start is the first 48 bits of a SHA-256 of
    seed and window, over the places that there are."""
    sha = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    return spark.range(windows).select(F.col("id").alias("window"), (F.conv(F.substring(sha, 1, 12), 16, 10).cast("long") % max(1, total - length)).alias("start"))


def token_range(stream: DataFrame, vocabulary: int) -> DataFrame:
    return stream.agg(F.min("token").alias("least"), F.max("token").alias("most"), (F.max("token") < vocabulary).alias("within"))
