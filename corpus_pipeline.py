"""A training-data pipeline over `documents`: toxicity, near-duplicates, decontamination, mixture, shards.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; all but the last have
the columns of `documents`. `run` writes each stage's result to the shared folder and reads it again.

Verdicts name a row by its identifier and a hash of its text, both of which may be missing: rows that share an
identifier but not the text have verdicts of their own, and rows without an identifier have theirs. Equal rows share
their verdicts; of a group of near-duplicates, equal rows included, one row stays. Texts of any length pass whole. Rows
that tie are told apart by text hash where a stage must choose. Null and empty texts are near-duplicates of one
another. An empty table passes all stages. Columns beyond those of `documents` are kept, whatever they are called, but
for those that the last stage's results replace (size, text_crc32, law, shard, slot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, mixing, sharding, simhash, toxicity
from lodestone.llm.common import documents, fresh, text_hash, written

#: Near-duplicates: shingles of five words, a Jaccard similarity of 0.8 or more. Two such sets have a cosine of 0.889,
#: so 512 bits differ in 78 places on average (standard deviation 8), in 96 for 4 of 5 shingles; unrelated texts differ
#: in 256. Pairs within the radius that meet in a shard are candidates, whose sets are compared.
SHINGLE, SIMILARITY, FINGERPRINT_WORDS, RADIUS = 5, 0.8, 8, 136
#: The mixture takes this share of all words, each document once at most.
SHARE = 0.9
SHARDS = 40
#: Verdicts (a pair of numbers and a mark each) that are broadcast, at most.
BROADCAST_VERDICTS = 2_000_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity grade is probably above 0 go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (severity,) = fresh(docs, "severity")
    return docs.withColumn(severity, toxicity.severity(model, F.col("text"))).where(F.col(f"{severity}.p_toxic") < 0.5).drop(severity)


def _judged(docs: DataFrame, verdicts: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with the verdicts (doc_id, text_hash and `columns`, each pair once) that name them, nulls where none does.

    At most `BROADCAST_VERDICTS` verdicts are broadcast, so texts stay where they are; more are joined by a shuffle."""
    doc, sha = fresh(docs, "v_doc", "v_text")
    wanted = verdicts.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(sha), *columns)
    if verdicts.limit(BROADCAST_VERDICTS + 1).count() <= BROADCAST_VERDICTS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs.doc_id.eqNullSafe(F.col(doc)) & (text_hash(docs.text) == F.col(sha)), "left").drop(doc, sha)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest identifier (rows without one come last)."""
    groups = simhash.near_duplicates(docs, k=SHINGLE, radius=RADIUS, words=FINGERPRINT_WORDS, min_similarity=SIMILARITY)
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    rows = written(groups.select("component", "doc_id", "text_hash", row.alias("row")), "groups")
    first = rows.groupBy("component").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # Written, so that the join shuffles both sides anew and Spark can split the rows of a large group.
    first = written(first, "first")
    (state,) = fresh(docs, "state")
    stays = F.max(F.col("row") == F.col("first"))
    # Of equal rows, which share a name, one stays.
    named = rows.join(first, "component").groupBy("doc_id", "text_hash").agg(F.when(~stays, "goes").when(F.count(F.lit(1)) > 1, "repeated").otherwise("stays").alias(state))
    judged = _judged(docs, written(named.where(F.col(state) != "stays"), "verdicts"), [state])
    alone = judged.where(F.col(state).isNull()).drop(state)
    doc, sha = fresh(docs, "d_doc", "d_text")
    repeated = judged.where(F.col(state) == "repeated").drop(state)
    return alone.unionByName(repeated.withColumns({doc: F.col("doc_id"), sha: text_hash(F.col("text"))}).dropDuplicates([doc, sha]).drop(doc, sha))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    (hit,) = fresh(docs, "hit")
    hits = written(found.where("n_hit > 0").select("doc_id", "text_hash").distinct().withColumn(hit, F.lit(True)), "contaminated")
    return _judged(docs, hits, [hit]).where(F.col(hit).isNull()).drop(hit)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The target mixture of nine tenths of all words."""
    names = fresh(docs, "domain", "n_tokens", "copies")
    mixed = mixing.mix(docs, mixing.source_domain(F.col("source")), mixing.WEIGHTS, share=SHARE, max_epochs=1, names=names)
    return mixed.where(F.col(names[2]) > 0).drop(*names)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; the largest shard is as small as it can be."""
    return sharding.assign_shards(docs, SHARDS).drop("text_sha", "grown_shard")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: No SQL: regression, fingerprints, seeded hashes and the minimax search are beyond it; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
