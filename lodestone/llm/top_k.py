"""Exact top-k search (operator 13): blocks of vectors in the order of their bounds, until a bound falls below the k-th score.

A vector is a document whose terms are its components, and a query's weight for a term is its own component. Candidates
are put into an order in which like vectors are neighbours (the nearest of a bounded number of pivots, then identifier)
and cut into ranges of blocks. A block holds a forward index (the components of its documents) and each term's greatest
and least component. A block's bound for a query is the sum over terms of weight times greatest component, or least for
a negative weight: no document of the block scores higher.

Blocks lie in partitions of bounded size, whose bounds are those of all their blocks together. A query first visits
the partition with its highest bound and learns a k-th score there. Then it is sent to those other partitions only whose
bound reaches that score. In a partition a query takes its blocks by falling bound and stops at the first one below its
k-th score; queries that want the same block are scored by one matrix product. A bound that equals the k-th score is
still visited, since a smaller identifier wins a tie.

Queries are dealt to groups and the blocks of a partition are copied once for each group, so a task holds one partition
and one group, whatever the table's size. Scores are exact: products run in float64 where all partial sums stay below
2^53, else in int64. Nothing is dropped: bounds only skip blocks that can't hold a result. How much they skip is a matter
of the data: vectors without any structure in many dimensions have bounds far above all scores, and every block is read.

Vectors that are null, empty, hold null or non-finite components or have another length than most take no part, nor do
rows without an identifier, which no result could name. A candidate with the query's identifier is the query's own
row. Repeated rows are candidates of their own, equal in score and identifier; a query that occurs twice is asked
once, and of unlike queries of one identifier the lesser vector is asked. Equal scores are ordered by identifier.
Empty tables give no rows. Other columns are not read, whatever they are called. Texts play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import spread_table, written
from lodestone.llm.vectors import integer_vectors, matrix

#: Documents of a block; documents of a partition, and queries of a group, that a task holds at once.
BLOCK_DOCS, PART_DOCS, GROUP_QUERIES = 256, 131_072, 8_192
#: Vectors by which candidates are ordered.
PIVOTS = 64
#: Bytes of the partitions' bounds that are broadcast; above that queries visit all partitions.
BROADCAST_BOUNDS = 32 << 20
LOWEST = -(2**62)


class Block:
    """A range of documents: identifiers (ascending), forward index, and each component's least and greatest value."""

    def __init__(self, ids: np.ndarray, forward: np.ndarray):
        self.ids, self.forward, self.low, self.high = ids, forward, forward.min(axis=0), forward.max(axis=0)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each query (row) and block (row) a number that no inner product exceeds."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def exact_kind(largest_query: int, largest_document: int, dim: int) -> type:
    """Floats where every partial sum of a product is an integer that they hold."""
    return np.float64 if largest_query * largest_document * max(1, dim) < 2**53 else np.int64


def search(queries: np.ndarray, own: np.ndarray, least: np.ndarray, blocks: list[Block], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best of the blocks for each query: row of the query, identifier, score; and how many times a block was scored.

    own: identifiers that are no candidates; least: scores below it are of no use (LOWEST: all are)."""
    kind = exact_kind(int(np.abs(queries).max(initial=0)), max((max(-int(b.low.min(initial=0)), int(b.high.max(initial=0))) for b in blocks), default=0), queries.shape[1])
    queries = queries.astype(kind)
    reach = bounds(queries, np.array([b.low for b in blocks]).astype(kind), np.array([b.high for b in blocks]).astype(kind))
    order = np.argsort(-reach, axis=1, kind="stable")
    kth = least.astype(np.int64).copy()
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    at, wide, scored = 0, 1, 0
    while at < len(blocks):
        window = order[:, at : at + wide]
        rows, columns = np.nonzero(np.take_along_axis(reach, window, axis=1) >= kth[:, None])
        if not len(rows):
            break  # the bounds that follow are lower still
        wanted = window[rows, columns]
        by_block = np.argsort(wanted, kind="stable")
        found = [best]
        for part in np.split(by_block, np.flatnonzero(np.diff(wanted[by_block])) + 1):
            block, asking = blocks[wanted[part[0]]], rows[part]
            scored += len(asking)
            scores = queries[asking] @ block.forward.astype(kind).T
            scores[block.ids[None, :] == own[asking, None]] = LOWEST
            some = np.flatnonzero((scores >= kth[asking, None]).any(axis=1))
            ranked = np.argsort(-scores[some], axis=1, kind="stable")[:, :k]  # equal scores by identifier, the block's order
            kept = np.take_along_axis(scores[some], ranked, axis=1).astype(np.int64)
            good = (kept >= kth[asking[some], None]) & (kept > LOWEST)
            found.append((np.repeat(asking[some], ranked.shape[1])[good.ravel()], block.ids[ranked][good], kept[good]))
        row, ids, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        sort = np.lexsort((ids, -score, row))
        row, ids, score = row[sort], ids[sort], score[sort]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        full = rank == k - 1
        kth[row[full]] = np.maximum(kth[row[full]], score[full])
        best = tuple(x[rank < k] for x in (row, ids, score))
        at += wide
        wide *= 2
    return *best, scored


def _nearest_pivot(vectors: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """Adds `cell`, the pivot of the greatest cosine; an order for locality only, no result depends on it."""
    unit = pivots / np.maximum(np.sqrt((pivots.astype(np.float64) ** 2).sum(axis=1, keepdims=True)), 1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.argmax(matrix(batch.column(1), dim, np.float64) @ unit.T, axis=1) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "vector", "cell"])

    return vectors.select("vec_id", "vector").mapInArrow(cells, "vec_id long, vector array<int>, cell int")


def block_index(vectors: DataFrame, dim: int, parts: int, block_docs: int = BLOCK_DOCS, pivots: int = PIVOTS) -> DataFrame:
    """part, ids, forward, low, high: a row for each block; numbers are packed, identifiers by 8 bytes and components by 4."""
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vector").limit(pivots).select("vector").collect()
    placed = _nearest_pivot(vectors, np.array([r.vector for r in chosen], np.int64).reshape(-1, dim), dim) if chosen else vectors.select("vec_id", "vector").withColumn("cell", F.lit(0))
    ranged = placed.repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(rows: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
            for at in range(0, rows.num_rows if whole else rows.num_rows // block_docs * block_docs, block_docs):
                some = rows.slice(at, block_docs).combine_chunks()
                ids, forward = some.column("vec_id").to_numpy(), matrix(some.column("vector").combine_chunks(), dim)
                sort = np.argsort(ids, kind="stable")
                block = Block(ids[sort], forward[sort])
                numbers = [block.ids.tobytes(), *(x.astype(np.int32).tobytes() for x in (block.forward, block.low, block.high))]
                yield pa.RecordBatch.from_arrays([some.column("part").combine_chunks().slice(0, 1), *(pa.array([x], pa.binary()) for x in numbers)], ["part", "ids", "forward", "low", "high"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 16 * block_docs:
                rows = pa.Table.from_batches(held)
                yield from packed(rows, False)
                held = rows.slice(rows.num_rows // block_docs * block_docs).to_batches()
        if held:
            yield from packed(pa.Table.from_batches(held), True)

    return ranged.select("part", "vec_id", "vector").mapInArrow(pack, "part int, ids binary, forward binary, low binary, high binary")


def _part_bounds(blocks: DataFrame, dim: int) -> DataFrame:
    """part, low, high: bounds of whole partitions."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(low, np.int32), np.frombuffer(high, np.int32)
                old = seen.setdefault(part, [a, b])
                seen[part] = [np.minimum(old[0], a), np.maximum(old[1], b)]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), *(pa.array([v[i].tolist() for v in seen.values()], pa.list_(pa.int32())) for i in range(2))], ["part", "low", "high"])

    some = blocks.select("part", "low", "high").mapInArrow(merge, "part int, low array<int>, high array<int>")
    whole = [F.array(*(f(F.get(c, F.lit(j))) for j in range(dim))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
    return some.groupBy("part").agg(*whole)


ASKED = "query_id long, vector array<int>, part int, least long, first boolean"


def _sent(queries: DataFrame, parts: list[tuple[int, list[int], list[int]]], dim: int) -> DataFrame:
    """A row for each query and partition, with whether it has the query's highest bound, and that bound as `reach`."""
    numbers = np.array([p[0] for p in parts], np.int32)
    low, high = (np.array([p[i] for p in parts], np.int64).reshape(-1, dim) for i in (1, 2))
    sent = queries.sparkSession.sparkContext.broadcast((numbers, low, high))

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, low, high = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                reach = bounds(matrix(some.column(1), dim), low, high)
                best = reach.argmax(axis=1)
                rows, columns = np.nonzero(reach >= some.column(2).to_numpy()[:, None])
                at_rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([some.column(0).take(at_rows), some.column(1).take(at_rows), pa.array(numbers[columns]), some.column(2).take(at_rows), pa.array(columns == best[rows])], ["query_id", "vector", "part", "least", "first"])

    return queries.select("query_id", "vector", "least").mapInArrow(reaching, ASKED)


def _answers(asked: DataFrame, blocks: DataFrame, groups: int, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score: of each query and partition the k best. groups: how many copies of a partition are made."""
    dealt = asked.select("query_id", "vector", "least", "part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"))
    copies = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def answer(some: pa.Table, there: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not some.num_rows or not there.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        held = [Block(np.frombuffer(i, np.int64), np.frombuffer(f, np.int32).astype(np.int64).reshape(-1, dim)) for i, f in zip(there.column("ids").to_pylist(), there.column("forward").to_pylist(), strict=True)]
        own = some.column("query_id").to_numpy()
        rows, ids, scores, _ = search(matrix(some.column("vector").combine_chunks(), dim), own, some.column("least").to_numpy(), held, k)
        return pa.table([pa.array(own[rows]), pa.array(ids), pa.array(scores)], names)

    return dealt.groupBy("part", "group").cogroup(copies.groupBy("part", "group")).applyInArrow(answer, "query_id long, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """Adds rank; Spark keeps k rows of a query in each task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_docs: int = BLOCK_DOCS, part_docs: int = PART_DOCS, group_queries: int = GROUP_QUERIES, broadcast_bounds: int = BROADCAST_BOUNDS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query with candidates of other identifiers."""
    spark = candidates.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def whole(rows: DataFrame) -> tuple[DataFrame, int]:
        named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id IS NOT NULL")
        return integer_vectors(named, scale)

    vectors, dim = whole(candidates)
    asking, query_dim = whole(queries)
    vectors = written(vectors, "vectors")
    asked = written(asking.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")).withColumn("least", F.lit(LOWEST).cast("long")), "queries")
    n, n_queries = vectors.count(), asked.count()
    if not n or not n_queries:
        return none
    if dim != query_dim:
        raise ValueError(f"queries have {query_dim} components, candidates {dim}")
    parts = max(-(-n // part_docs), min(2 * spark.sparkContext.defaultParallelism, -(-n // (8 * block_docs))))
    groups = -(-n_queries // group_queries)
    blocks = written(block_index(vectors, dim, parts, block_docs), "blocks")
    there = written(_part_bounds(blocks, dim), "part-bounds")
    n_parts = there.count()
    if n_parts * dim * 16 > broadcast_bounds:
        every = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(there.agg(F.max("part")).first()[0]))).alias("part"))
        return _ranked(_answers(every, blocks, groups, dim, k), k)
    limits = [tuple(r) for r in there.select("part", "low", "high").collect()]
    first = written(_answers(_sent(asked, limits, dim).where("first"), blocks, groups, dim, k), "first-answers")
    learnt = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).drop("n")
    rest = asked.drop("least").join(learnt, "query_id", "left").select("query_id", "vector", F.coalesce("kth", F.lit(LOWEST).cast("long")).alias("least"))
    return _ranked(first.unionByName(_answers(_sent(rest, limits, dim).where("NOT first"), blocks, groups, dim, k)), k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return _best(rows, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_table(spark, f"{sf_dir}/embeddings.parquet")
    return exact_top_k(rows, rows.where("vec_id % 100 = 0"))


OP13_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (SELECT vec_id AS query_id, min(v) AS q FROM kept WHERE vec_id % 100 = 0 GROUP BY vec_id),
scored AS (SELECT query_id, vec_id, list_inner_product(q, v)::BIGINT AS score FROM asked, kept WHERE query_id <> vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
