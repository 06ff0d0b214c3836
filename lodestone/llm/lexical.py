"""Ranked lexical search (operator 12): exact top-k over dual-sorted postings in wavelet trees, one tree for each shard.

One pass over the texts keeps, for each document, its number of terms and how often it holds each term that is asked
for; everything else is counted from that slim table. A shard is a run of its rows. Its documents are numbered by
identifier, and the postings of each term are written one after another by falling impact (what one unit of the term's
weight adds to the score). A wavelet tree over that sequence of document numbers makes it navigable by document, too:
a node stands for a range of numbers, holds the postings of that range in the same order, and a term's postings in a
node are an interval that two rank look-ups carry over to either child. Since order is kept, the first posting of an
interval has the greatest impact of the term in the node's range, and the weighted sum of these is a bound on the
scores below the node; in a leaf it is the score.

A query walks the tree best first: of the nodes in hand those with the highest bounds are opened together, some
hundreds at a time, and a node whose bound is below the k-th score in hand is let go. A bound that equals it is opened,
as a smaller identifier wins a tie. Where many terms make nodes large, the deepest nodes are opened first, so what is
in hand stays bounded by the height of the tree. Every shard gives its k best, and Spark merges those.

Items are asked in groups of bounded size, whose terms, weights and numbers are all that is broadcast; texts are read
once for each group. Long texts are counted in pieces that end between terms. No text, posting or shard is shuffled, so
neither frequent terms nor groups of copies meet in one task.

A null or empty text has no terms: it is no document of the collection's counts and is never ranked; an item without
terms gets no rows. A term that no document holds adds nothing. Rows are documents of their own, also where texts or
identifiers repeat; missing identifiers come last among equal scores. Items of equal identifier and text are one; unlike
texts of one identifier are ranked each. Empty tables give no rows. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SEPARATORS, UPPER, documents, written

#: Constants of the score: how much a length counts, of 100, and the units of weights and impacts.
LENGTH_SHARE, WEIGHT_UNIT, IMPACT_UNIT = 90, 1_000, 1_000_000_000
#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 8_192, 1 << 20
#: Bytes of items that are asked at once; bytes of text that are counted at once.
ITEM_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: Nodes that are opened together before and after k documents are known; intervals in hand before the deepest nodes come first.
FEW, MANY, IN_HAND = 128, 1024, 1 << 22
_FLAT = bytes(ord(" ") if chr(c) in SEPARATORS else ord(chr(c).lower()) if chr(c) in UPPER else c for c in range(256))


def pieces(flat: bytes) -> Iterator[bytes]:
    """A flattened text in parts that end between terms."""
    at = 0
    while len(flat) - at > PIECE_BYTES:
        end = flat.find(b" ", at + PIECE_BYTES)
        if end < 0:
            break
        yield flat[at:end]
        at = end
    yield flat[at:]


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, by pieces: runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    for piece in pieces(text.translate(_FLAT)):
        yield piece.split()


def term_counts(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, and how often those of the vocabulary."""
    n, found, known = 0, Counter(), vocabulary.__contains__
    for terms in terms_of(text):
        n += len(terms)
        found.update(filter(known, terms))
    return n, found


@dataclass
class Collection:
    """Counts of a whole collection: documents with a term, their terms, and documents that hold each term asked for."""

    docs: int
    terms: int
    holding: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(WEIGHT_UNIT * math.log((2 * self.docs + 2) / (2 * self.holding.get(term, 0) + 1)))

    def length_factors(self, lengths: np.ndarray) -> np.ndarray:
        if int(lengths.max(initial=0)) * LENGTH_SHARE * self.docs >= 2**63:
            return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * self.docs // self.terms for n in lengths], np.int64)
        return 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * self.docs // self.terms

    def impacts(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return IMPACT_UNIT * counts // (1000 * counts + 8 * self.length_factors(lengths))


@dataclass
class Nodes:
    """Nodes of a tree by level and number, and their intervals that are not empty: owner (ascending), term, low, high."""

    level: np.ndarray
    number: np.ndarray
    owner: np.ndarray
    term: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def held(self) -> Nodes:
        """Without empty intervals."""
        some = self.high > self.low
        return Nodes(self.level, self.number, *(x[some] for x in (self.owner, self.term, self.low, self.high)))

    def only(self, chosen: np.ndarray) -> Nodes:
        some = chosen[self.owner]
        return Nodes(self.level[chosen], self.number[chosen], (np.cumsum(chosen) - 1)[self.owner[some]], *(x[some] for x in (self.term, self.low, self.high)))

    def __add__(self, more: Nodes) -> Nodes:
        return Nodes(*(np.concatenate(x) for x in ((self.level, more.level), (self.number, more.number), (self.owner, more.owner + len(self.level)), (self.term, more.term), (self.low, more.low), (self.high, more.high))))


class DualSorted:
    """Postings by term and falling impact, as a wavelet tree over document numbers."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((docs, -impacts, terms))
        self.begins = np.searchsorted(terms[order], np.arange(n_terms + 1)).astype(np.int32)
        self.height = max(1, (n_docs - 1).bit_length())
        size = len(docs)
        #: By level: postings before each place that go to the lower half, impacts in the level's order, where nodes begin.
        self.lower, self.impacts, edges = np.zeros((self.height, size + 1), np.int32), np.empty((self.height + 1, size), np.int32), []
        numbers, held = docs[order].astype(np.int64), impacts[order]
        for level in range(self.height):
            shift = self.height - level
            node = numbers >> shift
            self.impacts[level] = held
            edges.append(np.concatenate([[0], np.cumsum(np.bincount(node, minlength=1 << level))]).astype(np.int32))
            upper = (numbers >> (shift - 1)) & 1
            below = self.lower[level]
            np.cumsum(1 - upper, out=below[1:])
            start, end = edges[level][node], edges[level][node + 1]
            place = np.arange(size)
            to = np.where(upper == 0, start + below[:-1] - below[start], place + below[end] - below[:-1])
            moved, moved_impacts = np.empty_like(numbers), np.empty_like(held)
            moved[to], moved_impacts[to] = numbers, held
            numbers, held = moved, moved_impacts
        self.impacts[self.height] = held
        self.edges, self.edges_of = np.concatenate(edges), np.cumsum([0, *map(len, edges[:-1])])

    def children(self, nodes: Nodes) -> tuple[Nodes, Nodes]:
        """The lower and the upper halves of nodes, with the intervals that are carried over to either."""
        level = nodes.level[nodes.owner]
        own = self.edges_of[level] + nodes.number[nodes.owner]
        start, end = self.edges[own], self.edges[own + 1]
        below, in_low, in_high = self.lower[level, start], self.lower[level, nodes.low], self.lower[level, nodes.high]
        rest = self.lower[level, end]
        return (
            Nodes(nodes.level + 1, 2 * nodes.number, nodes.owner, nodes.term, in_low + start - below, in_high + start - below),
            Nodes(nodes.level + 1, 2 * nodes.number + 1, nodes.owner, nodes.term, nodes.low + rest - in_low, nodes.high + rest - in_high),
        )

    def reach(self, nodes: Nodes, weights: np.ndarray) -> np.ndarray:
        """Bounds of nodes: weighted sums of the first impacts of their intervals."""
        out = np.zeros(len(nodes.level), np.int64)
        if len(nodes.owner):
            first = np.flatnonzero(np.diff(nodes.owner, prepend=-1))
            out[nodes.owner[first]] = np.add.reduceat(weights[nodes.term] * self.impacts[nodes.level[nodes.owner], nodes.low], first)
        return out

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and scores of the k best documents with a score above 0, equal scores by number; and how many nodes were opened."""
        weights = weights.astype(np.int64)
        docs, scores, opened, kth, batch = np.empty(0, np.int64), np.empty(0, np.int64), 0, 1, FEW
        nodes = Nodes(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(len(terms), np.int64), np.arange(len(terms)), self.begins[terms], self.begins[terms + 1]).held()
        reach = self.reach(nodes, weights)
        while len(nodes.level):
            chosen = np.ones(len(reach), bool)
            if len(reach) > batch:
                by = -nodes.level * 2.0**62 - reach if len(nodes.owner) > IN_HAND else -reach
                chosen[np.argpartition(by, batch - 1)[batch:]] = False
            opened += int(chosen.sum())
            lower, upper = self.children(nodes.only(chosen))
            born = lower.held() + upper.held()
            bound = self.reach(born, weights)
            good = bound >= kth
            leaf = good & (born.level == self.height)
            if leaf.any():
                docs, scores = np.concatenate([docs, born.number[leaf]]), np.concatenate([scores, bound[leaf]])
                best = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[best], scores[best]
                if len(docs) == k:
                    kth, batch = max(kth, int(scores[-1])), MANY
            inner, stay = good & (born.level < self.height), ~chosen & (reach >= kth)
            nodes, reach = nodes.only(stay) + born.only(inner), np.concatenate([reach[stay], bound[inner]])
        return docs, scores, opened


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n_terms, and the terms asked for with their counts, of each document that has a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_terms", "terms", "counts"]
        numbers = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    n, found = term_counts(text.as_py() or b"", numbers)
                    if n:
                        rows.append((doc, n, [numbers[t] for t in found], list(found.values())))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", F.encode("text", "utf-8").alias("text")).mapInArrow(count, "doc_id long, n_terms long, terms array<int>, counts array<long>")


def _shards(batches: Iterator[pa.RecordBatch], most_docs: int, most_postings: int) -> Iterator[pa.Table]:
    """Rows in runs that make a shard each."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy()) if batch.num_rows else np.empty(0, np.int64)
        begin = 0
        for i, size in enumerate(sizes.tolist()):
            docs, postings = docs + 1, postings + size
            if docs >= most_docs or postings >= most_postings:
                yield pa.Table.from_batches([*held, batch.slice(begin, i + 1 - begin)])
                held, docs, postings, begin = [], 0, 0, i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def shard_of(rows: pa.Table, about: Collection, n_terms: int) -> tuple[DualSorted, list[int | None]]:
    """The tree of a shard, and the identifiers that its numbers stand for, ascending, missing ones last."""
    ids = rows.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    terms, counts = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
    sizes = np.diff(terms.offsets.to_numpy())
    lengths = rows.column("n_terms").to_numpy()
    impacts = about.impacts(counts.flatten().to_numpy(), np.repeat(lengths, sizes))
    return DualSorted(np.repeat(number, sizes), terms.flatten().to_numpy().astype(np.int64), impacts, len(ids), n_terms), [ids[i] for i in order]


def _asked(items: list[tuple[int | None, str]]) -> tuple[dict[bytes, int], list[tuple[int | None, np.ndarray]]]:
    """Numbers of all terms, and of each item its identifier and terms."""
    vocabulary: dict[bytes, int] = {}
    out = []
    for item, text in items:
        terms = sorted({t for some in terms_of(text.encode()) for t in some})
        out.append((item, np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], np.int64)))
    return vocabulary, out


FOUND = "item int, item_id long, doc_id long, score long"


def _found(docs: DataFrame, items: list[tuple[int | None, str]], k: int, most_docs: int, most_postings: int) -> DataFrame:
    """The k best documents of each item in each shard, for one group of items."""
    vocabulary, asked = _asked(items)
    slim = written(_counted(docs, vocabulary), "term-counts")
    n, terms = slim.agg(F.count(F.lit(1)), F.sum("n_terms")).first()
    holding = slim.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row for each term asked for
    about = Collection(n, terms or 0, {r.term: r["count"] for r in holding})
    queries = [(item, t, np.array([about.weight(x) for x in t.tolist()], np.int64)) for item, t in asked]
    sent = docs.sparkSession.sparkContext.broadcast((about, len(vocabulary), queries))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, n_terms, queries = sent.value
        for rows in _shards(batches, most_docs, most_postings):
            tree, ids = shard_of(rows, about, n_terms)
            for i, (item, terms, weights) in enumerate(queries):
                docs, scores, _ = tree.top(terms, weights, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), i, np.int32)), pa.array([item] * len(docs), pa.int64()), pa.array([ids[d] for d in docs.tolist()], pa.int64()), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return slim.mapInArrow(best, FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k highest scores above 0 of each item, equal ones by doc_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    asked = written(asked, "items")
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    groups = -(-size // item_bytes)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in range(groups):
        # Bounded by item_bytes, about: the texts of one group only.
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).collect()
        ordered = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = _found(rows, [(r.item_id, r.text) for r in some], k, shard_docs, shard_postings).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
        best = best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = out.unionByName(best) if groups > 1 else best
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH told AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
words AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM told),
lengths AS (SELECT r, doc_id, count(*) AS n FROM words GROUP BY r, doc_id),
whole AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS terms FROM lengths),
asked AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY term, docs),
parts AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS impact FROM counts JOIN lengths USING (r), whole),
scores AS (SELECT item_id, asked.text, r, doc_id, sum(w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY item_id, asked.text, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
