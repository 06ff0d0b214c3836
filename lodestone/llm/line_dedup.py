"""Line dedup (operator 10): a sharded minimal perfect hash over line hashes, probed by documents.

Lines of at least `min_chars` code points are counted by 128-bit hashes of their keys, each once per document. The
hashes that reach `min_docs` documents are dealt to shards, and every shard builds a minimal perfect hash over its
own (levels of bit arrays; a key sits at the first level where nothing collides with it). Its rank indexes three
compact arrays: a 64-bit fingerprint that tells members from strangers, the number of documents, and the largest
identifier among them. Documents probe those arrays and never meet other documents' lines.

Shards up to `broadcast_bytes` in all are sent to every task. Beyond that size the probes travel instead: hashes of
a document's lines go to the shard that can answer them, and only answers that drop a line come back. Probes are
dealt to copies of their shard, as many as its load asks for: the lines of the shard that are known to be frequent,
by their counts, and an even part of all others. Both ways give the same rows.

A null text is one empty line; a text of any length is split whole, and its long lines are hashed some at a time. Keys
are lines without white space at their ends, A-Z lower-cased. A row is a document; rows without an identifier don't
count towards `min_docs` and keep no line that must go, since no identifier is theirs. Rows that share an identifier
are one document where documents are counted, and each keeps the lines whose largest identifier is theirs. An empty
table gives no rows. Columns besides the identifier and the text are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, documents, written

#: Keys in a shard, and bits of a level for each key that is left.
SHARD_KEYS, GAMMA = 50_000, 1.6
BROADCAST_BYTES = 96 << 20
#: Probes that meet one copy of a shard, about, when they travel.
COPY_PROBES = 200_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys ^ np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own number below n; other keys get any number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            counts = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.ranks.append(np.concatenate([[0], counts])[:-1] + total)
            total += int(counts[-1]) if len(counts) else 0
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            if len(levels) > 200:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, int(GAMMA * len(keys)) // 64 * 64 + 64)
            at = (_mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(levels)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (_mixed(keys[left], k) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            there = (bits[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[there], bit[there]
            below = bits[w] & ((np.uint64(1) << b) - np.uint64(1))
            out[left[there]] = ranks[w] + np.bitwise_count(below)
            left = left[~there]
        return out


class Shard:
    """A perfect hash with the arrays it indexes."""

    def __init__(self, hashes: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.hashes, self.prints, self.counts, self.last = hashes, prints, counts, last

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Shard:
        hashes = PerfectHash.build(keys)
        order = np.argsort(hashes.rank(keys))
        return cls(hashes, prints[order], counts[order], last[order])

    def pack(self) -> bytes:
        sizes = [len(x) for x in self.hashes.levels]
        head = np.array([len(sizes), len(self.prints), *sizes], np.int64)
        return b"".join([head.tobytes(), *(x.tobytes() for x in self.hashes.levels), self.prints.tobytes(), self.counts.tobytes(), self.last.tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        words = np.frombuffer(data, np.int64)
        k, n = int(words[0]), int(words[1])
        at, levels = 2 + k, []
        for size in words[2 : 2 + k]:
            levels.append(words[at : at + size].view(np.uint64))
            at += size
        return cls(PerfectHash(levels), words[at : at + n].view(np.uint64), words[at + n : at + 2 * n], words[at + 2 * n : at + 3 * n])

    def last_document(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are members, and the largest identifier of those that are."""
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = self.hashes.rank(keys)
        member = (at >= 0) & (self.prints[at] == prints)
        return member, np.where(member, self.last[at], 0)


def line_keys(text: str | None) -> tuple[list[str], list[bytes]]:
    """The lines of a text and the key of each."""
    lines = (text or "").split("\n")
    return lines, [x.strip(SPACES).encode().lower() for x in lines]


def hashes_of(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.dtype(">u8")).astype(np.uint64).reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy()


def _long(keys: list[bytes], min_chars: int) -> list[int]:
    """Places of the keys with at least min_chars code points."""
    return [i for i, k in enumerate(keys) if len(k) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars)]


def _counted(docs: DataFrame, min_chars: int) -> DataFrame:
    """key, print, doc_id: each line hash once for each row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            keys, owners, held = [], [], 0
            for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                lines, all_keys = line_keys(text.as_py())
                own = {all_keys[j] for j in _long(all_keys, min_chars)}
                keys += own
                owners += [doc] * len(own)
                held += len(own)
                if held > 200_000 or i == len(ids) - 1:
                    if keys:
                        a, b = hashes_of(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(owners, pa.int64())], ["key", "print", "doc_id"])
                    keys, owners, held = [], [], 0

    return docs.mapInArrow(emit, "key long, print long, doc_id long")


def frequent_lines(docs: DataFrame, min_chars: int, min_docs: int, unique_ids: bool = False) -> DataFrame:
    """key, print, n_docs, last: line hashes of at least `min_docs` documents.

    unique_ids: identifiers are known not to repeat, so rows can be counted as they are."""
    lines = _counted(docs, min_chars)
    if not unique_ids:
        lines = lines.distinct()
    return lines.groupBy("key", "print").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= min_docs)


def build_shards(frequent: DataFrame, n_shards: int) -> DataFrame:
    """shard, data: packed shards, each built in a task of its own."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        keys, prints, counts, last = (rows.column(c).to_numpy() for c in ("key", "print", "n_docs", "last"))
        shard = Shard.build(keys.view(np.uint64), prints.view(np.uint64), counts, last)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([shard.pack()], pa.binary())})

    return frequent.withColumn("shard", _home(n_shards)).groupBy("shard").applyInArrow(build, "shard int, data binary")


def _kept(text: str | None, drop: np.ndarray) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    kept = "\n".join(x for x, gone in zip(lines, drop, strict=True) if not gone) if drop.any() else text or ""
    return len(lines), int(drop.sum()), hashlib.sha256(kept.encode()).hexdigest()


RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string"


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, keep_text: bool = True, copy_probes: int = COPY_PROBES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and the kept text of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequent = written(frequent_lines(rows, min_chars, min_docs), "lines")
    n = frequent.count()
    n_shards = max(1, -(-n // SHARD_KEYS))
    shards = written(build_shards(frequent, n_shards), "line-shards")
    size = shards.agg(F.sum(F.length("data"))).first()[0] or 0
    if size <= broadcast_bytes:
        return _probe_all(rows, {r.shard: bytes(r.data) for r in shards.collect()}, n_shards, min_chars, keep_text)
    # A probe takes min_chars bytes of text and a line feed at least.
    others = (rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // (min_chars + 1) // n_shards
    load = frequent.groupBy(_home(n_shards).alias("shard")).agg(F.sum("n_docs").alias("n"))
    copies = {r.shard: 1 + (r.n + others) // copy_probes for r in load.collect()}  # one number for each shard
    return _probe_travelling(rows, shards, [copies.get(i, 1) for i in range(n_shards)], min_chars, keep_text)


def _home(n_shards: int) -> Column:
    return F.pmod(F.col("print"), F.lit(n_shards)).cast("int")


def _probe_all(rows: DataFrame, packed: dict[int, bytes], n_shards: int, min_chars: int, keep_text: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(packed)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: Shard.unpack(v) for k, v in sent.value.items()}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for begin in range(0, len(ids), 256):
                part = range(begin, min(begin + 256, len(ids)))
                cut = [line_keys(texts[i].as_py()) for i in part]
                longs = [_long(c[1], min_chars) for c in cut]
                flags = [np.zeros(len(c[0]), bool) for c in cut]
                flat = [c[1][j] for c, js in zip(cut, longs, strict=True) for j in js]
                if flat:
                    keys, prints = hashes_of(flat)
                    # pmod of the signed print, as in build_shards
                    home = np.mod(prints.view(np.int64), n_shards)
                    own = np.repeat(np.array([0 if ids[i] is None else ids[i] for i in part], np.int64), [len(js) for js in longs])
                    nameless = np.repeat(np.array([ids[i] is None for i in part]), [len(js) for js in longs])
                    gone = np.zeros(len(flat), bool)
                    for s in np.unique(home):
                        if (shard := shards.get(int(s))) is not None:
                            at = np.flatnonzero(home == s)
                            member, last = shard.last_document(keys[at], prints[at])
                            gone[at] = member & (nameless[at] | (last != own[at]))
                    k = 0
                    for js, flag in zip(longs, flags, strict=True):
                        flag[js] = gone[k : k + len(js)]
                        k += len(js)
                out = [_kept(texts[i].as_py(), flag) for i, flag in zip(part, flags, strict=True)]
                kept = ["\n".join(x for x, g in zip(c[0], flag, strict=True) if not g) for c, flag in zip(cut, flags, strict=True)] if keep_text else [None] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in part], pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    return rows.mapInArrow(probe, RESULT)


def _probe_travelling(rows: DataFrame, shards: DataFrame, copies: list[int], min_chars: int, keep_text: bool) -> DataFrame:
    """The way for arrays of any size: hashes of lines go to copies of their shard; lines to drop come back by row.

    Rows are named by a 128-bit hash of identifier and text: only equal rows share a name, and they share all answers.
    copies: how many of each shard there are (one number for each `SHARD_KEYS` frequent lines)."""
    n_shards = len(copies)
    keyed = rows.withColumn("row_key", F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text").isNull().cast("string"), "text"))))
    sent = rows.sparkSession.sparkContext.broadcast(np.array(copies, np.int64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_keys, ids, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                _, all_keys = line_keys(texts[i].as_py())
                if js := _long(all_keys, min_chars):
                    keys, prints = hashes_of([all_keys[j] for j in js])
                    home = np.mod(prints.view(np.int64), n_shards)
                    name = row_keys[i].as_py()
                    salt = np.mod(int.from_bytes(name[:7], "big"), sent.value[home])
                    same = pa.array(np.full(len(js), i))
                    yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(salt.astype(np.int32)), row_keys.take(same), ids.take(same), pa.array(js, pa.int32()), pa.array(keys.view(np.int64)), pa.array(prints.view(np.int64))], ["shard", "salt", "row_key", "doc_id", "line", "key", "print"])

    probes = keyed.select("row_key", "doc_id", "text").mapInArrow(emit, "shard int, salt int, row_key binary, doc_id long, line int, key long, print long")
    numbers = rows.sparkSession.createDataFrame(list(enumerate(copies)), "shard int, copies long")
    held = shards.join(numbers, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("salt"), "data")

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = asked.select(["row_key", "line"])
        if not held.num_rows or not asked.num_rows:
            return out.slice(0, 0)
        shard = Shard.unpack(held.column("data")[0].as_py())
        member, last = shard.last_document(asked.column("key").to_numpy().view(np.uint64), asked.column("print").to_numpy().view(np.uint64))
        # Identifiers stay 64-bit integers; a missing one equals none.
        own = pc.fill_null(pc.equal(asked.column("doc_id"), pa.array(last)), False).to_numpy()
        return out.filter(pa.array(member & ~own))

    dropped = probes.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInArrow(answer, "row_key binary, line int")
    gone = dropped.groupBy("row_key").agg(F.collect_set("line").alias("lines"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lines = (batch.column(i) for i in range(3))
            out = []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                flag = np.zeros(text.count("\n") + 1, bool)
                flag[lines[i].as_py() or []] = True
                kept = "\n".join(x for x, g in zip(text.split("\n"), flag, strict=True) if not g) if keep_text else None
                out.append((*_kept(text, flag), kept))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    return keyed.join(gone, "row_key", "left").select("doc_id", "text", "lines").mapInArrow(apply, RESULT)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir), keep_text=False).drop("kept")


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM lines
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut
), often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE last IS NOT NULL AND doc_id IS DISTINCT FROM last)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last IS NULL OR doc_id IS NOT DISTINCT FROM last), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (key) GROUP BY r, doc_id
"""
