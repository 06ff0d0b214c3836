"""Token shards as the end of a stream, by transactions.

register(spark) makes `writeStream.format("token_partials")` known for rows source, start, tokens (two bytes each,
little-endian): a document's place in its source's stream and its tokens. Each task of a batch writes one immutable
partial for each source, with an index of its documents; the commit of a batch names its partials with sizes and
SHA-256 in one file, written last and once. A batch that is run again finds its transaction, and what it wrote anew is
deleted. Files that no transaction names belong to nobody and are never read.

`assembled` makes exact shards of all committed partials. A partial counts only if its size and digest are those of its
transaction."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from lodestone.sources import files
from lodestone.sources.shards import ShardError, write_manifest

WIDE = 2
INDEX = np.dtype([("start", "<i8"), ("n", "<i8")])


@dataclass
class Partials(WriterCommitMessage):
    files: list = field(default_factory=list)


class _Open:
    """A partial that is being written."""

    def __init__(self, store, folder: str, source: str):
        self.name, self.source = uuid.uuid4().hex, source
        self.handle, self.digest, self.index = store.open_output_stream(f"{folder}/{self.name}.bin"), hashlib.sha256(), []

    def add(self, start: int, tokens: bytes) -> None:
        self.handle.write(tokens)
        self.digest.update(tokens)
        self.index.append((start, len(tokens) // WIDE))

    def close(self, folder: str) -> dict:
        self.handle.close()
        index = np.array(self.index, INDEX).tobytes()
        files.write(f"{folder}/{self.name}.idx", index)
        return {"source": self.source, "file": self.name, "documents": len(self.index), "bytes": WIDE * sum(n for _, n in self.index), "sha256": self.digest.hexdigest(), "index_sha256": hashlib.sha256(index).hexdigest()}


class _Sink(DataSourceStreamArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        folder = f"{self.folder}/partials"
        store, where = files.store(folder)
        store.create_dir(where, recursive=True)
        opened: dict[str, _Open] = {}
        for batch in iterator:
            for source, start, tokens in zip(*(batch.column(c).to_pylist() for c in ("source", "start", "tokens")), strict=True):
                if source is None or start is None or tokens is None or len(tokens) % WIDE:
                    raise ShardError("a row without source, start or whole tokens")
                if source not in opened:
                    opened[source] = _Open(store, where, source)
                opened[source].add(start, tokens)
        return Partials([p.close(folder) for p in opened.values()])

    def _transaction(self, batch: int) -> str:
        return f"transaction_{batch:09d}.json"

    def _drop(self, messages) -> None:
        store, where = files.store(f"{self.folder}/partials")
        for f in (f for m in messages if m for f in m.files):
            for suffix in (".bin", ".idx"):
                store.delete_file(f"{where}/{f['file']}{suffix}")

    def commit(self, messages, batchId):
        name = self._transaction(batchId)
        if any(f.base_name == name for f in files.listed(f"{self.folder}/transactions", ".json")):
            self._drop(messages)
            return
        found = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["source"], f["sha256"], f["file"]))
        files.write(f"{self.folder}/transactions/{name}", json.dumps({"batch": batchId, "partials": found}, sort_keys=True).encode())

    def abort(self, messages, batchId):
        self._drop(messages)


class TokenPartials(DataSource):
    @classmethod
    def name(cls):
        return "token_partials"

    def schema(self):
        return "source string, start long, tokens binary"

    def streamWriter(self, schema, overwrite):
        return _Sink(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenPartials)


def transactions(folder: str) -> list[dict]:
    """What batches have committed, in order: one object for each batch."""
    return [files.read_object(f"{folder}/transactions/{f.base_name}") for f in files.listed(f"{folder}/transactions", ".json")]


def verified(path: str, told: dict) -> np.ndarray:
    """The index of a partial whose bytes are those of its transaction."""
    store, where = files.store(f"{path}/{told['file']}.bin")
    digest, size = hashlib.sha256(), 0
    with store.open_input_stream(where) as f:
        while raw := f.read(1 << 20):
            digest.update(raw)
            size += len(raw)
    index = files.read(f"{path}/{told['file']}.idx")
    if size != told["bytes"] or digest.hexdigest() != told["sha256"] or hashlib.sha256(index).hexdigest() != told["index_sha256"]:
        raise ShardError(f"partial {told['file']} isn't what its transaction says")
    return np.frombuffer(index, INDEX)


DOCUMENTS = "source string, start long, n long, file string, offset long"


def assembled(spark: SparkSession, folder: str, shard_tokens: int, vocabulary: int = 1 << 16) -> dict[str, list[dict]]:
    """Shards of exactly `shard_tokens` tokens (the last may be shorter) of each source in folder/<source>, with a
    manifest, made of all committed partials. The stream of a source must be without gaps. Running it again gives the
    same bytes."""
    told = [p for t in transactions(folder) for p in t["partials"]]  # a row for each file
    rows = spark.createDataFrame([(json.dumps(p),) for p in told], "told string")
    partials = f"{folder}/partials"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in map(json.loads, batch.column(0).to_pylist()):
                index = verified(partials, told)
                n = index["n"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([told["source"]] * len(n), pa.string()), pa.array(index["start"].astype(np.int64)), pa.array(n), pa.array([told["file"]] * len(n), pa.string()), pa.array(np.cumsum(n) - n)], ["source", "start", "n", "file", "offset"])

    held = rows.repartition(max(1, len(told))).mapInArrow(documents, DOCUMENTS)
    first = F.floor(F.col("start") / shard_tokens).cast("long")
    last = F.floor((F.col("start") + F.col("n") - 1) / shard_tokens).cast("long")
    pieces = held.where("n > 0").withColumn("shard", F.explode(F.sequence(first, last)))
    begin, end = F.greatest(F.col("start"), F.col("shard") * shard_tokens), F.least(F.col("start") + F.col("n"), (F.col("shard") + 1) * shard_tokens)
    pieces = pieces.select("source", "shard", "file", (F.col("offset") + begin - F.col("start")).alias("offset"), begin.alias("begin"), (end - begin).alias("n"))

    def write(key: tuple, some: pa.Table) -> pa.Table:
        """One shard: its pieces are at most as many as its tokens."""
        source, shard = (k.as_py() for k in key)
        store, where = files.store(partials)
        parts, at = [], shard * shard_tokens
        opened: dict[str, object] = {}
        for file, offset, begin, n in sorted(zip(*(some.column(c).to_pylist() for c in ("file", "offset", "begin", "n")), strict=True), key=lambda p: p[2]):
            if begin != at:
                raise ShardError(f"{source} has a gap or an overlap at token {at}")
            if file not in opened:
                opened[file] = store.open_input_file(f"{where}/{file}.bin")
            opened[file].seek(WIDE * offset)
            parts.append(opened[file].read(WIDE * n))
            at += n
        for f in opened.values():
            f.close()
        data = b"".join(parts)
        if len(data) and int(np.frombuffer(data, "<u2").max()) >= vocabulary:
            raise ShardError("a token is outside the vocabulary")
        name = f"shard_{shard:05d}.bin"
        files.write(f"{folder}/{source}/{name}", data)
        about = {"file": name, "tokens": len(data) // WIDE, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
        return pa.table({"source": pa.array([source]), "shard": pa.array([shard], pa.int64()), "about": pa.array([json.dumps(about)])})

    done = pieces.groupBy("source", "shard").applyInArrow(write, "source string, shard long, about string").collect()  # a row for each shard
    out: dict[str, list[dict]] = {}
    for r in sorted(done, key=lambda r: (r.source, r.shard)):
        out.setdefault(r.source, []).append(json.loads(r.about))
    for source, shards in out.items():
        if any(s["tokens"] != shard_tokens for s in shards[:-1]) or len(shards) != max(int(s["file"][6:-4]) for s in shards) + 1:
            raise ShardError(f"{source} has a gap")
        write_manifest(f"{folder}/{source}", shards)
    return out
