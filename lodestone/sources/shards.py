"""Token shards: headerless little-endian uint16 files, read and written as a Spark data source.

register(spark) makes `spark.read.format("token_shards").load(folder)` and the writer known. Reading gives one
partition for each shard, in path order. Writing takes rows (shard long, pos long, token int), repartitioned by shard
and sorted by pos; each task writes whole files to temporary names, and the commit renames them and writes the
manifest last, so a reader never sees a half-written corpus. Folders may lie in any store that `files` reaches."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileInfo, FileType
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from lodestone.operators.tokens import CorpusExhausted, overlapping, shard_offsets
from lodestone.sources import files

BATCH = 1 << 16


class ShardError(ValueError):
    pass


def shard_files(folder: str) -> list[FileInfo]:
    """shards/*.bin, else *.bin, by name; an empty or odd file is an error."""
    found = files.listed(f"{folder}/shards", ".bin") or files.listed(folder, ".bin")
    if not found:
        raise ShardError(f"no shards in {folder}")
    for f in found:
        if not f.size or f.size % 2:
            raise ShardError(f"{f.path} is empty or of an odd size")
    return found


@dataclass
class ShardPart(InputPartition):
    """Tokens first .. last - 1 of the stream, which lie in a file that begins with token `start`."""

    path: str = ""
    name: str = ""
    start: int = 0
    first: int = 0
    last: int = 0


class _Reader(DataSourceReader):
    """Filters on `pos` choose files and places in them; what they leave out is never opened or read."""

    def __init__(self, folder: str):
        self.folder, self.low, self.high = folder, 0, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("pos",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif not isinstance(f, IsNotNull):  # no column is ever null
                yield f

    def partitions(self):
        out, at = [], 0
        for f in shard_files(self.folder):
            end = at + f.size // 2
            first, last = max(at, self.low), end if self.high is None else min(end, self.high)
            if first < last:
                part = ShardPart(None)
                part.path, part.name, part.start, part.first, part.last = f.path, f.base_name, at, first, last
                out.append(part)
            at = end
        return out or [ShardPart(None)]

    def read(self, partition):
        if partition.first >= partition.last:
            return
        store, _ = files.store(self.folder)
        at = partition.first
        with store.open_input_file(partition.path) as f:
            f.seek(2 * (at - partition.start))
            while at < partition.last:
                part = np.frombuffer(f.read(2 * min(BATCH, partition.last - at)), "<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["shard", "pos", "token"])
                at += len(part)


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, vocabulary: int):
        self.folder, self.vocabulary = folder, vocabulary

    def write(self, iterator):
        store, where = files.store(self.folder)
        store.create_dir(where, recursive=True)
        done, current, handle, part, count, digest = Written([]), None, None, "", 0, None

        def close():
            if handle:
                handle.close()
                done.files.append({"file": f"shard_{current:05d}.bin", "part": part, "tokens": count, "bytes": 2 * count, "sha256": digest.hexdigest()})

        for batch in iterator:
            shards = batch.column("shard").to_numpy()
            tokens = batch.column("token").to_numpy()
            if len(tokens) and (tokens.min() < 0 or tokens.max() >= self.vocabulary):
                raise ShardError("a token is outside the vocabulary")
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shards[a] != current:
                    close()
                    current, count, digest = int(shards[a]), 0, hashlib.sha256()
                    part = f"{where}/.{uuid.uuid4().hex}.part"
                    handle = store.open_output_stream(part)
                raw = tokens[a:b].astype("<u2").tobytes()
                handle.write(raw)
                digest.update(raw)
                count += b - a
        close()
        return done

    def commit(self, messages):
        found = sorted((f for m in messages if m for f in m.files), key=lambda f: f["file"])
        if len({f["file"] for f in found}) < len(found):
            self.abort(messages)
            raise ShardError("a shard came from two tasks: repartition by shard before writing")
        store, where = files.store(self.folder)
        for f in found:
            store.move(f.pop("part"), f"{where}/{f['file']}")
        write_manifest(self.folder, found)

    def abort(self, messages):
        store, _ = files.store(self.folder)
        for f in (f for m in messages if m for f in m.files):
            if f.get("part") and store.get_file_info(f["part"]).type == FileType.File:
                store.delete_file(f["part"])


def write_manifest(folder: str, found: list[dict]) -> None:
    files.write(f"{folder}/manifest.json", json.dumps({"format_version": 1, "shards": found, "tokens": sum(f["tokens"] for f in found)}, sort_keys=True).encode())


class TokenShards(DataSource):
    @classmethod
    def name(cls):
        return "token_shards"

    def schema(self):
        return "shard string, pos long, token int"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("vocabulary", 1 << 16)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShards)
    # Without it, Spark refuses a source that takes filters.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_shards(tokens: DataFrame, folder: str, shard_tokens: int, vocabulary: int = 1 << 16) -> None:
    """tokens: pos, token. Exact shards of `shard_tokens` tokens; the last may be shorter."""
    register(tokens.sparkSession)
    rows = tokens.select(F.floor(F.col("pos") / shard_tokens).cast("long").alias("shard"), F.col("pos").cast("long").alias("pos"), F.col("token").cast("int").alias("token"))
    rows.repartition("shard").sortWithinPartitions("shard", "pos").write.format("token_shards").option("path", folder).option("vocabulary", vocabulary).mode("append").save()


def read_tokens(spark: SparkSession, folder: str, start: int = 0, end: int | None = None) -> DataFrame:
    """shard, pos, token of the tokens start .. end - 1 (null: to the last): only files that hold some of them are opened."""
    register(spark)
    rows = spark.read.format("token_shards").load(folder).where(F.col("pos") >= start)
    return rows if end is None else rows.where(F.col("pos") < end)


#: Tokens of a file that one task reads for windows, about.
WINDOW_STRETCH = 1 << 24


def read_windows(spark: SparkSession, folder: str, windows: DataFrame, length: int, opened: Accumulator | None = None) -> DataFrame:
    """windows: window (unique), start. Adds `tokens`, the `length` tokens from there, also across shards.

    A window meets the shards that hold a part of it (`tokens.overlapping`); pieces go to tasks by file and place, and a
    task opens a file once. Shards that no window touches are never opened. opened: counts files as they are opened."""
    sizes = [(f.path, f.size // 2) for f in shard_files(folder)]  # a row for each file
    offsets = shard_offsets(spark.createDataFrame(sizes, "path string, tokens long"))
    total = sum(n for _, n in sizes)
    if windows.where((F.col("start") < 0) | (F.col("start") + length > total)).take(1):
        raise CorpusExhausted(f"a window of {length} tokens leaves the {total} of {folder}")
    pieces = overlapping(windows.select("window", "start"), offsets, length)

    def read(batches):
        store, _ = files.store(folder)
        path, file = None, None
        for batch in batches:
            out = []
            for window, place, name, offset, n in zip(*(batch.column(c).to_pylist() for c in ("window", "place", "path", "offset", "n")), strict=True):
                if name != path:
                    if file:
                        file.close()
                    path, file = name, store.open_input_file(name)
                    if opened is not None:
                        opened.add(1)
                file.seek(2 * offset)
                out.append((window, place, np.frombuffer(file.read(2 * n), "<u2").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["window", "place", "tokens"])
        if file:
            file.close()

    dealt = pieces.select(F.col("window").cast("long"), "place", "path", "offset", "n").repartition(F.col("path"), F.floor(F.col("offset") / WINDOW_STRETCH)).sortWithinPartitions("path", "offset")
    parts = dealt.mapInArrow(read, "window long, place long, tokens array<int>")
    whole = parts.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("place", "tokens"))).alias("_parts"))
    return windows.join(whole, "window").withColumn("tokens", F.flatten(F.col("_parts.tokens"))).drop("_parts")


def verify_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows against the files: size and digest, both ways."""
    told = files.read_object(f"{folder}/manifest.json")["shards"]
    manifest = spark.createDataFrame([(x["file"], x["bytes"], x["sha256"]) for x in told], "file string, bytes long, sha256 string")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("real_bytes"), F.sha2("content", 256).alias("real_sha256"))
    return manifest.join(there, "file", "full_outer").withColumn("ok", F.col("bytes").eqNullSafe(F.col("real_bytes")) & F.col("sha256").eqNullSafe(F.col("real_sha256")))


def copied(source: str, target: str, told: dict) -> None:
    """A shard under another path, byte for byte what its manifest row says; one that is there already is left alone."""
    def same(path: str) -> bool:
        store, where = files.store(path)
        info = store.get_file_info(where)
        return info.type == FileType.File and info.size == told["bytes"] and hashlib.sha256(files.read(path)).hexdigest() == told["sha256"]

    if same(target):
        return
    if not same(source):
        raise ShardError(f"{source} isn't what its manifest says")
    files.write(target, files.read(source))
    if not same(target):
        raise ShardError(f"{target} wasn't written as it was read")


def assemble(spark: SparkSession, folders: dict[str, str], plan: DataFrame, target: str) -> list[dict]:
    """plan: source, shard (its number in the source), position (from 0). The planned shards of several builds as one
    corpus, copied by tasks of their own, each verified against its source's manifest; the manifest comes last, and
    a run that is repeated goes on where files are missing."""
    rows = [(source, i, json.dumps(x)) for source, folder in folders.items() for i, x in enumerate(files.read_object(f"{folder}/manifest.json")["shards"])]  # one row for each shard file
    told = spark.createDataFrame(rows, "source string, shard long, told string")
    asked = plan.select("source", "shard", "position").join(told, ["source", "shard"], "left")

    def copy(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["told"] is None:
                    raise ShardError(f"{row['source']} has no shard {row['shard']}")
                told = json.loads(row["told"])
                name = f"shard_{row['position']:05d}.bin"
                copied(f"{folders[row['source']]}/{told['file']}", f"{target}/{name}", told)
                out.append((row["position"], json.dumps(told | {"file": name, "source": row["source"]})))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["position", "row"])

    done = [json.loads(r.row) for r in sorted(asked.repartition("position").mapInArrow(copy, "position long, row string").collect(), key=lambda r: r.position)]
    write_manifest(target, done)
    return done


def manifest_rows(documents: DataFrame, tokens: str, split: str, stage: str, steps: list[str]) -> DataFrame:
    """One row for each source and license, as a data card lists them: documents, tokens, processing steps, and a hash
    over the hashes of its texts (columns source, license, key)."""
    by = documents.groupBy("source", "license").agg(F.count(F.lit(1)).alias("document_count"), F.sum(tokens).alias("estimated_tokens"), F.bit_xor(F.conv(F.substring("key", 1, 15), 16, 10).cast("long")).alias("_keys"))
    return by.select("source", F.lit(split).alias("split"), F.lit(stage).alias("stage"), "license", "document_count", "estimated_tokens", F.array(*map(F.lit, steps)).alias("processing_steps"), F.sha2(F.concat_ws(":", "source", F.col("document_count").cast("string"), F.col("_keys").cast("string")), 256).alias("sha256"))
