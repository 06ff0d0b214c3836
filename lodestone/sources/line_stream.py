"""A stream of the lines of files, which goes on where it stopped, also inside a file.

register(spark) makes `spark.readStream.format("line_stream")` known, with the options

- path: a folder of files that don't change once they are there; new ones come later by name;
- suffix: which files (".jsonl");
- batch_bytes: how much a micro-batch takes at most, over all files (0: all there is);
- part_bytes: how much one task reads at most;
- cursor: a folder that remembers what has been planned, and where a `pause` marker asks for no more batches.

An offset names a file and a number of bytes of it; all files before it are done. A line belongs to the stretch in which
it begins, so offsets need not fall between lines, and nobody reads a file to plan a batch. Reading is steady: errors of
the store that may pass lead to a new start after the last line that was read (`sources.retry`). What Spark has planned
lies in the query's checkpoint; the cursor only sees to it that a new session never plans behind that."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileInfo, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.sources import files
from lodestone.sources.retry import Limits, steady

CHUNK, ROWS, PART_BYTES = 1 << 20, 4096, 32 << 20


@dataclass
class Stretch(InputPartition):
    """Bytes begin .. end - 1 of a file: the lines that begin there."""

    path: str = ""
    name: str = ""
    begin: int = 0
    end: int = 0


def stretch(path: str, name: str, begin: int, end: int) -> Stretch:
    part = Stretch(None)
    part.path, part.name, part.begin, part.end = path, name, begin, end
    return part


def lines_between(file, begin: int, end: int, chunk_bytes: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [begin, end) of an open file, without their line feeds."""
    at = max(0, begin - 1)  # the byte before tells whether a line begins at `begin`
    file.seek(at)
    start, skipping, held = at, begin > 0, []
    while chunk := file.read(chunk_bytes):
        cut = 0
        while (to := chunk.find(b"\n", cut)) >= 0:
            if not skipping:
                yield start, b"".join(held) + chunk[cut:to]
            skipping, held, cut = False, [], to + 1
            start = at + cut
            if start >= end:
                return
        held.append(chunk[cut:])
        at += len(chunk)
    if not skipping and any(held):
        yield start, b"".join(held)


def steady_lines(store, path: str, begin: int, end: int, limits: Limits | None = None, **waiting) -> Iterator[tuple[int, bytes]]:
    """The same, over failures of the store that may pass; each line once."""
    at = begin

    def rows_from(_: int) -> Iterator[tuple[int, bytes]]:
        nonlocal at
        if at < end:
            with store.open_input_file(path) as f:
                for place, line in lines_between(f, at, end):
                    at = place + len(line) + 1
                    yield place, line

    return steady(rows_from, limits=limits, **waiting)


def planned(there: list[FileInfo], start: dict, most: int) -> dict:
    """The offset after at most `most` bytes from `start` (0: all)."""
    left, at = most or sum(f.size for f in there) + 1, dict(start)
    for f in there:
        if f.base_name < start["file"]:
            continue
        begin = start["at"] if f.base_name == start["file"] else 0
        step = min(left, f.size - begin)
        if step > 0:
            at, left = {"file": f.base_name, "at": begin + step}, left - step
        if not left:
            break
    return at


def stretches(there: list[FileInfo], start: dict, end: dict, part_bytes: int) -> list[Stretch]:
    out = []
    for f in there:
        if start["file"] <= f.base_name <= end["file"]:
            begin = start["at"] if f.base_name == start["file"] else 0
            last = end["at"] if f.base_name == end["file"] else f.size
            out += [stretch(f.path, f.base_name, a, min(a + part_bytes, last)) for a in range(begin, last, part_bytes)]
    return out


class _Lines:
    def __init__(self, options):
        self.path, self.suffix, self.part_bytes = options["path"], options.get("suffix", ".jsonl"), int(options.get("part_bytes", PART_BYTES))
        self.limits = Limits(first=float(options.get("first_delay", Limits.first)))

    def there(self) -> list[FileInfo]:
        return files.listed(self.path, self.suffix)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = files.store(self.path)
        held: list[tuple[int, bytes]] = []
        for row in steady_lines(store, partition.path, partition.begin, partition.end, self.limits):
            held.append(row)
            if len(held) == ROWS:
                yield self.batch(partition.name, held)
                held = []
        if held:
            yield self.batch(partition.name, held)

    @staticmethod
    def batch(name: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].decode("utf-8", "replace") for r in rows])], ["file", "at", "value"])


class _Whole(_Lines, DataSourceReader):
    def partitions(self):
        there = self.there()
        return stretches(there, {"file": "", "at": 0}, planned(there, {"file": "", "at": 0}, 0), self.part_bytes) or [stretch("", "", 0, 0)]

    def read(self, partition):
        return _Lines.read(self, partition) if partition.path else iter(())


class _Stream(_Lines, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.cursor, self.batch_bytes = options.get("cursor"), int(options.get("batch_bytes", 0))
        self.at = self.remembered()

    def initialOffset(self):
        return {"file": "", "at": 0}

    def remembered(self) -> dict:
        return files.read_object(f"{self.cursor}/planned.json") if self.cursor and files.listed(self.cursor, "planned.json") else self.initialOffset()

    def latestOffset(self):
        if not (self.cursor and files.listed(self.cursor, "pause")):
            self.at = planned(self.there(), self.at, self.batch_bytes)
            if self.cursor and self.at != self.remembered():
                files.write(f"{self.cursor}/planned.json", json.dumps(self.at, sort_keys=True).encode())
        return self.at

    def partitions(self, start, end):
        self.at = max(self.at, end, key=lambda x: (x["file"], x["at"]))  # a batch that is run again may be ahead of a lost cursor
        return stretches(self.there(), start, end, self.part_bytes)

    def commit(self, end):
        if self.cursor:
            files.write(f"{self.cursor}/committed.json", json.dumps(end, sort_keys=True).encode())


class LineStream(DataSource):
    @classmethod
    def name(cls):
        return "line_stream"

    def schema(self):
        return "file string, at long, value string"

    def reader(self, schema):
        return _Whole(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineStream)


def pause(cursor: str) -> None:
    """No batch is planned from now on; one that runs goes on to its end."""
    files.write(f"{cursor}/pause", b"")


def resume(cursor: str) -> None:
    store, where = files.store(f"{cursor}/pause")
    if store.get_file_info(where).type == FileType.File:
        store.delete_file(where)
