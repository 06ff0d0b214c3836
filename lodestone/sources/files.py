"""Files of any store that Arrow or Hadoop can reach: a path may be local, file:, hdfs:, s3: or the like.

Executors go through Arrow's file systems, the driver through Hadoop's, so folders need only be shared, not mounted."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs as arrow
from pyspark.sql import SparkSession


class FileError(ValueError):
    """A file is missing, not alone, or not what it should be."""


def store(path: str) -> tuple[arrow.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return arrow.FileSystem.from_uri(path)


def listed(folder: str, suffix: str) -> list[arrow.FileInfo]:
    """Files of a folder by name; none where there is no folder."""
    files, where = store(folder)
    found = files.get_file_info(arrow.FileSelector(where, allow_not_found=True))
    return sorted((f for f in found if f.type == arrow.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(".")), key=lambda f: f.base_name)


def read(path: str) -> bytes:
    files, where = store(path)
    with files.open_input_stream(where) as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    """Under a temporary name first, so that nobody sees half a file."""
    files, where = store(path)
    folder, _, name = where.rpartition("/")
    files.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as f:
        f.write(data)
    files.move(part, where)


def read_object(path: str) -> dict:
    """A JSON file that holds an object; anything else is an error."""
    value = json.loads(read(path))
    if not isinstance(value, dict):
        raise FileError(f"{path} holds no object")
    return value


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path, on the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def found(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files that any pattern matches, each once, in order."""
    out = set()
    for pattern in patterns:
        files, where = hadoop(spark, pattern)
        out |= {s.getPath().toString() for s in files.globStatus(where) or []}
    return sorted(out)


def only(spark: SparkSession, patterns: list[str]) -> str:
    """The one file that the patterns match."""
    files = found(spark, patterns)
    if len(files) != 1:
        raise FileError(f"{len(files)} files match {patterns}")
    return files[0]


def cleared(spark: SparkSession, folder: str, overwrite: bool, mark: str = "_BUILD") -> str:
    """A folder for a build, empty but for its mark. One that holds other things is refused, and so is one that has no
    mark or lies fewer than two levels below the root, even if it may be overwritten."""
    files, where = hadoop(spark, folder)
    marked = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, mark)
    if files.exists(where) and files.listStatus(where):
        if not overwrite:
            raise FileError(f"{folder} isn't empty")
        if not files.exists(marked) or where.depth() < 2:
            raise FileError(f"{folder} wasn't made by a build")
        files.delete(where, True)
    files.mkdirs(where)
    files.create(marked, True).close()
    return folder
