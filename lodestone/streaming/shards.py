"""A corpus build as a stream that ends in token shards: lines, texts, tokens, budgets, partials, shards.

Every step resumes: the source goes on inside a file, state lies in the checkpoint, a batch that is run again finds its
transaction, and shards are made of committed partials only. A changed configuration refuses to resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.hashing import dedup_key
from lodestone.functions.text import normalize_corpus
from lodestone.operators.corpus import MIN_CHARS
from lodestone.sources import line_stream, shard_sink
from lodestone.streaming.budget import budget_stream
from lodestone.streaming.build import guard
from lodestone.streaming.session import Progress, run_session

ROW = "source string, doc_id long, text string"
#: The end of a document; a fixed value.
END = 3


def packed(tokens: Column) -> Column:
    """array<int> below 65,536 as two little-endian bytes each."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    return F.unhex(F.array_join(F.transform(tokens, lambda t: F.concat(byte(t % 256), byte(F.floor(t / 256)))), ""))


def hashed_words(text: Column, vocabulary: int = 32_000) -> Column:
    """Runs of non-blanks as numbers from 4 on, by hash: token ids where no tokenizer file is at hand."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), 0)
    return F.transform(words, lambda w: (F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("long") % (vocabulary - 4) + 4).cast("int"))


def documents_of(lines: DataFrame) -> DataFrame:
    """source, doc_id and text of lines that hold such objects; a line that doesn't is an error."""
    parsed = lines.select(F.from_json("value", ROW, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return parsed.where("source IS NOT NULL AND doc_id IS NOT NULL")


def tokenized(docs: DataFrame, tokens: Callable[[Column], Column], min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows of `budget_stream`: normalized texts of at least `min_chars` characters as tokens and their end."""
    text = F.col("_normal")
    rows = docs.withColumn("_normal", normalize_corpus(F.col("text"))).where(F.length("_normal") >= min_chars)
    whole = rows.select("source", "doc_id", dedup_key(text).alias("key"), F.concat(tokens(text), F.array(F.lit(END))).alias("_t"))
    return whole.select("source", "doc_id", "key", F.size("_t").cast("long").alias("n_tokens"), packed(F.col("_t")).alias("tokens"))


def line_frames(spark: SparkSession, lines: str, cursor: str, batch_bytes: int = 0, **options) -> DataFrame:
    line_stream.register(spark)
    return spark.readStream.format("line_stream").options(path=lines, cursor=cursor, batch_bytes=batch_bytes, **options).load()


def stream_session(spark: SparkSession, lines: str, folder: str, target: int, tokens: Callable[[Column], Column] = hashed_words, batch_bytes: int = 64 << 20, seconds: float | None = None, batches: int | None = None, **options) -> Progress:
    """One session of a build of `target` tokens for each source into folder/partials; call again to go on.

    lines: a folder of JSON lines of source, doc_id and text, in the order in which documents are to be taken."""
    guard(spark, folder, {"target": target, "min_chars": MIN_CHARS, "lines": lines})
    shard_sink.register(spark)
    cursor = f"{folder}/cursor"

    def start():
        rows = tokenized(documents_of(line_frames(spark, lines, cursor, batch_bytes, **options)), tokens)
        cut = budget_stream(rows, target).select("source", "start", "tokens")
        return cut.writeStream.format("token_partials").option("path", folder).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").start()

    return run_session(spark, start, cursor, seconds, batches)


def write_lines(docs: DataFrame, folder: str, order: list[str], files: int) -> None:
    """Rows as JSON lines over files whose names are in their order."""
    ordered = docs.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.text(folder)
