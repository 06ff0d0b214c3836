"""Token counts (operator 2): batch encoding in Arrow functions that returns lengths only.

A text is cut before every run of white space that follows another character, and a piece that is still long also
between an ASCII letter and an ASCII digit. The byte-level pattern never joins what stands on the two sides of such
places, and special strings hold no white space and no digit, so the counts of the pieces add up to the count of the
text, however long it is. Each distinct piece is encoded once per worker, in batches of nearly equal bytes. Whether a
file has that pattern, no normalizer and such special strings is read from the file (`cuts_are_safe`); texts of other
files are encoded whole, as are those of sentencepiece models, whose words are not independent.

Null and empty texts have no bytes and no tokens; repeated rows are counted each; a table without rows gives none.
Columns besides the identifier and the text are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.tokenizers import Counter, _counter, _groups, balanced, cuts_are_safe, pieces  # noqa: F401
from lodestone.llm.common import documents

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: its identifier, UTF-8 bytes, tokens, and whether these exceed `limit`.

    `tokenizer`: a file that every executor has at this path (.json or .model)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            texts = [x or "" for x in texts]
            sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
            n = [c for a, b in _groups(sizes) for c in counter.counts(texts[a:b])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
