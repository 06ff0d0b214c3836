"""Language identification by character trigrams, learnt from labelled texts.

Texts are seen as words of letters: A-Z count as a-z, every run of other ASCII characters as one blank, and a text has a
blank at both ends. A trigram's weight for a language is 1000 ln((its count + 1) / (all counts + trigrams)), rounded
down, and a text's score is the sum over all its trigrams that the model knows. The language of the highest score wins,
of equal ones the first by name. A text without letters has no language.

The model is as large as its bounds say, however many texts there are; every text is scored, whole, in pieces of bounded
size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import in_fraction
from lodestone.sources.scratch import table

#: Labelled texts to learn from, about; least count of a trigram, and trigrams of a model.
TRAIN_ROWS, LEAST, MOST = 20_000, 5, 50_000
PIECE = 1 << 20


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Trigrams as numbers of three code points of 21 bits, piece by piece."""
    tail, after_letter = np.array([32], np.int64), False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
        letter = (codes >= 128) | ((codes >= 97) & (codes <= 122))
        kept = letter | np.concatenate([[after_letter], letter[:-1]])  # of a run of others the first one, as a blank
        stream = np.concatenate([tail, np.where(letter, codes, 32)[kept]])
        after_letter = bool(letter[-1])
        yield (stream[:-2] << 42) | (stream[1:-1] << 21) | stream[2:]
        tail = stream[-2:]
    if tail[-1] != 32:
        yield np.array([(int(tail[-2]) << 42) | (int(tail[-1]) << 21) | 32], np.int64)


def as_text(gram: int) -> str:
    return "".join(chr(gram >> s & 0x1FFFFF) for s in (42, 21, 0))


@dataclass
class Model:
    """languages, by name; grams, ascending; weights[gram, language]."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray

    def scores(self, text: str) -> tuple[int, np.ndarray]:
        """How many trigrams a text has, and its score for each language."""
        n, total = 0, np.zeros(len(self.languages), np.int64)
        for grams in trigrams(text):
            n += len(grams)
            if len(self.grams):
                at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
                total += self.weights[at[self.grams[at] == grams]].sum(axis=0)
        return n, total

    def told(self, text: str | None) -> tuple[int, str | None, int]:
        """Trigrams, language, and by how much its score is above the next one's."""
        n, total = self.scores(text or "")
        if not n or not self.languages:
            return n, None, 0
        order = np.lexsort((np.arange(len(total)), -total))
        return n, self.languages[order[0]], int(total[order[0]] - total[order[1]]) if len(total) > 1 else 0


#: Trigrams that are counted at a time, and distinct ones that a task holds before it passes them on.
COUNTED, HELD = 1 << 20, 1 << 20


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and how often each stands, of several such pairs."""
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(grams), np.int64)
    np.add.at(n, at, np.concatenate([k for _, k in parts]))
    return grams, n


class _Counter:
    """How often each trigram stands in the texts of a language, counted by bounded stretches."""

    def __init__(self):
        self.told, self.open, self.n = [], [], 0

    def add(self, grams: np.ndarray) -> None:
        self.open.append(grams)
        self.n += len(grams)
        if self.n >= COUNTED:
            self.close()

    def close(self) -> None:
        if self.open:
            self.told = [_summed([*self.told, np.unique(np.concatenate(self.open), return_counts=True)])]
            self.open, self.n = [], 0


def _counts(rows: DataFrame) -> DataFrame:
    def told(language: str, counter: _Counter) -> Iterator[pa.RecordBatch]:
        counter.close()
        for grams, n in counter.told:
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["language", "gram", "n"])
        counter.told = []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counter = counters.setdefault(language, _Counter())
                for grams in trigrams(text.as_py()):
                    counter.add(grams)
                if sum(len(g) for g, _ in counter.told) >= HELD:
                    yield from told(language, counter)
        for language, counter in counters.items():
            yield from told(language, counter)

    return rows.mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", label: str = "lang", rows: int | None = TRAIN_ROWS, least: int = LEAST, most: int = MOST) -> Model:
    """A model from at most about `rows` labelled texts, chosen by the hash of the text; without a number, from all."""
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("language"), F.col(text).alias("text"))
    n = 0 if rows is None else known.count()
    sample = known if rows is None or n <= rows else known.where(in_fraction(F.col("text"), rows / n))
    counts = table(_counts(sample), "trigrams")
    often = counts.groupBy("gram").agg(F.sum("n").alias("all")).where(F.col("all") >= least).orderBy(F.desc("all"), "gram").limit(most)
    held = counts.join(often, "gram").select("language", "gram", "n").collect()  # at most `most` for each language
    languages, grams = sorted({r.language for r in held}), np.array(sorted({r.gram for r in held}), np.int64)
    count = np.zeros((len(grams), len(languages)), np.int64)
    if held:
        count[np.searchsorted(grams, [r.gram for r in held]), [languages.index(r.language) for r in held]] = [r.n for r in held]
    total = count.sum(axis=0)
    weights = np.array([[math.floor(1000 * math.log((int(c) + 1) / (int(t) + len(grams)))) for c, t in zip(row, total, strict=True)] for row in count], np.int64)
    return Model(languages, grams, weights.reshape(len(grams), len(languages)))


def identified(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of `keep` with n_grams, language (null: no letters) and margin."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                told = [sent.value.told(t.as_py()) for t in some.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *(pa.array([x[i] for x in told], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64())))], [*keep, "n_grams", "language", "margin"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tell, f"{kinds}, n_grams long, language string, margin long")
