"""Toxicity (operator 7): cumulative-link ordinal regression over sparse text features.

Features are whole words and their first 4, 5 and 6 letters (lower case), so inflected and compounded forms count.
Out of the labelled sample come the cues: features of at least `CUE_SHARE` of the toxic rows (and `CUE_ROWS`) that
are rarely seen in clean ones. A row's vector holds log(1 + occurrences) of each cue and log(1 + cues per 100
words). One weight vector serves all thresholds, P(grade <= k) = sigmoid(threshold_k - w x), and the expected
severity is the sum over k of P(grade > k). A row is toxic if P(grade > 0) is at least `cut`.

Grades are the labels' own: 0 for clean rows, 1 and up in order of severity (those above the highest grade count as
it). Where labels tell toxic rows from clean ones only, grades above 1 are quantiles of the density of cues among
toxic rows. Such grades are made of a feature: they spread the expected severity by density, and only the first
threshold, on which `toxic` rests, then carries what labels say.

Training takes at most `TRAIN_ROWS` labelled rows (by the order of a hash of the identifier) and, of those that share
the three least hashes of their long words, one row: the most severe. Every row of the documents is scored, over its
whole text, however long; a long text's cues are set against all its words. Texts of equal scores have equal grades.

Null texts have no words and severity near 0. Labels that are null are left out, of several labels of an identifier
the largest counts. At the bound of the training rows, equal hashes are ordered by identifier. Without any toxic label,
or without cues, every row has severity 0; a table without rows gives none. Repeated rows give repeated results.
Columns besides the identifier and the text are not read, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, written

TRAIN_ROWS = 40_000
CUE_SHARE, CUE_ROWS = 0.01, 3
#: A cue's share of toxic rows among those that have it, both classes weighing the same.
CUE_PURITY = 0.97
PREFIXES = (4, 5, 6)
GRADES = 3
_WORDS = re.compile(r"\w+")
_AMOUNTS = "feature string, toxic long, clean long"


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def features(words: list[str]) -> set[str]:
    """' word ' stands for the whole word, ' wor' for words that begin so."""
    own = set(words)
    return {f" {w} " for w in own} | {f" {w[:n]}" for w in own for n in PREFIXES if len(w) >= n}


@dataclass
class OrdinalModel:
    cues: list[str]
    weights: np.ndarray  # one for each cue, then one for the density
    thresholds: np.ndarray  # ascending

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, cue in enumerate(self.cues):
            found.add_word(cue, i)
        if self.cues:
            found.make_automaton()
        return found

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def cue_counts(words: list[str], automaton) -> dict[int, int]:
    return Counter(i for _, i in automaton.iter(f" {' '.join(words)} ")) if words and len(automaton) else {}


def vector(counts: dict[int, int], n_words: int, n_cues: int) -> dict[int, float]:
    """Sparse vector of a text; the last place is the density of cues."""
    if not counts:
        return {}
    return {i: float(np.log1p(c)) for i, c in counts.items()} | {n_cues: float(np.log1p(100 * sum(counts.values()) / n_words))}


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, multiplicity: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-3, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link (logit) model, by full-batch gradient steps with momentum.

    multiplicity: how many rows each vector stands for."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    val = np.array([v for r in rows for v in r.values()], float)
    total = multiplicity.sum()
    w, base, gaps = np.zeros(n_features), 2.0, np.zeros(n_grades - 2)
    state = np.zeros((2, n_features + n_grades - 1))
    for step in range(1, steps + 1):
        theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(at, val * w[col], len(rows))
        upper = np.concatenate([theta, [np.inf]])[grades]
        lower = np.concatenate([[-np.inf], theta])[grades]
        with np.errstate(over="ignore"):
            up, low = 1 / (1 + np.exp(-(upper - score))), 1 / (1 + np.exp(-(lower - score)))
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p * multiplicity / total, low * (1 - low) / p * multiplicity / total
        g_score = d_up - d_low  # of the negative log-likelihood
        g_w = np.bincount(col, val * g_score[at], n_features) + l2 * w / max(1, n_features)
        g_theta = np.zeros(n_grades - 1)
        np.add.at(g_theta, grades[grades < n_grades - 1], -d_up[grades < n_grades - 1])
        np.add.at(g_theta, grades[grades > 0] - 1, d_low[grades > 0])
        g_gaps = np.array([g_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(n_grades - 2)])
        g = np.concatenate([g_w, [g_theta.sum()], g_gaps])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w, base, gaps = w - move[:n_features], base - move[n_features], gaps - move[n_features + 1 :]
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def signature(words: list[str]) -> int | None:
    """Made of the three least hashes of the long words; copies of a text, near ones too, mostly share it, other texts
    hardly ever. Texts of fewer long words have none: only equal ones are copies."""
    least = sorted({zlib.crc32(w.encode()) for w in set(words) if len(w) >= 8})[:3]
    return zlib.crc32(repr(least).encode()) if len(least) == 3 else None


def _without_copies(sample: DataFrame) -> DataFrame:
    """One row of each group of copies, lest the rare words of a group that is often copied pass for cues."""

    @F.pandas_udf("long")
    def sign(texts: pd.Series) -> pd.Series:
        return pd.Series([signature(words_of(x)) for x in texts], dtype="Int64")

    signed = sample.withColumn("_sign", F.coalesce(sign("text"), F.xxhash64("text")))
    # Of a group one row is kept while it is aggregated, so a large group is no burden.
    best = signed.groupBy("_sign").agg(F.max_by("text", F.struct("grade", F.xxhash64("text"))).alias("text"), F.max("grade").alias("grade"))
    return best.select("text", "grade")


def _amounts(sample: DataFrame, among: list[str] | None) -> DataFrame:
    """How many toxic and clean rows have each feature (each of `among`, if given)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if among is None else set(among)
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = features(words_of(text.as_py()))
                held[0 if toxic > 0 else 1].update(own if wanted is None else own & wanted)
        names = list(held[0].keys() | held[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[x] for x in part], pa.int64()) for c in held)], ["feature", "toxic", "clean"])

    found = sample.select("text", "grade").mapInArrow(count, _AMOUNTS)
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, grades: int = GRADES, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """labels: doc_id and toxic (0: clean; larger numbers: grades)."""
    if grades < 2:
        raise ValueError("an ordinal model needs two grades")
    nothing = OrdinalModel([], np.zeros(1), np.full(grades - 1, 500.0))
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.greatest(F.lit(0), F.least(F.lit(grades - 1), F.max("toxic"))).cast("int").alias("grade"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = written(_without_copies(rows.join(F.broadcast(chosen), "doc_id").select("text", "grade")), "labelled")  # at most train_rows identifiers
    n = {r.toxic: r["count"] for r in sample.groupBy((F.col("grade") > 0).alias("toxic")).count().collect()}
    if not n.get(True):
        return nothing
    least = max(CUE_ROWS, CUE_SHARE * n[True])
    # A row has as many features as words, so those of one toxic row in a hundred are boundedly many.
    often = [r.feature for r in _amounts(sample.where("grade > 0"), None).where(F.col("toxic") >= least).collect()]
    share = {r.feature: r.toxic / n[True] / (r.toxic / n[True] + (r.clean + 0.5) / (n.get(False, 0) + 1)) for r in _amounts(sample, often).collect()}
    cues = sorted(f for f, s in share.items() if s >= CUE_PURITY)
    if not cues:
        return nothing
    model = OrdinalModel(cues, np.zeros(len(cues) + 1), np.zeros(grades - 1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            out = []
            for text, grade in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = words_of(text.as_py())
                v = vector(cue_counts(words, automaton), len(words), len(cues))
                if v or grade:
                    out.append((grade, list(v.keys()), list(v.values())))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["grade", "at", "value"])

    found = sample.mapInArrow(vectors, "grade int, at array<int>, value array<double>").collect()  # at most train_rows
    found.sort(key=lambda r: (r.grade, r["at"], r.value))
    sparse = [dict(zip(r["at"], r.value, strict=True)) for r in found]
    grade = np.array([r.grade for r in found])
    toxic = grade > 0
    if grades > 2 and len(np.unique(grade[toxic])) == 1:
        density = np.array([v.get(len(cues), 0.0) for v in sparse])
        bounds = np.quantile(density[toxic], np.arange(1, grades - 1) / (grades - 1))
        grade = np.where(toxic, 1 + np.searchsorted(bounds, density, side="left"), 0)
    clean = n.get(False, 0) - int((~toxic).sum())
    w, theta = fit_ordinal([*sparse, {}], np.append(grade, 0), np.append(np.ones(len(sparse)), max(clean, 0)), len(cues) + 1, grades)
    return OrdinalModel(cues, w, theta)


def severity(model: OrdinalModel, text: Column) -> Column:
    """struct<severity double, p_toxic double> of a text column; severity lies between 0 and the highest grade."""

    @F.pandas_udf("severity double, p_toxic double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for texts in batches:
            scores = np.zeros(len(texts))
            for i, text in enumerate(texts):
                words = words_of(text)
                scores[i] = sum(v * model.weights[j] for j, v in vector(cue_counts(words, automaton), len(words), len(model.cues)).items())
            p = model.probabilities(scores)
            yield pd.DataFrame({"severity": p.sum(axis=1), "p_toxic": p[:, 0]})

    return score(text)


def score_toxicity(docs: DataFrame, model: OrdinalModel, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity, p_toxic, toxic for every row of `docs`."""
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), severity(model, F.col(text_col).cast("string")).alias("_s"))
    return scored.select("doc_id", F.col("_s.severity").alias("severity"), F.col("_s.p_toxic").alias("p_toxic"), (F.col("_s.p_toxic") >= cut).alias("toxic"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
