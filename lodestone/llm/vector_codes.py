"""Vector code compression (operator 11): product codes over integer components, exact in every bit.

Vectors are cut into equal consecutive parts, and each part is named by the nearest entry of its position's codebook.
Nearest entries are screened by a float32 matrix product. An entry's distance, but for the point's own square, is
|c|^2 - 2 x.c; the product of length d is off by at most gamma |x| |c| in float32, gamma = (d + 2) u / (1 - (d + 2) u)
and u = 2^-24, in whatever order it is summed and also where a component is rounded to float32 (by Cauchy and Schwarz,
the sum of |x_i c_i| is at most |x| |c|). Each entry so has an interval that surely holds its value. Every entry whose
interval overlaps the best one is evaluated again in int64, and ties go to the lower index. Results do not depend on
the screening, on batches, or on the machine's matrix library.

Codebooks begin as the parts of the first vectors by identifier. A round sends one sum and one count for each part,
entry and component from each task, so what reaches the driver has the size of the codebooks and never that of the
table. The integer vectors are written once; each round reads them again, and a lost executor costs its tasks only.

Rows whose vector is null, empty, holds null or non-finite components or has another length than most are left out.
Rows without an identifier are coded, but give the codebooks their entries only where there are too few others. Of
equal identifiers the lesser vector comes first. Repeated rows count as often as they occur. Fewer vectors than
entries make smaller codebooks; equal entries are never told apart, the lower index wins. An empty table gives no
rows. Null labels are equal to each other. Further columns are not read, whatever they are called. Texts play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import spread_table, written
from lodestone.llm.vectors import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums of as many labels are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Products that are held at once in a task.
AT_ONCE = 1 << 21


@dataclass
class Codebooks:
    """entries[part, index] are integer vectors; codes name them by index."""

    entries: np.ndarray

    def text(self) -> str:
        return ",".join(map(str, self.entries.reshape(-1).tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The vector that a code stands for."""
        return [int(x) for part, index in enumerate(bytes.fromhex(code)) for x in self.entries[part, index]]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of int64 points the index of its nearest entry, the lowest of equally near ones, and its squared distance."""
    best, error = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    step = max(1, AT_ONCE // max(1, len(entries)))
    for at in range(0, len(points), step):
        best[at : at + step], error[at : at + step] = _nearest(points[at : at + step], entries)
    return best, error


def intervals(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of |c|^2 - 2 x.c for all points and entries, from a float32 product."""
    d = points.shape[1]
    product = (points.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    lengths = [np.sqrt(np.einsum("nd,nd->n", x.astype(np.float64), x.astype(np.float64))) for x in (points, entries)]
    u = (d + 2) * 2.0**-24
    squares = np.einsum("nd,nd->n", entries, entries).astype(np.float64)
    # The slack covers the roundings of this line's own float64 terms.
    radius = 2 * u / (1 - u) * (1 + 1e-6) * lengths[0][:, None] * lengths[1][None, :] + 2.0**-50 * (squares + 2 * np.abs(product))
    value = squares - 2 * product
    return value - radius, value + radius


def _nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = intervals(points, entries)
    rows, columns = np.nonzero(low <= high.min(axis=1, keepdims=True))  # of a row together, entries ascending
    apart = points[rows] - entries[columns]
    exact = np.einsum("nd,nd->n", apart, apart)
    begins = np.flatnonzero(np.diff(rows, prepend=-1))
    least = np.minimum.reduceat(exact, begins)
    winners = np.flatnonzero(exact == least[rows])
    first = winners[np.flatnonzero(np.diff(rows[winners], prepend=-1))]
    return columns[first], least


def _blocks(batches: Iterator[pa.RecordBatch], column: int, parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, matrix(batch.column(column), parts * width).reshape(-1, parts, width)


def _round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floor of the mean of its parts; entries that no part chose stay."""
    parts, entries, width = books.entries.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, points in _blocks(batches, 0, parts, width):
            for p in range(parts):
                best, _ = nearest(points[:, p], sent.value[p])
                order = np.argsort(best, kind="stable")
                begins = np.flatnonzero(np.diff(best[order], prepend=-1))
                total[p, best[order][begins]] += np.add.reduceat(points[order, p], begins, axis=0)
                count[p] += np.bincount(best, minlength=entries)
        place = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.reshape(-1)), pa.array(np.repeat(count.reshape(-1), width))], ["place", "total", "n"])

    rows = vectors.select("vector").mapInArrow(sums, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.entries.reshape(-1).copy()
    for place, total, n in rows.collect():  # one row for each number of the codebooks
        if n:
            out[place] = total // n
    sent.unpersist()
    return Codebooks(out.reshape(parts, entries, width))


def fit_codebooks(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """vectors: vec_id and integer `vector` of length dim."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hexadecimal digits for each part")
    if dim % parts:
        raise ValueError(f"vectors of {dim} components have no {parts} equal parts")
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    books = Codebooks(np.array([r.vector for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy())
    for _ in range(rounds if first else 0):
        books = _round(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with `code` (hexadecimal, two digits for each part) and `error` (squared distance of the coded vector) instead of `vector`."""
    parts, entries, width = books.entries.shape
    others = [c for c in vectors.columns if c != "vector"]
    sent = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points in _blocks(batches, len(others), parts, width):
            code, error = np.empty((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
            for p in range(parts):
                best, off = nearest(points[:, p], sent.value[p])
                code[:, p] = best
                error += off
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([row.tobytes().hex() for row in code], pa.string()), pa.array(error)], [*others, "code", "error"])

    ordered = vectors.select(*(F.col(f"`{c}`") for c in others), "vector")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-1])
    return ordered.mapInArrow(codes, f"{kinds}, code string, error long") if entries else ordered.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).drop("vector").limit(0)


def compress_vectors(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", broadcast_labels: int = BROADCAST_LABELS) -> tuple[DataFrame, Codebooks]:
    """vec_id, code, error and label_error (errors summed over rows of equal labels) of each row, and the codebooks."""
    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    whole, dim = integer_vectors(chosen, scale)
    vectors = written(whole, "vectors")
    books = fit_codebooks(vectors, dim, parts, entries, rounds)
    coded = written(encode(vectors, books), "codes")
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= broadcast_labels else sums
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(spread_table(spark, f"{sf_dir}/embeddings.parquet"))
    return codes.withColumn("codebooks_sha256", F.lit(books.sha256()))


def _op11_sql() -> str:
    """Rounds are written out one after another; all numbers are integers that doubles hold exactly."""
    steps = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"pieces AS (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS t(p))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < {ENTRIES})",
        "book0 AS (SELECT p, e, x AS c FROM pieces JOIN first USING (r))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"far{i} AS (SELECT r, p, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM pieces JOIN book{i} USING (p))")
        steps.append(f"near{i} AS (SELECT r, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM far{i} GROUP BY r, p)")
        if i < ROUNDS:
            steps.append(f"sums{i} AS (SELECT p, e, k, floor(sum(y) / count(*)) AS y FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM near{i}) GROUP BY p, e, k)")
            steps.append(f"mean{i} AS (SELECT p, e, list(y ORDER BY k) AS m FROM sums{i} GROUP BY p, e)")
            steps.append(f"book{i + 1} AS (SELECT p, e, coalesce(m, c) AS c FROM book{i} LEFT JOIN mean{i} USING (p, e))")
    last = f"""whole AS (SELECT r, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
  hashed AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN whole USING (r), hashed"""
    return "WITH " + ",\n  ".join([*steps, last])


OP11_SQL = _op11_sql()
