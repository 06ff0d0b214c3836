"""Benchmark decontamination (operator 9) by winnowing, with DataFrame functions only.

Words are hashed, runs of `K` word hashes are hashed again, and of every `WINDOW - K + 1` consecutive ones the least
is kept with its place (the first of equal ones). Two texts that share `WINDOW` words therefore keep the same hash
at the same place of the shared words, so joining kept hashes finds every such span. Hits are extended word by word,
by at most WINDOW - K words to each side, and count if the words (their 64-bit hashes, one by one) agree over at
least WINDOW words. The benchmark's side of that join holds each kept hash with the words around it once, however
many items have them; items are looked up after a hit has been verified.

Benchmark items of fewer words than a window are windows themselves: they are looked up by the hash of all their
words among the document's runs of that length. This costs nothing where there are none.

Kept benchmark hashes are broadcast if they are at most `BROADCAST_ROWS`; beyond that both sides are shuffled by
hash.

Null texts have no words, null and repeated item ids and repeated items are items like others (a null id adds
nothing to items_sha256). A row is a document, so repeated rows give repeated results. Empty tables give no hits.
Columns besides identifiers and texts are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_words, documents, rolling_hashes, text_hash, written

WINDOW, K = 10, 5
BROADCAST_ROWS = 200_000
#: Low bits of a kept hash that hold its place; a string has less than 2 ** 31 bytes, so any place fits.
PLACE_BITS = 31


def _packed(grams: Column) -> Column:
    """High bits of each hash, its place in the low bits."""
    return F.transform(grams, lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long")))


def winnowed(packed: Column, span: int) -> Column:
    """Kept hashes of `packed` (a column by name: within a lambda any other expression would be evaluated anew)."""
    n = F.size(packed)
    return F.when(n >= span, F.array_distinct(F.transform(F.sequence(F.lit(0), n - span), lambda i: F.least(*(F.get(packed, i + j) for j in range(span)))))).otherwise(F.array().cast("array<bigint>"))


def _place(kept: Column) -> Column:
    return kept.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _prints(rows: DataFrame, lengths: list[int], window: int, k: int) -> DataFrame:
    """rows with `words`: adds probes, array<struct<m, at, h, ctx, off>>: winnowed hashes (m 0) and hashes of runs of m
    words, each with the hashes of the words around it and its own place among them.

    Probes carry at most window + (window - k) word hashes, never the text, so long texts cost in proportion."""
    side = window - k
    hashed = rows.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    hashed = hashed.withColumn("_grams", rolling_hashes(F.col("_hashes"), k))
    hashed = hashed.withColumn("_packed", _packed(F.col("_grams")))
    hashed = hashed.withColumn("_kept", winnowed(F.col("_packed"), side + 1))

    def around(x: Column) -> Column:
        at = _place(x)
        begin = F.greatest(at - side, F.lit(0))
        return F.struct(F.lit(0).alias("m"), at.alias("at"), F.get("_grams", at).alias("h"), F.slice("_hashes", begin + 1, F.lit(window + side)).alias("ctx"), (at - begin).alias("off"))

    def run(m: int) -> Column:
        return F.transform(rolling_hashes(F.col("_hashes"), m), lambda h, i: F.struct(F.lit(m).alias("m"), i.alias("at"), h.alias("h"), F.slice("_hashes", i + 1, F.lit(m)).alias("ctx"), F.lit(0).alias("off")))

    kept = F.transform("_kept", around)
    return hashed.withColumn("probes", F.concat(kept, *map(run, lengths)) if lengths else kept).drop("_hashes", "_grams", "_packed", "_kept")


def benchmark_prints(items: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame, list[int]]:
    """m, h, item_ctx, item_off as in `_prints`, each once, under the number `print`; print and item_id; and the lengths of items shorter than a window."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), ascii_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    short = sorted(r[0] for r in words.where(F.size("words") < window).select(F.size("words").alias("m")).distinct().collect())  # numbers below the window
    runs = _prints(words, short, window, k).select("item_id", F.size("words").alias("n"), F.explode_outer("probes").alias("p")).select("item_id", "n", "p.*")
    own = runs.where((F.col("m") == 0) | (F.col("m") == F.col("n"))).select("m", "h", F.col("ctx").alias("item_ctx"), F.col("off").alias("item_off"), "item_id")
    what = ["m", "h", "item_ctx", "item_off"]
    prints = written(own.groupBy(*what).agg(F.count(F.lit(1)).alias("n")).withColumn("print", F.monotonically_increasing_id()), "prints")
    return prints.select(*what, "print"), own.distinct().join(prints, what).select("print", "item_id"), short


def _extended(window: int, k: int) -> tuple[Column, Column]:
    """First word and end of the agreement around a hit; both null where it is shorter than the window."""
    at, m = F.col("at"), F.col("m")

    def same(j: int) -> Column:
        return F.coalesce(F.get("ctx", F.col("off") + j) == F.get("item_ctx", F.col("item_off") + j), F.lit(False))

    core = same(0)
    for j in range(1, k):
        core = core & same(j)
    # Nested from the outermost word inwards, so a mismatch next to the hit stops the count.
    left, right = F.lit(0), F.lit(0)
    for j in range(window - k, 0, -1):
        left = F.when(same(-j), F.lit(1) + left).otherwise(0)
        right = F.when(same(k + j - 1), F.lit(1) + right).otherwise(0)
    long_enough = core & (left + right + k >= window)
    whole = F.col("ctx") == F.col("item_ctx")
    return F.when(m == 0, F.when(long_enough, at - left)).when(whole, at), F.when(m == 0, F.when(long_enough, at + k + right)).when(whole, at + m)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_hash, n_words, n_hit, spans (merged hit words as begin, end), items (sorted ids)."""
    prints, holders, short = benchmark_prints(items, window, k)
    holders = written(holders, "holders")
    small = max(prints.limit(broadcast_rows + 1).count(), holders.limit(broadcast_rows + 1).count()) <= broadcast_rows
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), ascii_words(F.col(text_col)).alias("words"))
    # explode_outer: for explode, Spark would infer a filter that computes all of this a second time, inlined.
    # The first probe stands for the row itself, whatever it hits; its hash is the row's number, so no task gets all.
    itself = F.array(F.struct(F.lit(-1).alias("m"), F.lit(0).alias("at"), F.col("row").alias("h"), F.array().cast("array<bigint>").alias("ctx"), F.lit(0).alias("off")))
    probes = _prints(rows, short, window, k).select("row", "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.concat(itself, F.col("probes"))).alias("p")).select("row", "doc_id", "text_hash", "n_words", "p.*")
    hits = probes.join(F.broadcast(prints) if small else prints, ["m", "h"], "left").where((F.col("m") == -1) | F.col("item_off").isNotNull())
    begin, end = _extended(window, k)
    # A row's own probe has no print; it gets a number of its own, lest one task of the next join receive all of them.
    found = hits.select("row", "doc_id", "text_hash", "n_words", "m", F.coalesce("print", F.lit(-1) - F.col("row")).alias("print"), begin.alias("begin"), end.alias("end")).where((F.col("m") == -1) | F.col("begin").isNotNull())
    found = found.join(F.broadcast(holders) if small else holders, "print", "left")
    per_row = found.groupBy("row", "doc_id", "text_hash", "n_words").agg(F.collect_set(F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))).alias("hits"), F.collect_set("item_id").alias("items"))
    # One pass over a row's spans in order: (merged spans so far, the open span).
    nothing = F.struct(F.array().cast("array<struct<begin:int,end:int>>").alias("done"), F.lit(-1).alias("begin"), F.lit(-1).alias("end"))

    def merge(acc: Column, x: Column) -> Column:
        joins = x["begin"] <= acc["end"]
        closed = F.when(acc["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end")))))
        return F.struct(F.when(joins, acc["done"]).otherwise(closed).alias("done"), F.when(joins, acc["begin"]).otherwise(x["begin"]).alias("begin"), F.when(joins, F.greatest(acc["end"], x["end"])).otherwise(x["end"]).alias("end"))

    def finish(acc: Column) -> Column:
        return F.when(acc["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end")))))

    spans = F.aggregate(F.array_sort("hits"), nothing, merge, finish)
    merged = per_row.select("doc_id", "text_hash", "n_words", spans.alias("spans"), F.array_sort("items").alias("items"))
    hit_words = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["begin"]))
    return merged.select("doc_id", "text_hash", "n_words", hit_words.alias("n_hit"), "spans", "items")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(documents(spark, sf_dir), items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM windows
), grams AS (
  SELECT r, m, s, array_to_string(w[s + 1 : s + m], ' ') AS gram
  FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM d, sizes WHERE len(w) >= m)
), hits AS (SELECT r, s, g.m, item_id FROM grams g JOIN windows USING (m, gram)
), hit_words AS (SELECT r, count(DISTINCT s + j) AS n_hit FROM (SELECT DISTINCT r, s, m, unnest(range(0, m)) AS j FROM hits) GROUP BY r
), found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN found USING (r)
"""
