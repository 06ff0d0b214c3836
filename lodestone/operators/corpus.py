"""Corpus building: licences, rejection reasons, exact deduplication, splits, budgets, shards, schedules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.hashing import content_hash, hash_in_fraction
from lodestone.functions.text import normalize_corpus, whitespace_tokens
from lodestone.operators.ordered import null_safe_join, prefix_sum
from lodestone.sources.scratch import table

#: Licences that the code source accepts; fixed values.
ALLOWED_LICENSES = ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense"]
MIN_CHARS = 120


def text_license(text: Column) -> Column:
    """The licence that a text names, as a short label; null if it names none."""
    rules = [("mit", "mit license"), ("apache-2.0", "apache license"), ("gpl-3.0", "gnu general public license"), ("cc-by-4.0", "cc by")]
    out = F.lit(None).cast("string")
    for label, phrase in reversed(rules):
        out = F.when(F.lower(text).contains(phrase), label).otherwise(out)
    return out


def license_allowed(license_col: Column, allowed: list[str] | None) -> Column:
    """No list keeps all; a missing licence is 'none' and is refused by any list."""
    if allowed is None:
        return F.lit(True)
    return F.lower(F.coalesce(license_col, F.lit("none"))).isin([x.lower() for x in allowed])


def license_allowed_or_blank(license_col: Column, allowed: list[str]) -> Column:
    """The older rule: a blank licence passes."""
    name = F.lower(F.trim(F.coalesce(license_col, F.lit(""))))
    return (name == "") | name.isin([x.lower() for x in allowed])


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Exact deduplication: the row of least ordinal of each key stays.

    Only keys and ordinals are aggregated (partially before the shuffle), so a key that holds most rows is no burden."""
    first = df.groupBy(*keys).agg(F.min(ordinal).alias("_first"))
    match = F.col(ordinal) == F.col("_first")
    named = first.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_first")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(named, match, "left_semi")


def without_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier run has not stored."""
    return df.join(seen.select(key), key, "left_anti")


def normalized(docs: DataFrame, unicode_form: bool = True) -> DataFrame:
    return docs.withColumn("text", normalize_corpus(F.col("text"), unicode_form))


def measured(docs: DataFrame, keep: list[str], tokens: Callable[[Column], Column] = whitespace_tokens, validation_fraction: float = 0.05) -> DataFrame:
    """What later steps need to know of each text, written once: the columns of `keep`, key (16 bytes of the normalized
    text's hash), chars, n_tokens (its end included) and validation. Texts are normalized once and never shuffled."""
    text = F.col("_normal")
    rows = docs.withColumn("_normal", normalize_corpus(F.col("text")))
    hashed = rows.select(*keep, content_hash(text).alias("_sha"), F.length(text).cast("long").alias("chars"), (tokens(text) + 1).alias("n_tokens"))
    return table(hashed.select(*keep, F.unhex(F.substring("_sha", 1, 32)).alias("key"), "chars", "n_tokens", hash_in_fraction(F.col("_sha"), validation_fraction).alias("validation")), "measured")


def rejection_reasons(docs: DataFrame, allowed: list[str] | None, validation_fraction: float, mode: str = "train", scope: list[str] | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs: doc_id, source, text, license. doc_id, source, the columns of `scope`, key, chars, n_tokens and `reason`:
    license, not_text, short, duplicate, split, or null if accepted.

    The order of checks is the builder's: split-rejected documents are never remembered, so of equal texts each is
    rejected by split, and a duplicate is one of an accepted document."""
    scope = scope or ["source"]
    about = {"_refused": ~license_allowed(F.col("license"), allowed), "_null": F.col("text").isNull()}
    rows = measured(docs.withColumns(about), [*dict.fromkeys(["doc_id", "source", *scope, *about])], validation_fraction=validation_fraction)
    wrong_split = {"train": F.col("validation"), "validation": ~F.col("validation"), "all": F.lit(False)}[mode]
    early = F.when(F.col("_refused"), "license").when(F.col("_null"), "not_text").when(F.col("chars") < min_chars, "short").when(wrong_split, "split")
    rows = rows.withColumn("_early", early)
    firsts = rows.where("_early IS NULL").groupBy(*scope, "key").agg(F.min("doc_id").alias("_first"))
    reason = F.coalesce("_early", F.when(F.col("doc_id") != F.col("_first"), "duplicate"))
    return null_safe_join(rows, firsts, [*scope, "key"], "left").withColumn("reason", reason).drop("_early", "_first", *about)


def reason_counters(reasons: DataFrame) -> DataFrame:
    """One row for each source: rows read, accepted, and rejected by reason."""
    names = ["license", "not_text", "short", "split", "duplicate"]
    return reasons.groupBy("source").agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("reason").isNull()).alias("accepted"), *(F.count_if(F.col("reason") == n).alias(f"rejected_{n}") for n in names))


def budget_cut(docs: DataFrame, by: list[str], ordinal: str, tokens: Column, target: int) -> DataFrame:
    """Adds n_tokens, start and kept: documents in order until their tokens sum up to `target` exactly; the last is cut."""
    rows = docs.withColumn("n_tokens", tokens)
    out = prefix_sum(rows, by, ordinal, F.col("n_tokens"), "start")
    return out.withColumn("kept", F.least(F.col("n_tokens"), F.greatest(F.lit(0), F.lit(target) - F.col("start"))).cast("long")).where("kept > 0")


def shard_pieces(cut: DataFrame, shard_tokens: int) -> DataFrame:
    """Rows of `budget_cut` to the parts of shards they fill: shard, offset in the shard, tokens, offset in the document."""
    first, last = F.floor(F.col("start") / shard_tokens), F.floor((F.col("start") + F.col("kept") - 1) / shard_tokens)
    rows = cut.withColumn("shard", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin = F.greatest(F.col("start"), F.col("shard") * shard_tokens)
    end = F.least(F.col("start") + F.col("kept"), (F.col("shard") + 1) * shard_tokens)
    return rows.withColumns({"shard_offset": (begin - F.col("shard") * shard_tokens).cast("long"), "tokens": (end - begin).cast("long"), "doc_offset": (begin - F.col("start")).cast("long")})


def shard_manifest(pieces: DataFrame, by: list[str]) -> DataFrame:
    """One row for each shard: tokens, bytes (two for each token), pieces, first and last document."""
    return pieces.groupBy(*by, "shard").agg(F.sum("tokens").alias("tokens"), (F.sum("tokens") * 2).alias("bytes"), F.count(F.lit(1)).alias("pieces"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def fair_order(docs: DataFrame, weights: DataFrame, ordinal: str = "doc_id") -> DataFrame:
    """docs: source, ordinal, n_tokens; weights: source, weight. Adds `turn`: tokens written before over weight; ascending turn is the schedule.

    A source without a weight raises an error, as its documents would have no turn."""
    if unknown := docs.select("source").distinct().join(weights, "source", "left_anti").take(5):
        raise ValueError(f"sources without a weight: {', '.join(map(str, sorted(str(r.source) for r in unknown)))}")
    rows = prefix_sum(docs, ["source"], ordinal, F.col("n_tokens"), "written").join(F.broadcast(weights), "source")  # one row for each configured source
    return rows.withColumn("turn", F.col("written") / F.col("weight"))


def fair_shard_plan(shards: DataFrame) -> DataFrame:
    """shards: source, shard, tokens (one row for each shard file). Adds `turn`: the share of its source scheduled before it."""
    by = Window.partitionBy("source").orderBy("shard")
    before = F.coalesce(F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("turn", before / F.sum("tokens").over(Window.partitionBy("source")))


def interleaved(rows: DataFrame, category: str, ordinal: str) -> DataFrame:
    """Adds `turn`: rows of the category emitted before over rows of the category; ties go by category."""
    sizes = rows.groupBy(category).agg(F.count(F.lit(1)).alias("_size"))
    return prefix_sum(rows, [category], ordinal, F.lit(1), "_before").join(F.broadcast(sizes), category).withColumn("turn", F.col("_before") / F.col("_size")).drop("_before", "_size")  # one row for each category


def commits(cut: DataFrame, shard_tokens: int) -> DataFrame:
    """Documents whose last token crosses a shard boundary: where a builder commits."""
    return cut.where(F.floor((F.col("start") + F.col("kept")) / shard_tokens) > F.floor(F.col("start") / shard_tokens))


def realized_mixture(rows: DataFrame, by: str, tokens: Column) -> DataFrame:
    """Tokens of each group and their fraction of all."""
    sums = rows.groupBy(by).agg(F.sum(tokens).alias("tokens"))
    return sums.withColumn("fraction", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))  # one row for each group


def mixture_check(realized: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """Full comparison by source: what is off by more than the tolerance, missing or unexpected."""
    r, e = realized.select("source", F.col("fraction").alias("realized")), expected.select("source", F.col("fraction").alias("expected"))
    both = r.join(e, "source", "full_outer")
    status = F.when(F.col("realized").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.abs(F.col("realized") - F.col("expected")) > tolerance, "off").otherwise("ok")
    return both.withColumn("status", status)


def chunked(docs: DataFrame, longest: int, header: Column) -> DataFrame:
    """A text of at most `longest` characters as one row under its header, a longer one in fixed slices with part numbers."""
    n = F.ceil(F.length("text") / longest).cast("int")
    rows = docs.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    body = F.substring(F.col("text"), (F.col("part") - 1) * longest + 1, F.lit(longest))
    title = F.when(F.col("_n") == 1, header).otherwise(F.concat(header, F.lit("\nPart "), F.col("part"), F.lit(" of "), F.col("_n")))
    return rows.withColumn("chunk", F.concat(title, F.lit("\n"), body)).drop("_n")


def paragraph_chunks(docs: DataFrame, longest: int, shortest: int) -> DataFrame:
    """Paragraphs (split at blank lines, trimmed, longer ones sliced) packed greedily into chunks of at most `longest`
    characters, joined by line feeds; chunks below `shortest` are dropped. Adds part (from 0) and chunk."""
    pieces = F.filter(F.transform(F.split("text", "\\n\\s*\\n"), lambda p: F.trim(F.regexp_replace(p, "\\A\\s+|\\s+\\z", ""))), lambda p: F.length(p) > 0)
    sliced = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / longest).cast("int")), lambda i: F.substring(p, i * longest + 1, F.lit(longest)))))

    def pack(acc: Column, piece: Column) -> Column:
        joined = F.concat(acc["open"], F.lit("\n"), piece)
        fits = F.length(acc["open"]) + F.length(piece) + 2 <= longest
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), piece.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), piece.alias("open")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    packed = F.aggregate("_pieces", start, pack, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    rows = docs.withColumn("_pieces", sliced).withColumn("_chunks", F.filter(packed, lambda c: F.length(c) >= shortest))
    return rows.select(*docs.columns, F.posexplode("_chunks").alias("part", "chunk"))


def byte_budget(docs: DataFrame, ordinal: str, budget: int, mark: str = "\n<|endoftext|>\n") -> DataFrame:
    """Texts with their end mark, in order, while their UTF-8 bytes stay within the budget; the first overflow stops it."""
    rows = docs.withColumns({"record": F.concat("text", F.lit(mark)), "_all": F.lit(0)})
    return prefix_sum(rows, ["_all"], ordinal, F.octet_length("record"), "start").where(F.col("start") + F.octet_length("record") <= budget).drop("_all")


def write_budgeted(docs: DataFrame, ordinal: str, budget: int, folder: str, files: int = 16, mark: str = "\n<|endoftext|>\n") -> None:
    """The records of `byte_budget` as text files whose names are in the records' order; one after another, the files
    hold what the budget allows, byte for byte."""
    if not mark.endswith("\n"):
        raise ValueError("the mark must end a line")
    kept = byte_budget(docs, ordinal, budget, mark)
    ordered = kept.repartitionByRange(files, ordinal).sortWithinPartitions(ordinal)
    ordered.select(F.expr("left(record, length(record) - 1)").alias("value")).write.option("lineSep", "\n").text(folder)


def slice_counts(docs: DataFrame, validation_fraction: float = 0.05) -> DataFrame:
    """The minimum corpus slice: normalize, length, first-wins, split, tokens by source and split."""
    rows = measured(docs, ["source", "doc_id"], validation_fraction=validation_fraction).where(F.col("chars") >= MIN_CHARS)
    # Rows of one key have one text, and so one split and one number of tokens: the first stands for all.
    kept = rows.groupBy("source", "key").agg(F.first("n_tokens").alias("n_tokens"), F.first("validation").alias("validation"))
    split = F.when(F.col("validation"), "validation").otherwise("train")
    return kept.groupBy("source", split.alias("split")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
