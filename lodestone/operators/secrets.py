"""Secrets in texts: tokens that look random by their characters, and known forms of keys.

A candidate is a run of at least 20 characters of the alphabets that keys are written in. It looks random if its entropy
is high, letters and digits both occur, its classes of characters (lower, upper, digit, other) change often, as they do
in keys and not in words, names and paths, and other characters are few. Known forms are found wherever they stand.
All of it is expressions of Spark's own; nothing is explained by a word list."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 20
CANDIDATE = f"[A-Za-z0-9+/=_-]{{{LEAST},}}"
#: Known forms of keys; fixed values.
FORMS = r"(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:(api[_-]?key|secret|token|password)\s*[:=]\s*['\x22]?[A-Za-z0-9_\-/+]{16,}))"
#: Identifiers of this form are no secrets.
PLAIN = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Least bits of entropy, least runs of classes for each character, most other characters.
ENTROPY, RUNS, OTHERS = 3.2, 0.3, 0.1
RUN = "a+|A+|0+|[^aA0]+"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, value>>: all matches from left to right, with the place (from 0, in characters) of each."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)

    def upto(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))

    return F.transform(values, lambda v, i: F.struct((upto(gaps, i + 1) + upto(values, i)).cast("long").alias("start"), v.alias("value")))


def entropy(token: Column) -> Column:
    """Bits of a character, by the token's own counts."""
    chars = F.split(token, "")
    n = F.length(token)
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + (share := F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(share))


def class_runs(token: Column) -> Column:
    """Runs of characters of one class, written as a, A, 0 and anything else."""
    flat = F.translate(token, string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10)
    return F.regexp_extract_all(flat, F.lit(RUN), 0)


def looks_random(token: Column) -> Column:
    n, runs = F.length(token), class_runs(token)
    others = F.length(F.regexp_replace(token, "[A-Za-z0-9]", ""))
    letters, digits = F.length(F.regexp_replace(token, "[^A-Za-z]", "")), F.length(F.regexp_replace(token, "[^0-9]", ""))
    return (letters >= 2) & (digits >= 2) & (others <= OTHERS * n) & (F.size(runs) >= RUNS * n) & (F.round(entropy(token), 9) >= ENTROPY) & ~token.rlike(PLAIN)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The identifier, start (from 0, in characters), length, kind (random or form) and value of each secret of each text.

    A token that is found both ways has both rows. A null text has none."""
    rows = docs.select(id_col, F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), spans(F.col("_text"), pattern).alias("found")) for kind, pattern in (("random", CANDIDATE), ("form", FORMS))))
    found = rows.select(id_col, F.explode(kinds).alias("_k")).select(id_col, F.col("_k.kind").alias("kind"), F.explode("_k.found").alias("_s"))
    out = found.select(id_col, F.col("_s.start").alias("start"), F.length("_s.value").alias("length"), "kind", F.col("_s.value").alias("value"))
    return out.where((F.col("kind") == "form") | looks_random(F.col("value")))
