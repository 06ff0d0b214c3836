"""Text functions: Column -> Column. Normalizations, slugs, words, renderings."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS, _TRAILING, _BLANK, _MANY, _CONTROLS = (re.compile(x) for x in (r"\r\n?", r"(?m)[^\S\n]+$", r"\n{3,}", r"\n{4,}", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))


def corpus_form(text: str, unicode_form: bool = True) -> str:
    out = unicodedata.normalize("NFKC", text) if unicode_form else text
    out = _TRAILING.sub("", _ENDS.sub("\n", out.replace("\x00", "")))
    return _BLANK.sub("\n\n", out).strip()


def tokenizer_form(text: str | None, unicode_form: bool = True) -> str:
    out = unicodedata.normalize("NFKC", text or "") if unicode_form else text or ""
    return _MANY.sub("\n\n\n", _CONTROLS.sub("", _ENDS.sub("\n", out))).strip()


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Only texts beyond ASCII reach Python, in Arrow batches; Spark has no such function."""

    @F.pandas_udf("string")
    def norm(x: pd.Series) -> pd.Series:
        return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")

    return F.coalesce(norm(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize_corpus(text: Column, unicode_form: bool = True) -> Column:
    """NFKC, no NUL, LF line ends, no trailing white space, at most one blank line in a row, stripped.

    One Arrow call makes all steps: NFKC needs it anyway, and the others cost less there than as four JVM regular
    expressions over Unicode classes (0.9 against 5 seconds for 24 MB on one core)."""

    @F.pandas_udf("string")
    def norm(x: pd.Series) -> pd.Series:
        return x.map(lambda s: corpus_form(s, unicode_form), na_action="ignore")

    return norm(text)


def normalize_tokenizer(text: Column, unicode_form: bool = True) -> Column:
    """The tokenizer pipeline's form: null becomes empty, controls vanish, more than three line feeds become three."""

    @F.pandas_udf("string")
    def norm(x: pd.Series) -> pd.Series:
        return pd.Series([tokenizer_form(s, unicode_form) for s in x], dtype=object)

    return norm(text.cast("string"))


def safe_slug(text: Column, longest: int = 120, default: str = "tool") -> Column:
    """Runs of what is neither letter nor digit become one underscore."""
    slug = F.regexp_replace(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.left(slug, F.lit(longest)), F.lit("")), F.lit(default))


def run_filename(name: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit(".json"))


def casefolded(text: Column) -> Column:
    """Case-folded text. Only texts beyond ASCII reach Python: there folding differs from lower case (ß becomes ss)."""

    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.map(str.casefold, na_action="ignore")

    return F.coalesce(fold(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def lexical_words(text: Column) -> Column:
    """Distinct [a-z0-9]+ of the case-folded text."""
    return F.array_distinct(F.regexp_extract_all(casefolded(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def whitespace_tokens(text: Column) -> Column:
    """The default tokenizer's count: runs of \\S."""
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


def humanized(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "[_.\\-]+", " "))


def compact_value(value: Column, longest: int = 160) -> Column:
    """JSON text cut to `longest` characters, the last of which is an ellipsis then."""
    return F.when(F.length(value) <= longest, value).otherwise(F.concat(F.left(value, F.lit(longest - 1)), F.lit("…")))


def known_arguments(arguments: Column) -> Column:
    """map<string,string> of JSON values as 'k = v; …', sorted by key."""
    entries = F.array_sort(F.map_entries(arguments))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" = "), compact_value(e["value"]))), "; ")


def chat_prompt(request: Column, tools_json: Column) -> Column:
    return F.concat(F.lit("<|user|>\n"), request, F.lit("\n<|tool_schema|>\n"), tools_json, F.lit("\n<|assistant|>\n"))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact binary value; exact ties go up."""
    x = x.cast("double")
    tie = F.pmod(x * float(2 ** (digits + 1)), F.lit(2.0)) == 1.0
    return F.regexp_replace(F.format_number(F.when(tie, x + 10.0 ** -(digits + 1)).otherwise(x), digits), ",", "")


def format_tokens(n: Column) -> Column:
    scales = ((1e9, "B", 2), (1e6, "M", 1), (1e3, "K", 1))
    out = n.cast("long").cast("string")
    for by, unit, digits in reversed(scales):
        out = F.when(n >= by, F.concat(fixed(n / by, digits), F.lit(unit))).otherwise(out)
    return F.coalesce(out, F.lit("—"))


def format_duration(seconds: Column) -> Column:
    short, minutes, hours = (F.concat(fixed(seconds / by, digits), F.lit(unit)) for by, unit, digits in ((1.0, "s", 0), (60.0, "m", 1), (3600.0, "h", 2)))
    return F.coalesce(F.when(seconds < 60, short).when(seconds < 3600, minutes).otherwise(hours), F.lit("—"))
