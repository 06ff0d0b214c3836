"""Content identity, hash splits and SimHash fingerprints."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def dedup_key(text: Column) -> Column:
    """The first 16 bytes of the content hash, in hexadecimal."""
    return F.substring(content_hash(text), 1, 32)


def fraction_bound(fraction: float) -> str:
    """Hashes whose first 8 bytes are below this text fall into the fraction."""
    return f"{min(math.ceil(fraction * 2**64), 2**64 - 1):016x}"


def in_fraction(text: Column, fraction: float) -> Column:
    """Deterministic Bernoulli choice by content: the first 8 bytes of SHA-256 over 2^64 are below the fraction."""
    return hash_in_fraction(content_hash(text), fraction)


def hash_in_fraction(sha: Column, fraction: float) -> Column:
    """The same of a content hash that is known already."""
    if 0 < fraction < 1:
        return F.substring(sha, 1, 16) < fraction_bound(fraction)
    return F.lit(fraction >= 1)


def split_90_5_5(signature: Column) -> Column:
    """train, validation or test by the first 12 hexadecimal digits of a signature."""
    bucket = F.conv(F.substring(signature, 1, 12), 16, 10).cast("long") % 10000
    return F.when(bucket < 9000, "train").when(bucket < 9500, "validation").otherwise("test")


def seeded_order(*parts: Column | str) -> Column:
    """A deterministic order key: SHA-256 over the parts, set apart by unit separators."""
    return F.sha2(F.concat_ws("\x1f", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


#: 64-bit hashes of a token. The published fingerprints use BLAKE2b; the SHA-256 ones can be computed in SQL as well.
DIGESTS = {"blake2b": lambda t: hashlib.blake2b(t, digest_size=8).digest(), "sha256": lambda t: hashlib.sha256(t).digest()[:8]}


def _majority(tokens: list[bytes], digest: str = "blake2b") -> int:
    """Each bit is 1 if it is set in half of the hashes or more; no tokens give 0. A signed number."""
    if not tokens:
        return 0
    h = np.array([int.from_bytes(DIGESTS[digest](t), "big") for t in tokens], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 >= len(tokens), bitorder="little").view(np.int64)[0])


def simhash_of_words(text: str | None, digest: str = "blake2b") -> int:
    """64-bit SimHash of the [a-z0-9]+ tokens of a text (with repeats); as a signed number."""
    return _majority([w.encode() for w in re.findall("[a-z0-9]+", (text or "").casefold())], digest)


def simhash_words(text: Column, digest: str = "blake2b") -> Column:
    """64-bit SimHash of [a-z0-9]+ tokens (with repeats); as bigint, the bit pattern."""

    @F.pandas_udf("long")
    def sim(x: pd.Series) -> pd.Series:
        return pd.Series([simhash_of_words(t, digest) for t in x], dtype="int64")

    return sim(text)


def simhash_shingles(text: Column, width: int = 5, most_words: int = 4000, digest: str = "blake2b") -> Column:
    """64-bit SimHash of word shingles (of single words if there are fewer than `width`); the first words only, as the audit defines it."""

    @F.pandas_udf("long")
    def sim(x: pd.Series) -> pd.Series:
        out = []
        for t in x:
            w = re.findall(r"[A-Za-z0-9_./:{}-]+", (t or "").lower())[:most_words]
            k = width if len(w) >= width else 1
            out.append(_majority(["\x1f".join(w[i : i + k]).encode() for i in range(len(w) - k + 1)], digest))
        return pd.Series(out, dtype="int64")

    return sim(text)


def band_values(fingerprint: Column, bands: int = 4) -> Column:
    """array<struct<band, value>> of 64 / bands bits each."""
    bits = 64 // bands
    return F.array(*(F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(fingerprint, b * bits).bitwiseAND(F.lit((1 << bits) - 1)).alias("value")) for b in range(bands)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")
