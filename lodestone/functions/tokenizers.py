"""Tokenizer files as functions: counts, encodings and decodings of whole texts, in Arrow batches.

A file is named by its path, which every executor has: .json is read by `tokenizers`, .model by `sentencepiece`. It is
loaded once by each worker. No special tokens are added; the end of a document is one token more."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Json:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode_batch(ids, skip_special_tokens=False)


class _Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids)


@lru_cache(maxsize=4)
def loaded(path: str) -> _Json | _Pieces:
    return (_Pieces if path.endswith(".model") else _Json)(path)


def counter_of(path: str | None) -> Callable[[str], int]:
    """How many tokens a text has; without a file, how many runs of non-blanks."""
    if path is None:
        return lambda text: len(text.split())
    model = loaded(path)
    return lambda text: len(model.encode([text])[0])


def _batches(texts: pd.Series, most: int = 1 << 18):
    """Consecutive slices of about `most` characters (or tokens): a library holds over a hundred bytes for each token."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = 0 if text is None else len(text)
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def token_ids(text: Column, path: str, most: int | None = None, end: int | None = None) -> Column:
    """array<int>: the tokens of a text (null: none), the first most - 1 of them where there are `most` or more, and then `end`."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        model, out = loaded(path), []
        for a, b in _batches(texts):
            for ids in model.encode([t or "" for t in texts[a:b]]):
                kept = ids[: most - 1] if most is not None and len(ids) >= most else ids
                out.append([*kept, end] if end is not None else kept)
        return pd.Series(out, dtype=object)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        model, out = loaded(path), []
        for a, b in _batches(rows):
            out += model.decode([[int(x) for x in r] if r is not None else [] for r in rows.iloc[a:b]])
        return pd.Series(out, dtype=object)

    return decode(ids)


# --- counts by pieces ---

#: Characters of the Unicode property White_Space.
WHITE = "".join(map(chr, [*range(9, 14), 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Where none of these occurs, a blank always follows another character than white space.
_UNUSUAL = ["  ", "\n ", *(c for c in WHITE if c not in " \n")]
_UNUSUAL_ASCII = [x for x in _UNUSUAL if x.isascii()]
#: A piece of more characters is cut further.
LONG_PIECE = 4096
_CUTS = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Distinct pieces that a worker remembers, and their longest length; others are encoded each time.
REMEMBERED, LONGEST = 600_000, 64
#: Bytes in one call of the tokenizer.
BATCH_BYTES = 1 << 18


def pieces(text: str) -> list[str]:
    """The text cut at safe boundaries; joined they are the text."""
    if any(x in text for x in (_UNUSUAL_ASCII if text.isascii() else _UNUSUAL)):
        out = _PIECES.findall(text)
    else:
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        out = [first, *out] if first else out
    if len(text) > LONG_PIECE and any(len(x) > LONG_PIECE for x in out):
        # Line feeds that follow another character are safe places too, which the quick way above leaves alone.
        out = [y for x in out for y in (_CUTS.split(x) if len(x) > LONG_PIECE else [x])]
    return out


def cuts_are_safe(path: str) -> bool:
    """Whether the tokenizer of a .json file splits texts by the byte-level pattern alone."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    first = said.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    own = said.get("added_tokens") or []
    alone = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in own)
    return plain and said.get("normalizer") is None and alone and not any(c.isspace() or c.isdigit() for t in own for c in t["content"])


def balanced(items: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive batches of nearly `most` bytes; a longer item makes a batch of its own."""
    batch, size = [], 0
    for x in items:
        n = len(x) if x.isascii() else len(x.encode())
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(x)
        size += n
    if batch:
        yield batch


class Counter:
    """Counts tokens of whole texts with a tokenizer file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        self.sentences = path.endswith(".model")
        self.whole = self.sentences or not cuts_are_safe(path)
        if self.sentences:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)

    def lengths(self, texts: list[str]) -> list[int]:
        if self.sentences:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text. Where pieces aren't independent, texts are encoded whole."""
        if self.whole:
            return [n for batch in balanced(texts) for n in self.lengths(batch)]
        if len(self.known) > REMEMBERED:  # what came first is what comes often
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        cut = [pieces(x) for x in texts]
        known = self.known
        new = list({p for c in cut for p in c if p not in known})
        now = {}
        for batch in balanced(new):
            now.update(zip(batch, self.lengths(batch), strict=True))
        known.update((p, n) for p, n in now.items() if len(p) <= LONGEST)
        now = {p: n for p, n in now.items() if len(p) > LONGEST}
        if now:
            return [sum(known[p] if p in known else now[p] for p in c) for c in cut]
        return [sum(map(known.__getitem__, c)) for c in cut]


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _groups(sizes: list[int], most: int = 4 * BATCH_BYTES) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def token_count(path: str) -> Callable[[Column], Column]:
    """The count as a column function, to stand in for `whitespace_tokens`. Each distinct piece is encoded once per worker."""

    def count(text: Column) -> Column:
        @F.pandas_udf("long")
        def lengths(texts: pd.Series) -> pd.Series:
            rows = [t or "" for t in texts]
            return pd.Series([n for a, b in _groups([len(t) for t in rows]) for n in _counter(path).counts(rows[a:b])], dtype="int64")

        return lengths(text)

    return count
