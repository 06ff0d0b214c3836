"""Checks of build configurations; small values, checked on the driver."""

from __future__ import annotations

import hashlib
import json
import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of sources a build knows.
KINDS = {"huggingface", "openapi_raw", "openapi_docs", "openapi_actions"}


class ConfigError(ValueError):
    pass


def validate(config: dict) -> None:
    """Positive sizes, a vocabulary of at most 65,536, fractions between 0 and 1, weights of 1 in all and by category."""
    for name in ("train_tokens", "validation_tokens", "shard_tokens", "max_document_tokens"):
        if int(config.get(name, 0)) <= 0:
            raise ConfigError(f"{name} must be positive")
    if not 0 < int(config.get("vocab_size", 0)) <= 1 << 16:
        raise ConfigError("vocab_size")
    if not 0 < float(config.get("validation_fraction", 0)) < 1:
        raise ConfigError("validation_fraction")
    sources = config.get("sources") or []
    names = [s["name"] for s in sources]
    if len(set(names)) < len(names) or not names:
        raise ConfigError("source names must be unique")
    if unknown := {s["kind"] for s in sources} - KINDS:
        raise ConfigError(f"unknown kinds {sorted(unknown)}")
    if abs(math.fsum(float(s["weight"]) for s in sources) - 1) > 1e-8:
        raise ConfigError("weights must sum to 1")
    for category, want in (config.get("category_weights") or {}).items():
        have = sum((Fraction(str(s["weight"])) for s in sources if s["category"] == category), Fraction())
        if have != Fraction(str(want)):
            raise ConfigError(f"category {category}: {float(have)} instead of {want}")


def approve(config: dict, approval: dict, tokenizer_sha: str) -> None:
    """An approved allocation of this very configuration and tokenizer, whose sum is the training budget."""
    told = {"status": "approved", "config_sha256": fingerprint(config), "tokenizer_sha256": tokenizer_sha}
    for key, want in told.items():
        if approval.get(key) != want:
            raise ConfigError(f"approval: {key}")
    given = approval.get("allocations", {})
    if given.keys() != {s["name"] for s in config["sources"]}:
        raise ConfigError("approval: sources differ")
    if sum(map(int, given.values())) != int(config["train_tokens"]):
        raise ConfigError("approval: allocations don't sum to the budget")


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def source_signature(config: dict) -> tuple:
    """What makes two mixtures the same."""
    return tuple(sorted((s["name"], s["category"], s["kind"], float(s["weight"])) for s in config["sources"]))


#: What a build for a test keeps of its training tokens for validation and in a shard: one part in so many; tokens at least.
SCALED, LEAST_SCALED = {"validation_tokens": 20, "shard_tokens": 4}, 10_000


def scaled_down(config: dict, tokens: int) -> dict:
    """The same build for a test: `tokens` of training, the rest in proportion."""
    return config | {"train_tokens": tokens} | {k: max(LEAST_SCALED, tokens // n) for k, n in SCALED.items()}


def scaled_sizes(tokens: Column) -> dict[str, Column]:
    """The sizes of such builds, by their tokens."""
    return {k: F.greatest(F.lit(LEAST_SCALED).cast("long"), F.floor(tokens / n)) for k, n in SCALED.items()}


def split_targets(total: int) -> dict[str, int]:
    train, validation = total * 90 // 100, total * 5 // 100
    return {"train": train, "validation": validation, "test": total - train - validation}
