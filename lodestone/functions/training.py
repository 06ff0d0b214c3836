"""Arithmetic over training runs: perplexity, schedules, costs, parameter counts, token plans."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_perplexity(loss: Column, most: float = 20.0) -> Column:
    return F.exp(F.least(loss, F.lit(most)))


def cosine_rate(step: Column, peak: float, floor: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine from peak to floor; clamped after the last step."""
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / float(max(1, total - warmup))))
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).otherwise(floor + 0.5 * (peak - floor) * (1 + F.cos(F.lit(math.pi) * progress)))


def training_flops(parameters: Column, tokens: Column) -> Column:
    return F.lit(6).cast("long") * parameters * tokens


def progress(tokens: Column, target: Column) -> Column:
    return F.least(F.try_divide(tokens.cast("double"), target.cast("double")), F.lit(1.0))


def hours_left(tokens: Column, target: Column, tokens_per_second: Column) -> Column:
    return F.greatest(target - tokens, F.lit(0)) / F.greatest(tokens_per_second, F.lit(1.0)) / 3600.0


def mixture_tolerance(longest_document: Column, general_tokens: Column) -> Column:
    return F.greatest(F.lit(0.001), F.lit(2.0) * longest_document / general_tokens)


def retry_delay(attempt: Column, initial: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(initial) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def decoder_parameters(vocab: int, width: int, layers: int | Column, heads: int, kv_heads: int, inner: int) -> int | Column:
    """Tied embeddings, grouped attention, gated feed-forward and RMS norms, without biases."""
    head = width // heads
    attention = width * width * 2 + 2 * width * head * kv_heads
    return vocab * width + layers * (attention + 3 * width * inner + 2 * width) + width


def token_plan(source_tokens: int, length: int, per_device: int, devices: int, accumulation: int) -> dict[str, int]:
    """Whole optimizer steps that a packed corpus allows; a sequence takes length + 1 tokens."""
    sequences = per_device * devices * accumulation
    trained, read = sequences * length, sequences * (length + 1)
    steps = source_tokens // read
    used = steps * read
    unused = source_tokens - used
    return {"trained_tokens_per_step": trained, "source_tokens_per_step": read, "steps": steps, "trained_tokens": steps * trained, "source_tokens_used": used, "source_tokens_unused": unused, "checkpoint_every_steps": -(-steps // 50)}


def token_plans(source_tokens: Column, length: int, per_device: int, devices: int, accumulation: int) -> dict[str, Column]:
    """The same for a column of corpora: steps, tokens trained on, read and left over."""
    sequences = per_device * devices * accumulation
    steps = F.floor(source_tokens / (sequences * (length + 1)))
    used = steps * (sequences * (length + 1))
    return {"steps": steps, "trained_tokens": steps * (sequences * length), "source_tokens_used": used, "source_tokens_unused": source_tokens - used, "checkpoint_every_steps": F.ceil(steps / 50)}
