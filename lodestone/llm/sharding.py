"""Sharding (operator 4): minimax contiguous partition of ordered atomic groups.

All rows of one text form a group, which never leaves its shard. Groups are ordered by the SHA-256 of their text,
and a shard is a contiguous run of groups. The capacity is the smallest for which the greedy run fits into the
given number of shards, found by binary search.

The search never holds all groups. It holds sums over prefixes of the hash: at first of three hexadecimal digits.
The greedy cut number j for any capacity between the two bounds lies in an interval of bytes, which follows from
those sums and from the largest group of each prefix; only prefixes inside such an interval are opened by two more
digits, until each interval ends at a known group. Rows then find their shard by comparing their hash with at most
n - 1 boundaries, without a join.

The greedy run itself fills shards up to the capacity and leaves the last ones small or empty. The cut is therefore the
most even one within that capacity: each cut has a window of places that leave no shard above it, prefixes inside the
windows are opened, and a second binary search finds the largest size that the least shard can have.

What is contiguous is the order of the groups that remain: a group above the mean of what is left (there are fewer of
those than shards) is taken out first, largest first, and is a shard of its own. Were it left in the order, its size
would be the capacity, the greedy run would fill a few shards up to it and leave the others empty. No shard of the
others is above the least capacity that whole groups in this order allow, and none is empty unless there are fewer
groups than shards.

Slots are numbered where rows lie: a task sorts its rows by shard and writes them, and the counts of tasks and shards
give each run of rows its first slot. Neither texts nor rows are shuffled, and a hot group is numbered by all tasks
that read it.

Null texts count as empty ones; a very long text is a group like others, or a shard of its own. Groups of equal size
are ordered by their hash. Rows without an identifier are placed like others. Repeated rows are of one group and get
slots of their own. An empty table gives no rows. Other columns are kept by `assign_shards`, whatever they are called;
columns named as its results are replaced by them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents, fresh, written

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Runs that are opened at once in search of the most even cuts.
MOST_OPEN = 4096
#: Runs of rows (one for each task and shard) whose first slots are broadcast; more are joined by a shuffle.
BROADCAST_RUNS = 1_000_000


class Runs:
    """Consecutive runs of groups, each a prefix of the hash with its number of groups, bytes, and largest group."""

    def __init__(self, runs: list[tuple[str, int, int, int]]):
        self.runs = sorted(runs)
        self.ends, total = [], 0
        for _, _, size, _ in self.runs:
            total += size
            self.ends.append(total)
        self.total = total

    def cut(self, start: int, capacity: int, late: bool) -> int:
        """Where the greedy shard that begins at byte `start` ends: the earliest or the latest place it can be."""
        x = start + capacity
        if x >= self.total:
            return self.total
        i = bisect_right(self.ends, x)
        begin = self.ends[i] - self.runs[i][2]
        if self.runs[i][1] == 1:
            return max(begin, start)
        return x if late else max(begin, start, x - self.runs[i][3])

    def cuts(self, capacity: int, shards: int, late: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.cut(at, capacity, late)
            out.append(at)
        return out

    def smallest(self, shards: int, late: bool) -> int:
        """The smallest capacity with which `shards` greedy runs reach the end."""
        low, high = max([-(-self.total // shards), *(r[3] for r in self.runs)]), max(self.total, 1)
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, late)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_boundaries(runs: Runs, shards: int, opened: Callable[[list[str]], list[tuple[str, int, int, int]]]) -> tuple[int, list[str]]:
    """The smallest capacity, and the hash prefixes with which the second and later shards begin in the most even partition within it.

    opened: gives the next finer runs of the named prefixes."""
    while True:
        if not runs.total:
            return 0, []
        low, high = runs.smallest(shards, late=True), runs.smallest(shards, late=False)
        early, late = runs.cuts(low, shards, late=False), runs.cuts(high, shards, late=True)
        fuzzy = {}
        for a, b in zip(early, late, strict=True):
            i = bisect_right(runs.ends, a)
            while i < len(runs.runs) and runs.ends[i] - runs.runs[i][2] <= b:
                begin = runs.ends[i] - runs.runs[i][2]
                if runs.runs[i][1] > 1 and not a == b == begin:
                    fuzzy[runs.runs[i][0]] = i
                i += 1
        if not fuzzy:
            break
        runs = Runs([r for r in runs.runs if r[0] not in fuzzy] + opened(sorted(fuzzy)))
    runs, cuts = even_cuts(runs, low, min(shards, sum(r[1] for r in runs.runs)), opened)
    begins = {runs.ends[i] - r[2]: r[0] for i, r in enumerate(runs.runs)}
    return low, [begins[at] for at in cuts]


def _windows(total: int, capacity: int, shards: int, reach: int) -> list[tuple[int, int]]:
    """Where cut j of a partition into shards of at most `capacity` bytes can lie, at most `reach` from an even share."""
    return [(max(total - (shards - j) * capacity, total * j // shards - reach), min(j * capacity, total * j // shards + reach)) for j in range(1, shards)]


def even_cuts(runs: Runs, capacity: int, shards: int, opened: Callable[[list[str]], list[tuple[str, int, int, int]]], most_open: int = MOST_OPEN) -> tuple[Runs, list[int]]:
    """Of all partitions into `shards` runs of at most `capacity` bytes one whose least run is largest: its cuts, and the runs that know them.

    Runs of more groups inside the windows are opened. Where that would be more than `most_open` at once, windows are
    halved around even shares; then there are thousands of groups in each, and the least shard is short of the best
    one by less than their size."""
    total, reach = runs.total, runs.total
    while True:
        windows = _windows(total, capacity, shards, reach)
        fuzzy = set()
        for low, high in windows:
            i = bisect_right(runs.ends, low)
            while i < len(runs.runs) and runs.ends[i] - runs.runs[i][2] < high:
                if runs.runs[i][1] > 1:
                    fuzzy.add(runs.runs[i][0])
                i += 1
        if len(fuzzy) > most_open and reach > 1:
            reach //= 2
        elif fuzzy:
            runs = Runs([r for r in runs.runs if r[0] not in fuzzy] + opened(sorted(fuzzy)))
        else:
            break
    edges = [runs.ends[i] - r[2] for i, r in enumerate(runs.runs)] + [total]
    # Cuts of the greedy run are known edges, too, so that there is a partition however narrow the windows are.
    greedy = runs.cuts(capacity, shards, late=False)
    choices = [np.unique([*edges[bisect_left(edges, low) : bisect_right(edges, high)], *([at] if at < total else [])]) for (low, high), at in zip(windows, greedy, strict=False)]
    choices = [np.zeros(1, np.int64), *choices, np.array([total])]

    def reached(least: int) -> list[np.ndarray] | None:
        """Of each cut the places that shards of `least` to `capacity` bytes can reach."""
        out = [choices[0]]
        for places in choices[1:]:
            before = out[-1]
            places = places[np.searchsorted(before, places - least, "right") > np.searchsorted(before, places - capacity, "left")]
            if not len(places):
                return None
            out.append(places)
        return out

    low, high = 0, total // shards
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if reached(mid) is not None else (low, mid - 1)
    found = reached(low)
    if found is None:  # the greedy run takes fewer shards, and narrow windows have no better partition
        return runs, [at for at in greedy if at < total]
    cuts, at = [], total
    for j in range(shards - 1, 0, -1):
        places = found[j][(found[j] >= at - capacity) & (found[j] <= at - low)]
        at = int(places[np.abs(places - at * j // (j + 1)).argmin()])
        cuts.append(at)
    return runs, sorted({at for at in cuts if 0 < at < total})


def _runs_of(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    """At most 16 ** digits rows, or as many as the opened prefixes have children."""
    by = groups.groupBy(F.substring("text_sha", 1, digits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("size"), F.max("group_size").alias("most"))
    return [tuple(r) for r in by.collect()]


def shard_boundaries(groups: DataFrame, shards: int) -> tuple[int, list[str], list[str]]:
    """groups: text_sha (lowercase hex), group_size (long, positive). The capacity; texts that are shards of their own; where the other shards begin."""
    alone: list[str] = []
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    capacity = 0
    for sha, size in groups.orderBy(F.desc("group_size"), "text_sha").select("text_sha", "group_size").limit(shards - 1).collect():
        if size * (shards - len(alone)) <= total:
            break
        alone.append(sha)
        total -= size
        capacity = max(capacity, size)
    rest = groups.where(~F.col("text_sha").isin(alone)) if alone else groups

    def opened(prefixes: list[str]) -> list[tuple[str, int, int, int]]:
        out = []
        for digits in sorted({len(p) for p in prefixes}):
            named = rest.where(F.substring("text_sha", 1, digits).isin([p for p in prefixes if len(p) == digits]))
            out += _runs_of(named, digits + MORE_DIGITS)
        return out

    least, begins = minimax_boundaries(Runs(_runs_of(rest, FIRST_DIGITS)), shards - len(alone), opened)
    return max(capacity, least), alone, begins


RESULTS = ["size", "text_crc32", "text_sha", "law", "shard", "slot", "grown_shard"]


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", drop: list[str] | None = None, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """The rows with size, text_crc32, text_sha, law, shard (from 0), slot (gapless from 0 in each shard), grown_shard (null).

    drop: columns that the result need not have, which are not written then."""
    if shards < 1:
        raise ValueError("there must be a shard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = {id_col.lower(), text_col.lower()}
    own = [c for c in RESULTS if c not in named]
    kept = [c for c in docs.columns if c.lower() in named or c.lower() not in RESULTS]
    part, at, first, start = fresh(docs, "s_part", "s_at", "s_first", "s_start")
    values = {"size": (F.octet_length(text) + ROW_BYTES).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "text_sha": F.sha2(text.cast("binary"), 256)}
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), *(v.alias(c) for c, v in values.items()))
    groups = written(rows.groupBy("text_sha").agg(F.sum("size").alias("group_size")), "groups")
    _, alone, begins = shard_boundaries(groups, shards)
    shard = F.lit(len(alone)).cast("int")
    for i, prefix in enumerate(begins, len(alone) + 1):
        shard = F.when(F.col("text_sha") >= prefix, F.lit(i)).otherwise(shard)
    for i, sha in enumerate(alone):
        shard = F.when(F.col("text_sha") == sha, F.lit(i)).otherwise(shard)
    held = rows.drop(*(drop or [])).withColumn("shard", shard.cast("int")).sortWithinPartitions("shard")
    # Written, so that rows and counts come from one run of the tasks.
    held = written(held.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "placed")
    runs = held.groupBy(part, "shard").agg(F.min(at).alias(first), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # one row for each task
    starts = written(runs.select(part, "shard", first, F.coalesce(before, F.lit(0)).alias(start)), "starts")
    if starts.count() <= broadcast_runs:
        starts = F.broadcast(starts)
    slots = held.join(starts, [part, "shard"]).withColumns({"law": F.lit("bytes"), "slot": (F.col(start) + F.col(at) - F.col(first)).cast("long"), "grown_shard": F.lit(None).cast("int")})
    return slots.select(*(F.col(f"`{c}`") for c in kept if c not in (drop or [])), *own)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are near equal (`bytes`): the largest of 40 shards is as small as whole groups in hash order allow."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return assign_shards(docs, 40, drop=["text"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
