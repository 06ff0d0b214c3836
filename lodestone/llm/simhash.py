"""SimHash near-dedup (operator 5): fingerprints of word shingles, linked within a Hamming radius by vantage-point trees.

1. Every text becomes a fingerprint of one or more 64-bit words: each bit is 1 if it is set in over half of the
   shingle hashes (of the distinct ones, if a Jaccard similarity is asked for). Texts with fewer words than a shingle
   are one shingle; texts without words have fingerprint zero.
2. Equal fingerprints become one point.
3. A bounded sample of points (`SAMPLE`) shapes a tree: an inner node holds a vantage fingerprint and a radius and
   sends closer points one way, others the other way. Only the shape depends on the sample: every point goes to its
   own leaf (a shard), and as a visitor to every later leaf whose region its ball can overlap by the triangle
   inequality. A pair within the radius therefore meets in exactly one leaf. A leaf that received more than `LEAF_ROWS`
   rows is divided again by a tree of its own, until it has fewer or no vantage point tells its points apart; so leaves
   stay bounded however many points there are. (Rows sent to several leaves grow with the depth of the tree: at
   radius 2 by a factor of about 1.3 for each level.)
4. Within a leaf the same pruning goes on: a recursive join of vantage-point halves, in which only points near a
   boundary are compared across it, ends in small exact comparisons. What leaves a leaf is a spanning forest of
   the links found there, not the links: fewer rows than points came in, however dense a group of copies is.
5. Contraction joins the forests to components.

If a Jaccard similarity s is asked for, a point is a set of distinct shingles, told apart by its size too: two such
sets have sizes within a factor of s, a one-dimensional metric with the same triangle bound. Fingerprints of such sets
differ in so many bits that balls overlap all regions of a tree, which then divides nothing. So shards are made by
the sets themselves: sets that agree in the `BAND_ROWS` least hashes of one of `BANDS` bands meet in a shard (a pair
of similarity 0.8 meets nowhere with probability 3e-5, a pair of 0.2 meets with 0.03), and the tree only divides
shards that are heavy. The links of steps 3 and 4 are candidates then: within each of their components the sets
themselves are compared, and only pairs that have the similarity are linked. In a component with more than
`BLOCK_SHINGLES` shingles a few representatives are compared with all sets first, and only what they leave open is
compared with all others then (`large_links`).

Null texts count as empty; texts of any length vote with all their shingles, a piece of a batch at a time. A bit that
is set in exactly half of the hashes is 0; of equal distances none is preferred, all within the radius link. A null
identifier is never a component's smallest one unless the whole component lacks identifiers. Repeated rows give
repeated results. An empty table gives no rows. Columns besides the identifier and the text are not read, whatever
they are called.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents, text_hash, written
from lodestone.llm.components import connected_components

SEED = 42
#: Points that shape the first tree; its leaves at most; points of a leaf aimed at.
SAMPLE, FIRST_LEAVES, LEAF_POINTS = 8192, 1024, 4096
#: Rows of a leaf beyond which it is divided again; points that shape its tree, about; leaves of that tree; such trees
#: that are broadcast (about 10 KB each; more of them are sent to the rows of their leaves).
LEAF_ROWS, LEAF_SAMPLE, LEAF_PARTS, ROUND_LEAVES = 32_768, 2048, 32, 1024
#: Where sets are compared: bands, and least hashes that a band joins; keys of several sets that are broadcast, at most.
BANDS, BAND_ROWS, BROADCAST_KEYS = 20, 4, 1_000_000
#: Leaves at least, so that work spreads, where there are points enough.
LEAST_LEAVES = 64
#: Comparisons below which a pair of point sets is compared as a whole.
WHOLE = 1 << 16
#: Shingles (and 100 more for each set) of a block, where the sets of a component are compared. Sets of a larger component
#: that are compared with all others in a round, and rounds.
BLOCK_SHINGLES, REPRESENTATIVES, ROUNDS = 2_000_000, 64, 6


def _spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words) hash words; the first is the hash itself."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for w in range(1, words):
        h = hashes + np.uint64((w * 0x9E3779B97F4A7C15) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, w] = h ^ (h >> np.uint64(31))
    return out


def majority(hashes: np.ndarray, lengths: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints (n, words) of consecutive runs of hashes; runs of length 0 give zero."""
    out = np.zeros((len(lengths), words), np.uint64)
    filled = np.flatnonzero(lengths)
    if not len(filled):
        return out
    starts = np.cumsum(lengths) - lengths
    votes = np.zeros((len(filled), 64 * words), np.int64)
    # Unpacked bits are added as single bytes in blocks of at most 255 rows.
    for a, b in _slices(lengths[filled], 1 << 15):
        begin, end = starts[filled[a]], starts[filled[b - 1]] + lengths[filled[b - 1]]
        bits = np.unpackbits(_spread(hashes[begin:end], words).view(np.uint8), axis=1, bitorder="little")
        cuts, owner = [], []
        for i in range(a, b):
            at = np.arange(starts[filled[i]] - begin, starts[filled[i]] - begin + lengths[filled[i]], 255)
            cuts.append(at)
            owner.append(np.full(len(at), i))
        partial = np.add.reduceat(bits, np.concatenate(cuts), axis=0, dtype=np.uint8)
        owner = np.concatenate(owner)
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        votes[a:b] += np.add.reduceat(partial, firsts, axis=0, dtype=np.int64)
    set_bits = votes * 2 > lengths[filled][:, None]
    out[filled] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)
    return out


def _slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for i, n in enumerate(lengths):
        if i > a and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(lengths):
        yield a, len(lengths)


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 (seed 42) of the shingles of k words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, joined by blanks."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(begins, (ends[k - 1 :] - 1).tolist(), strict=True)]


_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * BAND_ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of sets, given as consecutive runs of hashes: each joins the least hashes in `BAND_ROWS` orders."""
    out = np.zeros((len(lengths), BANDS), np.uint64)
    filled = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[filled]
    for f, factor in enumerate(_FACTORS if len(filled) else []):
        band = f // BAND_ROWS
        x = hashes * factor
        key = out[filled, band] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts) + np.uint64(band)
        out[filled, band] = key ^ (key >> np.uint64(29))
    return out.view(np.int64)


def fingerprints(texts: list[str | None], k: int, words: int, sizes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, words) fingerprints; where `sizes` asks for them, (n, 2) the number of distinct shingles and a hash of their set, and (n, BANDS) keys.

    With `sizes` each distinct shingle votes once, else as often as it stands in the text."""
    fps, about, bands = [], [], []
    held: list[np.ndarray] = []
    n = 0

    def flush() -> None:
        flat, lengths = np.concatenate([np.empty(0, np.uint64), *held]), np.array([len(x) for x in held], np.int64)
        fps.append(majority(flat, lengths, words))
        bands.append(band_keys(flat, lengths) if sizes else np.empty((len(held), 0), np.int64))
        about.extend((len(x), xxhash.xxh64_intdigest(x.tobytes(), SEED)) if sizes else (0, 0) for x in held)

    for text in texts:
        hashes = np.array(shingle_hashes(text, k), np.uint64)
        held.append(np.unique(hashes) if sizes else hashes)
        n += len(held[-1])
        if n > 200_000:
            flush()
            held, n = [], 0
    flush()
    return np.concatenate(fps), np.array(about, np.uint64).reshape(-1, 2).view(np.int64), np.concatenate(bands)


def distances(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Hamming distances of points (n, w) from one point."""
    return np.bitwise_count(a ^ v).sum(axis=1, dtype=np.int64) if a.shape[1] > 1 else np.bitwise_count(a[:, 0] ^ v[0]).astype(np.int64)


# --- the tree of shards ---


class Tree:
    """Inner nodes: ("fp", vantage, radius, near, far) or ("size", None, bound, near, far); leaves: numbers in order."""

    def __init__(self, sample: np.ndarray, sizes: np.ndarray | None, leaves: int, radius: int, factor: float | None):
        self.radius, self.margin, self.leaves = radius, -np.log(factor) if factor else None, 0
        rng = np.random.default_rng(SEED)
        self.root = self._grow(sample, np.log(np.maximum(sizes, 1)) if sizes is not None else None, leaves, rng)

    def _grow(self, points: np.ndarray, sizes: np.ndarray | None, leaves: int, rng: np.random.Generator):
        if leaves > 1 and len(points) > 1:
            if sizes is not None and np.quantile(sizes, 0.9) - np.quantile(sizes, 0.1) > 4 * self.margin:
                bound = float(np.median(sizes))
                near = sizes <= bound
                if near.any() and not near.all():
                    return self._split(("size", None, bound), near, points, sizes, leaves, rng)
            best = None
            for i in rng.choice(len(points), min(8, len(points)), replace=False):
                d = distances(points, points[i])
                mid = int(np.median(d))
                near = d <= mid
                if near.all():
                    near = d < mid
                    mid -= 1
                if near.any() and not near.all():
                    both = np.count_nonzero(np.abs(d - mid - 0.5) < self.radius + 0.5)
                    if best is None or both < best[0]:
                        best = (both, points[i], mid, near)
            if best:
                return self._split(("fp", best[1], best[2]), best[3], points, sizes, leaves, rng)
        self.leaves += 1
        return self.leaves - 1

    def _split(self, rule, near, points, sizes, leaves, rng):
        a = self._grow(points[near], None if sizes is None else sizes[near], leaves - leaves // 2, rng)
        b = self._grow(points[~near], None if sizes is None else sizes[~near], leaves // 2, rng)
        return (*rule, a, b)

    def route(self, points: np.ndarray, sizes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return route_points(self.root, self.radius, self.margin, points, sizes)


def route_points(root, radius: int, size_margin: float | None, points: np.ndarray, sizes: np.ndarray | None, owned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parallel arrays: point, leaf, whether it is the point's own leaf. Visits go to later leaves only.

    owned: which points have a leaf of their own here; the others only visit."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    logs = None if sizes is None else np.log(np.maximum(sizes, 1))
    todo = [(root, np.arange(len(points)), np.ones(len(points), bool) if owned is None else owned)]
    while todo:
        node, at, own = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            out.append((at, node, own))
            continue
        kind, vantage, bound, near, far = node
        if kind == "size":
            d, margin = logs[at], size_margin + 1e-9
            inner, outer = d <= bound, d > bound
            visits = inner & (d + margin > bound)
        else:
            d, margin = distances(points[at], vantage), radius
            inner, outer = d <= bound, d > bound
            visits = inner & (d + margin > bound)
        # Nearer leaves come first, so points of the near side visit the far side and never the other way round;
        # a visitor keeps on visiting on both sides where its ball overlaps both.
        near_too = outer & ~own & (d - margin <= bound)
        go_near = inner | near_too
        todo.append((near, at[go_near], own[go_near] & inner[go_near]))
        go_far = outer | visits
        todo.append((far, at[go_far], own[go_far] & outer[go_far]))
    if not out:
        return np.array([], np.int64), np.array([], np.int64), np.array([], bool)
    return np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1]) for x in out]), np.concatenate([x[2] for x in out])


# --- the join within a leaf ---


class Forest:
    """Links are reduced to a spanning forest whenever many have been gathered."""

    def __init__(self, n: int):
        self.label, self.found, self.held = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.found.append((a, b))
            self.held += len(a)
            if self.held > 500_000:
                self.reduce()

    def reduce(self) -> None:
        if not self.found:
            return
        a, b = (np.concatenate(x) for x in zip(*self.found, strict=True))
        label = self.label
        while True:
            x, y = label[a], label[b]
            differs = x != y
            if not differs.any():
                break
            a, b, x, y = a[differs], b[differs], x[differs], y[differs]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label = up
        self.label, self.found, self.held = label, [], 0


class LeafJoin:
    """Links within `radius` (and size factor) among own points, and between them and visitors."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray | None, radius: int, factor: float | None):
        self.points, self.sizes, self.radius, self.factor = points, sizes, radius, factor
        self.forest = Forest(len(points))

    def _near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), np.uint16)
        for w in range(self.points.shape[1]):
            out += np.bitwise_count(self.points[a, w][:, None] ^ self.points[b, w][None, :])
        hit = out <= self.radius
        if self.sizes is not None:
            x, y = self.sizes[a][:, None], self.sizes[b][None, :]
            hit &= np.minimum(x, y) >= self.factor * np.maximum(x, y) - 1e-9
        return hit

    def _whole(self, a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, WHOLE * 4 // max(1, len(b)))
        for i in range(0, len(a), step):
            x, y = np.nonzero(self._near(a[i : i + step], b))
            self.forest.add(a[i : i + step][x], b[y])

    def within(self, at: np.ndarray, depth: int = 0) -> None:
        if len(at) < 2:
            return
        split = self._halves(at, at, depth)
        if split is None:
            if len(at) > 4096 and self._crowded(at):
                self._pivots(at)
            else:
                self._whole(at, at)
            return
        d, _, mid = split
        near, far = at[d <= mid], at[d > mid]
        self.within(near, depth + 1)
        self.within(far, depth + 1)
        self.across(near[d[d <= mid] + self.radius > mid], far[d[d > mid] - self.radius <= mid], depth + 1)

    def across(self, a: np.ndarray, b: np.ndarray, depth: int = 0) -> None:
        if not len(a) or not len(b):
            return
        split = self._halves(a, b, depth)
        if split is None:
            self._whole(a, b)
            return
        da, db, mid = split
        an, af, bn, bf = a[da <= mid], a[da > mid], b[db <= mid], b[db > mid]
        self.across(an, bn, depth + 1)
        self.across(af, bf, depth + 1)
        self.across(an[da[da <= mid] + self.radius > mid], bf[db[db > mid] - self.radius <= mid], depth + 1)
        self.across(af[da[da > mid] - self.radius <= mid], bn[db[db <= mid] + self.radius > mid], depth + 1)

    def _crowded(self, at: np.ndarray) -> bool:
        """Whether some point has a third of all the others near it."""
        return any(self._near(at[i : i + 1], at).mean() > 0.33 for i in range(0, len(at), max(1, len(at) // 16)))

    def _pivots(self, at: np.ndarray) -> None:
        """Points are compared with what isn't in their component yet, so a crowd costs a few passes over it."""
        label, waits = np.arange(len(at)), np.ones(len(at), bool)
        while True:
            waiting = np.bincount(label[waits], minlength=len(at))
            if np.count_nonzero(waiting) < 2:
                break
            own = np.argmin(np.where(waiting, waiting, len(at) + 1))
            p = np.flatnonzero(waits & (label == own))[0]
            waits[p] = False
            others = np.flatnonzero(waits & (label != own))
            hit = others[self._near(at[p : p + 1], at[others])[0]]
            label[np.isin(label, np.unique(label[hit]))] = own
        self.forest.add(at[label], at)

    def _halves(self, a: np.ndarray, b: np.ndarray, depth: int):
        """Distances from a vantage point and a radius, if a split spares comparisons."""
        if len(a) * len(b) <= WHOLE or depth > 40:
            return None
        big = a if len(a) >= len(b) else b
        best = None
        for i in range(3):
            v = self.points[big[(i * 7919 + depth * 104729) % len(big)]]
            d = distances(self.points[big[:: max(1, len(big) // 512)]], v)
            mid = int(np.median(d))
            both = np.mean(np.abs(d - mid - 0.5) < self.radius + 0.5)
            if best is None or both < best[0]:
                best = (both, v, mid)
        if best[0] > 0.8:
            return None
        da = distances(self.points[a], best[1])
        db = da if a is b else distances(self.points[b], best[1])
        return da, db, best[2]


def _leaf_links(points: np.ndarray, sizes: np.ndarray | None, own: np.ndarray, radius: int, factor: float | None) -> np.ndarray:
    """label: each point's smallest linked index within the leaf."""
    join = LeafJoin(points, sizes, radius, factor)
    mine, guests = np.flatnonzero(own), np.flatnonzero(~own)
    join.within(mine)
    join.across(mine, guests)
    join.forest.reduce()
    return join.forest.label


ROUTED = "leaf long, own boolean, id long, fp array<long>, size long"


def _routed_batches(ids: np.ndarray, fp: np.ndarray, sizes: np.ndarray, at: np.ndarray, leaf: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = fp.shape[1]
    for i in range(0, len(at), 100_000):
        j = at[i : i + 100_000]
        flat = pa.array(np.ascontiguousarray(fp[j]).view(np.int64).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(leaf[i : i + 100_000].astype(np.int64)), pa.array(own[i : i + 100_000]), pa.array(ids[j]), pa.ListArray.from_arrays(pa.array(np.arange(len(j) + 1, dtype=np.int32) * words), flat), pa.array(sizes[j])], ["leaf", "own", "id", "fp", "size"])


def _columns(rows: pa.RecordBatch | pa.Table, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, fp (n, words) and size of rows."""
    fp = rows.column("fp")
    fp = fp.combine_chunks() if isinstance(fp, pa.ChunkedArray) else fp
    return rows.column("id").to_numpy(), fp.flatten().to_numpy().view(np.uint64).reshape(-1, words), rows.column("size").to_numpy()


def renewed(df: DataFrame) -> DataFrame:
    """The frame with columns of its own, so that it can meet another one of the same origin."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def first_leaves(points: DataFrame, radius: int, words: int, factor: float | None) -> DataFrame:
    """points: id, fp, size. Every point in its own leaf of the first tree, and as a visitor in later ones."""
    spark = points.sparkSession
    n = points.count()
    sample = points.orderBy(F.xxhash64("id", F.lit(SEED))).limit(SAMPLE).collect()
    leaves = int(min(FIRST_LEAVES, max(min(LEAST_LEAVES, n // 64 + 1), n // LEAF_POINTS + 1)))
    fps = np.array([r.fp for r in sample], np.int64).reshape(-1, words).view(np.uint64)
    tree = Tree(fps, np.array([r.size for r in sample]) if factor else None, leaves, radius, factor)
    sent = spark.sparkContext.broadcast((tree.root, tree.radius, tree.margin))  # at most 2 * FIRST_LEAVES nodes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, fp, sizes = _columns(batch, words)
                yield from _routed_batches(ids, fp, sizes, *route_points(*sent.value, fp, sizes if factor else None))

    return points.select("id", "fp", "size").mapInArrow(route, ROUTED)


def divided(rows: DataFrame, radius: int, words: int, factor: float | None, leaf_rows: int | None = None, round_leaves: int | None = None) -> DataFrame:
    """Rows as `ROUTED`, with leaves of more than `leaf_rows` rows divided by trees of their own.

    A pass divides all heavy leaves of a level, and only their rows go on to the next; leaves that are light enough stay
    in the table of their level. A leaf stays as it is where its largest part got nearly all of it: its points are too
    close for a boundary. Up to `round_leaves` trees are broadcast; more meet the rows of their leaves by a shuffle,
    where a leaf is dealt out as its size asks for."""
    leaf_rows, round_leaves = leaf_rows or LEAF_ROWS, ROUND_LEAVES if round_leaves is None else round_leaves
    names = [c.split()[0] for c in ROUTED.split(", ")]
    rows, finished = written(rows.select(*names, F.lit(None).cast("long").alias("whole")), "routed"), []

    def grow(key: tuple, sample: pa.Table) -> pa.Table:
        _, fp, held = _columns(sample, words)
        order = np.lexsort(fp.T)
        tree = Tree(fp[order], held[order] if factor else None, LEAF_PARTS, radius, factor)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps((tree.root, tree.radius, tree.margin))], pa.binary())})

    def parts_of(leaf: int, tree: bytes, whole: int, ids: np.ndarray, fp: np.ndarray, held: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        point, part, mine = route_points(*pickle.loads(tree), fp, held if factor else None, own)
        # Leaves that chance gives one name are compared as one, which finds the same links.
        name = (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(leaf * 0xBF58476D1CE4E5B9 % 2**64)
        for batch in _routed_batches(ids, fp, held, point, name.view(np.int64), mine):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, whole))], [*names, "whole"])

    while True:
        # Of two leaves of one name the larger parent counts.
        sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("owned"), F.max("whole").alias("whole"))
        heavy = written(sizes.where((F.col("n") > leaf_rows) & (F.col("whole").isNull() | (F.col("n") <= 0.9 * F.col("whole")))).select("leaf", "n", (F.lit(float(LEAF_SAMPLE)) / F.greatest("owned", F.lit(1))).alias("part")), "heavy")
        few = heavy.count() <= round_leaves
        place = (F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(1 << 20)) / float(1 << 20)) < F.col("part")
        sample = rows.where("own").join(F.broadcast(heavy) if few else heavy, "leaf").where(place).select(*names)
        trees = written(sample.groupBy("leaf").applyInArrow(grow, "leaf long, tree binary").join(heavy.select("leaf", "n"), "leaf"), "trees")
        if trees.isEmpty():
            return reduce(DataFrame.unionByName, [*finished, rows.select(*names)])
        chosen = F.broadcast(trees.select("leaf")) if few else trees.select("leaf")
        finished.append(rows.join(chosen, "leaf", "left_anti").select(*names))
        if few:
            sent = rows.sparkSession.sparkContext.broadcast({r.leaf: (bytes(r.tree), r.n) for r in trees.collect()})  # round_leaves trees at most

            def route(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    leaf, own = batch.column("leaf").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
                    ids, fp, held = _columns(batch, words)
                    for k in np.unique(leaf).tolist():
                        at = np.flatnonzero(leaf == k)
                        yield from parts_of(k, *sent.value[k], ids[at], fp[at], held[at], own[at])

            routed = rows.join(chosen, "leaf", "left_semi").select(*names).mapInArrow(route, f"{ROUTED}, whole long")
        else:
            dealt = F.ceil(F.col("n") / leaf_rows).cast("int")
            asked = rows.drop("whole").join(trees.select("leaf", "n"), "leaf").withColumn("salt", F.pmod(F.xxhash64("id"), dealt).cast("int")).drop("n")
            copies = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), dealt - 1)))

            def meet(some: pa.Table, trees: pa.Table) -> pa.Table:
                empty = pa.schema([("leaf", pa.int64()), ("own", pa.bool_()), ("id", pa.int64()), ("fp", pa.list_(pa.int64())), ("size", pa.int64()), ("whole", pa.int64())]).empty_table()
                if not some.num_rows or not trees.num_rows:
                    return empty
                ids, fp, held = _columns(some, words)
                made = parts_of(trees.column("leaf")[0].as_py(), trees.column("tree")[0].as_py(), trees.column("n")[0].as_py(), ids, fp, held, some.column("own").to_numpy())
                return pa.concat_tables([empty, *(pa.Table.from_batches([x]).cast(empty.schema) for x in made)])

            routed = asked.groupBy("leaf", "salt").cogroup(renewed(copies).groupBy("leaf", "salt")).applyInArrow(meet, f"{ROUTED}, whole long")
        rows = written(routed, "routed")


def linked_points(routed: DataFrame, radius: int, words: int, factor: float | None = None) -> DataFrame:
    """routed: rows as `ROUTED`. Links a, b that connect what lies within the radius and meets in a leaf."""

    def meet(rows: pa.Table) -> pa.Table:
        ids, fp, sizes = _columns(rows, words)
        label = _leaf_links(fp, sizes if factor else None, rows.column("own").to_numpy(), radius, factor)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": ids[label[linked]], "b": ids[linked]})

    return divided(routed, radius, words, factor).groupBy("leaf").applyInArrow(meet, "a long, b long")


def band_shards(points: DataFrame, broadcast_keys: int | None = None) -> DataFrame:
    """points: id, fp, size, bands. Rows as `ROUTED` for shards in which several points meet, each set of points once."""
    keyed = points.select("id", F.explode("bands").alias("leaf"))
    # Most keys belong to one point: they are counted, and only points of the others travel with them.
    shared = written(keyed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf"), "keys")
    few = shared.count() <= (BROADCAST_KEYS if broadcast_keys is None else broadcast_keys)
    met = written(keyed.join(F.broadcast(shared) if few else shared, "leaf"), "shards")
    about = met.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("low"), F.max("id").alias("high"))
    once = about.groupBy("n", "x", "low", "high").agg(F.min("leaf").alias("leaf")).select("leaf")
    return met.join(once, "leaf").join(points.select("id", "fp", "size"), "id").select("leaf", F.lit(True).alias("own"), "id", "fp", "size")


def simhash_fingerprints(docs: DataFrame, k: int, words: int, sizes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (array<long> of `words` words), size (distinct shingles, or 0), set (their hash, or 0), bands (or none), text_hash for every row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in _slices([t.as_buffer().size if t.is_valid else 0 for t in texts], 1 << 23):
                fp, about, bands = fingerprints(texts.slice(a, b - a).to_pylist(), k, words, sizes)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * words), pa.array(fp.view(np.int64).ravel())), pa.array(about[:, 0]), pa.array(about[:, 1]), keys, batch.column(2).slice(a, b - a)], ["doc_id", "fp", "size", "set", "bands", "text_hash"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_hash(text).alias("text_hash")).mapInArrow(emit, "doc_id long, fp array<long>, size long, set long, bands array<long>, text_hash long")


# --- comparing the sets of candidates ---


def similar_sets(lengths: np.ndarray, hashes: np.ndarray, similarity: float) -> np.ndarray:
    """label: for sets given as consecutive runs of distinct hashes, the same number for those that links of the Jaccard similarity connect."""
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    size = lengths[order]
    begins = np.cumsum(lengths) - lengths
    starts = np.concatenate([[0], np.cumsum(size)])
    codes = np.unique(hashes, return_inverse=True)[1][np.repeat(begins[order] - starts[:-1], size) + np.arange(starts[-1])]
    marks = np.zeros(codes.max(initial=0) + 1, np.int64)
    label, waits = np.arange(n), np.ones(n, bool)
    # All links of a set that has been compared with those that wait are known; what waits in one component needs no more.
    while True:
        waiting = np.bincount(label[waits], minlength=n)
        if np.count_nonzero(waiting) < 2:
            break
        smallest = np.argmin(np.where(waiting, waiting, n + 1))
        p = np.flatnonzero(waits & (label == smallest))[0]
        waits[p] = False
        a, b = np.searchsorted(size, similarity * size[p] - 1e-9), np.searchsorted(size, size[p] / similarity + 1e-9, "right")
        at = np.arange(a, b)[(waits & (label != smallest))[a:b]]
        if not len(at):
            continue
        marks[codes[starts[p] : starts[p + 1]]] = 1
        held = np.repeat(starts[at] - (np.cumsum(size[at]) - size[at]), size[at]) + np.arange(size[at].sum())
        both = np.add.reduceat(marks[codes[held]], np.cumsum(size[at]) - size[at])
        marks[codes[starts[p] : starts[p + 1]]] = 0
        found = np.unique(label[at[both >= similarity * (size[at] + size[p] - both) - 1e-9]])
        label[np.isin(label, found)] = smallest
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def linked_sets(lengths: np.ndarray, hashes: np.ndarray, asks: np.ndarray, similarity: float) -> np.ndarray:
    """The same as `similar_sets`, by the links of those sets that ask (a mask) with all others only."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.unique(hashes, return_inverse=True)[1]
    marks, label = np.zeros(codes.max(initial=0) + 1, np.int64), np.arange(len(lengths))
    for p in np.flatnonzero(asks):
        at = np.flatnonzero((label != label[p]) & (lengths >= similarity * lengths[p] - 1e-9) & (lengths <= lengths[p] / similarity + 1e-9) & (lengths > 0))
        if not len(at):
            continue
        marks[codes[starts[p] : starts[p + 1]]] = 1
        begins = np.cumsum(lengths[at]) - lengths[at]
        held = np.repeat(starts[at] - begins, lengths[at]) + np.arange(lengths[at].sum())
        both = np.add.reduceat(marks[codes[held]], begins)
        marks[codes[starts[p] : starts[p + 1]]] = 0
        found = np.unique(label[at[both >= similarity * (lengths[at] + lengths[p] - both) - 1e-9]])
        label[np.isin(label, found)] = label[p]
    return label


def _spanning(ids: np.ndarray, label: np.ndarray) -> pa.Table:
    """Links of each row with the first of its label."""
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    a, b = ids[first[of]], ids
    return pa.table({"a": a[a != b], "b": b[a != b]})


def _sets(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, length, and all hashes of sets."""
    held = rows.column("shingles").combine_chunks()
    return rows.column("id").to_numpy(), held.value_lengths().to_numpy().astype(np.int64), held.flatten().to_numpy().view(np.uint64)


def _asking(members: DataFrame, asking: DataFrame, similarity: float) -> DataFrame:
    """members, asking: key columns component, own and (of both or neither) other, id, shingles. Links a, b of those that
    ask with the members of their key."""
    keys = [c for c in members.columns if c in ("component", "own", "other")]

    def compare(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        (ids, n, hashes), (own, m, more) = _sets(some), _sets(asked)
        new = ~np.isin(own, ids)  # members that ask are there already
        ids, asks = np.concatenate([ids, own[new]]), np.concatenate([np.isin(ids, own), np.ones(int(new.sum()), bool)])
        return _spanning(ids, linked_sets(np.concatenate([n, m[new]]), np.concatenate([hashes, more[np.repeat(new, m)]]), asks, similarity))

    return members.groupBy(*keys).cogroup(renewed(asking).groupBy(*keys)).applyInArrow(compare, "a long, b long")


def large_links(sets: DataFrame, similarity: float, representatives: int = REPRESENTATIVES, rounds: int = ROUNDS) -> DataFrame:
    """sets: id, component, blocks, shingles, a written table of components too large for one task. Links a, b that
    connect the sets of a component with that similarity.

    In each round a few representatives of every component are compared with all its sets, which is linear. What they
    link is one group; of the sets outside a component's largest group, one for each group is a representative of the
    next round. When those outside fill one block at most, or after `rounds` rounds, they are compared with all sets of
    the component. Pairs within the largest group need no comparison, since it is connected."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = sets.select("component", own.alias("own"), "id", "shingles")
    about = sets.select("id", "component", "blocks", (F.size("shingles") + 100).alias("load"))
    order = Window.partitionBy("component").orderBy(F.xxhash64("id", F.lit(SEED)))
    chosen, links = about.select("id", "component"), None
    for turn in range(rounds):
        few = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= representatives).select("id")
        asking = sets.join(few, "id").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), "id", "shingles")
        found = _asking(members, asking, similarity)
        links = written(found if links is None else links.unionByName(found), "set-links")
        groups = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("label"))
        labelled = written(about.join(groups, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
        largest = labelled.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
        outside = written(labelled.join(largest, "component").where("label != largest").drop("largest"), "outside")
        most = outside.groupBy("component").agg(F.sum("load").alias("load")).agg(F.max("load")).first()[0] or 0
        if most <= BLOCK_SHINGLES:
            break
        chosen = outside.groupBy("component", "label").agg(F.min("id").alias("id")).select("id", "component")
    loads = outside.groupBy("component").agg(F.ceil(F.sum("load") / BLOCK_SHINGLES).cast("int").alias("others"))
    several = outside.select("id", "component").join(loads, "component")
    asking = sets.drop("component").join(several, "id").withColumn("other", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("others")).cast("int"))
    asking = asking.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), "other", "id", "shingles")
    every = members.join(loads, "component").select("component", "own", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "id", "shingles")
    return links.unionByName(_asking(every, asking, similarity))


def verified_links(candidates: DataFrame, points: DataFrame, docs: DataFrame, k: int, similarity: float, text_col: str) -> DataFrame:
    """candidates: node, component; points: id, size, text_hash. Links a, b that connect the sets of a component with that similarity."""
    members = candidates.join(points, candidates.node == points.id).select("id", "component", "size", "text_hash")
    total = members.groupBy("component").agg(F.ceil(F.sum(F.col("size") + 100) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    wanted = written(members.join(total, "component"), "candidates")
    text = F.col(text_col).cast("string")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [np.unique(np.array(shingle_hashes(t, k), np.uint64)) for t in part.column(3).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "component", "blocks", "shingles"])

    def sets_of(some: DataFrame) -> DataFrame:
        # Of texts with equal hashes any will do: combined before they are sent.
        texts = docs.select(F.coalesce(text, F.lit("")).alias("text"), text_hash(text).alias("text_hash")).join(some.select("text_hash"), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
        return some.select("id", "component", "blocks", "text_hash").join(texts, "text_hash").select("id", "component", "blocks", "text").mapInArrow(shingle, "id long, component long, blocks int, shingles array<long>")

    def compare(rows: pa.Table) -> pa.Table:
        ids, lengths, hashes = _sets(rows)
        return _spanning(ids, similar_sets(lengths, hashes, similarity))

    small = sets_of(wanted.where("blocks = 1")).select("component", "id", "shingles").groupBy("component").applyInArrow(compare, "a long, b long")
    large = wanted.where("blocks > 1")
    return small if large.isEmpty() else small.unionByName(large_links(written(sets_of(large), "large-sets"), similarity))


def near_duplicates(docs: DataFrame, k: int = 5, radius: int = 12, words: int = 1, min_similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component (a number), component_id for every row: the smallest identifier reachable over links of fingerprints.

    min_similarity: links are those within the radius whose sets of distinct shingles have this Jaccard similarity."""
    # A point's id: the fingerprint itself if it is one word and all that counts, else a 64-bit hash of what tells it apart.
    sets = min_similarity is not None
    point = F.col("set") if sets else F.get("fp", 0) if words == 1 else F.xxhash64("fp")
    rows = written(simhash_fingerprints(docs, k, words, sets, id_col, text_col).withColumn("id", point), "fingerprints")
    points = written(rows.groupBy("id").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("first_id")), "points")
    routed = band_shards(points) if sets else first_leaves(points, radius, words, None)
    found = connected_components(linked_points(routed, radius, words, min_similarity))
    if sets:
        found = connected_components(verified_links(found, points, docs, k, min_similarity, text_col))
    found = found.select(F.col("node").alias("id"), "component")
    known = written(points.select("id", "first_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "known")
    # Written, so that the join below shuffles both sides anew and Spark can split a large component's rows.
    smallest = written(known.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    named = known.join(smallest, "component").select("id", "component", "component_id")
    return rows.join(named, "id").select("doc_id", "text_hash", "fp", "component", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), k=3, radius=2, words=1)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", 0)), 16, "0")).alias("fingerprint"), "component_id")
