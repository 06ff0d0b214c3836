"""Mixing sources to target weights (operator 1): hierarchical budgets and seeded token-prefixes.

A tree of domain, language and source carries weights. A budget of tokens goes down the tree: every node divides its
budget among its children by weight, none gets more than its subtree can give (its tokens times `max_epochs`), and
what one child can't use goes to its siblings by weight. A subtree asks no more than it can give, so a shortage
climbs to the ancestor's other children only after the siblings are full. Tokens are whole: shares are rounded down,
and single tokens that are left go to the children in order of the largest remainder.

A leaf with a budget of q tokens and T tokens of its own takes all its documents q // T times, and of the next epoch
the longest prefix of at most q % T tokens, in an order that a hash of seed, epoch and row gives. The prefix is
found by sums over `BUCKETS` buckets of that hash, coarse ones first and then those inside the one in which the
prefix ends; only rows of that last bucket are sorted, so no task ever holds a leaf, whichever share of all rows it
has, nor more than `SIDE` sums of it.

Null languages, sources and domains are nodes like others, with the weight for names that aren't listed. Null and
empty texts have no tokens and are taken with the epochs they belong to. Rows of equal order are taken as they come,
which can only be equal rows. An empty table gives no rows. A tree of more than `MOST_LEAVES` leaves is refused.
Columns named as the results (`names`) are replaced by them; all other columns, whatever they are called, stay as they
are. A text of any length is one row, counted whole and never cut; the row whose tokens would exceed what a leaf may
still take is the first that isn't taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import documents, fresh, written

#: Buckets of the order of a leaf: SIDE coarse ones of SIDE each.
SIDE = 64
BUCKETS = SIDE * SIDE
#: Leaves of the tree, which the driver holds, at most.
MOST_LEAVES = 200_000
SEED = 42


@dataclass
class Weights:
    """Weights of nodes by name and level; a name that isn't listed has the weight `other`."""

    domain: dict = field(default_factory=dict)
    lang: dict = field(default_factory=dict)
    source: dict = field(default_factory=dict)
    other: float = 1.0

    def of(self, level: int, name: str | None) -> Fraction:
        return Fraction((self.domain, self.lang, self.source)[level].get(name, self.other)).limit_denominator(10**9)


def divide(budget: int, children: dict, capacity: dict, weight: dict) -> dict:
    """Whole shares of `budget` by weight, none over its capacity; what is left over when all are full is not given."""
    share = dict.fromkeys(children, 0)
    budget = min(budget, sum(capacity.values()))
    open_ = [c for c in children if weight[c] > 0 and capacity[c] > 0]
    fallback = [c for c in children if weight[c] <= 0 and capacity[c] > 0]
    while budget and (open_ or fallback):
        if not open_:  # only nodes of no weight are left: they serve what nobody else can
            open_, fallback = fallback, []
        total = sum(weight[c] if weight[c] > 0 else Fraction(1) for c in open_)
        fair = {c: budget * (weight[c] if weight[c] > 0 else Fraction(1)) / total for c in open_}
        full = [c for c in open_ if share[c] + fair[c] >= capacity[c]]
        if full:
            for c in full:
                budget -= capacity[c] - share[c]
                share[c] = capacity[c]
            open_ = [c for c in open_ if c not in full]
            continue
        for c in open_:
            share[c] += int(fair[c])
            budget -= int(fair[c])
        for c in sorted(open_, key=lambda c: (int(fair[c]) - fair[c], str(c)))[:budget]:
            share[c] += 1
        budget = 0
    return share


def budgets(tokens: dict[tuple, int], weights: Weights, budget: int, max_epochs: int) -> dict[tuple, int]:
    """tokens: leaf (a path of names) -> tokens it has. The budget of each leaf."""

    def down(paths: list[tuple], level: int, amount: int) -> dict[tuple, int]:
        if level == len(paths[0]):
            return {paths[0]: amount}
        by: dict = {}
        for p in paths:
            by.setdefault(p[level], []).append(p)
        names = sorted(by, key=lambda x: (x is None, str(x)))
        capacity = {c: max_epochs * sum(tokens[p] for p in by[c]) for c in names}
        share = divide(amount, names, capacity, {c: weights.of(level, c) for c in names})
        return {p: n for c in names for p, n in down(by[c], level + 1, share[c]).items()}

    return down(list(tokens), 0, budget) if tokens else {}


def count_words(text: Column) -> Column:
    """Runs of characters other than [\\x20\\x09-\\x0D]: the default token count."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, domain: Column, weights: Weights, budget: int | None = None, share: float = 1.0, max_epochs: int = 1, seed: int = SEED, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", names: tuple[str, str, str] = ("domain", "n_tokens", "copies")) -> DataFrame:
    """The rows with domain, n_tokens and copies (how many times the mixture takes the row; 0: not at all), called `names`.

    budget: tokens of the mixture; if not given, `share` of all tokens there are."""
    spark = docs.sparkSession
    d, l, s, n, ident, sha, full, rest, order, bucket, kd, kl, ks, cut, before, more, copies = fresh(docs, *(f"m_{x}" for x in ("domain", "lang", "source", "tokens", "id", "text", "full", "rest", "order", "bucket", "kd", "kl", "ks", "cut", "before", "more", "copies")))
    leaf = [d, l, s]
    # Each row's place in the order of any epoch depends on the seed, the epoch, its identifier and its text.
    rows = docs.withColumns({d: domain.cast("string"), l: F.col(lang_col).cast("string"), s: F.col(source_col).cast("string"), n: tokens if tokens is not None else count_words(F.col(text_col)), ident: F.col(id_col), sha: F.xxhash64(text_col)})
    have = written(rows.select(*leaf, n, ident, sha), "tokens")
    sums = have.groupBy(*leaf).agg(F.sum(n).alias("t")).limit(MOST_LEAVES + 1).collect()  # one row for each leaf
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"the tree has more than {MOST_LEAVES} leaves")
    amounts = {tuple(r[c] for c in leaf): int(r.t) for r in sums}
    total = sum(amounts.values())
    quota = budgets(amounts, weights, int(total * share) if budget is None else budget, max_epochs)
    plan = [(*p, q // amounts[p] if amounts[p] else max_epochs, q % amounts[p] if amounts[p] else 0) for p, q in quota.items()]
    keys = f"{kd} string, {kl} string, {ks} string"
    same = F.col(d).eqNullSafe(F.col(kd)) & F.col(l).eqNullSafe(F.col(kl)) & F.col(s).eqNullSafe(F.col(ks))
    plans = F.broadcast(spark.createDataFrame(plan, f"{keys}, {full} long, {rest} long"))  # at most MOST_LEAVES rows

    def placed(df: DataFrame) -> DataFrame:
        at = F.xxhash64(F.lit(seed), F.col(full), F.col(ident), F.col(sha))
        return df.join(plans, same, "left").withColumn(order, at).withColumn(bucket, F.shiftrightunsigned(order, 64 - 12).cast("int")).drop(kd, kl, ks)

    def ends(sums: DataFrame, ahead: Column) -> list:
        """The bucket (of SIDE at most in a leaf) in which each leaf's prefix ends: where the running sum exceeds what is left."""
        upto = F.sum("sum").over(Window.partitionBy(*leaf).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("upto", upto + ahead).where(F.col("upto") > F.col(rest))
        found = over.groupBy(*leaf).agg(F.min(F.struct("at", (F.col("upto") - F.col("sum")).alias("before"))).alias("c"))
        return [(*(r[c] for c in leaf), r.c["at"], r.c["before"]) for r in found.collect()]  # one row for each leaf

    def known_cuts(cuts: list) -> DataFrame:
        return F.broadcast(spark.createDataFrame(cuts, f"{keys}, {cut} int, {before} long"))

    wanted = placed(have).where(F.col(rest) > 0)
    side = F.floor(F.col(bucket) / SIDE).cast("int")
    coarse = ends(wanted.groupBy(*leaf, rest, side.alias("at")).agg(F.sum(n).alias("sum")), F.lit(0))
    inside = wanted.join(known_cuts(coarse), same & (side == F.col(cut))).groupBy(*leaf, rest, before, F.col(bucket).alias("at")).agg(F.sum(n).alias("sum"))
    fine = ends(inside, F.col(before))
    known = placed(rows).join(known_cuts(fine), same, "left").drop(kd, kl, ks)
    taken = F.when(F.col(rest) == 0, 0).when(F.col(cut).isNull() | (F.col(bucket) < F.col(cut)), 1).otherwise(0)
    edge = (F.col(rest) > 0) & F.col(cut).isNotNull() & (F.col(bucket) == F.col(cut))
    by = Window.partitionBy(*leaf).orderBy(order, ident, sha).rowsBetween(Window.unboundedPreceding, 0)
    sure = known.where(~edge).withColumn(more, taken)
    unsure = known.where(edge).withColumn(more, F.when(F.col(before) + F.sum(n).over(by) <= F.col(rest), 1).otherwise(0))
    out = sure.unionByName(unsure).withColumn(copies, (F.col(full) + F.col(more)).cast("long"))
    replaced = {x.lower() for x in names}
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in replaced), F.col(d).alias(names[0]), F.col(n).alias(names[1]), F.col(copies).alias(names[2]))


#: The domains of the sources in the test tables, by the number in a source's name, and the target weights of the query.
def source_domain(source: Column) -> Column:
    n = F.regexp_extract(source, r"([0-9]+)$", 1).cast("int")
    return F.when(n < 8, "web").when(n < 14, "reference").when(n.isNotNull(), "forum")


WEIGHTS = Weights(domain={"web": 0.5, "reference": 0.3, "forum": 0.2}, lang={"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2})


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of half of all tokens, with at most two epochs of a source."""
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), source_domain(F.col("source")), WEIGHTS, share=0.5, max_epochs=2)
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")
