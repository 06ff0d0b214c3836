"""Queries of fingerprints, near-duplicates, shared words and chunks.

Near-duplicate operators take any 64-bit fingerprint; the queries here use SHA-256 where SQL has to agree (DuckDB has
no BLAKE2b, which `simhash_a` and `simhash_b` use)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import hashing as H
from lodestone.functions import text as T
from lodestone.operators import corpus, dialogs, near_dup
from lodestone.plans.catalog import _t, docs, query, spread_docs


def fingerprint_sql(tokens: str) -> str:
    """A CTE fp (doc_id, fp) over t (doc_id, tok list): majorities of the bits of hashes, as a signed number."""
    return f"""t AS ({tokens}), u AS (SELECT doc_id, unnest(tok) AS w FROM t), h AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 16))::UBIGINT AS h FROM u),
bits AS (SELECT doc_id, b, 2 * count(*) FILTER (WHERE (h >> b) & 1 = 1) >= count(*) AS one FROM h, range(64) r(b) GROUP BY ALL),
v AS (SELECT doc_id, sum(CASE WHEN one THEN (1::HUGEINT << b) ELSE 0 END)::HUGEINT AS v FROM (SELECT doc_id, b::INT AS b, one FROM bits) GROUP BY 1),
fp AS (SELECT t.doc_id, (CASE WHEN coalesce(v, 0) >= 9223372036854775808 THEN v - 18446744073709551616 ELSE coalesce(v, 0) END)::BIGINT AS fp FROM t LEFT JOIN v USING (doc_id))"""


_A = fingerprint_sql("SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+') AS tok FROM documents")
_B = fingerprint_sql(r"SELECT doc_id, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], chr(31))) AS tok FROM (SELECT *, CASE WHEN len(w) >= 5 THEN 5 ELSE 1 END AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_./:{}-]+')[1:4000] AS w FROM documents))")


@query()
def simhash_a(spark, d):
    return spread_docs(spark, d).select("doc_id", H.simhash_words(F.col("text")).alias("fp"))


@query()
def simhash_b(spark, d):
    return spread_docs(spark, d).select("doc_id", H.simhash_shingles(F.col("text")).alias("fp"))


@query(f"WITH {_A} SELECT * FROM fp")
def simhash_a_sha256(spark, d):
    return spread_docs(spark, d).select("doc_id", H.simhash_words(F.col("text"), "sha256").alias("fp"))


@query(f"WITH {_B} SELECT * FROM fp")
def simhash_b_sha256(spark, d):
    return spread_docs(spark, d).select("doc_id", H.simhash_shingles(F.col("text"), digest="sha256").alias("fp"))


def _prints(spark, d):
    return spread_docs(spark, d).select(F.col("doc_id").alias("id"), H.simhash_shingles(F.col("text"), digest="sha256").alias("fp"))


@query(f"WITH {_B}, c AS (SELECT min(doc_id) AS id, fp FROM fp GROUP BY fp) SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON x.id < y.id AND bit_count(xor(x.fp, y.fp)) <= 3")
def near_dup_pairs(spark, d):
    """Pairs of classes of equal fingerprints within 3 bits."""
    return near_dup.near_pairs(near_dup.classes(_prints(spark, d)).select("id", "fp"), 3)


@query(f"""WITH RECURSIVE {_B}, o AS (SELECT doc_id, fp, row_number() OVER (ORDER BY doc_id) AS n FROM fp),
g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, false AS accepted UNION ALL
SELECT o.n, CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k, o.fp)) <= 2)) = 0 THEN list_append(kept, o.fp) ELSE kept END, len(list_filter(kept, lambda k: bit_count(xor(k, o.fp)) <= 2)) = 0 FROM g JOIN o ON o.n = g.n + 1)
SELECT doc_id AS id, accepted FROM g JOIN o USING (n)""")
def near_dup_greedy(spark, d):
    return near_dup.greedy_accepted(_prints(spark, d), 2)


@query(f"""WITH {_B}, s AS (SELECT doc_id, source, fp FROM fp JOIN documents USING (doc_id) WHERE substr(sha256(text), 1, 16) < '{H.fraction_bound(0.5)}' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10000),
r AS (SELECT *, row_number() OVER (PARTITION BY source, band, v ORDER BY doc_id) AS n FROM (SELECT *, (fp >> (16 * band)::INT) & 65535 AS v FROM s, range(4) t(band))),
hit AS (SELECT DISTINCT a.source, a.doc_id FROM r a JOIN r b ON a.source = b.source AND a.band = b.band AND a.v = b.v AND a.n - b.n BETWEEN 1 AND 64 AND bit_count(xor(a.fp, b.fp)) <= 3)
SELECT s.source, count(*) AS sampled, count(hit.doc_id) AS near_duplicates, count(hit.doc_id)::DOUBLE / count(*) AS fraction FROM s LEFT JOIN hit USING (source, doc_id) GROUP BY 1""")
def near_dup_audit_sample(spark, d):
    return near_dup.audit_sample(spread_docs(spark, d), H.simhash_shingles(F.col("text"), digest="sha256"), 0.5, 10_000, 3)


@query(r"""WITH p AS (SELECT min(p_partkey)::VARCHAR AS id, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part GROUP BY p_name),
u AS (SELECT id, unnest(w) AS word FROM p), o AS (SELECT a.id, b.id AS other, count(*)::INT AS overlap FROM u a JOIN u b USING (word) WHERE a.id <> b.id GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, sha256(other))::INT AS rank FROM o QUALIFY rank <= 5""")
def lexical_overlap_topk(spark, d):
    """The five part names most like each one, by shared words."""
    parts = _t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").cast("string").alias("id")).select("id", F.col("p_name").alias("name"), T.lexical_words(F.col("p_name")).alias("words"), F.lit("all").alias("split"))
    return dialogs.partners(parts, ["split"], 5).select("id", "other", "overlap", "rank")


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: len(p) > 0) AS p FROM documents),
c AS (SELECT doc_id, flatten(list_transform(p, lambda x: list_transform(range(0, (len(x) - 1) // 8192 + 1), lambda i: substr(x, i * 8192 + 1, 8192)))) AS p FROM s),
f AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: {'done': []::VARCHAR[], 'open': x}), lambda a, x: CASE WHEN len(a.open) + len(x.open) + 2 <= 8192 THEN {'done': a.done, 'open': a.open || chr(10) || x.open} ELSE {'done': list_append(a.done, a.open), 'open': x.open} END) AS r FROM c WHERE len(p) > 0),
k AS (SELECT doc_id, list_filter(list_append(r.done, r.open), lambda x: len(x) >= 20) AS k FROM f)
SELECT doc_id, (unnest(range(1, len(k) + 1)) - 1)::INT AS part, unnest(k) AS chunk FROM k""")
def chunk_paragraph_pack(spark, d):
    return corpus.paragraph_chunks(spread_docs(spark, d), 8192, 20).select("doc_id", "part", "chunk")
