"""Queries of sequential decisions: quotas in sequence and the schedule that is coupled with deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import hashing as H
from lodestone.functions import text as T
from lodestone.operators import quotas
from lodestone.operators.ordered import global_position
from lodestone.plans.catalog import _905, _t, _weights, docs, query
from lodestone.plans.similarity import fingerprint_sql

_TURNS = fingerprint_sql("SELECT conv_id || '/' || turn AS doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+') AS tok FROM conversations")
_QUOTA = 12


@query(f"""WITH RECURSIVE {_TURNS}, r AS (SELECT conv_id, turn, role, fp, sha256(text) AS id, {_905.replace('text', 'conv_id::VARCHAR')} AS split FROM conversations JOIN fp ON doc_id = conv_id || '/' || turn),
o AS (SELECT *, split || '/' || role AS bucket, row_number() OVER (ORDER BY list_position(['train', 'validation', 'test'], split), role, turn, sha256(conv_id::VARCHAR), id) AS n FROM r),
g AS (SELECT 0::BIGINT AS n, ''::VARCHAR AS bucket, 0::BIGINT AS taken, []::STRUCT(role VARCHAR, fp BIGINT)[] AS kept, []::VARCHAR[] AS ids, false AS accepted
UNION ALL SELECT n, bucket, taken + ok::INT, CASE WHEN ok THEN list_append(kept, {{'role': role, 'fp': fp}}) ELSE kept END, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, ok FROM (
SELECT o.n, o.bucket, o.role, o.fp, o.id, g.kept, g.ids, CASE WHEN g.bucket = o.bucket THEN g.taken ELSE 0 END AS taken,
(g.bucket <> o.bucket OR g.taken < {_QUOTA}) AND NOT list_contains(g.ids, o.id) AND len(list_filter(g.kept, lambda k: k.role = o.role AND bit_count(xor(k.fp, o.fp)) <= 2)) = 0 AS ok FROM g JOIN o ON o.n = g.n + 1))
SELECT conv_id, turn, split, role FROM g JOIN o USING (n) WHERE accepted""")
def quota_sequence(spark, d):
    """Turns that fill a quota of each split and role, one bucket after another: no text twice, no near-duplicate of a role."""
    words = H.simhash_words(F.col("text"), "sha256")
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role", H.content_hash(F.col("text")).alias("id"), words.alias("fp"), H.split_90_5_5(H.content_hash(F.col("conv_id").cast("string"))).alias("split"))
    ranked = rows.withColumns({"_split": F.array_position(F.array(*map(F.lit, ["train", "validation", "test"])), F.col("split")), "_key": H.content_hash(F.col("conv_id").cast("string"))})
    kept = quotas.first_within_quotas(ranked, ["_split", "role"], ["turn", "_key"], _QUOTA, ["role"], 2, allow_short=True)
    return kept.select("conv_id", "turn", "split", "role")


@query(r"""WITH RECURSIVE t AS (SELECT source, doc_id, sha256(text) AS key, len(regexp_extract_all(text, '\S+')) + 1 AS n_tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
s AS (SELECT list({'source': source, 'weight': weight, 'written': 0::BIGINT, 'i': 0::BIGINT, 'n': n} ORDER BY source) AS state FROM (SELECT source, (1.0 + substr(source, 4)::INT % 4)::DOUBLE AS weight, count(*) AS n FROM documents GROUP BY 1)),
g AS (SELECT 0::BIGINT AS position, state, []::VARCHAR[] AS seen, ''::VARCHAR AS source, 0::BIGINT AS i, false AS accepted FROM s
UNION ALL SELECT position + 1, list_transform(state, lambda x: CASE WHEN x.source = next.source THEN {'source': x.source, 'weight': x.weight, 'written': x.written + CASE WHEN new THEN n_tokens ELSE 0 END, 'i': x.i + 1, 'n': x.n} ELSE x END), CASE WHEN new THEN list_append(seen, key) ELSE seen END, next.source, next.i + 1, new FROM (
SELECT p.position, p.state, p.seen, p.next, t.key, t.n_tokens, NOT list_contains(p.seen, t.key) AS new FROM (
SELECT position, state, seen, list_sort(list_transform(list_filter(state, lambda x: x.i < x.n), lambda x: {'turn': x.written / x.weight, 'source': x.source, 'i': x.i}))[1] AS next FROM g) p
JOIN t ON t.source = p.next.source AND t.i = p.next.i + 1))
SELECT g.source, doc_id, position - 1 AS position, accepted FROM g JOIN t ON t.source = g.source AND t.i = g.i WHERE position > 0""")
def coupled_schedule(spark, d):
    """The order in which documents are read, and which copies of texts survive, where both depend on each other."""
    rows = docs(spark, d).select("source", "doc_id", H.content_hash(F.col("text")).alias("key"), (T.whitespace_tokens(F.col("text")) + 1).alias("n_tokens"))
    turns = quotas.coupled_schedule(rows, _weights(spark)).select("source", "doc_id", "turn", "accepted")
    return global_position(turns, ["turn", "source", "doc_id"]).select("source", "doc_id", "position", "accepted")
