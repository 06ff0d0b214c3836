"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import hashlib
import re

import duckdb
import pytest

from lodestone.functions.text import corpus_form
from lodestone.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted(map(str, rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert got == want


def fingerprint(text, shingles):
    """Bit by bit, in Python's integers."""
    if shingles:
        words = re.findall(r"[A-Za-z0-9_./:{}-]+", (text or "").lower())[:4000]
        k = 5 if len(words) >= 5 else 1
        tokens = ["\x1f".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    else:
        tokens = re.findall("[a-z0-9]+", (text or "").casefold())
    hashes = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") for t in tokens]
    value = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))
    return value - 2**64 if value >= 2**63 else value


def audited():
    """The audit, document by document, with the library's own token counts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, out, seen = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, set()
    for source, text in duckdb.sql(f"SELECT source, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall():
        text = corpus_form(text)
        emitted, accepted, short, duplicate, characters, before, after = out.get(source, (0,) * 7)
        n = len(whole.encode(text, add_special_tokens=False).ids) + 1
        if len(text) < 120:
            short += 1
        elif (source, text) in seen:
            duplicate += 1
        else:
            seen.add((source, text))
            accepted, characters, before, after = accepted + 1, characters + len(text), before + n, after + min(n, 16384)
        out[source] = (emitted + 1, accepted, short, duplicate, characters, before, after)
    return out


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if name == "scaling_fit":
        assert rows[0].rmse < 0.15 and rows[0].runs == 9
    if name == "tokenized_documents":
        import public_tokenizers
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
        for r in rows:
            ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
            ids = [*(ids if len(ids) < 2048 else ids[:2047]), 50256]
            assert (r.n, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    if name.startswith("simhash"):
        texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
        assert {r.doc_id: r.fp for r in rows} == {i: fingerprint(t, name == "simhash_b") for i, t in texts.items()}
    if name == "capacity_audit_tokens":
        assert {r.source: (r.emitted, r.accepted, r.short, r.duplicate, r.characters, r.tokens_before, r.tokens_after) for r in rows} == audited()
    if name == "sft_records":
        assert all(r.fault is None and r.id.startswith("tc_sft_v1_") for r in rows)


def test_texts_are_normalized_in_one_arrow_call(spark):
    """And what is joined or sorted are keys: no text passes an exchange of the slim table."""
    from pyspark.sql import functions as F

    from lodestone.operators import corpus

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    plan = rows.withColumn("n", corpus.normalize_corpus(F.col("text"))).select(F.sha2("n", 256), F.length("n"), F.expr("regexp_count(n, '\\\\S+')"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    slim = corpus.measured(rows, ["source", "doc_id"])
    assert "text" not in slim.columns and all(t != "string" or c == "source" for c, t in slim.dtypes)


@pytest.mark.parametrize("name", ["packed_batches", "slugs"])
def test_all_rows_are_taken_at_another_size(spark, name):
    """150,000 orders and 10,000 documents."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("orders", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))
