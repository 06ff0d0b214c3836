import hashlib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import hashing as H
from lodestone.functions import schemas as S
from lodestone.functions import text as T
from lodestone.functions import training as R


def normal(text):
    text = unicodedata.normalize("NFKC", text).replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")
    lines, out = [x.rstrip() for x in text.split("\n")], []
    for x in lines:
        if x or not out or out[-1]:
            out.append(x)
    return "\n".join(out).strip()


def test_normalization(spark):
    texts = ["Ａ\r\n\r\n\r\n  B  \x00", "", " \n\t\n x \x0b\n\n\n\ny　", "a\rb\r\n c \x1c\n", "ﬁne ① é", "a\xa0\n\n \nb"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", T.normalize_corpus(F.col("t")).alias("n")).collect()}
    assert got == {i: normal(t) for i, t in enumerate(texts)} and got[0] == "A\n\n  B"
    assert spark.range(1).select(T.normalize_tokenizer(F.lit(None))).first()[0] == ""


def test_splits_agree_with_big_integers(spark):
    texts = [f"text {i}" for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for f in (0.0, 0.1, 0.5, 1.0):
        got = {r.t: r.x for r in rows.select("t", H.in_fraction(F.col("t"), f).alias("x")).collect()}
        assert got == {t: int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") / 2**64 < f for t in texts}


def test_fingerprints(spark):
    text = "alpha beta alpha gamma"
    hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in text.split()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))
    row = spark.range(1).select(H.simhash_words(F.lit(text)).alias("a"), H.simhash_words(F.lit("")).alias("e"), H.hamming(F.lit(5).cast("long"), F.lit(6).cast("long")).alias("d")).first()
    assert (row.a % 2**64, row.e, row.d) == (want, 0, 2)


def test_tools_of_both_conventions():
    typed = S.tidy_tool({"function": {"name": "f", "parameters": {"properties": {"city": {"type": "str", "required": True}, "days": {"type": "int"}}}}})
    assert typed["parameters"]["required"] == ["city"] and typed["parameters"]["properties"]["days"] == {"type": "integer"}
    older = S.tidy_tool({"name": "brew", "parameters": {"beans": {"type": "float"}, "strength": {"type": "int, optional"}, "water": {"type": "int", "default": 2}, "cup": {"type": "str", "required": "false"}, "milk": {"type": "bool", "required": "True", "default": False}}})
    assert older["parameters"]["required"] == ["beans", "milk"] and older["parameters"]["properties"]["strength"] == {"type": "integer"}
    assert S.tidy_tool({"name": " "}) is None and S.tidy_tool([]) is None and S.tidy_tool({"function": "f"}) is None
    assert S.tidy_tool({"name": "x", "parameters": None})["parameters"] == {"type": "object", "properties": {}, "required": [], "additionalProperties": False}
    assert [S.type_name(x) for x in ("List[int]", "dict, optional", " int | ", "", None, ["str", "null"], "weird", "optional, str", "Tuple", 5, "int |, x")] == ["array", "object", "integer", "string", None, ["null", "string"], "weird", "string", "array", "5", "int |"]


def test_schemas_are_kept_down_to_a_depth():
    deep = {"type": "str", "description": " x "}
    for i in range(9):
        deep = {"type": "list", "items": deep, "minLength": i, "other": 1}
    got, levels = S.tidy_schema(deep), 0
    while got["type"] == "array":
        assert set(got) == {"type", "items", "minLength"}
        got, levels = got["items"], levels + 1
    assert got == {"type": "string"} and levels == S.DEEPEST + 1
    mixed = {"properties": {"b": {"enum": []}, "a": {"enum": [1], "pattern": ["x"]}, "c": 5}, "required": ["z", "b"]}
    assert S.tidy_schema(mixed) == {"type": "object", "properties": {"a": {"type": "string", "enum": [1]}, "b": {"type": "string"}}, "required": ["b"]}
    assert S.tidy_schema({"items": 3}) == {"type": "array", "items": {"type": "string"}} and S.tidy_schema(None) == {"type": "string"}


def test_values_and_contracts():
    tool = S.tidy_tool({"name": "t", "parameters": {"properties": {"value": {"type": "integer"}, "mode": {"type": "string", "enum": ["safe", "fast"]}, "list": {"type": "array", "items": {"type": "number"}}}, "required": ["value"]}})
    assert S.arguments_fit(tool, {"value": 1, "mode": "safe", "list": [1, 2.5]}, True)
    for bad in ({"value": True}, {"value": 1.5}, {"mode": "safe"}, {"value": 1, "mode": "odd"}, {"value": 1, "more": 1}, {"value": 1, "list": ["a"]}, None):
        assert not S.arguments_fit(tool, bad, True)
    call = {"decision": "call", "tool_name": "t", "arguments": {"value": 1}, "missing_required_fields": []}
    ask = {"decision": "ask_clarification", "tool_name": "t", "arguments": {}, "missing_required_fields": ["value"]}
    none = {"decision": "no_call", "tool_name": None, "arguments": {}, "missing_required_fields": []}
    assert [S.target_fault(x, [tool]) for x in (call, ask, none)] == [None, None, None]
    assert S.fits(None, {"type": ["string", "null"]}) and S.fits(None, {}) and not S.fits(None, {"type": "string"}) and not S.fits(None, {"type": "any", "enum": [1]}) and S.fits([], {}) and not S.fits("x", {"type": "weird"}) and not S.fits(float("inf"), {"type": "number"})
    assert S.target_fault(call | {"confidence": 1}, [tool]) == "keys"
    assert S.target_fault(ask | {"missing_required_fields": ["mode"]}, [tool]) == "not missing"
    assert S.target_fault(none | {"arguments": {"a": 1}}, [tool]) == "no_call"
    assert S.target_fault(call, [tool, tool]) == "tool names"


def test_plans_and_tolerances(spark):
    plan = R.token_plan(4_007_835_072, 2048, 2, 2, 32)
    assert (plan["steps"], plan["trained_tokens"], plan["source_tokens_used"], plan["source_tokens_unused"]) == (15_281, 4_005_822_464, 4_007_778_432, 56_640)
    row = spark.range(1).select(R.mixture_tolerance(F.lit(16384), F.lit(1_050_000)).alias("a"), R.mixture_tolerance(F.lit(16384), F.lit(475_000_000)).alias("b")).first()
    assert row.a > 0.03 and row.b == 0.001


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=8))
def test_canonical_text_parses_back(value):
    assert S.parse_or(S.canonical(value)) == value
    with pytest.raises(ValueError):
        S.canonical([float("nan")])


def test_words_are_folded(spark):
    texts = ["Straße STRASSE", "ﬁne K2 ſee", "A-b_C a", None]
    got = [r.w for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.lexical_words(F.col("t")).alias("w")).collect()]
    assert got == [["strasse"], ["fine", "k2", "see"], ["a", "b", "c"], []]


def test_batches_for_python_are_bounded_by_bytes(spark, tmp_path):
    import pyarrow as pa

    from lodestone.plans.catalog import docs
    from lodestone.sources.scratch import BATCH_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text", "'en' AS lang", "'a' AS source")
    rows.write.parquet(f"{tmp_path}/documents.parquet")

    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    spark.conf.unset(name)
    assert max(r.n for r in docs(spark, str(tmp_path)).select("text").mapInArrow(told, "n long").collect()) < 2 * BATCH_BYTES
    spark.conf.set(name, "1m")
    docs(spark, str(tmp_path))
    assert spark.conf.get(name) in ("1m", "1048576b", "1048576")
    spark.conf.unset(name)


def test_tokens_are_decoded_by_bounded_slices():
    import pandas as pd

    from lodestone.functions.tokenizers import _batches

    rows = pd.Series([[1] * 100_000, None, [2] * 200_000, [], [3] * 300_000], dtype=object)
    assert list(_batches(rows)) == [(0, 2), (2, 4), (4, 5)] and list(_batches(rows[:0])) == []


def test_each_distinct_piece_is_encoded_once():
    import public_tokenizers

    from lodestone.functions.tokenizers import Counter

    counter, seen = Counter(public_tokenizers.path("byte_bpe_50k.json")), []
    whole = counter.lengths
    counter.lengths = lambda texts: seen.extend(texts) or whole(texts)
    texts = ["one two one\n\ntwo", "", "two one  two"] * 50
    assert counter.counts(texts) == [len(counter.model.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(seen) == len(set(seen))
