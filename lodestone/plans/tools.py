"""Queries of tools, call targets, seeds, dialogs and API descriptions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.functions import schemas
from lodestone.functions import text as T
from lodestone.operators import dialogs, generate
from lodestone.operators.ordered import global_position
from lodestone.plans.catalog import _t, query

#: Tools of both parameter conventions, arguments for them, and what is expected of each.
TOOLS = [
    ("typed", {"type": "function", "function": {"name": "weather", "description": " Look up ", "parameters": {"type": "object", "properties": {"city": {"type": "str"}, "days": {"type": "int, optional"}}, "required": ["city", "gone"]}}}, {"city": "Bonn", "days": 3}),
    ("older", {"name": "brew", "parameters": {"beans": {"type": "float"}, "water": {"type": "int"}, "heat": {"type": "float, optional"}, "cups": {"type": "int", "default": 2}}}, {"beans": 1.5}),
    ("listed", {"name": "sort", "parameters": {"items": {"type": "List[int]"}, "down": {"type": "bool", "required": "false"}}}, {"items": [3, 1], "down": True}),
    ("choice", {"name": "paint", "parameters": {"properties": {"hue": {"type": ["null", "str"], "enum": ["red", "blue"]}}}}, {"hue": None}),
    ("wrong", {"name": "paint", "parameters": {"properties": {"hue": {"type": "str", "enum": ["red", "blue"]}}}}, {"hue": "green"}),
    ("nameless", {"parameters": {}}, {}),
]
TIDY = {
    "typed": '{"description":"Look up","name":"weather","parameters":{"additionalProperties":false,"properties":{"city":{"type":"string"},"days":{"type":"integer"}},"required":["city"],"type":"object"}}',
    "older": '{"description":"Execute brew","name":"brew","parameters":{"additionalProperties":false,"properties":{"beans":{"type":"number"},"cups":{"type":"integer"},"heat":{"type":"number"},"water":{"type":"integer"}},"required":["beans","water"],"type":"object"}}',
    "listed": '{"description":"Execute sort","name":"sort","parameters":{"additionalProperties":false,"properties":{"down":{"type":"boolean"},"items":{"items":{"type":"string"},"type":"array"}},"required":["items"],"type":"object"}}',
    "choice": '{"description":"Execute paint","name":"paint","parameters":{"additionalProperties":false,"properties":{"hue":{"enum":["red","blue"],"type":["null","string"]}},"required":[],"type":"object"}}',
    "wrong": '{"description":"Execute paint","name":"paint","parameters":{"additionalProperties":false,"properties":{"hue":{"enum":["red","blue"],"type":"string"}},"required":[],"type":"object"}}',
    "nameless": None,
}
VALID = {"typed": True, "older": False, "listed": False, "choice": True, "wrong": False}


def _values(rows: list[tuple], names: str) -> str:
    said = ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"(VALUES {said}) v({names})"


def _tools(spark):
    return spark.createDataFrame([(k, json.dumps(t), json.dumps(a)) for k, t, a in TOOLS], "id string, tool string, arguments string")


@query(f"SELECT id, tool, sha256(tool) AS signature FROM {_values(list(TIDY.items()), 'id, tool')}")
def tool_schema_normalize(spark, d):
    return _tools(spark).select("id", schemas.tool_json(F.col("tool")).alias("tool")).withColumn("signature", F.sha2("tool", 256))


@query(f"SELECT id, valid::BOOLEAN AS valid FROM {_values(list(VALID.items()), 'id, valid')}")
def arguments_valid(spark, d):
    rows = _tools(spark).withColumn("tool", schemas.tool_json(F.col("tool"))).where("tool IS NOT NULL")
    return rows.select("id", schemas.arguments_valid(F.col("tool"), F.col("arguments")).alias("valid"))


_CALL = {"decision": "call", "tool_name": "brew", "arguments": {"beans": 1.5, "water": 2}, "missing_required_fields": []}
_ASK = {"decision": "ask_clarification", "tool_name": "brew", "arguments": {"beans": 1.5}, "missing_required_fields": ["water"]}
_NONE = {"decision": "no_call", "tool_name": None, "arguments": {}, "missing_required_fields": []}
#: Targets over the tool `brew`, and why each breaks its contract.
TARGETS = [
    ("call", _CALL, None), ("ask", _ASK, None), ("none", _NONE, None), ("fifth key", _CALL | {"confidence": 1}, "keys"), ("odd decision", _CALL | {"decision": "maybe"}, "decision"), ("arguments text", _CALL | {"arguments": "x"}, "types"),
    ("stranger", _CALL | {"tool_name": "bake"}, "unknown tool"), ("lacking", _CALL | {"arguments": {"beans": 1.5}}, "arguments"), ("call with missing", _CALL | {"missing_required_fields": ["water"]}, "missing fields"), ("ask for nothing", _ASK | {"missing_required_fields": []}, "missing fields"),
    ("ask for the given", _ASK | {"missing_required_fields": ["beans"]}, "not missing"), ("ask for the optional", _ASK | {"missing_required_fields": ["heat"]}, "not missing"), ("named none", _NONE | {"tool_name": "brew"}, "no_call"),
]


@query(f"SELECT id, fault FROM {_values([(i, f) for i, _, f in TARGETS], 'id, fault')}")
def target_contract(spark, d):
    rows = spark.createDataFrame([(i, json.dumps(t), json.dumps([json.loads(TIDY["older"])])) for i, t, _ in TARGETS], "id string, target string, tools string")
    return rows.select("id", schemas.contract_fault(F.col("target"), F.col("tools")).alias("fault"))


# --- seeds ---

_FIRST = "SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1"
#: The tool that dialogs.synthetic_rows makes of a request: its words by length, and what they become.
_SEEDS = rf"""w AS (SELECT conv_id, query, list_sort(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\p{{L}}\p{{N}}]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))), lambda x: {{'n': -len(x), 'w': x}}))[1:4] AS l FROM ({_FIRST}) WHERE query IS NOT NULL),
f AS (SELECT conv_id, query, l[1].w AS head, CASE WHEN len(l) > 1 THEN list_transform(l[2:], lambda x: x.w) ELSE ['value'] END AS names FROM w WHERE len(l) > 0 UNION ALL SELECT conv_id, query, 'plain', ['value'] FROM w WHERE len(l) = 0),
p AS (SELECT *, array_to_string(list_transform(list_sort(names), lambda x: '"' || x || '":{{"description":"The ' || x || ' to use","type":"' || CASE WHEN list_position(names, x) % 2 = 1 THEN 'string' ELSE 'integer' END || '"}}'), ',') AS fields FROM f),
s AS (SELECT *, sha256('{{"parameters":{{' || fields || '}}}}') AS family, head || '_' || (conv_id % 97) AS tool FROM p),
z AS (SELECT *, CASE WHEN ('0x' || substr(family, 1, 12))::BIGINT % 10000 < 9000 THEN 'train' WHEN ('0x' || substr(family, 1, 12))::BIGINT % 10000 < 9500 THEN 'validation' ELSE 'test' END AS split FROM s)"""


def _seeds(spark, d):
    return dialogs.synthetic_seeds(spark, _t(spark, d, "conversations"))


@query(f"WITH {_SEEDS} SELECT conv_id AS source_position, tool, family, split FROM z")
def seed_families(spark, d):
    """Seeds of the conversations with the family of their tool, which decides the split."""
    return _seeds(spark, d).select("source_position", F.get_json_object("tool", "$.name").alias("tool"), "family", "split")


@query(f"WITH {_SEEDS} SELECT family, count(*) AS seeds, count(DISTINCT split) AS splits FROM z GROUP BY 1")
def sft_leakage(spark, d):
    """Families and how many splits they are in: one, or records leak (`dialogs.split_leaks` lists those)."""
    seeds = _seeds(spark, d)
    return seeds.groupBy("family").agg(F.count(F.lit(1)).alias("seeds"), F.count_distinct("split").alias("splits")).join(dialogs.split_leaks(seeds, "family").select("family"), "family", "left_anti")


@query(f"""WITH f AS ({_FIRST}) SELECT conv_id AS source_position, CASE conv_id % 8 WHEN 0 THEN 'empty_query' WHEN 1 THEN 'unparseable_tools_or_answers' WHEN 2 THEN 'not_single_call' WHEN 3 THEN 'invalid_answer' WHEN 4 THEN 'called_tool_not_unique' WHEN 5 THEN 'invalid_arguments' END AS fault FROM f WHERE query IS NOT NULL""")
def seed_faults(spark, d):
    """Source rows broken on purpose, by the identifier's remainder, and the first check that each fails."""
    rows = dialogs.synthetic_rows(_t(spark, d, "conversations"))
    kind = F.col("source_position") % 8
    broken = rows.withColumns({
        "query": F.when(kind == 0, "  ").otherwise(F.col("query")),
        "tools": F.when(kind == 1, "[{").when(kind == 4, F.concat(F.lit("["), F.expr("substring(tools, 2, length(tools) - 2)"), F.lit(","), F.expr("substring(tools, 2, length(tools) - 1)"))).otherwise(F.col("tools")),
        "answers": F.when(kind == 2, "[]").when(kind == 3, '["text"]').when(kind == 5, F.regexp_replace("answers", r'"arguments": \{', '"arguments": {"stranger": 1, ')).otherwise(F.col("answers")),
    })
    return dialogs.checked_seeds(broken).select("source_position", "fault")


def _records(spark, d):
    return dialogs.candidates(_seeds(spark, d), 3)


@query()
def sft_records(spark, d):
    return _records(spark, d).select("id", "split", "category", "round", "source_id", "decision", "request", "tools", "target", "fault")


@query(f"""WITH {_SEEDS}, pool AS (SELECT split, count(DISTINCT tool) AS tools FROM z GROUP BY 1), k(category, decision) AS (VALUES ('valid_call', 'call'), ('missing_required_fields', 'ask_clarification'), ('no_applicable_tool', 'no_call'), ('confusable_tools', 'call'), ('schema_constraints', 'call'), ('injection_resistance', 'call')),
c AS (SELECT z.split, category, decision, conv_id FROM z JOIN pool USING (split), k WHERE tools > 1 OR category IN ('valid_call', 'missing_required_fields', 'schema_constraints'))
SELECT split, category, decision, 3 * count(*) AS records, 0::BIGINT AS faults FROM c GROUP BY ALL""")
def sft_decisions(spark, d):
    """Records by split, category and decision, and how many break their contract: none."""
    return _records(spark, d).groupBy("split", "category", "decision").agg(F.count(F.lit(1)).alias("records"), F.count("fault").alias("faults"))


@query()
def sft_quota(spark, d):
    """Forty records of each split and category, or fewer where the table's seeds give no more."""
    made = _records(spark, d).select("id", "split", "category", "round", "decision", "fault", "fp", "order_key")  # texts aren't asked for
    return dialogs.accepted_records(made, 40, allow_short=True).select("id", "split", "category", "round", "decision")


@query("SELECT c_custkey AS id, 'acct ' || c_mktsegment || ': balance = ' || CASE WHEN len(c_acctbal::VARCHAR) <= 160 THEN c_acctbal::VARCHAR END || '; name = \"' || c_name || '\"' AS line, upper(c_mktsegment) AS segment FROM customer")
def argument_rendering(spark, d):
    """Arguments as text: names in order, JSON values."""
    c = _t(spark, d, "customer")
    given = F.create_map(F.lit("name"), F.concat(F.lit('"'), "c_name", F.lit('"')), F.lit("balance"), F.col("c_acctbal").cast("string"))
    return c.select(F.col("c_custkey").alias("id"), F.concat(T.humanized(F.concat(F.lit("acct_-"), "c_mktsegment")), F.lit(": "), T.known_arguments(given)).alias("line"), F.upper("c_mktsegment").alias("segment"))


# --- generated rows ---


def _draw(purpose: str, seed: int = 42) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || i || ':{purpose}'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


@query(f"SELECT i AS pos, floor({_draw('token')} * 32000)::INT AS token FROM (SELECT row_number() OVER () - 1 AS i FROM orders)")
def synthetic_tokens(spark, d):
    """As many random tokens as there are orders, each drawn for its place."""
    rows = global_position(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "pos")
    return generate.random_tokens(rows, 32000, 42)


def _generated_sql() -> str:
    pick, kind = f"floor({_draw('tool')} * {len(generate.TOOLS)})::INT", _draw("kind")
    texts = []
    for t, (name, about, fields) in enumerate(generate.TOOLS):
        must = [k for k, m in fields.items() if m]
        schema = json.dumps({"description": about, "name": name, "parameters": {"properties": {k: {"type": "string"} for k in fields}, "required": must, "type": "object"}}, sort_keys=True)
        gone = f"[{', '.join(repr(k) for k in must)}][floor({_draw('gone')} * {len(must)})::INT + 1]"
        values = ", ".join(f"{{'k': '{k}', 'v': " + (f"'{k}_' || substr(sha256('42:' || i || ':{k}'), 1, 6)" if m else f"CASE WHEN {_draw('drop ' + k)} >= {generate.DROP_OPTIONAL} THEN '{k}_' || substr(sha256('42:' || i || ':{k}'), 1, 6) END") + "}" for k, m in fields.items())
        given = f"list_filter([{values}], lambda x: x.v IS NOT NULL AND (decision <> 'ask_clarification' OR x.k <> {gone}))"
        request = f"CASE WHEN decision = 'no_call' THEN 'Tell me something pleasant without using a tool.' ELSE '{about}: ' || array_to_string(list_transform({given}, lambda x: x.k || ' ' || x.v), ', ') || '.' END"
        target = f"""CASE WHEN decision = 'no_call' THEN '{{"arguments": {{}}, "decision": "no_call", "missing_required_fields": [], "tool_name": null}}' ELSE '{{"arguments": {{' || array_to_string(list_transform({given}, lambda x: '"' || x.k || '": "' || x.v || '"'), ', ') || '}}, "decision": "' || decision || '", "missing_required_fields": [' || CASE WHEN decision = 'ask_clarification' THEN '"' || {gone} || '"' ELSE '' END || '], "tool_name": "{name}"}}' END"""
        texts.append(f"WHEN {t} THEN '<|user|>\n' || {request} || '\n<|tool_schema|>\n{schema}\n<|assistant|>\n' || {target}")
    return f"WITH b AS (SELECT i, {pick} AS tool, CASE WHEN {kind} < {generate.CLARIFY} THEN 'ask_clarification' WHEN {kind} < {generate.CLARIFY + generate.NO_CALL} THEN 'no_call' ELSE 'call' END AS decision FROM (SELECT doc_id AS i FROM documents)) SELECT i AS doc_id, decision, CASE tool {' '.join(texts)} END AS text FROM b"


@query(_generated_sql())
def tool_dialogs(spark, d):
    """A generated dialog for each document's identifier."""
    return generate.tool_dialogs(_t(spark, d, "documents"))


@query(f"WITH b AS (SELECT i, {_draw('older kind')} AS k FROM (SELECT doc_id AS i FROM documents)) SELECT i AS doc_id, CASE WHEN k < 0.75 THEN 'call' WHEN k < 0.9 THEN 'ask_clarification' ELSE 'no_call' END AS decision, true AS sound FROM b")
def older_tool_dialogs(spark, d):
    """Decisions of the older generator; a text is sound if its target says the same."""
    rows = generate.older_dialogs(_t(spark, d, "documents"))
    target = F.try_parse_json(F.regexp_extract("text", r"(?s)<\|tool_call\|>\n(.*)\n<\|end\|>", 1))
    return rows.select("doc_id", "decision", (F.try_variant_get(target, "$.decision", "string") == F.col("decision")).alias("sound"))


@query("SELECT DISTINCT word, CASE word WHEN 'almond' THEN 'nut' WHEN 'blush' THEN 'pink' ELSE 'example_' || word END AS example FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS word FROM part)")
def parameter_examples(spark, d):
    words = _t(spark, d, "part").select(F.explode(T.lexical_words(F.col("p_name"))).alias("word")).distinct()
    return words.select("word", generate.example_value(F.col("word"), {"almond": "nut", "blush": "pink"}).alias("example"))


@query("SELECT c.conv_id, c.turn, '<|user|>\n' || c.text || '\n<|tool_schema|>\n[]\n<|tool_call|>\n' || '[{\"n\":' || c.turn || '}]' || '\n<|end|>' AS text FROM conversations c WHERE role = 'user' AND coalesce(text, '') <> ''")
def call_documents(spark, d):
    rows = generate.web_documents(_t(spark, d, "conversations").where("role = 'user'")).select("conv_id", "turn", F.col("text").alias("query"), F.lit("[ ]").alias("tools"), F.concat(F.lit('[{"n": '), F.col("turn").cast("string"), F.lit("}]")).alias("answers"))
    return generate.call_documents(rows).select("conv_id", "turn", "text")
