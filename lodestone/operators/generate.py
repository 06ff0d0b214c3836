"""Generated rows: tool dialogs without end, random token shards, seeded orders, and the older text sources.

Every draw is a hash of seed, row and purpose, so row i is the same on any executor and after any restart."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import seeded_order

#: Tools of the generator: name, description, parameters with whether each is required.
TOOLS = [
    ("create_reminder", "Create a reminder", {"title": True, "time": True, "priority": False}),
    ("search_flights", "Search for flights", {"origin": True, "destination": True, "date": True, "cabin": False}),
    ("send_message", "Send a message", {"recipient": True, "body": True, "channel": False}),
    ("convert_currency", "Convert an amount", {"amount": True, "source": True, "target": True}),
    ("get_forecast", "Get a weather forecast", {"city": True, "days": False}),
    ("open_ticket", "Open a support ticket", {"subject": True, "details": True, "severity": False}),
    ("book_table", "Book a restaurant table", {"restaurant": True, "people": True, "notes": False}),
    ("track_parcel", "Track a parcel", {"number": True, "carrier": False}),
]
DROP_OPTIONAL, CLARIFY, NO_CALL = 0.45, 0.15, 0.07


def draw(seed: int, row: Column, purpose: str) -> Column:
    """A number in [0, 1) that depends on seed, row and purpose only: the first 48 bits of a SHA-256."""
    sha = F.sha2(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(purpose)), 256)
    return F.conv(F.substring(sha, 1, 12), 16, 10).cast("long") / float(1 << 48)


def tool_dialogs(rows: DataFrame, seed: int = 42) -> DataFrame:
    """rows: doc_id. doc_id, decision, text: calls (78 %), clarifications (15 %) and refusals (7 %) over the tools."""
    base = rows.select(F.col("doc_id").cast("long").alias("doc_id"))
    i = F.col("doc_id")
    pick = F.floor(draw(seed, i, "tool") * len(TOOLS)).cast("int")
    decision = F.when(draw(seed, i, "kind") < CLARIFY, "ask_clarification").when(draw(seed, i, "kind") < CLARIFY + NO_CALL, "no_call").otherwise("call")
    text = F.lit(None).cast("string")
    for t, (name, about, fields) in enumerate(TOOLS):
        schema = json.dumps({"description": about, "name": name, "parameters": {"properties": {k: {"type": "string"} for k in fields}, "required": [k for k, must in fields.items() if must], "type": "object"}}, sort_keys=True)
        must = [k for k, m in fields.items() if m]
        gone = F.element_at(F.array(*map(F.lit, must)), F.floor(draw(seed, i, "gone") * len(must)).cast("int") + 1)
        values = F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.lit(m) | (draw(seed, i, f"drop {k}") >= DROP_OPTIONAL), F.concat(F.lit(f"{k}_"), F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), F.lit(k)), 256), 1, 6))).alias("v")) for k, m in fields.items()))
        given = F.filter(values, lambda x: x["v"].isNotNull() & ((decision != "ask_clarification") | (x["k"] != gone)))  # noqa: B023
        pairs = F.array_join(F.transform(given, lambda x: F.concat(F.lit('"'), x["k"], F.lit('": "'), x["v"], F.lit('"'))), ", ")
        known = F.array_join(F.transform(given, lambda x: F.concat(x["k"], F.lit(" "), x["v"])), ", ")
        request = F.when(decision == "no_call", "Tell me something pleasant without using a tool.").otherwise(F.concat(F.lit(f"{about}: "), known, F.lit(".")))
        target = F.when(decision == "no_call", '{"arguments": {}, "decision": "no_call", "missing_required_fields": [], "tool_name": null}').otherwise(F.concat(F.lit('{"arguments": {'), pairs, F.lit('}, "decision": "'), decision, F.lit('", "missing_required_fields": ['), F.when(decision == "ask_clarification", F.concat(F.lit('"'), gone, F.lit('"'))).otherwise(""), F.lit(f'], "tool_name": "{name}"}}')))
        text = F.when(pick == t, F.concat(F.lit("<|user|>\n"), request, F.lit(f"\n<|tool_schema|>\n{schema}\n<|assistant|>\n"), target)).otherwise(text)
    return base.select("doc_id", decision.alias("decision"), text.alias("text"))


def random_tokens(rows: DataFrame, vocabulary: int, seed: int) -> DataFrame:
    """rows: pos. A token for each place of a stream."""
    return rows.select(F.col("pos").cast("long").alias("pos"), F.floor(draw(seed, F.col("pos").cast("long"), "token") * vocabulary).cast("int").alias("token"))


def shuffled(files: DataFrame, seed: int) -> DataFrame:
    """Paths in a reproducible random order."""
    return files.orderBy(seeded_order(F.lit(str(seed)), F.col("path")), "path")


def code_documents(files: DataFrame, allowed: list[str]) -> DataFrame:
    """files: repo, path, license, content, autogenerated. Code texts under a header; generated, empty and unlicensed ones go."""
    from lodestone.operators.corpus import license_allowed_or_blank

    kept = files.where(~F.coalesce("autogenerated", F.lit(False)) & (F.coalesce("content", F.lit("")) != "") & license_allowed_or_blank(F.col("license"), allowed))
    return kept.select("path", F.concat_ws("\n", F.concat(F.lit("Repository: "), "repo"), F.concat(F.lit("Path: "), "path"), "content").alias("text"))


def filled(source: DataFrame, filler: DataFrame, order: str, target: int) -> DataFrame:
    """source and filler: n_tokens and `order`. Rows of the source first; what it lacks of the target comes from the filler."""
    from lodestone.operators.corpus import budget_cut

    both = source.withColumn("_prio", F.lit(0)).unionByName(filler.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    placed = both.withColumns({"_all": F.lit(0), "_at": (F.col("_prio") * (1 << 40) + F.col(order)).cast("long")})
    return budget_cut(placed, ["_all"], "_at", F.col("n_tokens"), target).withColumn("filled", F.col("_prio") == 1).drop("_all", "_at", "_prio")


def web_documents(rows: DataFrame) -> DataFrame:
    """Texts of a web source: empty and missing ones go."""
    return rows.where(F.coalesce("text", F.lit("")) != "")


def spec_documents(specs: DataFrame, seed: int) -> DataFrame:
    """API descriptions as texts under their path, in a reproducible random order."""
    placed = specs.where(F.lower("path").rlike(r"\.(json|ya?ml)$"))
    return placed.select("path", F.concat(F.lit("# API description: "), "path", F.lit("\n"), "text").alias("text"), seeded_order(F.lit(str(seed)), F.col("path")).alias("turn"))


def call_documents(rows: DataFrame) -> DataFrame:
    """rows: query, tools, answers (JSON texts). One rendered exchange for each row, JSON without blanks."""
    from lodestone.functions.schemas import canonical_json

    tools, answers = (F.coalesce(canonical_json(F.col(c)), F.lit("null")) for c in ("tools", "answers"))
    return rows.withColumn("text", F.concat(F.lit("<|user|>\n"), F.coalesce("query", F.lit("")), F.lit("\n<|tool_schema|>\n"), tools, F.lit("\n<|tool_call|>\n"), answers, F.lit("\n<|end|>")))


def example_value(name: Column, examples: dict[str, str]) -> Column:
    """The example of a parameter, or one made of its name."""
    known = F.create_map(*(F.lit(x) for kv in sorted(examples.items()) for x in kv)) if examples else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.element_at(known, name), F.concat(F.lit("example_"), name))


#: Example values of the older generator's parameters; others get one made of their name.
EXAMPLES = {"city": "Bonn", "date": "2026-05-04", "people": "4", "recipient": "sam@example.org", "severity": "low"}


def older_dialogs(rows: DataFrame, seed: int = 42) -> DataFrame:
    """rows: doc_id. doc_id, decision, text of the older generator: calls (75 %), clarifications (15 %) and refusals (10 %), with example values."""
    kind, pick = draw(seed, F.col("doc_id"), "older kind"), F.floor(draw(seed, F.col("doc_id"), "older tool") * len(TOOLS)).cast("int")
    decision = F.when(kind < 0.75, "call").when(kind < 0.9, "ask_clarification").otherwise("no_call")
    shown = F.lit(None).cast("struct<name:string,about:string,fields:array<string>>")
    for t, (name, about, fields) in enumerate(TOOLS):
        shown = F.when(pick == t, F.struct(F.lit(name).alias("name"), F.lit(about).alias("about"), F.array(*map(F.lit, fields)).alias("fields"))).otherwise(shown)
    base = rows.select(F.col("doc_id").cast("long").alias("doc_id")).withColumns({"decision": decision, "tool": shown})
    fields = F.col("tool.fields")
    gone = F.get(fields, F.floor(draw(seed, F.col("doc_id"), "older gone") * F.size(fields)).cast("int"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    schema = F.concat(F.lit('{"description":'), quoted(F.col("tool.about")), F.lit(',"name":'), quoted(F.col("tool.name")), F.lit(',"required":['), F.array_join(F.transform(fields, quoted), ","), F.lit("]}"))
    given = F.when(F.col("decision") == "call", F.array_join(F.transform(fields, lambda f: F.concat(quoted(f), F.lit(":"), quoted(example_value(f, EXAMPLES)))), ",")).otherwise("")
    missing = F.when(F.col("decision") == "ask_clarification", quoted(gone)).otherwise("")
    tool = F.when(F.col("decision") == "no_call", "null").otherwise(quoted(F.col("tool.name")))
    target = F.concat(F.lit('{"arguments":{'), given, F.lit('},"decision":'), quoted(F.col("decision")), F.lit(',"missing_required_fields":['), missing, F.lit('],"tool_name":'), tool, F.lit("}"))
    return base.select("doc_id", "decision", F.concat(F.lit("<|user|>\n"), "tool.about", F.lit(".\n<|tool_schema|>\n"), schema, F.lit("\n<|tool_call|>\n"), target, F.lit("\n<|end|>")).alias("text"))
