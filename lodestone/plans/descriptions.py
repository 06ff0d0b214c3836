"""Queries of API descriptions, one for each nation.

The SQL writes out what each text must be; «K», «N» and «S» stand for a nation's key, its name, and its name in a tool's."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import openapi
from lodestone.plans.catalog import _t, query

_SLUG = "regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g')"


def _sql(template: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for mark, value in (("«K»", "n_nationkey"), ("«N»", "n_name"), ("«S»", _SLUG)):
        out = out.replace(mark, f"' || {value} || '")
    return out


def _json(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


_TRACE = {"name": "trace", "in": "header"}
_LANG = {"name": "lang", "in": "query", "required": True, "schema": {"type": "string", "description": "hidden"}}
_MANY = {"name": "n", "in": "query", "type": "integer", "required": True, "description": "How many"}
_BODY = {"required": True, "content": {"text/plain": "none", "application/json": {"schema": {"type": "object", "title": "«N»"}}, "a/b": {}}}
_SPEC = {
    "openapi": "3.0.0",
    "info": {"title": "«N»", "version": "1", "created": "2026-02-31"},
    "paths": {
        "/nations/«K»": {"parameters": [_TRACE, "odd"], "x-note": {}, "get": {"operationId": "read.«K»", "summary": "Read «N»", "parameters": [_LANG], "responses": {}}, "head": {"responses": {}}},
        "/nations": {"post": {"operationId": "create", "description": "Make one", "parameters": [{"$ref": "#/x"}, _MANY], "requestBody": _BODY, "responses": {"200": {}}, "security": []}},
        "/empty": "nothing",
    },
}
_PATH = "apis/«K»/1/openapi.json"
_BROKEN = "apis/broken/openapi.yaml"


def _tool(name: str, about: str, properties: dict, required: list[str]) -> str:
    return _json({"name": name, "description": about, "parameters": {"type": "object", "properties": properties, "required": required}})


_GET = {
    "place": "0.2", "title": "«N»", "route": "/nations/«K»", "method": "GET", "id": "read.«K»", "tool_name": "«S»_read_«K»", "parameters": [_TRACE, _LANG], "names": ["trace", "lang"], "must": ["lang"],
    "tool": _tool("«S»_read_«K»", "Read «N»", {"trace": {"type": "string", "description": ""}, "lang": {"type": "string", "description": ""}}, ["lang"]), "words": ["Read «N»"], "body": None, "responses": {}, "security": None, "call": "read_«K»(trace, lang)",
}
_HEAD = {
    "place": "0.3", "title": "«N»", "route": "/nations/«K»", "method": "HEAD", "id": "HEAD_/nations/«K»", "tool_name": "«S»_HEAD_nations_«K»", "parameters": [_TRACE], "names": ["trace"], "must": [],
    "tool": _tool("«S»_HEAD_nations_«K»", "HEAD /nations/«K»", {"trace": {"type": "string", "description": ""}}, []), "words": [], "body": None, "responses": {}, "security": None, "call": "HEAD_nations_«K»(trace)",
}
_POST = {
    "place": "1.0", "title": "«N»", "route": "/nations", "method": "POST", "id": "create", "tool_name": "«S»_create", "parameters": [{"$ref": "#/x"}, _MANY], "names": ["n", "body"], "must": ["n", "body"],
    "tool": _tool("«S»_create", "Make one", {"n": {"type": "integer", "description": "How many"}, "body": {"type": "object", "title": "«N»"}}, ["n", "body"]), "words": ["Make one"], "body": _BODY, "responses": {"200": {}}, "security": [], "call": "create(n)",
}
_OPERATIONS = [_GET, _HEAD, _POST]


def _specs(spark, d):
    """The same texts as in SQL, and one that can't be read."""
    rows = _t(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string"))
    made = rows.select(F.expr(_sql(_PATH)).alias("path"), F.expr(_sql(_json(_SPEC))).alias("text"))
    return made.unionByName(spark.createDataFrame([(_BROKEN, ": : :")], "path string, text string"))


def _placed(df):
    return df.withColumn("place", F.concat_ws(".", F.col("place").cast("array<string>")))


@query(" UNION ALL ".join(f"SELECT {_sql(_PATH)} AS path, '{o['place']}' AS place, {_sql(o['method'] + ' ' + o['route'])} AS operation, {_sql(o['tool'])} AS tool FROM nation" for o in _OPERATIONS))
def openapi_operations(spark, d):
    ops = _placed(openapi.operations(_specs(spark, d)))
    return ops.select("path", "place", F.concat("method", F.lit(" "), "route").alias("operation"), "tool")


def _documents_sql(o: dict) -> str:
    place = [f"API: {o['title']}", f"Route: {o['method']} {o['route']}", f"Name: {o['id']}"]
    takes, gives = {"parameters": o["parameters"], "requestBody": o["body"]}, {"responses": o["responses"]}
    bodies = {
        "reference": ["Operation in full", *place, *o["words"], _json(takes | gives | {"security": o["security"]})],
        "request": ["What an operation takes", *place, _json(takes)],
        "response": ["What an operation gives", *place, _json(gives)],
        "signature": ["An operation as a function", o["call"], *place, *o["words"]],
    }
    return " UNION ALL ".join(f"SELECT {_sql(_PATH)} AS path, '{o['place']}' AS place, '{kind}' AS kind, 1::INT AS part, {_sql('\n'.join(lines))} AS text FROM nation" for kind, lines in bodies.items())


@query(" UNION ALL ".join(map(_documents_sql, _OPERATIONS)))
def openapi_docs(spark, d):
    return _placed(openapi.documents(openapi.operations(_specs(spark, d))))


def _dialogs_sql(o: dict) -> str:
    def drawn(what: str) -> str:
        return f"sha256('42' || chr(31) || {_sql(o['tool_name'])} || chr(31) || {_sql(o['route'])} || chr(31) || '{what}')"

    def given(names: list[str]) -> str:
        return "'{' || " + " || ',' || ".join([f"'\"{n}\":\"sample_{n}_' || substr({drawn(n)}, 1, 8) || '\"'" for n in names] or ["''"]) + " || '}'"

    def text(kind: str, request: str, name: str, arguments: str, missing: str) -> str:
        head, sure = _sql(f"<|user|>\n{request}\n<|tool_schema|>\n{o['tool']}\n<|assistant|>\n"), openapi.CONFIDENCE[kind]
        return f"""SELECT {_sql(_PATH)} AS path, '{o['place']}' AS place, '{kind}' AS kind, {head} || '{{"decision":"{kind}","tool_name":' || {name} || ',"arguments":' || {arguments} || ',"missing_required_fields":' || {missing} || ',"confidence":{sure}}}' AS text FROM nation"""

    name = _sql(_json(o["tool_name"]))
    out = [text("call", f"{o['title']}: {o['method']} {o['route']}, with the values I gave.", name, given(o["names"]), "'[]'")]
    if o["must"]:
        at = f"('0x' || substr({drawn('missing')}, 1, 8))::BIGINT % {len(o['must'])}"
        rest = "CASE " + " ".join(f"WHEN {at} = {i} THEN {given([n for n in o['names'] if n != gone])}" for i, gone in enumerate(o["must"])) + " END"
        missing = "CASE " + " ".join(f"WHEN {at} = {i} THEN '[\"{gone}\"]'" for i, gone in enumerate(o["must"])) + " END"
        out.append(text("ask_clarification", f"{o['tool_name']} is what I need, though I left something out.", name, rest, missing))
    out.append(text("no_call", f"No {o['tool_name']} today. A haiku about autumn instead, please.", "'null'", "'{}'", "'[]'"))
    return " UNION ALL ".join(out)


@query(" UNION ALL ".join(map(_dialogs_sql, _OPERATIONS)))
def openapi_dialogs(spark, d):
    return _placed(openapi.dialogs(openapi.operations(_specs(spark, d))))


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_VIEWS = {
    "source": f"API description {_PATH} as written (JSON)\n{_json(_SPEC)}",
    "canonical": f"API description {_PATH} as sorted JSON\n{_canonical(_SPEC)}",
    "components": f"Shared parts of the API description {_PATH}\n{_canonical({'info': _SPEC['info'], 'components': {}, 'definitions': {}, 'parameters': {}, 'securityDefinitions': {}})}",
    "paths": f"Routes of the API description {_PATH}\n{_canonical({'info': _SPEC['info'], 'servers': [], 'basePath': None, 'paths': _SPEC['paths']})}",
}


@query(" UNION ALL ".join([f"SELECT '{_BROKEN}' AS path, 'source' AS kind, 1::INT AS part, 'API description {_BROKEN} as written (YAML)\n: : :' AS text", *(f"SELECT {_sql(_PATH)}, '{kind}', 1, {_sql(text)} FROM nation" for kind, text in _VIEWS.items())]))
def openapi_views(spark, d):
    """All views of each description; of one that can't be read only the text."""
    return openapi.views(_specs(spark, d))
