"""License scans (operator 3) by diagonal voting, with DataFrame functions only.

Phrases and notices are templates. Every run of k words of a text is hashed and joined to the places of the same
runs in the templates (k is 2 for phrases, 4 for notices). A match at word i of the text and word j of the template
votes for the diagonal i - j. Votes are gathered by row, template and diagonal; neighbouring diagonals of a notice
are merged, so a few inserted or lost words don't break it; and spans are verified word by word: a phrase needs all
its places on one diagonal, and of a notice the words that agreeing runs cover are counted once each, in the notice
and in the text. Their share of the notice's words, and of the words of the span, must both reach `SHARE`: runs that
a text repeats count once, and words between agreeing runs count against it. Runs agree if their 64-bit hashes do:
with a few hundred template places, chance agreement stays below one in 10^16 runs.

Templates are a fixed table (`PHRASES`, `NOTICES`), whose size is checked before it is broadcast.

Null texts have no words. A text of any length is voted on and verified whole; its places and votes are rows and
arrays of its own. A row is a document; repeated rows give repeated results; an empty
table gives no rows. Columns besides the identifier and the text are not read, whatever they are called. Score: 1.0
where a phrase stands, else the largest share of a notice's words that one place of the text has, halved where the
place fails the verification; 0.0 where no vote was cast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_words, documents, rolling_hashes, written

#: Phrase -> label. Fixed values of the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label -> a sentence of the licence's usual notice, from the public licence texts.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license",
    "proprietary": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}
PHRASE_K, NOTICE_K = 2, 4
#: Share of a notice's words, and of a span's, that must agree, and how far diagonals of one place may lie apart.
SHARE, DRIFT = 0.6, 6
MOST_TEMPLATE_ROWS = 20_000


def template_rows(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    """(template, kind, label, size, k, t, run): the places of all runs of k words."""
    out = []
    for kind, k, items in (("phrase", PHRASE_K, list(phrases.items())), ("notice", NOTICE_K, [(text, label) for label, text in notices.items()])):
        for text, label in items:
            words = re.findall(r"[a-z0-9\x80-\U0010FFFF]+", text)
            if len(words) < k:
                raise ValueError(f"a template needs {k} words: {text}")
            out += [(f"{kind}:{text[:40]}", kind, label, len(words), k, j, words[j : j + k]) for j in range(len(words) - k + 1)]
    return out


def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    rows = template_rows(phrases, notices)
    if len(rows) > MOST_TEMPLATE_ROWS:
        raise ValueError("too many template places to broadcast")
    table = spark.createDataFrame(rows, "template string, kind string, label string, size int, k int, t int, run array<string>")
    hashes = F.transform("run", lambda w: F.xxhash64(w))
    h = F.when(F.col("k") == PHRASE_K, F.get(rolling_hashes(hashes, PHRASE_K), 0)).otherwise(F.get(rolling_hashes(hashes, NOTICE_K), 0))
    return table.withColumn("h", h)


def license_votes(docs: DataFrame, phrases: dict[str, str], notices: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n_words, template, kind, label, size, diagonal, places (of the template, ascending: one vote each), begin, end; a row without votes stays with nulls."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), ascii_words(F.col(text_col)).alias("words"))
    rows = rows.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w)))

    def probes(k: int) -> Column:
        return F.transform(rolling_hashes(F.col("_hashes"), k), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("at"), h.alias("h")))

    # explode_outer: for explode, Spark would infer a filter that computes all of this a second time, inlined.
    itself = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h")))
    runs = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.concat(itself, probes(PHRASE_K), probes(NOTICE_K))).alias("p"))
    flat = runs.select("row", "doc_id", "n_words", "p.*")
    votes = flat.join(F.broadcast(_templates(spark, phrases, notices)), ["k", "h"], "left").where((F.col("k") == 0) | F.col("t").isNotNull())
    diagonal = F.col("at") - F.col("t")
    return votes.groupBy("row", "doc_id", "n_words", "template", "kind", "label", "size", diagonal.alias("diagonal")).agg(F.sort_array(F.collect_set("t")).alias("places"), F.min("at").alias("begin"), (F.max("at") + F.max("k")).alias("end"))


def _covered(starts: Column, k: int) -> Column:
    """How many words the runs of k words cover that begin at these distinct ascending places."""
    gaps = F.transform(starts, lambda x, i: F.when(i == 0, F.lit(k)).otherwise(F.least(x - F.get(starts, i - 1), F.lit(k))))
    return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)


def license_spans(votes: DataFrame) -> DataFrame:
    """Verified spans of each row: row, doc_id, n_words, kind, label, begin, end, share; a row without any stays once with nulls."""
    phrase_runs = F.col("size") - PHRASE_K + 1
    phrase = (F.col("kind") == "phrase") & (F.size("places") == phrase_runs)
    plain = votes.where(F.col("kind").isNull() | phrase).select("row", "doc_id", "n_words", "kind", "label", "begin", "end", F.when(F.col("kind").isNull(), 0.0).otherwise(1.0).alias("share"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    before = Window.partitionBy("row", "template").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, -1)
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= DRIFT) & (F.col("begin") <= F.max("end").over(before) + F.col("size"))
    placed = votes.where("kind = 'notice'").withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_place", F.sum("_new").over(order))
    # What is gathered is one text's agreement with one template: fewer places than the text has words.
    merged = placed.groupBy("row", "doc_id", "n_words", "kind", "label", "template", "size", "_place").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("there"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("places", lambda t: t + F.col("diagonal")))))).alias("here"), F.min("begin").alias("begin"), F.max("end").alias("end")
    )
    share = _covered(F.col("there"), NOTICE_K) / F.col("size")
    dense = _covered(F.col("here"), NOTICE_K) / (F.col("end") - F.col("begin"))
    # A span far longer than the notice is another text that repeats its runs.
    fits = (F.col("end") - F.col("begin") <= 1.5 * F.col("size")) & (dense >= SHARE)
    sound = fits & (share >= SHARE)
    found = merged.select("row", "doc_id", "n_words", F.when(sound, F.col("kind")).alias("kind"), F.when(sound, F.col("label")).alias("label"), "begin", "end", F.when(fits, share).otherwise(share * 0.5).alias("share"))
    return plain.unionByName(found)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    # Two branches read the votes; written once, they cost one pass over the texts. Plain words cast hardly any.
    spans = license_spans(written(license_votes(docs, phrases, notices, id_col, text_col), "votes"))
    is_phrase = F.col("kind") == "phrase"
    named = F.when(F.col("kind").isNotNull(), F.struct("begin", "end", "label", "kind"))
    by = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(is_phrase, 1)).alias("n_base"), F.min(F.when(is_phrase, F.col("begin"))).cast("long").alias("first_word"), F.max(F.when(is_phrase, F.col("begin"))).cast("long").alias("last_word"),
        F.collect_set(F.when(is_phrase, F.col("label"))).alias("_base"), F.collect_set("label").alias("_all"), F.max("share").alias("score"),
        F.collect_set(named).alias("spans"),
    )
    return by.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(F.array_sort("_all"), ",").alias("labels"), "score", F.array_sort("spans").alias("spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


def _sql() -> str:
    """The same in SQL: runs of words are compared as text, places are merged and verified as above."""

    def table(items: list[tuple[str, str]]) -> str:
        return ", ".join(f"('{text}', '{label}')" for text, label in items)

    k = NOTICE_K
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {table(list(PHRASES.items()))}) v(p, label)
), notices AS (SELECT row_number() OVER () AS notice, string_split(p, ' ') AS p, label FROM (VALUES {table([(text, label) for label, text in NOTICES.items()])}) v(p, label)
), starts AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d
), base AS (SELECT r, i, label FROM starts JOIN phrases ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p
), runs AS (SELECT notice, label, len(p) AS size, j, array_to_string(p[j + 1 : j + {k}], ' ') AS run FROM (SELECT *, unnest(range(0, len(p) - {k} + 1)) AS j FROM notices)
), votes AS (SELECT r, notice, label, size, i, j, i - j AS diagonal FROM (SELECT r, i, array_to_string(w[i + 1 : i + {k}], ' ') AS run FROM starts WHERE i + {k} <= len(w)) JOIN runs USING (run)
), diagonals AS (SELECT r, notice, diagonal, min(i) AS b, max(i) + {k} AS e FROM votes GROUP BY ALL
), near AS (SELECT *, diagonal - lag(diagonal) OVER o <= {DRIFT} AND b <= max(e) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + size AS same FROM diagonals JOIN (SELECT DISTINCT notice, size FROM runs) USING (notice) WINDOW o AS (PARTITION BY r, notice ORDER BY diagonal)
), places AS (SELECT r, notice, diagonal, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY r, notice ORDER BY diagonal) AS place FROM near
), marks AS (SELECT r, notice, label, size, place, i, j FROM votes JOIN places USING (r, notice, diagonal)
), cover AS (SELECT r, notice, place, count(DISTINCT i + x) AS here, count(DISTINCT j + x) AS there, min(i) AS b, max(i) + {k} AS e FROM marks, range({k}) t(x) GROUP BY ALL
), judged AS (SELECT r, label, there / size::DOUBLE AS share, e - b <= 1.5::DOUBLE * size AND here / (e - b)::DOUBLE >= {SHARE}::DOUBLE AS fits FROM cover JOIN (SELECT DISTINCT notice, label, size FROM runs) USING (notice)
), named AS (
  SELECT r, label, 1.0::DOUBLE AS score FROM base UNION ALL
  SELECT r, CASE WHEN fits AND share >= {SHARE}::DOUBLE THEN label END, CASE WHEN fits THEN share ELSE share * 0.5::DOUBLE END FROM judged
), b AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY 1
), n AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM named GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0) AS n_base, first AS first_word, last AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(n.labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN n USING (r)
"""


OP3_SQL = _sql()
