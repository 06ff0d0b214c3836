"""Web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import table

#: What no reader sees, and tags that end a block; fixed values.
UNSEEN = r"(?is)<(?:script|style|noscript|template)\b.*?</(?:script|style|noscript|template)>|<!--.*?-->"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>"
LINK = r"(?is)<a\b[^>]*>(.*?)</a>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
#: A block with more of its text in links is navigation; one on so many pages of its host, and such a share, a template.
MOST_LINKED, TEMPLATE_PAGES, TEMPLATE_SHARE = 0.5, 3, 0.25

def main_text(html: Column) -> Column:
    """The text of a page without scripts, styles and navigation; runs of white space become one blank."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</(script|style|nav|header|footer|aside)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


def spam_score(text: Column) -> Column:
    """How much of a text repeats itself, from 0 to 1: the largest of the share of its commonest word, of repeated
    lines, and of repeated word pairs. Made text that fills pages scores high; texts of fewer than 20 words score 0."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def repeated(items: Column) -> Column:
        return F.lit(1.0) - F.size(F.array_distinct(items)) / F.greatest(F.size(items), F.lit(1))

    ordered = F.array_sort(words)
    # Equal neighbours in order: the longest run is the commonest word's count.
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(acc: Column, w: Column) -> Column:
        n = F.when(acc["w"] == w, acc["n"] + 1).otherwise(1)
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(acc["most"], n).alias("most"))

    commonest = F.aggregate(ordered, start, step, lambda acc: acc["most"]) / F.greatest(F.size(words), F.lit(1))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) < 20, F.lit(0.0)).otherwise(F.greatest(commonest, repeated(lines), repeated(pairs)))


def shown(html: Column) -> Column:
    """The text of a piece of HTML without its tags, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


def page_blocks(html: Column) -> Column:
    """array<struct<text, linked>>: the blocks of a page that show text, in order, and how many characters of links each has."""
    pieces = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " "), BLOCK, -1)
    links = lambda piece: F.aggregate(F.regexp_extract_all(piece, F.lit(LINK), 1), F.lit(0), lambda a, x: a + F.length(shown(x)))
    return F.filter(F.transform(pieces, lambda p: F.struct(shown(p).alias("text"), links(p).alias("linked"))), lambda b: b["text"] != "")


def without_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_linked: float = MOST_LINKED, template_pages: int = TEMPLATE_PAGES, template_share: float = TEMPLATE_SHARE) -> DataFrame:
    """The identifier, host, n_blocks, n_linked, n_template and body of each page: its blocks without navigation (much of
    the text in links) and without what its host repeats from page to page, joined by line feeds.

    A block's text is counted once for each page that has it, by host and hash, combined before the shuffle, so a host
    that holds most pages is counted by all tasks. Pages are split once, into a table; what goes back to them are hashes
    of templates. A page without a host shares templates with nobody; identifiers must be unique."""
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)), F.lit(""))
    cut = table(pages.select(F.col(id_col).alias("_id"), host.alias("host"), page_blocks(F.col(html_col)).alias("_blocks")), "page-blocks")
    read = cut.withColumns({"_prose": F.filter("_blocks", lambda b: b["linked"] <= F.lit(most_linked) * F.length(b["text"])), "n_blocks": F.size("_blocks")})
    hashes = F.transform("_prose", lambda b: F.substring(F.sha2(b["text"], 256), 1, 32))
    keyed = read.where("host IS NOT NULL").select("_id", "host", F.explode(F.array_distinct(hashes)).alias("key"))
    sizes = cut.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    repeated = keyed.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= template_pages)
    templates = table(repeated.join(sizes, "host").where(F.col("n") >= F.lit(template_share) * F.col("pages")).select("host", "key"), "templates")
    own = keyed.join(templates, ["host", "key"], "left_semi").groupBy("_id").agg(F.collect_set("key").alias("_templates"))
    joined = read.join(own, "_id", "left")
    kept = F.filter("_prose", lambda b: ~F.coalesce(F.array_contains("_templates", F.substring(F.sha2(b["text"], 256), 1, 32)), F.lit(False)))
    return joined.select(F.col("_id").alias(id_col), "host", "n_blocks", (F.col("n_blocks") - F.size("_prose")).alias("n_linked"), (F.size("_prose") - F.size(kept)).alias("n_template"), F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("body"))
