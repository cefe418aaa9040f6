"""The structure of paged documents: roles, running lines, folios, references and titles.

Pages come as rows (doc_id, page, text); every step is a window or an
aggregate over a document's pages, so a long document is one sort and no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.basics import blank
from quire.operators.aggregates import repeated_lines
from quire.operators.windows import keep_latest, longest_island

EDGE = 4  # rows at the head and foot of a page that may run


def page_role(text: Column) -> Column:
    """What a page is by its own text: blank, contents, references, colophon, abstract, licence or body."""
    t = F.trim(blank(text))
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"(?i)^\s*(?:table of )?contents\b|^\s*(?:목차|차례)"), "contents")
        .when(t.rlike(r"(?im)^\s*(?:references|bibliography|works cited|참고\s*문헌)\s*$"), "references")
        .when(t.rlike(r"(?i)\bISBN\b") & t.rlike(r"(?i)published by|printed in|all rights reserved"), "colophon")
        .when(t.rlike(r"(?i)creative\s+commons|licen[cs]e agreement"), "licence")
        .when(t.rlike(r"(?i)^\s*(?:abstract|초\s*록|요\s*약)\b"), "abstract")
        .otherwise("body")
    )


def lines_of(pages: DataFrame) -> DataFrame:
    """doc_id, page, row, rows and line of every line that isn't blank."""
    kept = pages.select("doc_id", "page", F.filter(F.transform(F.split(blank(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("_kept"))
    return kept.select("doc_id", "page", F.size("_kept").alias("rows"), F.posexplode("_kept").alias("row", "line")).select("doc_id", "page", "row", "line", "rows")


def running_lines(pages: DataFrame) -> DataFrame:
    """Heads and feet: edge lines, digits apart, at about the same place on two pages or more."""
    lines = lines_of(pages)
    key = F.trim(F.regexp_replace(F.lower("line"), r"\d+", "#"))
    from_end = F.col("rows") - 1 - F.col("row")
    edge = F.when(F.col("row") < EDGE, "head").when(from_end < EDGE, "foot")
    placed = lines.withColumn("edge", edge).where("edge is not null").select("doc_id", "page", F.concat_ws(":", "edge", key).alias("line"), F.when(F.col("edge") == "head", F.col("row")).otherwise(from_end).alias("rank"))
    return repeated_lines(placed, "doc_id", "page", "line", "rank")


def folios(pages: DataFrame) -> DataFrame:
    """Numbers that stand alone in a page's first or last row: doc_id, page, folio."""
    lines = lines_of(pages).where((F.col("row") == 0) | (F.col("row") == F.col("rows") - 1))
    return lines.select("doc_id", "page", F.regexp_extract("line", r"^[-–—\s]*(\d{1,5})[-–—\s]*$", 1).try_cast("int").alias("folio")).where("folio is not null").distinct()


def folio_run(pages: DataFrame) -> DataFrame:
    """The longest run of pages whose folios go up with them, two pages at least: doc_id, offset, first, last."""
    placed = folios(pages).withColumn("offset", F.col("folio") - F.col("page"))
    runs = longest_island(placed, ["doc_id", "offset"], "page").where("length >= 2")
    return keep_latest(runs, ["doc_id"], F.col("length").desc(), F.col("first"), F.col("offset")).select("doc_id", "offset", "first", "last")


def roles(pages: DataFrame, *carried: str) -> DataFrame:
    """doc_id, page, role and the ``carried`` columns, references carried on to the body pages that follow without a gap."""
    own = pages.select("doc_id", "page", *carried, page_role(F.col("text")).alias("own"))
    w = Window.partitionBy("doc_id").orderBy("page")
    gap = F.col("page") - F.lag("page").over(w) != 1
    starts = F.coalesce(gap, F.lit(True)) | ~F.col("own").isin("body", "references")
    block = own.withColumn("_starts", starts.cast("int")).withColumn("_block", F.sum("_starts").over(w))
    seen = F.max((F.col("own") == "references").cast("int")).over(Window.partitionBy("doc_id", "_block").orderBy("page"))
    role = F.when((F.col("own") == "body") & (seen == 1), "references").otherwise(F.col("own"))
    return block.select("doc_id", "page", role.alias("role"), *carried)


def document_title(pages: DataFrame, longest: int = 300) -> DataFrame:
    """The first line of a document's first telling page that is no running line, folio or label."""
    lines = lines_of(roles(pages, "text").where(F.col("role").isin("body", "abstract")))
    running = running_lines(pages).select("doc_id", F.regexp_replace("line", "^(?:head|foot):", "").alias("_key")).distinct()
    keyed = lines.withColumn("_key", F.trim(F.regexp_replace(F.lower("line"), r"\d+", "#")))
    named = keyed.where(F.col("line").rlike(r"\p{L}{2}") & (F.char_length("line") <= longest) & ~F.col("line").rlike(r"(?i)^(?:abstract|vol\.?|no\.?|issn|doi)\b|[:：]$"))
    return keep_latest(named.join(running, ["doc_id", "_key"], "left_anti"), ["doc_id"], F.col("page"), F.col("row")).select("doc_id", F.col("line").alias("title"))
