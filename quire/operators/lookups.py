"""Asking registries and catalogues: each is a table, so a lookup is a join.

Identifiers are normalised on both sides and joined by equality. Searches by
words use the tokens of titles: a title that shares the wanted share of a
query's words has at least one of the query's rarest few, so only these are
joined, and the share is then computed for the pairs that met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import titles
from quire.operators.windows import top

#: Least share of a query's words that a title must have, and the records that a search gives.
LEAST, ROWS = 0.6, 5


def by_identifier(readings: DataFrame, registry: DataFrame, read: Column, known: Column, carried: Sequence[str]) -> DataFrame:
    """``readings`` with the ``carried`` columns of the registry's record of the same identifier; nulls where there is none.

    ``read`` and ``known`` are normalised identifiers, empty where there is none.
    """
    records = registry.where(known != "").select(known.alias("_id"), *carried)
    asked = readings.withColumn("_asked", F.when(read != "", read))
    return asked.join(records, F.col("_asked") == F.col("_id"), "left").drop("_asked", "_id")


def search(queries: DataFrame, registry: DataFrame, query: str, title: str, least: float = LEAST, rows: int = ROWS) -> DataFrame:
    """The best ``rows`` records of ``registry`` for each text in ``query``: query, title, score and rank.

    The score is the share of a query's words that a title has. Titles and
    queries are taken once each, whatever rows have them.
    """
    asked = queries.select(query).where(F.col(query).isNotNull()).distinct().withColumn("_wanted", titles.words(F.col(query)))
    known = registry.select(title).where(F.col(title).isNotNull()).distinct()
    by_word = known.select(title, F.explode(titles.words(F.col(title))).alias("word"))
    often = by_word.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = asked.where(F.size("_wanted") > 0).select(query, F.size("_wanted").alias("size"), F.explode("_wanted").alias("word")).join(often, "word", "left")
    ranked = words.groupBy(query, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "word"))).alias("by_rarity"))
    # Of s words, ceil(least * s) must be shared, so one of the s - ceil(least * s) + 1 rarest is.
    prefix = F.slice("by_rarity", F.lit(1), F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1)
    met = ranked.select(query, F.explode(prefix).alias("p")).select(query, F.col("p.word").alias("word")).join(by_word, "word").select(query, title).distinct()
    scored = met.withColumn("score", titles.token_overlap(F.col(query), F.col(title))).where(F.col("score") >= least)
    return top(scored, [query], rows, F.col("score").desc(), F.char_length(title), F.col(title))


def by_coordinates(readings: DataFrame, registry: DataFrame, keys: Sequence[str], page: str, first: str, last: str) -> DataFrame:
    """Readings with the registry's records of equal ``keys`` whose pages hold theirs, and how many there are; one alone is an answer."""
    from quire.operators.joins import range_join

    met = range_join(readings, registry, keys, page, first, last, 50)
    return met.groupBy(*readings.columns).agg(F.count(F.lit(1)).alias("records"), F.min("record").alias("record")).withColumn("answered", F.col("records") == 1)


def json_records(messages: DataFrame, column: str, schema: str) -> DataFrame:
    """Registry messages in JSON as columns; what doesn't parse gives nulls."""
    return messages.withColumn("_m", F.from_json(column, schema)).select(*(c for c in messages.columns if c != column), "_m.*")


def feed_entries(feeds: DataFrame, column: str) -> DataFrame:
    """The entries of Atom feeds: title, identifier, published year and authors, in order."""
    entry = "struct<title:string,id:string,published:string,author:array<struct<name:string>>>"
    parsed = feeds.withColumn("_f", F.from_xml(column, f"entry array<{entry}>", {"rowTag": "feed"}))
    each = parsed.select(*(c for c in feeds.columns if c != column), F.posexplode("_f.entry").alias("place", "e"))
    return each.select(
        *(c for c in feeds.columns if c != column), "place", F.trim("e.title").alias("title"), F.regexp_extract("e.id", "/abs/(.+?)(?:v[0-9]+)?$", 1).alias("identifier"),
        F.left("e.published", F.lit(4)).alias("year"), F.array_join("e.author.name", "; ").alias("authors"),
    )


def page_hits(pages: DataFrame, key: str, html: str, follow: int = 2) -> DataFrame:
    """The first ``follow`` distinct addresses that a result page links to: place, url and label."""
    whole = r"""(?is)<a\s[^>]*?href=["']([^"'#]+)["'][^>]*>(.*?)</a>"""
    urls, labels = (F.regexp_extract_all(F.col(html), F.lit(whole), F.lit(n)) for n in (1, 2))
    each = pages.select(key, F.posexplode(F.arrays_zip(urls.alias("url"), labels.alias("label"))).alias("place", "hit")).select(key, "place", "hit.url", "hit.label")
    once = each.groupBy(key, "url").agg(F.min(F.struct("place", "label")).alias("first"))
    return top(once.select(key, "url", F.col("first.place").alias("place"), F.trim(F.regexp_replace("first.label", "<[^>]*>", "")).alias("label")), [key], follow, F.col("place"))


def chosen(found: DataFrame, query: str, margin: float = 0.1) -> DataFrame:
    """The best hit of a search where no other comes within ``margin`` of it; else nothing."""
    from quire.operators.windows import best_and_second

    best = best_and_second(found, [query], "score", "title")
    return best.where(F.col("second").isNull() | (F.col("score") - F.col("second") >= margin)).drop("second")
