"""Lookups in registries. The registry of works stands on ``part``: each part is a work with identifiers, coordinates and a title."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import identifiers
from quire.operators import lookups
from quire.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

#: The registry in SQL; Spark's is built by ``works``.
WORKS = """w AS (SELECT *, '978' || d || CAST((10 - s % 10) % 10 AS VARCHAR) AS isbn, d || CASE WHEN c = 10 THEN 'X' ELSE CAST(c AS VARCHAR) END AS isbn10 FROM (
  SELECT p_partkey AS work, p_name || ' ' || lower(p_type) AS title, '10.5555/' || replace(lower(p_brand), '#', '.') || '.' || p_partkey AS doi, p_size AS volume, 1980 + p_partkey % 40 AS year,
    1 + (p_partkey * 37) % 900 AS first_page, 1 + (p_partkey * 37) % 900 + p_size AS last_page, d,
    (11 - list_sum(list_transform(range(1, 10), lambda i: CAST(d[i:i] AS INT) * (11 - i))) % 11) % 11 AS c,
    list_sum(list_transform(range(1, 13), lambda i: CAST(('978' || d)[i:i] AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) AS s
  FROM (SELECT *, lpad(CAST((p_partkey * 7919) % 1000000000 AS VARCHAR), 9, '0') AS d FROM part)))"""


def works(t):
    """Works with doi, isbn (13 digits), title, volume, year and pages."""
    d = F.lpad(((F.col("p_partkey") * 7919) % 1_000_000_000).cast("string"), 9, "0")
    check = (11 - identifiers.digit_sum(F.col("d"), 9, lambda i: 11 - i) % 11) % 11
    first = F.lit(1) + (F.col("p_partkey") * 37) % 900
    rows = t("part").withColumn("d", d).withColumn("isbn10", F.concat("d", F.when(check == 10, "X").otherwise(check.cast("string"))))
    return rows.select(
        F.col("p_partkey").alias("work"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"), F.concat(F.lit("10.5555/"), F.regexp_replace(F.lower("p_brand"), "#", "."), F.lit("."), "p_partkey").alias("doi"),
        identifiers.normalized_isbn(F.col("isbn10")).alias("isbn"), "isbn10", F.col("p_size").alias("volume"), (1980 + F.col("p_partkey") % 40).alias("year"), first.alias("first_page"), (first + F.col("p_size")).alias("last_page"),
    )


@query(f"""
WITH {WORKS} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 6 < 4 THEN work END AS work, CASE WHEN l_linenumber % 6 < 4 THEN title END AS title,
  CASE l_linenumber % 6 WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'differs' WHEN 5 THEN 'missing' ELSE 'exact' END AS agreement
FROM lineitem JOIN w ON work = l_partkey""")
def registry_by_doi(t):
    """Records of printed DOIs, however they are printed."""
    k = F.col("l_linenumber") % 6
    printed = (
        F.when(k == 0, F.upper("doi")).when(k == 1, F.concat(F.lit("https://doi.org/"), "doi")).when(k == 2, F.concat(F.lit(" http://dx.doi.org/"), F.upper("doi"), F.lit(" ")))
        .when(k == 3, F.col("doi")).when(k == 4, F.concat("doi", F.lit("x"))).otherwise("")
    )
    known = works(t)
    lines = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("work")).join(known.select("work", "doi"), "work")
    read = lines.select("l_orderkey", "l_linenumber", printed.alias("printed"), F.when(k == 3, F.concat("doi", F.lit("."))).otherwise(F.col("doi")).alias("stored"))
    found = lookups.by_identifier(read, known, identifiers.normalized_doi(F.col("printed")), identifiers.normalized_doi(F.col("doi")), ["work", "title"])
    return found.select("l_orderkey", "l_linenumber", "work", "title", identifiers.compare_doi(F.col("printed"), F.col("stored")).alias("agreement"))


@query(f"""
WITH {WORKS} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 < 3 THEN work END AS work, CASE l_linenumber % 5 WHEN 3 THEN 'differs' WHEN 4 THEN 'missing' ELSE 'exact' END AS agreement
FROM lineitem JOIN w ON work = l_partkey""")
def registry_by_isbn(t):
    """Records of printed ISBNs of ten or thirteen digits, with or without hyphens."""
    k, ten = F.col("l_linenumber") % 5, F.col("isbn10")
    hyphened = F.concat_ws("-", F.substring(ten, 1, 1), F.substring(ten, 2, 4), F.substring(ten, 6, 4), F.substring(ten, 10, 1))
    wrong = F.concat(F.substring("isbn", 1, 12), ((F.substring("isbn", 13, 1).cast("int") + 1) % 10).cast("string"))
    printed = F.when(k == 0, ten).when(k == 1, hyphened).when(k == 2, F.concat_ws(" ", F.substring("isbn", 1, 3), F.substring("isbn", 4, 10))).when(k == 3, wrong).otherwise("")
    known = works(t)
    lines = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("work")).join(known.select("work", "isbn", "isbn10"), "work")
    read = lines.select("l_orderkey", "l_linenumber", printed.alias("printed"), F.col("isbn").alias("stored"))
    found = lookups.by_identifier(read, known.select("work", "isbn"), identifiers.normalized_isbn(F.col("printed")), F.col("isbn"), ["work"])
    return found.select("l_orderkey", "l_linenumber", "work", identifiers.compare_isbn(F.col("printed"), F.col("stored")).alias("agreement"))


SEARCHED = """
WITH k AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS title FROM part), q AS (SELECT DISTINCT 'new ' || p_name || ' ' || lower(p_type) || ' no' || p_size % 3 AS query FROM part),
tw AS (SELECT title, list_filter(list_distinct(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+')), lambda x: length(x) >= 2) AS tws FROM k),
qw AS (SELECT query, list_filter(list_distinct(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}]+')), lambda x: length(x) >= 2) AS qws FROM q),
s AS (SELECT query, title, len(list_intersect(qws, tws)) / len(qws)::DOUBLE AS score FROM qw, tw WHERE len(qws) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, length(title), title) AS rank FROM s WHERE score >= 0.6)"""


@query(f"{SEARCHED} SELECT query, title, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def registry_search(t):
    """The five best records of a search by words."""
    return searched(t).select("query", "title", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def searched(t):
    known = works(t).select("title")
    asked = t("part").select(F.concat_ws(" ", F.lit("new"), "p_name", F.lower("p_type"), F.concat(F.lit("no"), F.col("p_size") % 3)).alias("query"))
    return lookups.search(asked, known, "query", "title")


@query(f"""{SEARCHED}, b AS (SELECT *, lead(score) OVER (PARTITION BY query ORDER BY score DESC, title) AS second, row_number() OVER (PARTITION BY query ORDER BY score DESC, title) AS n FROM r WHERE rank <= 5)
SELECT query, title FROM b WHERE n = 1 AND (second IS NULL OR score - second >= 0.1)""")
def catalogue_choice(t):
    """The record of a search that no other comes near."""
    return lookups.chosen(searched(t), "query").select("query", "title")


@query(f"""
WITH {WORKS}, r AS (SELECT DISTINCT volume, year, first_page + work % 7 AS page FROM w)
SELECT r.volume, r.year, r.page, count(*) AS records, min(work) AS record, count(*) = 1 AS answered FROM r JOIN w ON w.volume = r.volume AND w.year = r.year AND r.page BETWEEN first_page AND last_page GROUP BY 1, 2, 3""")
def registry_by_coordinates(t):
    """Records by volume, year and a page within theirs."""
    known = works(t).withColumnRenamed("work", "record").select("record", "volume", "year", "first_page", "last_page")
    read = known.select("volume", "year", (F.col("first_page") + F.col("record") % 7).alias("page")).distinct()
    return lookups.by_coordinates(read, known, ["volume", "year"], "page", "first_page", "last_page")


@query(f"""
WITH {WORKS} SELECT w.work, title AS name, doi, year, first_page || '-' || last_page AS pages, volume FROM w WHERE work % 4 <> 3
UNION ALL SELECT work, NULL, NULL, NULL, NULL, NULL FROM w WHERE work % 4 = 3""")
def open_archive_records(t):
    """Records from JSON answers, read by a schema of the wanted keys alone."""
    message = F.to_json(F.struct(F.col("title").alias("name"), "doi", "year", F.concat_ws("-", "first_page", "last_page").alias("pages"), "volume", F.lit("x" * 50).alias("unread")))
    sent = works(t).select("work", F.when(F.col("work") % 4 == 3, F.concat(F.lit("<html>"), message)).otherwise(message).alias("body"))
    return lookups.json_records(sent, "body", "name string, doi string, year long, pages string, volume int")


@query(f"""
WITH {WORKS}, e AS (SELECT work // 3 AS feed, row_number() OVER (PARTITION BY work // 3 ORDER BY work) - 1 AS place, title, work, year FROM w)
SELECT feed, place, title, lpad(CAST(work AS VARCHAR), 9, '0') AS identifier, CAST(year AS VARCHAR) AS year, CASE WHEN work % 2 = 0 THEN 'A. One; B. Two' ELSE 'C. Three' END AS authors FROM e""")
def preprint_feed(t):
    """Entries of preprint feeds in XML."""
    authors = F.when(F.col("work") % 2 == 0, "<author><name>A. One</name></author><author><name>B. Two</name></author>").otherwise("<author><name>C. Three</name></author>")
    entry = F.concat(
        F.lit("<entry><id>http://example.org/abs/"), F.lpad(F.col("work").cast("string"), 9, "0"), F.lit("v2</id><title> "), "title", F.lit(" </title><published>"), "year", F.lit("-05-01T00:00:00Z</published>"), authors, F.lit("</entry>")
    )
    rows = works(t).select(F.floor(F.col("work") / 3).alias("feed"), "work", entry.alias("entry"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("work", "entry"))), lambda x: x["entry"])
    feeds = rows.groupBy("feed").agg(F.concat(F.lit("<feed>"), F.array_join(parts, ""), F.lit("</feed>")).alias("xml"))
    return lookups.feed_entries(feeds, "xml").withColumn("place", F.col("place").cast("long"))


@query("""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1) AS us, regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 2) AS ls FROM pages),
h AS (SELECT page_id, unnest(us) AS url, unnest(ls) AS label, unnest(range(len(us))) AS place FROM a),
o AS (SELECT page_id, url, min(place) AS place, arg_min(label, place) AS label FROM h GROUP BY 1, 2)
SELECT page_id, url, trim(regexp_replace(label, '<[^>]*>', '', 'g')) AS label, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n FROM o) WHERE n <= 2""")
def result_page_hits(t):
    """The two first addresses that a page of results leads to."""
    return lookups.page_hits(t("pages").select("page_id", "html"), "page_id", "html").select("page_id", "url", "label", F.col("place").cast("long").alias("place"))
