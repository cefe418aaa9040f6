"""Caches, page transcripts, printed identifiers and refinements over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import readings
from quire.operators import refine
from quire.operators.windows import best_and_second, keep_latest, top
from quire.plans.registry import Registry
from quire.sources import tables

REGISTRY = Registry()
query = REGISTRY.query


@query("""
SELECT l.doc_id, CASE WHEN d.doc_id IS NULL OR l.doc_id % 10 = 0 THEN 'missing' WHEN l.doc_id % 10 = 1 THEN 'unreadable' WHEN l.doc_id % 10 = 2 OR trim(d.text, ' ' || chr(9) || chr(10)) = '' THEN 'empty' ELSE 'present' END AS state
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def text_cache_states(t):
    """Each item's text cache: present, missing, empty or unreadable."""
    k = F.col("doc_id") % 10
    cache = t("documents").where("doc_id % 10 <> 0").select("doc_id", F.when(k == 2, " \n\t ").when(k == 1, None).otherwise(F.col("text")).alias("content"), (k != 1).alias("readable"))
    return tables.text_states(t("labels").select("doc_id"), cache, "doc_id")


@query("""
WITH f AS (SELECT event_id, user_id, event_id % 7 = 0 AS corrupt, event_id % 5 = 0 AS bare, event_id % 5 = 0 AND event_id % 2 = 0 AS by_print, ts FROM events),
k AS (SELECT *, CASE WHEN NOT bare OR by_print THEN user_id END AS key FROM f WHERE NOT corrupt)
SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM k) AS parsed, (SELECT count(*) FROM f WHERE corrupt) AS corrupt, (SELECT count(*) FROM k WHERE key IS NULL) AS without_key,
  (SELECT count(*) - count(DISTINCT key) FROM k WHERE key IS NOT NULL) AS duplicates""")
def row_cache_counts(t):
    """What a folder of cached rows holds: parsed, corrupt, without a key, and duplicates of one."""
    k = F.col("event_id")
    row = F.to_json(F.struct(F.when(k % 5 != 0, F.col("user_id")).alias("key"), F.when((k % 5 == 0) & (k % 2 == 0), F.to_json(F.struct(F.col("user_id").alias("key")))).alias("print"), F.unix_micros(F.col("ts").cast("timestamp")).alias("saved")))
    bodies = t("events").select("event_id", F.when(k % 7 == 0, F.concat(F.lit("{broken"), row)).otherwise(row).alias("body"))
    return tables.cached_row_counts(bodies, "body")


@query("""
WITH f AS (SELECT event_id, user_id, epoch_us(ts) AS saved FROM events WHERE event_id % 7 <> 0 AND (event_id % 5 <> 0 OR event_id % 2 = 0))
SELECT user_id AS key, max(saved) AS saved, count(*) - 1 AS replaced FROM f GROUP BY 1""")
def cached_rows_kept(t):
    """Of several cached rows of a key the one saved last."""
    k = F.col("event_id")
    rows = t("events").where((k % 7 != 0) & ((k % 5 != 0) | (k % 2 == 0))).select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("saved"))
    return keep_latest(rows, ["key"], F.col("saved").desc(), F.col("event_id"), extra="replaced").select("key", "saved", "replaced")


@query("""
WITH p AS (SELECT conv_id, turn + 1 AS page, CASE WHEN turn % 4 = 3 THEN '' ELSE trim(text, ' ' || chr(10)) END || CASE WHEN turn % 5 = 0 AND turn % 4 <> 3 THEN repeat(' long', 3000) ELSE '' END AS body FROM conversations)
SELECT conv_id, page, length(body[1:12000]) AS text, length(body[1:24000]) AS layout, length(body) > 12000 AS truncated FROM p WHERE page <= 12 AND body <> ''""")
def transcript_pages(t):
    """Pages of a transcript by its page marks, the first twelve, with their limits."""
    k = F.col("turn")
    body = F.concat(F.when(k % 4 == 3, "").otherwise(F.trim("text", F.lit(" \n"))), F.when((k % 5 == 0) & (k % 4 != 3), F.repeat(F.lit(" long"), 3000)).otherwise(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("--- PAGE "), (k + 1).cast("string"), F.lit(" ---\n"), body).alias("p")))), lambda x: x["p"])
    whole = t("conversations").groupBy("conv_id").agg(F.concat(F.lit("head\n"), F.array_join(parts, "\n")).alias("text"))
    pages = tables.transcript_pages(whole, "conv_id", "text")
    return pages.select("conv_id", "page", F.char_length("text").cast("long").alias("text"), F.char_length("layout").cast("long").alias("layout"), "truncated")


_PRINTED = "SELECT p_partkey, p_partkey % 2 = 0 AS doi, p_partkey % 6 = 0 AS second, p_partkey % 3 = 0 AS isbn, p_partkey % 10 = 0 AS unclear, p_partkey % 4 = 0 AS stop FROM part"


def _identified(t):
    k = F.col("p_partkey")
    key = k.cast("string")
    doi = F.when(k % 2 == 0, F.concat(F.lit("doi 10.1234/p."), key, F.when(k % 10 == 0, "(x").otherwise(""), F.when(k % 4 == 0, ".").otherwise(""), F.lit(" "))).otherwise("")
    second = F.when(k % 6 == 0, F.concat(F.lit("and 10.5678/q."), key, F.lit(" "))).otherwise("")
    isbn = F.when(k % 3 == 0, "ISBN 978-0-306-40615-7").otherwise("")
    return t("part").select("p_partkey", readings.identifiers_in(F.concat(F.lit("On parts. "), doi, second, isbn)).alias("found"))


@query(f"""
SELECT count(*) FILTER (doi AND NOT isbn) AS doi_only, count(*) FILTER (isbn AND NOT doi) AS isbn_only, count(*) FILTER (doi AND isbn) AS both, count(*) FILTER (NOT doi AND NOT isbn) AS neither,
  count(*) FILTER (doi AND unclear) AS ambiguous, count(*) FILTER (doi AND stop AND NOT unclear) AS repaired, count(*) FILTER (second) AS multiple FROM ({_PRINTED})""")
def identifier_sets(t):
    """Which identifiers documents print, and how surely (A3)."""
    return refine.identifier_sets(_identified(t), "found")


@query(f"""
WITH r AS (SELECT *, p_partkey % 5 AS held FROM ({_PRINTED}) WHERE doi),
o AS (SELECT *, CASE WHEN held = 0 THEN 'noRecord' WHEN unclear AND NOT second THEN 'heldAmbiguous' WHEN held IN (1, 2) AND NOT unclear THEN 'exact' WHEN held = 3 AND second THEN 'exact' ELSE 'differs' END AS outcome FROM r)
SELECT outcome, count(*) AS n, count(*) FILTER (outcome = 'exact' AND held IN (1, 2) AND stop) AS repaired FROM o GROUP BY 1""")
def printed_against_stored(t):
    """One outcome for each record from the identifiers that its document prints, and how many of those that agree were repaired (A4)."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    stored = F.when(k % 5 == 0, "").when(k % 5 == 3, F.concat(F.lit("10.5678/Q."), key)).when(k % 5 == 4, "10.1/other").otherwise(F.concat(F.lit("https://doi.org/10.1234/P."), key))
    return refine.printed_outcomes(_identified(t).withColumn("stored", stored), "found", "stored")


@query("""
SELECT label, vec_id, CASE WHEN score < 0.45 THEN 'weak' WHEN second IS NOT NULL AND score - second < 0.1 THEN 'close' ELSE 'chosen' END AS verdict FROM (
  SELECT label, vec_id, score, lead(score) OVER w AS second, row_number() OVER w AS n FROM (SELECT p_brand AS label, p_partkey AS vec_id, ((p_partkey * 37) % 101) / 101.0::DOUBLE * CASE WHEN p_brand < 'Brand#15' THEN 0.4 ELSE 1 END AS score FROM part)
  WINDOW w AS (PARTITION BY label ORDER BY score DESC, vec_id)) WHERE n = 1""")
def best_by_margin(t):
    """The best of each group, chosen only by a score of 0.45 and a margin of 0.1."""
    score = ((F.col("p_partkey") * 37) % 101) / F.lit(101.0) * F.when(F.col("p_brand") < "Brand#15", 0.4).otherwise(1.0)
    rows = t("part").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("vec_id"), score.alias("score"))
    best = best_and_second(rows, ["label"], "score", "vec_id")
    verdict = F.when(F.col("score") < 0.45, "weak").when(F.coalesce(F.col("score") - F.col("second") < 0.1, F.lit(False)), "close").otherwise("chosen")
    return best.select("label", "vec_id", verdict.alias("verdict"))


@query("""
WITH w AS (SELECT doc_id, string_split_regex(text, '\\s+') AS ws FROM documents), f AS (SELECT doc_id, list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z]{1,2}$') THEN 'f' ELSE '-' END) AS marks FROM w)
SELECT doc_id, contains(array_to_string(marks, ''), 'ffff') AS degraded FROM f""")
def degraded_pages(t):
    """Texts with four fragments of words in a row."""
    return t("documents").select("doc_id", refine.is_degraded(F.col("text")).alias("degraded"))


@query("""
WITH q AS (SELECT o_custkey, kind, text, min(place) AS place FROM (
  SELECT o_custkey, 'title' AS kind, o_orderpriority AS text, 1 * 1000000 + o_orderkey AS place FROM orders UNION ALL SELECT o_custkey, 'isbn', o_orderstatus, o_orderkey FROM orders) GROUP BY 1, 2, 3)
SELECT o_custkey, string_agg(kind || ':' || text, ',' ORDER BY place) AS queries FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY place) AS n FROM q) WHERE n <= 8 GROUP BY 1""")
def ranked_queries(t):
    """Queries by kind, then order, once each, eight at most: the cap is the feature."""
    o = t("orders")
    kinds = o.select("o_custkey", F.lit("isbn").alias("kind"), F.col("o_orderstatus").alias("text"), F.col("o_orderkey").alias("place")).unionByName(
        o.select("o_custkey", F.lit("title").alias("kind"), F.col("o_orderpriority").alias("text"), (F.lit(1_000_000) + F.col("o_orderkey")).alias("place"))
    )
    once = kinds.groupBy("o_custkey", "kind", "text").agg(F.min("place").alias("place"))
    first = top(once, ["o_custkey"], 8, F.col("place"), rank="n")
    each = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "kind", "text").alias("q")))), lambda x: x["q"])
    return first.groupBy("o_custkey").agg(F.array_join(each, ",").alias("queries"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS labelled, 'S' || l_suppkey AS issuer FROM lineitem), a AS (SELECT DISTINCT l_orderkey, 'S' || l_suppkey AS issuer FROM lineitem WHERE l_linestatus = 'F' AND l_discount > 0.05)
SELECT l_orderkey, arg_min(issuer, (CASE WHEN labelled THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey)) AS issuer FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = s.l_orderkey AND a.issuer = s.issuer) GROUP BY 1""")
def issuers(t):
    """The issuer of a document: a labelled one, else the first seated, without its sponsors."""
    name = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("issuer")
    stated = t("lineitem").select("l_orderkey", name, F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("seat"), "l_linenumber", "l_partkey", "l_suppkey")
    sponsors = t("lineitem").where("l_linestatus = 'F' AND l_discount > 0.05").select("l_orderkey", name)
    left = stated.join(sponsors.distinct(), ["l_orderkey", "issuer"], "left_anti")
    return left.groupBy("l_orderkey").agg(F.min(F.struct("seat", "l_linenumber", "l_partkey", "l_suppkey", "issuer"))["issuer"].alias("issuer"))


@query("""
WITH q AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'ab' WHEN 1 THEN substr(text, 1, 60) WHEN 2 THEN text || text WHEN 3 THEN 'One sentence here. And then another one. And more of it.' WHEN 4 THEN 'Word' ELSE 'Electroencephalographically' END AS q FROM benchmark)
SELECT item_id, length(trim(q)) BETWEEN 4 AND 200 AND len(regexp_extract_all(q, '[.!?]\\s+[A-Z]')) < 2 AS askable, length(trim(q)) BETWEEN 4 AND 200 AND len(regexp_extract_all(q, '[.!?]\\s+[A-Z]')) < 2
  AND (len(regexp_extract_all(q, '[A-Za-z0-9]{2,}')) >= 2 OR length(trim(q)) >= 12) AS by_web FROM q""")
def askable_queries(t):
    """Texts that may be asked for, and by web search: two words or one of a title's size."""
    k, text = F.col("item_id") % 6, F.col("text")
    q = (
        F.when(k == 0, "ab").when(k == 1, F.substring(text, 1, 60)).when(k == 2, F.concat(text, text)).when(k == 3, "One sentence here. And then another one. And more of it.")
        .when(k == 4, "Word").otherwise("Electroencephalographically")
    )
    return t("benchmark").select("item_id", refine.is_askable(q).alias("askable"), refine.is_askable(q, web=True).alias("by_web"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN o_custkey || '-' || (o_custkey + 5) WHEN 4 THEN 'Müller ' || o_custkey END AS refined FROM orders""")
def refined_values(t):
    """Fuller forms of the same statement: longer dates, whole page ranges, spellings with marks."""
    k, d, c = F.col("o_orderkey") % 6, F.col("o_orderdate"), F.col("o_custkey")
    field = F.when(k < 2, "date").when(k < 4, "pages").otherwise("publisher")
    read = F.when(k < 2, F.date_format(d, "yyyy-MM")).when(k < 4, c.cast("string")).otherwise(F.concat(F.lit("MULLER "), c.cast("string")))
    stated = (
        F.when(k == 0, F.date_format(d, "MMMM d, yyyy")).when(k == 1, F.date_format(F.add_months(d, 1), "yyyy-MM-dd")).when(k == 2, F.concat_ws("–", c, c + 5)).when(k == 3, F.concat_ws("-", c + 1, c + 5))
        .when(k == 4, F.concat(F.lit("Müller "), c.cast("string"))).otherwise(F.concat(F.lit("Miller "), c.cast("string")))
    )
    return t("orders").select("o_orderkey", refine.refined(field, read, stated).alias("refined"))


@query("""
SELECT doc_id, n, CASE WHEN doc_id % 9 = 0 THEN 'failed' ELSE 'done' END AS state, CASE WHEN doc_id % 9 = 0 THEN 'no text' END AS error FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def resumed_run(t):
    """A run over what earlier ones left: each row done or failed by itself, in order."""
    from quire.operators.stages import run_rows

    work = lambda rows: rows.withColumn("error", F.when(F.col("doc_id") % 9 == 0, "no text"))
    return run_rows(t("documents").select("doc_id"), t("labels").select("doc_id"), "doc_id", work)


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN o_custkey = o_custkey % 7 WHEN 3 THEN true ELSE false END AS same FROM orders""")
def same_files(t):
    """Whether two readings are of one file: by size and time where both state them, else by their text."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    mark = lambda path, length, at: F.to_json(F.struct(path.alias("path"), length.alias("length"), F.date_format(at, "yyyy-MM-dd").alias("modified")))
    d = F.col("o_orderdate")
    a = F.when(k < 3, mark(F.lit("a"), c, d)).otherwise(F.concat(F.lit("plain"), c.cast("string")))
    b = F.when(k == 0, mark(F.lit("b"), c, d)).when(k == 1, mark(F.lit("a"), c, F.date_add(d, 1))).when(k == 2, mark(F.lit("a"), c % 7, d)).when(k == 3, F.concat(F.lit("plain"), c.cast("string"))).otherwise(F.lit("plain"))
    return t("orders").select("o_orderkey", tables.same_file(a, b).alias("same"))


#: Fixtures in order: what an address must hold, or match, and the status answered.
FIXTURES = (("/en/1", False, 201), ("/de/", False, 202), (r"://[^/]*\.org/.*[02468]$", True, 203), ("http", False, 204))


@query("""
SELECT page_id, CASE WHEN contains(url, '/en/1') THEN 201 WHEN contains(url, '/de/') THEN 202 WHEN regexp_matches(url, '://[^/]*\\.org/.*[02468]$') THEN 203 ELSE 204 END AS status FROM pages WHERE contains(url, 'http')""")
def fixture_answers(t):
    """The first fixture that an address fits."""
    urls = t("pages").select("page_id", "url")
    listed = urls.sparkSession.createDataFrame([(i, m, r, n) for i, (m, r, n) in enumerate(FIXTURES)], "ordinal int, match string, is_regex boolean, status int")
    met = tables.fixtures_for(urls.select("url").distinct(), listed).select("url", "status")
    return urls.join(met, "url").select("page_id", "status")


@query("""
WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '연구 ' || p_name WHEN 2 THEN '한국어 제목의 연구와 분석 ' || p_brand ELSE '한글만 있는 제목' END AS title FROM part),
c AS (SELECT p_partkey, len(regexp_extract_all(title, '[가-힣]')) AS h, len(regexp_extract_all(title, '[A-Za-z]')) AS l FROM x)
SELECT p_partkey, CASE WHEN h = 0 THEN 'none' WHEN h >= l THEN 'hangul' ELSE 'mixed' END AS script FROM c""")
def title_scripts(t):
    """Which letters prevail in a title."""
    from quire.functions.titles import title_script

    k, name = F.col("p_partkey") % 4, F.col("p_name")
    title = F.when(k == 0, name).when(k == 1, F.concat(F.lit("연구 "), name)).when(k == 2, F.concat(F.lit("한국어 제목의 연구와 분석 "), "p_brand")).otherwise("한글만 있는 제목")
    return t("part").select("p_partkey", title_script(title).alias("script"))


@query("""
WITH w AS (SELECT l_orderkey AS doc_id, 1 + l_linenumber % 2 AS page, 10 * (l_partkey % 3) AS y, l_linenumber AS x, l_returnflag || l_linenumber AS word FROM lineitem),
l AS (SELECT doc_id, page, y, string_agg(word, ' ' ORDER BY x, word) AS line FROM w GROUP BY 1, 2, 3)
SELECT doc_id, page, string_agg(line, chr(10) ORDER BY y) AS text FROM l GROUP BY 1, 2""")
def page_texts(t):
    """Pages' texts from words with places."""
    line = F.col("l_linenumber")
    words = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), (1 + line % 2).alias("page"), (10 * (F.col("l_partkey") % 3) + 0.2).alias("y"), line.alias("x"), F.concat("l_returnflag", line.cast("string")).alias("text"))
    lines = tables.lines_of_words(words)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"])
    return lines.groupBy("doc_id", "page").agg(F.array_join(parts, "\n").alias("text"))
