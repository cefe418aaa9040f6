"""Fields judged, compared and verified, and pages read, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import pages, records
from quire.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


@query("""
WITH p AS (SELECT p_partkey, lpad(CAST(p_partkey * 7 AS VARCHAR), CAST(2 + p_partkey % 9 AS INTEGER), '1') AS code, lpad(CAST((p_partkey * 7919) % 1000000000 AS VARCHAR), 9, '0') AS d, lpad(CAST((p_partkey * 131) % 10000000 AS VARCHAR), 7, '0') AS e,
  CASE WHEN p_partkey % 11 = 10 THEN 'X' ELSE CAST(p_partkey % 11 AS VARCHAR) END AS x FROM part),
c AS (SELECT *, (11 - list_sum(list_transform(range(1, 10), lambda i: CAST(d[i:i] AS INT) * (11 - i))) % 11) % 11 AS ten, (11 - list_sum(list_transform(range(1, 8), lambda i: CAST(e[i:i] AS INT) * (9 - i))) % 11) % 11 AS eight FROM p)
SELECT p_partkey, CASE WHEN length(code) NOT BETWEEN 4 AND 9 THEN 'noDoiShape' WHEN p_partkey % 13 = 0 THEN 'template' END AS doi, CASE WHEN ten <> p_partkey % 11 THEN 'checkDigit' END AS isbn, CASE WHEN eight <> p_partkey % 11 THEN 'checkDigit' END AS issn FROM c""")
def identifier_validity(t):
    """Why identifiers can't stand in their fields: shapes, templates, check digits."""
    k = F.col("p_partkey")
    code = F.lpad((k * 7).cast("string"), (2 + k % 9).cast("int"), "1")
    doi = F.concat(F.lit("10."), code, F.when(k % 13 == 0, F.lit("/xxx")).otherwise(F.concat(F.lit("/a."), k.cast("string"))))
    x = F.when(k % 11 == 10, "X").otherwise((k % 11).cast("string"))
    isbn = F.concat(F.lpad(((k * 7919) % 1_000_000_000).cast("string"), 9, "0"), x)
    digits = F.lpad(((k * 131) % 10_000_000).cast("string"), 7, "0")
    issn = F.concat(F.left(digits, F.lit(4)), F.lit("-"), F.substring(digits, 5, 3), x)
    problem = lambda f, v: records.field_problem(F.lit(f), v)
    return t("part").select("p_partkey", problem("DOI", doi).alias("doi"), problem("ISBN", isbn).alias("isbn"), problem("ISSN", issn).alias("issn"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN CASE WHEN o_orderkey % 17 NOT BETWEEN 1 AND 12 THEN 'noDate' END WHEN try_cast(printf('%04d-%02d-%02d', 1990 + o_orderkey % 30, o_orderkey % 14, o_orderkey % 33) AS DATE) IS NULL THEN 'noDate' END AS date,
  CASE WHEN o_custkey % 5 = 4 OR (o_custkey % 5 = 3 AND NOT regexp_matches(CAST(o_custkey AS VARCHAR), '^[0-9]{1,8}$')) THEN 'noPages' END AS pages,
  CASE WHEN o_custkey % 6 IN (0, 3, 5) THEN 'noNumber' END AS volume, CASE WHEN o_custkey % 6 = 2 THEN 'citation' END AS container FROM orders""")
def date_and_locator_validity(t):
    """Why dates, pages, volumes and containers can't stand in their fields."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    whole = F.concat_ws("-", 1990 + k % 30, k % 14, k % 33)
    date = F.when(k % 4 == 3, F.concat_ws("/", k % 17, F.lit("2019"))).otherwise(whole)
    number = c.cast("string")
    pages_ = F.when(c % 5 == 0, F.concat_ws("–", c, c + 9)).when(c % 5 == 1, F.concat(F.lit("S"), number)).when(c % 5 == 2, F.concat(F.lit("e"), number, F.lit(" - e"), (c + 2).cast("string"))).when(c % 5 == 3, number).otherwise(F.concat(number, F.lit("+ pp.")))
    volume = F.get(F.array(F.lit("00"), number, F.lit("xiv"), F.lit("Suppl"), F.lit("1a"), F.lit("several of")), (c % 6).cast("int"))
    container = F.when(c % 6 == 2, F.concat(F.lit("Vol. "), number)).otherwise(F.concat(F.lit("Journal "), number))
    problem = lambda f, v: records.field_problem(F.lit(f), v)
    return t("orders").select("o_orderkey", problem("date", date).alias("date"), problem("pages", pages_).alias("pages"), problem("volume", volume).alias("volume"), problem("publicationTitle", container).alias("container"))


@query("""
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'empty' WHEN 1 THEN 'placeholder' WHEN 2 THEN 'placeholder' WHEN 3 THEN 'placeholder' WHEN 4 THEN 'noLetters' END AS title, CASE p_partkey % 5 WHEN 0 THEN 'noLetters' WHEN 1 THEN 'address' WHEN 2 THEN 'address' END AS publisher,
  CASE p_partkey % 4 WHEN 0 THEN 'noAddress' WHEN 3 THEN 'noAddress' END AS url, CASE WHEN p_partkey % 3 = 0 OR p_size = 0 THEN 'noNumber' END AS num_pages, CASE p_partkey % 3 WHEN 2 THEN 'noLanguage' END AS language FROM part""")
def text_validity(t):
    """Why titles, houses, addresses, extents and languages can't stand in their fields."""
    k, name, key = F.col("p_partkey"), F.col("p_name"), F.col("p_partkey").cast("string")
    title = F.get(F.array(F.lit(" "), F.concat(name, F.lit(".pdf")), F.concat(name, F.lit(" : ")), F.lit("Untitled"), F.concat(key, F.lit(" / 12")), name, F.upper(name), F.concat(F.lit("On "), name), F.concat(name, F.lit(" 2"))), (k % 9).cast("int"))
    house = F.get(F.array(key, F.concat(F.lit("https://"), F.regexp_replace(name, " ", "")), F.concat(F.lit("info@"), F.regexp_replace(name, " ", ""), F.lit(".org")), name, F.concat(name, F.lit(" Press"))), (k % 5).cast("int"))
    url = F.get(F.array(name, F.concat(F.lit("https://example.org/"), key), F.concat(F.lit("HTTP://Example.org?"), key), F.lit("javascript:alert(1)")), (k % 4).cast("int"))
    extent = F.when(k % 3 == 0, F.lit("many")).when(k % 3 == 1, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("xii, "), F.col("p_size").cast("string")))
    language = F.get(F.array(F.lit("English"), F.lit("pt-BR"), name), (k % 3).cast("int"))
    problem = lambda f, v: records.field_problem(F.lit(f), v)
    return t("part").select(
        "p_partkey", problem("title", title).alias("title"), problem("publisher", house).alias("publisher"), problem("url", url).alias("url"), problem("numPages", extent).alias("num_pages"), problem("language", language).alias("language")
    )


def _long(df, key, **fields):
    return df.select(F.col(key).alias("key"), F.inline(F.array(*(F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()))))


@query("""
SELECT o_orderkey AS key, field, old, new FROM (
  SELECT o_orderkey, 'title' AS field, o_orderpriority AS old, 'New title' AS new FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
  SELECT o_orderkey, 'date', '2018', '2019-05-07' FROM orders WHERE o_orderkey % 2 = 1 UNION ALL
  SELECT o_orderkey, 'volume', '', '12' FROM orders UNION ALL
  SELECT o_orderkey, 'ISSN', '0378-5955', '0378-5955 2434-561X' FROM orders UNION ALL
  SELECT o_orderkey, 'rights', 'x', '' FROM orders)""")
def record_changes(t):
    """What a reading proposes, without what only says the same otherwise."""
    k, lit = F.col("o_orderkey"), F.lit
    title = F.when(k % 3 == 0, "New title").otherwise(F.lower(F.regexp_replace("o_orderpriority", "-", " : ")))
    stored = _long(t("orders"), "o_orderkey", title=F.col("o_orderpriority"), date=F.when(k % 2 == 0, "2019-05-07").otherwise("2018"), ISSN=lit("0378-5955"), publisher=lit("House Ltd."), callNumber=lit("QA1"), rights=lit("x"))
    read = _long(t("orders"), "o_orderkey", title=title, date=F.when(k % 2 == 0, "May 7, 2019").otherwise("2019-05-07"), ISSN=lit("2434-561X"), publisher=lit("House Inc"), callNumber=lit("QA2"), volume=lit("12"), accessDate=lit("today"))
    return records.record_diff(stored, read, authoritative=True)


_FOLD = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 4 WHEN 0 THEN substr(text, 11, 30) WHEN 1 THEN replace(substr(text, 5, 25), ' ', ' - ') WHEN 2 THEN 'zq' || doc_id || ' name' ELSE '' END AS new, doc_id % 3 = 0 AS rival, doc_id % 5 = 0 AS linked FROM documents),
f AS (SELECT *, {_FOLD.format("text")} AS t, {_FOLD.format("coalesce(new, '')")} AS v FROM d)
SELECT doc_id, CASE WHEN coalesce(trim(new), '') = '' THEN 'unknown' WHEN v <> '' AND contains(t, v) THEN 'verified' WHEN rival THEN 'conflicting' WHEN linked THEN 'verified' WHEN text = '' THEN 'sourceStated' ELSE 'proposed' END AS level FROM f""")
def verification_levels(t):
    """What documents say of proposed values, which are taken from them, changed, or others' (A31, X1, J23, J34)."""
    k, text = F.col("doc_id"), F.col("text")
    new = F.when(k % 4 == 0, F.substring(text, 11, 30)).when(k % 4 == 1, F.replace(F.substring(text, 5, 25), F.lit(" "), F.lit(" - "))).when(k % 4 == 2, F.concat(F.lit("zq"), k.cast("string"), F.lit(" name"))).otherwise("")
    changes = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("shortTitle").alias("field"), F.trim(F.coalesce(new, F.lit(""))).alias("new"))
    return records.verify(changes, F.col("text"), F.when(k % 3 == 0, F.lit("another value")), k % 5 == 0).select("doc_id", "level")


@query(f"""
WITH b AS (SELECT item_id, text, substr(text, 1, 10 + item_id % 30) AS title, ['Adams', 'Brown', 'Clark'][1:1 + item_id % 3] AS names, item_id % 2 = 0 AS doi, item_id % 5 = 0 AS unclear FROM benchmark),
p AS (SELECT *, text || CASE item_id % 4 WHEN 0 THEN ' Adams' WHEN 1 THEN ' ADAMS, Brown' WHEN 2 THEN '' ELSE ' Brown and Clark' END || CASE WHEN item_id % 3 = 0 THEN ' 2019' ELSE '' END AS page FROM b),
x AS (SELECT item_id, doi AND NOT unclear AS doi_same, unclear, length({_FOLD.format("title")}) >= 12 AND contains({_FOLD.format("page")}, {_FOLD.format("title")}) AS titled, len(list_filter(names, lambda n: contains({_FOLD.format("page")}, lower(n)))) >= ceil(len(names) / 2.0) AS authored, contains(page, '2019') AS dated FROM p)
SELECT item_id, doi_same AS doi, titled AS title, authored AS authors, dated AS year, unclear AS ambiguous, doi_same AND NOT unclear AND (titled OR (authored AND dated)) AS bound FROM x""")
def registry_bindings(t):
    """Five checks that tie records to documents."""
    k, key = F.col("item_id"), F.col("item_id").cast("string")
    page = F.concat("text", F.get(F.array(F.lit(" Adams"), F.lit(" ADAMS, Brown"), F.lit(""), F.lit(" Brown and Clark")), (k % 4).cast("int")), F.when(k % 3 == 0, " 2019").otherwise(""))
    printed = F.concat(F.lit("10.1234/"), F.when(k % 2 == 0, key).otherwise("other"), F.when(k % 5 == 0, ".").otherwise(""))
    names = F.slice(F.array(F.lit("Adams"), F.lit("Brown"), F.lit("Clark")), F.lit(1), (1 + k % 3).cast("int"))
    b = records.binding(F.concat(F.lit("10.1234/"), key), printed, F.substring("text", F.lit(1), (10 + k % 30).cast("int")), page, names, F.lit("2019"))
    return t("benchmark").select("item_id", b.alias("b")).select("item_id", "b.*")


#: Each customer's document has 3 to 8 pages, references from one on, a page without its number, and numbers that start anywhere.
_SHAPE = "SELECT DISTINCT o_custkey AS doc_id, 3 + o_custkey % 6 AS n, 2 + o_custkey % 5 AS refs, 1 + o_custkey % 4 AS bare, o_custkey % 50 AS shift FROM orders"


def _paged(t):
    key, page = F.col("o_custkey"), F.col("page")
    rows = t("orders").select("o_custkey").distinct().withColumn("page", F.explode(F.sequence(F.lit(1), (3 + key % 6).cast("int"))))
    body = F.when(page == 1, F.concat(F.lit("A study of customer "), key.cast("string"))).when(page == 2 + key % 5, "References").otherwise(F.concat(F.lit("text of page "), page.cast("string"), F.lit(" and "), key.cast("string"), F.lit(" more")))
    parts = [F.lit("Journal of Orders"), body, F.lit("first"), F.lit("second"), F.concat(F.lit("line"), F.hex(F.xxhash64("o_custkey", "page"))), F.when(page != 1 + key % 4, (page + key % 50).cast("string"))]
    return rows.select(key.alias("doc_id"), "page", F.concat_ws("\n", *parts).alias("text"))


@query(f"""
SELECT doc_id, CAST(p AS INT) AS page, CASE WHEN p >= refs THEN 'references' ELSE 'body' END AS role FROM ({_SHAPE}) s, range(1, 9) r(p) WHERE p <= n""")
def page_roles(t):
    """What pages are, references carried on."""
    return pages.roles(_paged(t))


@query(f"""
SELECT doc_id, shift AS "offset", CASE WHEN bare > n THEN 1 WHEN bare - 1 >= n - bare THEN 1 ELSE bare + 1 END AS first, CASE WHEN bare > n THEN n WHEN bare - 1 >= n - bare THEN bare - 1 ELSE n END AS last FROM ({_SHAPE}) s
WHERE CASE WHEN bare > n THEN n ELSE greatest(bare - 1, n - bare) END >= 2""")
def folio_runs(t):
    """The longest run of printed page numbers, the earlier of equals."""
    return pages.folio_run(_paged(t))


@query("""SELECT DISTINCT o_custkey AS doc_id, 'A study of customer ' || o_custkey AS title FROM orders""")
def document_titles(t):
    """Titles past running heads."""
    return pages.document_title(_paged(t))


@query("""
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'mismatch' WHEN o_orderkey % 4 = 1 THEN 'ready' WHEN o_orderkey % 4 = 2 THEN 'review' ELSE 'noChanges' END AS status,
  CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 1 END AS changes FROM orders""")
def evaluated_rows(t):
    """From a reading to a row's status: diff, verification, decision."""
    key = F.col("o_orderkey")
    k = key % 4
    title = F.when(k == 3, "Old title").otherwise(F.concat(F.lit("New title "), key.cast("string")))
    stored = _long(t("orders"), "o_orderkey", title=F.lit("Old title"))
    read = _long(t("orders"), "o_orderkey", title=title)
    changes = records.record_diff(stored, read)
    k = F.col("key") % 4
    text = F.when(k == 1, F.concat(F.lit("A new title "), F.col("key").cast("string"))).otherwise("nothing of it")
    judged = records.verify(changes, text, F.when(k == 0, F.lit("Third title")), F.lit(False))
    counts = judged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "verified").alias("verified"), F.count_if(F.col("level") == "conflicting").alias("conflicting"))
    rows = t("orders").select(key.alias("key")).join(counts.hint("merge"), "key", "left").fillna(0)
    status = F.when(F.col("conflicting") > 0, "mismatch").when(F.col("n") == 0, "noChanges").when(F.col("verified") == F.col("n"), "ready").otherwise("review")
    return rows.select("key", status.alias("status"), F.col("n").cast("int").alias("changes"))
