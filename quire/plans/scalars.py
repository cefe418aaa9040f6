"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import dates, identifiers, titles, web
from quire.functions.basics import half_up
from quire.operators import joins, windows
from quire.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
DIGITS = "lpad(CAST((p_partkey * 7919) % 1000000000 AS VARCHAR), 9, '0')"


@query(f"""
SELECT p_partkey, CASE WHEN c = 10 THEN d || 'X' ELSE d || c END AS isbn10, '978' || d || CAST((10 - s % 10) % 10 AS VARCHAR) AS isbn13, true AS valid FROM (
  SELECT p_partkey, d, (11 - list_sum(list_transform(range(1, 10), lambda i: CAST(d[i:i] AS INT) * (11 - i))) % 11) % 11 AS c,
    list_sum(list_transform(range(1, 13), lambda i: CAST(('978' || d)[i:i] AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) AS s
  FROM (SELECT p_partkey, {DIGITS} AS d FROM part))""")
def isbn_checksum(t):
    """ISBN check digits and their conversion."""
    digits = F.lpad(((F.col("p_partkey") * 7919) % 1_000_000_000).cast("string"), 9, "0")
    check = (11 - identifiers.digit_sum(F.col("d"), 9, lambda i: 11 - i) % 11) % 11
    ten = F.concat("d", F.when(check == 10, "X").otherwise(check.cast("string")))
    rows = t("part").select("p_partkey", digits.alias("d")).withColumn("isbn10", ten)
    return rows.select("p_partkey", "isbn10", identifiers.normalized_isbn(F.col("isbn10")).alias("isbn13"), (identifiers.valid_isbn(F.col("isbn10")) != "").alias("valid"))


@query("""
SELECT p_partkey, CASE WHEN c = k THEN d[1:4] || '-' || d[5:7] || x ELSE '' END AS issn FROM (
  SELECT p_partkey, d, x, CASE x WHEN 'X' THEN 10 ELSE CAST(x AS INT) END AS k, (11 - list_sum(list_transform(range(1, 8), lambda i: CAST(d[i:i] AS INT) * (9 - i))) % 11) % 11 AS c
  FROM (SELECT p_partkey, lpad(CAST((p_partkey * 131) % 10000000 AS VARCHAR), 7, '0') AS d, CASE WHEN p_partkey % 11 = 10 THEN 'X' ELSE CAST(p_partkey % 11 AS VARCHAR) END AS x FROM part))""")
def issn_checksum(t):
    """ISSN check digits, valid or not."""
    d = F.lpad(((F.col("p_partkey") * 131) % 10_000_000).cast("string"), 7, "0")
    x = F.when(F.col("p_partkey") % 11 == 10, "X").otherwise((F.col("p_partkey") % 11).cast("string"))
    return t("part").select("p_partkey", identifiers.valid_issn(F.concat(d, x)).alias("issn"))


@query("""
WITH RECURSIVE s AS (SELECT p_partkey, lpad(CAST(p_partkey * 104729 AS VARCHAR), 15, '0') AS d, 0 AS i, 0::BIGINT AS total FROM part
  UNION ALL SELECT p_partkey, d, i + 1, (total + CAST(d[i + 1:i + 1] AS BIGINT)) * 2 FROM s WHERE i < 15)
SELECT p_partkey, CASE WHEN CASE WHEN (12 - total % 11) % 11 = 10 THEN 'X' ELSE CAST((12 - total % 11) % 11 AS VARCHAR) END = CAST(p_partkey % 10 AS VARCHAR)
  THEN d[1:4] || '-' || d[5:8] || '-' || d[9:12] || '-' || d[13:15] || CAST(p_partkey % 10 AS VARCHAR) ELSE '' END AS orcid FROM s WHERE i = 15""")
def orcid_checksum(t):
    """ORCID check digits."""
    d = F.lpad((F.col("p_partkey") * 104729).cast("string"), 15, "0")
    text = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 4), F.lit("-"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 3), (F.col("p_partkey") % 10).cast("string"))
    return t("part").select("p_partkey", identifiers.valid_orcid(text).alias("orcid"))


@query("""
SELECT p_partkey, lower(p_name) AS doi, CASE WHEN p_partkey % 4 = 0 THEN 'missing' WHEN p_partkey % 4 = 1 THEN 'exact' WHEN p_partkey % 4 = 2 THEN 'ambiguous' ELSE 'differs' END AS agreement
FROM (SELECT p_partkey, '10.1234/part.' || p_partkey AS p_name FROM part)""")
def doi_agreement(t):
    """DOIs normalised and compared."""
    own = F.concat(F.lit("https://doi.org/10.1234/PART."), F.col("p_partkey").cast("string"))
    other = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.lower(own)).when(F.col("p_partkey") % 4 == 2, F.concat(own, F.lit("."))).otherwise(F.concat(own, F.lit("9")))
    return t("part").select("p_partkey", identifiers.normalized_doi(own).alias("doi"), identifiers.compare_doi(own, other).alias("agreement"))


@query("""SELECT p_partkey, '10.1234/a.' || p_partkey AS doi, CASE WHEN p_partkey % 2 = 0 THEN '10.1234/a.' || p_partkey END AS container FROM part""")
def doi_in_text(t):
    """DOIs found in texts and addresses, and the whole of a part."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("see https://x.org/10.1234/a."), key, F.lit(".pdf?x=1)."))
    part = F.concat(F.lit("10.1234/a."), key, F.when(F.col("p_partkey") % 2 == 0, "_ch3").otherwise("ch3"))
    return t("part").select("p_partkey", identifiers.doi_from_url(text).alias("doi"), identifiers.container_doi(part, F.concat(F.lit("10.1234/a."), key)).alias("container"))


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, round(2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)), 6) AS dice FROM
 (SELECT p_partkey, p_brand, p_size, list_distinct(list_transform(range(1, length(f)), lambda i: f[i:i + 1])) AS ga, f FROM (SELECT *, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS f FROM part)) a
JOIN (SELECT p_partkey, p_brand, p_size, list_distinct(list_transform(range(1, length(f)), lambda i: f[i:i + 1])) AS gb, f FROM (SELECT *, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS f FROM part)) b
ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def bigram_dice_parts(t):
    """Likeness of titles that share two keys (A18, J6's blocking)."""
    p = t("part").select("p_partkey", "p_brand", "p_size", titles.fold(F.col("p_name")).alias("f"))
    dressed = F.struct(F.col("f"), F.array_distinct(titles.bigrams(F.col("f"))).alias("grams"))
    dice = lambda x, y: F.when(x["f"] == y["f"], 1.0).otherwise(titles.gram_dice(x["grams"], y["grams"]))
    return joins.class_pairs(p, ["p_brand", "p_size"], "f", "p_partkey", dressed, dice).select("a", "b", F.round("score", 6).alias("dice"))


@query("""
WITH g AS (SELECT n_nationkey, n_regionkey, unnest(list_transform(range(1, length(n_name)), lambda i: n_name[i:i + 1])) AS gram FROM nation),
c AS (SELECT n_nationkey, n_regionkey, gram, count(*) AS n FROM g GROUP BY 1, 2, 3), s AS (SELECT n_nationkey, sum(n) AS total FROM c GROUP BY 1)
SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2.0 * coalesce((SELECT sum(least(x.n, y.n)) FROM c x JOIN c y ON x.gram = y.gram WHERE x.n_nationkey = a.n_nationkey AND y.n_nationkey = b.n_nationkey), 0) / (sa.total + sb.total), 6) AS dice
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN s sa ON sa.n_nationkey = a.n_nationkey JOIN s sb ON sb.n_nationkey = b.n_nationkey""")
def bigram_dice_multiset(t):
    """Likeness that counts repeats."""
    n = t("nation").select("n_nationkey", "n_regionkey", "n_name")
    m = n.select(F.col("n_nationkey").alias("b"), "n_regionkey", F.col("n_name").alias("other"))
    met = n.withColumnRenamed("n_nationkey", "a").join(m, "n_regionkey").where("a < b")
    return met.select("a", "b", F.round(titles.bag_dice(F.col("n_name"), F.col("other")), 6).alias("dice"))


@query("""
SELECT page_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, h)) / len(w)::DOUBLE END, 6) AS overlap FROM (
  SELECT page_id, list_filter(list_distinct(regexp_split_to_array(lower(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '[^\\p{L}\\p{N}]+')), lambda x: length(x) >= 2) AS w,
    list_filter(list_distinct(regexp_split_to_array(lower(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '[^\\p{L}\\p{N}]+')), lambda x: length(x) >= 2) AS h FROM pages)""")
def token_overlap_pages(t):
    """The share of one text's words that another has."""
    heading = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return t("pages").select("page_id", F.round(titles.token_overlap(web.page_title(F.col("html")), heading), 6).alias("overlap"))


@query("""
SELECT c_custkey, levenshtein(c_name, 'Customer#000000500') AS edits, CASE WHEN levenshtein(c_name, 'Customer#000000500') <= 2 THEN levenshtein(c_name, 'Customer#000000500') ELSE 0 END AS within FROM customer""")
def edit_distances(t):
    """Edit distance, whole and bounded."""
    other = F.lit("Customer#000000500")
    return t("customer").select("c_custkey", F.levenshtein("c_name", other).cast("long").alias("edits"), titles.within_edits(F.col("c_name"), other).cast("long").alias("within"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript>', ' ', 'g'),
    '(?i)<(?:br|p|div|li|tr|td|th|h[1-6]|dt|dd|section|article)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)), '&ndash;', '–'), '&copy;', '©'), '&amp;', '&'),
  '[ \\t\\x{A0}]+', ' ', 'g'), '[ \\t\\r\\n]*\\n[ \\t\\r\\n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM pages""")
def page_visible_text(t):
    """What a reader sees of a page."""
    return t("pages").select("page_id", web.visible_text(F.col("html")).alias("text"))


@query("""SELECT regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':\\d*$', '') AS host, count(*) AS n FROM pages GROUP BY 1""")
def page_host_counts(t):
    """Pages by host."""
    return t("pages").groupBy(web.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'A long title ' || page_id ELSE '' END AS title FROM pages""")
def page_slug_title(t):
    """A title from an address."""
    last = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/x/a-long_title-"), F.col("page_id").cast("string"), F.lit(".html?q=1"))).otherwise("/two-words")
    return t("pages").select("page_id", web.title_from_slug(F.concat(F.lit("https://example.org"), last)).alias("title"))


@query("""
SELECT page_id, NOT (page_id % 6 IN (1, 2, 3, 4)) AS public, page_id % 6 <> 4 AS external FROM pages""")
def url_guards(t):
    """Addresses that may be asked, and that may be shown."""
    hosts = ("http://127.0.0.1/", "http://192.168.1.9/x", "http://[::1]/", "ftp://example.org/")
    bad = F.lit(None).cast("string")
    for i, h in enumerate(hosts, 1):
        bad = F.when(F.col("page_id") % 6 == i, h).otherwise(bad)
    url = F.coalesce(bad, F.col("url"))
    return t("pages").select("page_id", web.is_public_url(url).alias("public"), web.is_external_url(url).alias("external"))


@query("""
SELECT page_id, url || '?a=1&' || CASE page_id % 9 WHEN 0 THEN 'key=***' WHEN 1 THEN 'apikey=***' WHEN 2 THEN 'API_KEY=***' WHEN 3 THEN 'token=***' WHEN 4 THEN 'access_token=***&client_secret=***' WHEN 5 THEN 'client_secret=***' WHEN 6 THEN 'ttbkey=***' WHEN 7 THEN 'cert_key=***'
  ELSE 'mytoken=s' || page_id || '&keys=1' END || '&x=1#key=9' AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)""")
def redacted_urls(t):
    """Secrets in addresses masked, whatever their parameter is called."""
    secret = F.concat(F.lit("s"), F.col("page_id").cast("string"))
    names = [F.concat(F.lit(f"{n}="), secret) for n in ("key", "apikey", "API_KEY", "token")]
    both = F.concat(F.lit("access_token="), secret, F.lit("&client_secret="), secret)
    names += [both, *(F.concat(F.lit(f"{n}="), secret) for n in ("client_secret", "ttbkey", "cert_key")), F.concat(F.lit("mytoken="), secret, F.lit("&keys=1"))]
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?a=1&"), F.get(F.array(*names), (F.col("page_id") % 9).cast("int")), F.lit("&x=1#key=9"))
    return t("pages").select("page_id", web.redact_url(url).alias("url"))


@query("""
SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS links, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
  array_to_string(list_transform(regexp_extract_all(html, '(?i)<meta\\s+[^>]*?(?:name|property)=["'']([^"'']+)["'']', 1), lambda x: lower(x)), ',') AS metas FROM pages""")
def page_parts(t):
    """Title, links and meta names of pages."""
    html = F.col("html")
    return t("pages").select("page_id", F.size(web.links(html)).cast("long").alias("links"), web.page_title(html).alias("title"), F.array_join(web.meta_tags(html), ",").alias("metas"))


def _held(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p.lower()}')" for p in phrases) + ")"


@query(f"""
WITH p AS (SELECT page_id, html, lower(html[1:20000]) AS head, page_id % 12 AS k FROM pages),
x AS (SELECT *, CASE WHEN k = 8 THEN replace(head, '<title>', '<title>just a moment ') WHEN k = 9 THEN head || 'unusual traffic' WHEN k = 10 THEN head || 'captcha citation_title' ELSE head END AS h FROM p)
SELECT page_id, CASE WHEN k = 0 THEN 'timeout' WHEN k = 1 THEN 'authRequired' WHEN k = 2 THEN 'rateLimited' WHEN k = 3 THEN 'noMatch' WHEN k = 4 THEN 'serverError' WHEN k = 5 THEN 'rejected' WHEN k = 6 THEN 'authRequired' WHEN k = 7 THEN 'parseError'
  WHEN {_held("h", web.CHALLENGES)} AND NOT {_held("h", web.RECORD_SIGNS)} THEN 'blocked' ELSE 'record' END AS kind FROM x""")
def fetch_outcomes(t):
    """The kind of a request's outcome."""
    k, html = F.col("page_id") % 12, F.lower(F.left("html", F.lit(20000)))
    status = F.when(k == 1, 401).when(k == 2, 429).when(k == 3, 404).when(k == 4, 503).when(k == 5, 301).otherwise(200)
    body = (
        F.when(k == 6, "<html><title>Member Login</title><form><input name=p type='password'></form>").when(k == 7, "plain words, no page")
        .when(k == 8, F.replace(html, F.lit("<title>"), F.lit("<title>just a moment "))).when(k == 9, F.concat(F.lit("<html>unusual traffic"), html)).when(k == 10, F.concat(F.lit("captcha citation_title"), html)).otherwise(F.col("html"))
    )
    return t("pages").select("page_id", web.fetch_kind(status, body, k == 0).alias("kind"))


#: Ways of writing a date, by Spark's patterns, and the precision that they have; those without one are no dates.
WAYS = (
    ("yyyy/M/d", "day"), ("yyyy", "year"), ("M/yyyy", "month"), ("MMMM d, yyyy", "day"), ("d MMM. yyyy", "day"), ("yyyy년 M월 d일", "day"), ("yyyy年M月", "month"), ("yyyy年", "year"), ("yyyy.MM.", "month"), ("d'th' MMMM yyyy", "day"),
    ("MMMM yyyy", "month"), ("M월 d, yyyy", "day"), ("'Decade' d, yyyy", None), ("'Maybe' d, yyyy", None), ("yyyy-MM-dd-1", None), ("yyyy MMMM d", None),
)
#: Names of months in other languages that a date takes by its month.
OTHER_MONTHS = ("Januar", "février", "März", "abril", "Mai", "giugno", "juillet", "agosto", "setembro", "Oktober", "noviembre", "dicembre")


@query(f"""
WITH w AS (SELECT o_orderkey, o_orderdate, {[p or 'none' for _, p in WAYS] + ['day', 'month', 'none']}[o_orderkey % {len(WAYS) + 3} + 1] AS p FROM orders)
SELECT o_orderkey, CASE p WHEN 'day' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'month' THEN strftime(o_orderdate, '%Y-%m') WHEN 'year' THEN strftime(o_orderdate, '%Y') END AS date, CASE WHEN p <> 'none' THEN p END AS precision FROM w""")
def canonical_dates(t):
    """Dates as precise as stated, in many ways of writing."""
    k, d = F.col("o_orderkey") % (len(WAYS) + 3), F.col("o_orderdate")
    text = F.lit(None).cast("string")
    for i, (way, _) in enumerate(WAYS):
        text = F.when(k == i, F.date_format(d, way)).otherwise(text)
    month = F.get(F.array(*map(F.lit, OTHER_MONTHS)), F.month(d) - 1)
    text = F.when(k == len(WAYS), F.concat(F.dayofmonth(d), F.lit(". de "), month, F.lit(" de "), F.year(d))).when(k == len(WAYS) + 1, F.concat_ws(" ", month, F.year(d))).otherwise(text)
    text = F.when(k == len(WAYS) + 2, F.concat(F.year(d), F.lit("-"), F.month(d), F.lit("-31-02"))).otherwise(text)
    date = dates.canonical_date(text)
    return t("orders").select("o_orderkey", date.alias("date"), dates.precision(date).alias("precision"))


@query("""
SELECT o_orderkey, o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND month(o_orderdate) = month(o_orderdate + INTERVAL 1 DAY)) AS same FROM orders""")
def same_dates(t):
    """Dates that are equal at equal precision, however they are written."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    a = F.when(k == 0, F.date_format(d, "d MMMM yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy"))
    b = F.when(k == 0, F.date_format(d, "yyyy.M.d.")).when(k == 1, F.date_format(F.date_add(d, 1), "MMMM yyyy")).otherwise(F.date_format(d, "yyyy-MM"))
    return t("orders").select("o_orderkey", dates.same_date(a, b).alias("same"))


@query("""
SELECT o_orderkey, try_cast(printf('%04d-%02d-%02d', 1990 + o_orderkey % 30, o_orderkey % 14, o_orderkey % 33) AS DATE) IS NOT NULL AS real FROM orders""")
def real_dates(t):
    """Whether the calendar has a day."""
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", dates.is_real_date(1990 + k % 30, k % 14, k % 33).alias("real"))


@query("""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'published' WHEN event_type = 'purchase' THEN 'online' ELSE 'record' END AS role FROM events""")
def date_roles(t):
    """What a date is of."""
    role = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).when(F.col("event_type") == "purchase", "Published online").otherwise("created")
    return t("events").select("event_id", dates.date_role(role).alias("role"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AS coarser FROM orders""")
def coarser_dates(t):
    """New dates that say less than the old, or add January 1st."""
    k = F.col("o_orderkey") % 3
    new = F.when(k == 0, "2019").when(k == 1, "2019-01-01").otherwise("2020-05")
    return t("orders").select("o_orderkey", dates.coarser_or_default(F.lit("2019-03"), new).alias("coarser"))


@query("""
SELECT c_custkey, trim(regexp_replace(c_name, '#', ' ')) AS core, c_custkey % 5 = 0 AS placeholder, c_custkey % 5 IN (0, 1) AS file_like FROM customer""")
def title_rules(t):
    """Titles without notes, and titles that name nothing."""
    k = F.col("c_custkey") % 5
    plain = F.regexp_replace("c_name", "#", " ")
    noted = F.concat(plain, F.lit(" (2nd edition)"))
    odd = F.when(k == 0, F.concat(plain, F.lit(".pdf"))).when(k == 1, "full text").otherwise(plain)
    placeholder = titles.is_placeholder(odd) & (k != 1)
    return t("customer").select("c_custkey", titles.title_core(noted).alias("core"), placeholder.alias("placeholder"), titles.is_file_like(odd).alias("file_like"))


@query("""
SELECT doc_id, CAST(contains(lower(text), 'the') AND contains(lower(text), 'thing') AS BOOLEAN) AS found FROM documents""")
def list_search(t):
    """All words of a query in a text."""
    return t("documents").select("doc_id", titles.matches_query("The  THING", F.col("text")).alias("found"))


@query("""SELECT o_custkey, string_agg(o_orderstatus, '; ' ORDER BY o_orderkey) AS names, count(*) AS n FROM orders GROUP BY 1""")
def creators_text(t):
    """A list as text and back."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]), "; ")
    rows = t("orders").groupBy("o_custkey").agg(text.alias("names"))
    return rows.withColumn("n", F.size(F.split("names", "; ")).cast("long"))


@query("""SELECT c_custkey, sha256('[{"key":"a","value":"' || c_mktsegment || '"},{"key":"b","value":"' || c_name || '"}]') AS print FROM customer""")
def record_fingerprints(t):
    """Digests of records whatever their order."""
    from quire.sources.sinks import fingerprint

    fields = F.create_map(F.lit("b"), F.col("c_name"), F.lit("a"), F.col("c_mktsegment"))
    return t("customer").select("c_custkey", fields.alias("fields")).select("c_custkey", fingerprint().alias("print"))


@query("""SELECT c_custkey, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS rounded FROM customer""")
def rounded_half_up(t):
    """Rounding with halves upward."""
    return t("customer").select("c_custkey", half_up(F.col("c_acctbal")).cast("long").alias("rounded"))


@query("""
SELECT a.s_suppkey AS a, b.s_suppkey AS b, CASE WHEN least(len(la), len(lb)) = 0 THEN NULL ELSE round(len(list_intersect(la, lb)) / greatest(len(la), len(lb))::DOUBLE, 6) END AS overlap FROM
 (SELECT s_suppkey, s_nationkey, list_distinct(string_split(lower(s_name), '0')) AS la FROM supplier) a JOIN (SELECT s_suppkey, s_nationkey, list_distinct(string_split(lower(s_name), '0')) AS lb FROM supplier) b
ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def author_overlaps(t):
    """Shared names over the longer list."""
    from quire.functions.decisions import author_overlap

    s = t("supplier").select("s_suppkey", "s_nationkey", F.split(F.lower("s_name"), "0").alias("names"))
    return joins.class_pairs(s, ["s_nationkey"], "names", "s_suppkey", F.array_distinct("names"), author_overlap).select("a", "b", F.round("score", 6).alias("overlap"))


@query("""
WITH c AS (SELECT l_orderkey, v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM (SELECT l_orderkey, 0 AS side, l_returnflag AS v FROM lineitem UNION ALL SELECT l_orderkey, 1, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE l_linestatus END FROM lineitem WHERE l_linenumber > 1) GROUP BY 1, 2)
SELECT l_orderkey, sum(b) > 0 AND sum(least(a, b)) / greatest(sum(a), sum(b)) < 0.5 AS differ FROM c GROUP BY 1 HAVING sum(a) > 0""")
def creators_differ(t):
    """Matching of two lists, each name used once: equal names share as bags do."""
    status = F.when(F.col("l_linestatus") == "F", "A").otherwise(F.col("l_linestatus"))
    listed = lambda c, n: F.transform(F.array_sort(F.collect_list(F.when(c, n))), lambda x: x["v"])
    by = t("lineitem").groupBy("l_orderkey").agg(
        listed(F.lit(True), F.struct("l_linenumber", F.col("l_returnflag").alias("v"))).alias("stored"), listed(F.col("l_linenumber") > 1, F.struct("l_linenumber", status.alias("v"))).alias("read")
    )
    return by.select("l_orderkey", joins.creators_differ(F.col("stored"), F.col("read")).alias("differ"))


@query("""SELECT doc_id, sha256(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}]+', '', 'g')) AS folded FROM documents""")
def folded_names(t):
    """Letters without marks; the SQL holds for texts of Latin letters."""
    return t("documents").select("doc_id", F.sha2(titles.folded_letters(F.col("text")), 256).alias("folded"))


@query("""
WITH p AS (SELECT conv_id, turn, word, s, s + length(word) AS e FROM (
  SELECT conv_id, turn, word, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(word)) = word)) AS s
  FROM conversations CROSS JOIN (VALUES ('the'), ('and'), ('thing')) AS v(word)))
SELECT conv_id, turn, max(n) AS covered, max(n) >= 2.55 AS supported FROM (
  SELECT a.conv_id, a.turn, a.e, count(DISTINCT b.word) AS n FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.e BETWEEN a.e - 83 AND a.e AND b.s >= a.e - 83 GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def span_cover_all_hits(t):
    """Whether any stretch of a text holds enough of some words."""
    hit = lambda w: F.transform(windows.hits(F.col("text"), w), lambda s: F.struct(F.lit(w).alias("word"), s.alias("s")))
    found = t("conversations").select("conv_id", "turn", F.inline(F.concat(hit("the"), hit("and"), hit("thing"))))
    return windows.span_cover(found.withColumn("e", F.col("s") + F.char_length("word")), ["conv_id", "turn"], "s", "e", "word", 3).select("conv_id", "turn", F.col("covered").cast("long").alias("covered"), "supported")


@query("""SELECT b.item_id, count(d.doc_id) AS documents FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def benchmark_containment(t):
    """Which texts occur whole in which documents (J12, C14): blocked by an item's longest inner word, then compared; items without one are compared with all."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    # An item's first and last words may be parts of a document's; one within is whole there too.
    inner = F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 2, F.greatest(F.lit(0), F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    items = t("benchmark").select("item_id", F.col("text").alias("wanted"), longest.alias("word"))
    # Words go without their text; it comes back once for each document that has candidates.
    docs = t("documents").select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    found = docs.join(joins.small(items), "word").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("item_id", "wanted")).alias("items"))
    texts = t("documents").select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("id")))
    blocked = texts.select(F.inline(F.filter("items", lambda x: F.contains(F.col("text"), x["wanted"])))).select("item_id")
    loose = joins.small(items.where("word IS NULL AND wanted IS NOT NULL").select("item_id", "wanted"))
    whole = t("documents").select("text").join(loose, F.contains("text", F.col("wanted"))).select("item_id")
    met = blocked.unionAll(whole).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return t("benchmark").select("item_id").join(met, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))
