"""What texts state, and names across scripts, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names, readings
from quire.operators import joins
from quire.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
INITIALS, MEDIALS, FINALS = (str(list(x)) for x in (names.INITIALS, names.MEDIALS, names.FINALS))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 900 + 100 AS VARCHAR) AS s, CAST(l_linenumber * 13 AS VARCHAR) AS e FROM lineitem),
y AS (SELECT *, s[1:greatest(0, length(s) - length(e))] || e AS full_end FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN CAST(e AS INT) > CAST(s AS INT) THEN s || '-' || e WHEN length(e) < length(s) AND CAST(full_end AS INT) > CAST(s AS INT) THEN s || '-' || full_end ELSE '' END AS range FROM y""")
def page_ranges(t):
    """Ranges with abbreviated ends written out."""
    text = F.concat(F.lit("pp. "), (F.col("l_orderkey") % 900 + 100).cast("string"), F.lit("–"), (F.col("l_linenumber") * 13).cast("string"), F.lit(" of it"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.get(readings.page_ranges(text), 0), F.lit("")).alias("range"))


@query("""
WITH o AS (SELECT p_partkey, p_size, [CAST(p_size AS VARCHAR), '00' || p_size, CAST(p_size + 1 AS VARCHAR), '', p_size || '–' || (p_size + 3), CAST(p_partkey % 60 AS VARCHAR)][p_partkey % 6 + 1] AS other FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_size AS VARCHAR) END AS volume, CASE WHEN p_partkey % 4 <> 2 THEN CAST(p_partkey % 9 AS VARCHAR) END AS issue,
  other = '' OR regexp_replace(other, '^0+', '') = CAST(p_size AS VARCHAR) OR (p_size = 0 AND regexp_matches(other, '^0+$')) AS agree FROM o""")
def volume_and_issue(t):
    """Volumes and issues that a text states, and whether locators agree."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    volume = F.when(k % 4 == 0, F.concat(F.lit("Vol. "), size)).when(k % 4 == 1, F.concat(F.lit("VOLUME: "), size)).when(k % 4 == 2, F.concat(F.lit("vol "), size)).otherwise(F.concat(F.lit("pages "), size))
    issue = F.when(k % 4 == 0, F.lit("No. ")).when(k % 4 == 1, F.lit("issue ")).when(k % 4 == 2, F.lit("part ")).otherwise(F.lit("Number "))
    text = F.concat(F.lit("Journal of Parts, "), volume, F.lit(", "), issue, (k % 9).cast("string"), F.lit(" (2019)"))
    other = F.get(F.array(size, F.concat(F.lit("00"), size), (F.col("p_size") + 1).cast("string"), F.lit(""), F.concat_ws("–", F.col("p_size"), F.col("p_size") + 3), (k % 60).cast("string")), (k % 6).cast("int"))
    return t("part").select("p_partkey", F.get(readings.volumes(text), 0).alias("volume"), F.get(readings.issues(text), 0).alias("issue"), readings.same_locator(size, other).alias("agree"))


ORDINAL_LIST = str(list(readings.ORDINALS))


@query(f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(1 + p_partkey % 10 AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN '' ELSE CAST(p_size AS VARCHAR) || lower(p_type) END AS edition FROM part""")
def edition_keys(t):
    """Editions for comparison, by number or by their own words."""
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    word = F.initcap(F.get(F.array(*map(F.lit, readings.ORDINALS)), (F.col("p_partkey") % 10).cast("int")))
    text = (
        F.when(k == 0, F.concat(word, F.lit(" Edition"))).when(k == 1, F.concat(size, F.lit("th revised ed."))).when(k == 2, F.concat(F.col("p_name"), F.lit(" edn")))
        .when(k == 3, F.concat(F.lit("제"), size, F.lit("판"))).when(k == 4, F.lit(" Rev. ed. ")).otherwise(F.concat(size, F.lit("nd "), F.col("p_type"), F.lit(" edition")))
    )
    return t("part").select("p_partkey", readings.edition_key(text).alias("edition"))


@query("""SELECT doc_id, lang AS code FROM documents""")
def language_codes(t):
    """Codes of languages and locales."""
    table = F.create_map(*(F.lit(x) for p in (("en", "English"), ("fr", "fre"), ("de", "de-AT"), ("es", "ES_mx")) for x in p))
    return t("documents").select("doc_id", readings.language_code(table[F.col("lang")]).alias("code"))


@query("""
SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_suppkey = b.s_suppkey AND b.s_suppkey % 7 < 6 AS same FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey""")
def publisher_equality(t):
    """Publishers equal but for legal forms, among those of one country."""
    key = F.col("s_suppkey").cast("string")
    forms = ["{} Publishing Ltd.", "THE {} PRESS", "{}, Inc.", "{} GmbH & Co.", "{} (Group) Publishers", "{} Verlag Haus", "Other {} Books"]
    house = lambda k: F.get(F.array(*(F.concat(F.lit(f.split("{}")[0] + "House"), F.lpad(key, 6, "0"), F.lit(f.split("{}")[1])) for f in forms)), (k % 7).cast("int"))
    # Houses are read row by row, their pairs only compare what was read.
    own = F.concat(F.lit("House"), F.lpad(key, 6, "0"), F.lit(" Limited"))
    side = lambda name, value, as_: t("supplier").select("s_nationkey", F.col("s_suppkey").alias(name), readings.publisher_traits(value).alias(as_))
    met = joins.dealt_join(side("a", own, "own"), side("b", house(F.col("s_suppkey")), "theirs"), ["s_nationkey"])
    return met.select("a", "b", readings.equal_publishers(F.col("own"), F.col("theirs")).alias("same"))


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'url' WHEN 1 THEN 'doi' WHEN 2 THEN 'doi' WHEN 3 THEN CASE WHEN (10 - (9 * 1 + 7 * 3 + 8 * 1 + list_sum(list_transform(range(1, 10), lambda i: CAST(d[i:i] AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))) % 10) % 10 = page_id % 10 THEN 'isbn' END WHEN 4 THEN 'url' END AS kind,
  CASE page_id % 6 WHEN 0 THEN NOT regexp_matches(url, '^https?://[^/?#]+/?([?#]|$)') AND NOT regexp_matches(lower(url), '^https?://[^/?#]+[^?#]*/search([^a-z0-9_]|$)') AND NOT regexp_matches(lower(url), '[?&](q|query|keyword|search|s)=') WHEN 2 THEN true ELSE false END AS report
FROM (SELECT *, lpad(CAST(page_id % 1000000000 AS VARCHAR), 9, '0') AS d FROM pages)""")
def reference_kinds(t):
    """What a pasted reference is, and whether an address is of a page of its own."""
    k, key = F.col("page_id") % 6, F.col("page_id").cast("string")
    isbn = F.concat(F.lit("ISBN-13: 978"), F.lpad((F.col("page_id") % 1_000_000_000).cast("string"), 9, "0"), (F.col("page_id") % 10).cast("string"))
    text = (
        F.when(k == 0, F.concat(F.lit(" "), F.col("url"))).when(k == 1, F.concat(F.lit("doi:10.1234/"), key, F.lit("."))).when(k == 2, F.concat(F.lit("https://doi.org/10.1234/x"), key))
        .when(k == 3, isbn).when(k == 4, F.concat(F.lit("example.org/"))).otherwise(F.concat(F.lit("note "), key))
    )
    return t("pages").select("page_id", readings.reference_kind(text).alias("kind"), F.coalesce(text.rlike("^ ?http") & readings.is_report_url(text), F.lit(False)).alias("report"))


@query("""SELECT c_custkey, c_mktsegment AS value, 'Note: x' || chr(10) || 'Segment: new' AS changed FROM customer""")
def extra_lines(t):
    """Labelled lines in free text read and written."""
    extra = F.concat(F.lit("Note: x\nsegment: "), F.col("c_mktsegment"), F.lit("\n\n"))
    return t("customer").select("c_custkey", readings.extra_line(extra, "Segment").alias("value"), readings.with_extra_line(extra, "Segment", F.lit("new")).alias("changed"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'preprint' WHEN o_orderkey % 3 = 0 THEN 'versionOfRecord' ELSE 'unknown' END AS stage FROM orders""")
def registry_records(t):
    """Dates and stages of a registry's JSON records."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    parts = F.when(k % 3 == 0, F.array(F.year(d))).when(k % 3 == 1, F.array(F.year(d), F.month(d))).otherwise(F.array(F.year(d), F.month(d), F.day(d)))
    kind = F.when(k % 2 == 0, "posted-content").otherwise("journal-article")
    message = F.to_json(F.struct(kind.alias("type"), F.when(k % 3 == 0, "12").alias("volume"), F.struct(F.array(parts).alias("date-parts")).alias("issued")))
    rows = t("orders").select("o_orderkey", message.alias("m"))
    return rows.select("o_orderkey", readings.registry_date(F.col("m")).alias("date"), readings.registry_stage(F.col("m")).alias("stage"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Linked ' || page_id WHEN page_id % 3 = 1 THEN 'Cited ' || page_id ELSE trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) END AS title, CASE WHEN page_id % 3 = 0 THEN '2019-05-01' WHEN page_id % 3 = 1 THEN '2020' END AS date FROM pages""")
def page_citations(t):
    """Title and date of a page by the first reader that has them."""
    k, key = F.col("page_id") % 3, F.col("page_id").cast("string")
    linked = F.concat(F.lit('<script type="application/ld+json">{"@type": "Article", "headline": "Linked '), key, F.lit('", "datePublished": "2019-05-01"}</script>'))
    cited = F.concat(F.lit('<meta content="Cited '), key, F.lit('" name="citation_title"><meta name="citation_date" content="2020">'))
    html = F.when(k == 0, F.concat(linked, "html")).when(k == 1, F.concat(cited, "html")).otherwise(F.col("html"))
    got = t("pages").select("page_id", readings.page_citation(html).alias("c"))
    return got.select("page_id", "c.title", "c.date")


@query(f"""
WITH s AS (SELECT p_partkey, [44032 + (p_partkey * 37) % 11172, 44032 + (p_partkey * 101) % 11172] AS codes FROM part)
SELECT p_partkey, array_to_string(list_transform(codes, lambda c: {INITIALS}[1 + (c - 44032) // 588] || {MEDIALS}[1 + (c - 44032) % 588 // 28] || {FINALS}[1 + (c - 44032) % 28]), '') || 'x' AS latin,
  CAST((codes[1] - 44032) // 588 AS INT) AS initial FROM s""")
def romanised(t):
    """Syllables in Latin letters, and their parts."""
    def syllable(code):
        byte = lambda c: F.hex(c)
        return F.decode(F.unhex(F.concat(byte(0xE0 + F.shiftright(code, 12)), byte(0x80 + F.shiftright(code, 6).bitwiseAND(63)), byte(0x80 + code.bitwiseAND(63)))), "UTF-8")

    a, b = (44032 + (F.col("p_partkey") * m) % 11172 for m in (37, 101))
    text = F.concat(syllable(a), syllable(b), F.lit("X"))
    return t("part").select("p_partkey", names.romanise(text).alias("latin"), names.jamo(F.left(text, F.lit(1)))["initial"].alias("initial"))


@query(f"""
WITH s AS (SELECT c, {INITIALS}[1 + c // 588] || {MEDIALS}[1 + c % 588 // 28] || {FINALS}[1 + c % 28] AS latin FROM range(11172) r(c))
SELECT latin, count(*) AS n, min(chr(CAST(44032 + c AS INT))) AS first FROM s GROUP BY 1""")
def syllable_index(t):
    """Each spelling with its syllables."""
    rows = names.syllables_by_spelling(t("nation").sparkSession)
    return rows.select("latin", F.size("syllables").cast("long").alias("n"), F.get("syllables", 0).alias("first"))


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'same' WHEN 1 THEN 'initials' WHEN 2 THEN 'swapped' WHEN 3 THEN 'otherScript' WHEN 4 THEN 'surnameOnly' ELSE 'different' END AS relation, 'Adams' || c_custkey AS last FROM customer""")
def name_relations(t):
    """How names agree."""
    k, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    own = F.concat(F.lit("Mary Jane Adams"), key)
    a = names.person_parts(own)
    pair = lambda last, first: F.struct(last.alias("last"), first.alias("first"))
    last = F.concat(F.lit("Adams"), key)
    b = (
        F.when(k == 0, pair(last, F.lit("Mary Jane"))).when(k == 1, pair(last, F.lit("M. J."))).when(k == 2, pair(F.lit("Mary Jane"), last))
        .when(k == 3, pair(F.lit("김"), F.lit("민수"))).when(k == 4, pair(last, F.lit(""))).otherwise(pair(F.lit("Brown"), F.lit("Mary")))
    )
    left = F.when(k == 3, pair(F.lit("Kim"), F.lit("Minsu"))).otherwise(a)
    return t("customer").select("c_custkey", names.name_relation(left, b).alias("relation"), a["last"].alias("last"))


@query("""SELECT p_partkey, 1 AS n FROM part""")
def isbns_in_text(t):
    """ISBNs of a text, set apart by spaces too."""
    text = F.concat(F.lit("Printed as 978 0306 406157, and 0-306-40615-2; part "), F.col("p_partkey").cast("string"))
    return t("part").select("p_partkey", F.size(readings.isbns_in(text)).cast("int").alias("n"))


@query("""
SELECT p_partkey, '10.1234/a.' || p_partkey AS doi, CASE WHEN p_partkey % 2 = 0 THEN 'repaired' ELSE 'exact' END AS confidence, p_partkey % 3 = 0 AS cited FROM part""")
def scanned_identifiers(t):
    """Identifiers of a text with what is sure of them, as rows."""
    k = F.col("p_partkey")
    head = F.when(k % 3 == 0, "References\n").otherwise("Body\n")
    text = F.concat(head, F.lit("doi 10.1234/A."), k.cast("string"), F.when(k % 2 == 0, ".").otherwise(""), F.lit(" and ISSN 0378-5954"))
    rows = t("part").select("p_partkey", F.inline(readings.identifiers_in(text)))
    return rows.select("p_partkey", F.col("value").alias("doi"), "confidence", "cited")


@query("""SELECT p_partkey, 'US2019' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || 'A1,US9' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || 'B2' AS numbers FROM part""")
def patent_numbers(t):
    """Patent numbers that a text prints."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("Pub. No.: US 2019/"), F.lpad(key, 7, "0"), F.lit(" A1; see US 9,"), F.substring(F.lpad(key, 6, "0"), 1, 3), F.lit(","), F.substring(F.lpad(key, 6, "0"), 4, 3), F.lit(" B2"))
    return t("part").select("p_partkey", F.array_join(readings.us_patents(text), ",").alias("numbers"))


@query("""
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS front FROM conversations WHERE turn BETWEEN 1 AND 5 AND length(text) >= 40 GROUP BY 1""")
def usable_chunks(t):
    """Chunks of an index long enough and near the front, in order."""
    rows = t("conversations").where("turn between 1 and 5 and length(text) >= 40")
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("front"))
