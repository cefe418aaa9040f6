"""Decision lists over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import decisions
from quire.functions.basics import is_empty
from quire.operators import aggregates, joins
from quire.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


@query("""
SELECT kind, rank, count(*) AS n FROM (
  SELECT CASE WHEN k = 0 THEN 'applied' WHEN k = 1 THEN 'excluded' WHEN k = 2 THEN 'unread' WHEN k = 3 AND o_orderstatus = 'F' THEN 'stopped' WHEN k = 3 THEN 'pending'
    WHEN k = 4 THEN 'preprintKept' WHEN o_orderstatus = 'P' THEN 'identifier' WHEN k = 5 THEN 'webPage' WHEN k = 6 THEN 'catalogue' WHEN k = 7 THEN 'documentRead' ELSE 'none' END AS kind
  FROM (SELECT o_orderkey % 9 AS k, o_orderstatus FROM orders))
JOIN (VALUES ('pending', 0), ('stopped', 1), ('excluded', 2), ('unread', 3), ('documentRead', 6), ('none', 7), ('preprintKept', 8), ('catalogue', 11), ('webPage', 12), ('identifier', 13), ('applied', 14)) r(kind2, rank) ON kind2 = kind
GROUP BY 1, 2""")
def evidence_grade(t):
    """What each row rests on, in list order."""
    k = F.col("o_orderkey") % 9
    status = F.when(k == 0, "updated").when(k == 1, "excluded").when(k == 2, "textlessPDF").when(k == 3, "pending").when(k == 4, "protected").otherwise("review")
    error = F.when(F.col("o_orderstatus") == "F", "stopped by hand")
    provider = F.when(k == 5, "Google").when(k == 6, "registry")
    kind = decisions.evidence_grade(status, error, F.col("o_orderstatus") == "P", provider, F.lit(False), k == 7)
    return t("orders").select(kind.alias("kind")).select("kind", decisions.evidence_rank(F.col("kind")).alias("rank")).groupBy("kind", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT code, code IN ('chosen', 'approved', 'replacement', 'verified', 'selected') AS writable, count(*) AS n FROM (
  SELECT CASE WHEN l_linenumber = 7 THEN 'notSelected' WHEN l_quantity > 45 AND l_orderkey % 5 <> 0 THEN 'protected' WHEN l_tax > 0.07 THEN 'chosen' WHEN l_orderkey % 5 = 0 THEN 'approved'
    WHEN l_orderkey % 5 = 1 THEN 'approvalStale' WHEN l_discount = 0 AND l_returnflag = 'R' THEN 'replacement' WHEN l_discount = 0 THEN 'clearing' WHEN l_orderkey % 7 = 0 THEN 'typeFieldLoss'
    WHEN l_orderkey % 11 = 0 THEN 'advisedAgainst' WHEN l_linestatus = 'F' THEN 'verified' WHEN l_returnflag = 'A' THEN 'conflicting' ELSE 'selected' END AS code FROM lineitem) GROUP BY 1, 2""")
def eligibility_decision(t):
    """Under which code each change is written or refused."""
    key = F.col("l_orderkey")
    check = F.when(key % 5 == 0, "approved").when(key % 5 == 1, "valueChanged").otherwise("none")
    code = decisions.eligibility(
        F.col("l_linenumber") != 7, F.col("l_quantity") > 45, check, F.col("l_tax") > 0.07, F.col("l_discount") == 0, F.col("l_returnflag") == "R",
        key % 7 == 0, key % 11 == 0, F.col("l_linestatus") == "F", F.col("l_returnflag") == "A",
    )
    out = t("lineitem").select(code.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("writable", decisions.is_writable(F.col("code")))


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'none' WHEN l.quality <> 1 THEN 'valueChanged' WHEN d.lang <> 'en' THEN 'fileChanged' WHEN l.toxic <> 0 THEN 'identityChanged' ELSE 'approved' END AS check
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def approval_check(t):
    """The first respect in which an approval doesn't cover a change."""
    met = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    yes = F.lit(True)
    check = decisions.approval_check(F.col("quality").isNotNull(), F.col("quality") == 1, yes, F.col("lang") == "en", yes, F.col("toxic") == 0, yes)
    return met.select("doc_id", check.alias("check"))


@query("""
SELECT p_partkey, CASE WHEN total = 0 THEN NULL ELSE CAST(floor(got / total * 100 + 0.5) AS INT) END AS score FROM (
  SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 5 ELSE 0 END)::DOUBLE AS total,
    CASE WHEN p_size % 2 = 0 THEN 60 * (p_size / 50.0::DOUBLE) ELSE 0 END + CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 25.0 ELSE 0 END + CASE WHEN p_size % 5 = 0 AND p_partkey % 3 = 0 THEN 5.0 ELSE 0 END AS got FROM part)""")
def weighted_match_score(t):
    """A score from the evidence there is."""
    s, k = F.col("p_size"), F.col("p_partkey")
    title = F.when(s % 2 == 0, s / F.lit(50.0))
    doi = F.when(s % 3 == 0, (k % 2 == 0).cast("int"))
    year = F.when(s % 5 == 0, (k % 3 == 0).cast("int"))
    return t("part").select("p_partkey", decisions.match_score(title, doi, year, F.lit(None).cast("double")).alias("score"))


@query("""
SELECT c_custkey, CASE WHEN score >= 0.9 AND k = 0 THEN 'published-over-preprint' WHEN k <> 1 AND score < 0.65 THEN 'title-mismatch' WHEN k IN (2, 3) AND score < 0.85 THEN 'doi-title-conflict'
  WHEN k IN (2, 3) AND overlap < 0.5 THEN 'doi-author-conflict' WHEN score >= 0.95 AND overlap < 0.34 THEN 'same-title-author-conflict' END AS code
FROM (SELECT c_custkey, c_custkey % 6 AS k, (c_custkey % 101) / 100.0::DOUBLE AS score, (c_custkey % 7) / 7.0::DOUBLE AS overlap FROM customer)""")
def publication_safety(t):
    """Why a reading must not overwrite a record."""
    rows = t("customer").select("c_custkey", (F.col("c_custkey") % 6).alias("k"), (F.col("c_custkey") % 101 / F.lit(100.0)).alias("score"), (F.col("c_custkey") % 7 / F.lit(7.0)).alias("overlap"))
    k, no, yes = F.col("k"), F.lit(False), F.lit(True)
    code = decisions.publication_safety(F.col("score"), k == 0, yes, no, k == 1, no, k.isin(2, 3), yes, F.col("overlap"), no)
    return rows.select("c_custkey", code.alias("code"))


@query("""
SELECT o_orderkey, CASE WHEN k = 0 THEN CASE WHEN o_orderstatus = 'P' THEN 'protected' ELSE 'mismatch' END WHEN k = 1 THEN 'noChanges' WHEN k = 2 THEN 'review' WHEN k = 3 THEN 'ready' WHEN o_orderstatus = 'O' THEN 'review' ELSE 'ready' END AS status
FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderstatus FROM orders)""")
def row_status(t):
    """The status that a row gets."""
    k, s = F.col("o_orderkey") % 5, F.col("o_orderstatus")
    code = F.when(s == "P", "published-over-preprint").otherwise("title-mismatch")
    status = decisions.row_status(k == 0, code, F.when(k == 1, 0).otherwise(3), k == 2, k == 3, F.lit(False), s == "O")
    return t("orders").select("o_orderkey", status.alias("status"))


@query("""
SELECT o_orderkey, CASE WHEN open = 0 AND unverified = 0 AND o_orderkey % 2 = 0 THEN 'complete' WHEN o_orderkey % 3 = 0 AND open = 0 THEN 'identifierSettled' WHEN o_orderkey % 5 = 0 AND open = 0 AND unverified = 0 THEN 'linkedComplete' ELSE 'ask' END AS decision,
  CASE WHEN open = 0 THEN 'linked' WHEN unverified > 0 THEN 'held' WHEN o_orderkey % 2 = 0 THEN 'candidates' ELSE 'noRecord' END AS outcome
FROM (SELECT o_orderkey, count(*) FILTER (l_discount = 0) AS open, count(*) FILTER (l_returnflag = 'R') AS unverified FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def restore_gate(t):
    """Whether to search further, and what a phase gave."""
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_discount") == 0).alias("open"), F.count_if(F.col("l_returnflag") == "R").alias("unverified"))
    rows = rows.join(t("orders").select("o_orderkey"), "o_orderkey", "left_semi")
    key, yes = F.col("o_orderkey"), F.lit(True)
    gate = decisions.restore_gate(yes, key % 2 == 0, F.col("open"), F.col("unverified"), key % 3 == 0, key % 5 == 0)
    outcome = decisions.phase_outcome(yes, F.col("open") == 0, F.lit(False), F.col("unverified"), F.when(key % 2 == 0, 1).otherwise(0))
    return rows.select("o_orderkey", gate.alias("decision"), outcome.alias("outcome"))


_LINKS = """SELECT o_orderkey, ['article', 'book', 'report', 'thesis'][o_orderkey % 4 + 1] AS kind, o_custkey % 7 = 0 AS conflict, o_custkey % 5 = 0 AS soft, o_orderstatus = 'P' AS id, o_orderkey % 3 > 0 AS title, o_custkey % 3 > 0 AS authors,
  o_orderpriority = '1-URGENT' AS coordinates, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS year, o_orderkey % 11 < 5 AS published, o_orderkey % 13 < 7 AS line, o_custkey % 2 = 0 AS people, o_orderkey % 10 = 0 AS exact, o_custkey % 11 = 0 AS citation FROM orders"""
#: The same decision by what each outcome needs, not in the order of rules.
_EDITION = """(id AND NOT conflict AND NOT soft AND (title OR authors OR coordinates OR kind = 'book')) OR (NOT id AND coordinates AND (title OR authors))
  OR (NOT id AND NOT (coordinates AND (title OR authors)) AND NOT soft AND ((kind = 'book' AND title AND authors AND coalesce(year, false)) OR (kind = 'report' AND title AND authors AND coalesce(year, true)) OR (kind = 'thesis' AND title AND authors AND coalesce(year, true) AND NOT published)
    OR (NOT (kind = 'thesis' AND published AND title) AND ((kind <> 'book' AND line AND people AND exact AND NOT citation) OR (kind = 'article' AND title AND authors AND year IS NULL AND NOT citation)))))
  OR (id AND NOT conflict AND NOT soft AND NOT (title OR authors OR coordinates OR kind = 'book') AND kind <> 'book' AND line AND people AND exact AND NOT citation)"""


@query(f"""
SELECT o_orderkey, CASE WHEN conflict AND NOT id THEN 'conflict' WHEN {_EDITION} THEN 'sameEdition' WHEN (id AND (conflict OR soft)) OR (title AND (authors OR coalesce(year, false) OR soft OR (kind = 'thesis' AND published))) THEN 'sameWork' ELSE 'unknown' END AS relation FROM ({_LINKS})""")
def link_relation(t):
    """How records stand to documents, of all kinds."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    zero_one = lambda x: F.when(x, 1).otherwise(0)
    kind = F.get(F.array(*map(F.lit, ("article", "book", "report", "thesis"))), (k % 4).cast("int"))
    year = F.when(k % 5 == 0, True).when(k % 5 == 1, False)
    relation = decisions.link_relation(
        zero_one(c % 7 == 0), zero_one(c % 5 == 0), F.col("o_orderstatus") == "P", k % 3 > 0, c % 3 > 0, F.col("o_orderpriority") == "1-URGENT", year, kind, k % 11 < 5, k % 13 < 7, c % 2 == 0, k % 10 == 0, c % 11 == 0
    )
    return t("orders").select("o_orderkey", relation.alias("relation"))


@query("""
SELECT o_custkey, arg_min(o_orderkey, (a, b, c, d, o_orderkey)) AS record FROM (
  SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS a, -(o_orderkey % 4) AS b, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS c, o_orderkey % 5 AS d
  FROM orders WHERE o_orderstatus IN ('F', 'P')) GROUP BY o_custkey HAVING min(a) = 0""")
def citation_target(t):
    """The one record that a document is tied to."""
    k = F.col("o_orderkey")
    stage = F.when(k % 4 == 3, "versionOfRecord").when(k % 4 == 2, "acceptedManuscript").when(k % 4 == 1, "unknown").otherwise("preprint")
    linked = t("orders").select(
        "o_custkey", k.alias("record"), F.when(F.col("o_orderstatus") == "F", "sameEdition").when(F.col("o_orderstatus") == "P", "sameWork").otherwise("unknown").alias("relation"),
        stage.alias("stage"), (k % 3 == 0).alias("identifier_match"), F.lit("registry").alias("provider"), F.lit(True).alias("title_line"), (k % 5).alias("missing_people"),
        F.lit(True).alias("exact_year"), F.lit(1.0).alias("title_score"), F.lit(1).alias("n_evidence"),
    )
    return joins.choose_target(linked, "o_custkey").select("o_custkey", "record")


@query("""
SELECT l_orderkey, CASE WHEN l_orderkey % 13 = 0 THEN 'alreadyApplied' WHEN l_orderkey % 17 = 0 THEN 'staleRules' WHEN bool_or(l_linestatus = 'F') THEN NULL WHEN bool_or(l_returnflag = 'N' AND l_quantity > 45) THEN 'protected'
  WHEN bool_or(l_returnflag = 'N' AND l_discount = 0) THEN 'clearing' ELSE 'fieldsOff' END AS code FROM lineitem GROUP BY l_orderkey""")
def skip_codes(t):
    """Why a row has nothing to write."""
    refused = F.when(F.col("l_quantity") > 45, "protected").when(F.col("l_discount") == 0, "clearing").otherwise("notSelected")
    flagged = F.when(F.col("l_returnflag") == "N", refused).otherwise("notSelected")
    rows = t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("writable"), F.collect_set(flagged).alias("codes"), F.count(F.lit(1)).alias("n"))
    key = F.col("l_orderkey")
    code = decisions.skip_code(key % 13 == 0, F.col("n"), F.lit(True), key % 17 == 0, F.col("writable"), F.col("codes"), F.lit(False))
    return rows.select("l_orderkey", code.alias("code"))


@query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS external, count(*) FILTER (l_returnflag = 'R') AS page, count(*) FILTER (l_returnflag = 'N') AS unverified,
  CASE WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'needsChecking' WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'matchesRegistry' ELSE 'matchesDocument' END AS standing FROM lineitem GROUP BY 1""")
def row_standing(t):
    """Where a row's fields come from, and what that makes of it."""
    is_ = lambda f: F.count_if(F.col("l_returnflag") == f)
    rows = t("lineitem").groupBy("l_orderkey").agg(is_("A").alias("external"), is_("R").alias("page"), is_("N").alias("unverified"), F.count(F.lit(1)).alias("n"))
    zero, no = F.lit(0), F.lit(False)
    return rows.select("l_orderkey", "external", "page", "unverified", decisions.row_standing(no, F.col("n"), F.col("unverified"), F.col("external"), zero, no).alias("standing"))


TYPE_FIELDS = {"F": ("quantity", "tax"), "O": ("quantity",), "P": ("tax",)}


@query("""
SELECT o_orderkey, array_to_string(CASE o_orderstatus WHEN 'F' THEN ['quantity', 'tax'] WHEN 'O' THEN ['quantity'] ELSE ['tax'] END, ',') AS kept, CASE o_orderstatus WHEN 'F' THEN 'discount' WHEN 'O' THEN 'discount,tax' ELSE 'discount,quantity' END AS dropped FROM orders""")
def valid_fields(t):
    """Fields that a type has, and those it loses."""
    spark = t("orders").sparkSession
    valid = spark.createDataFrame([(k, list(v)) for k, v in TYPE_FIELDS.items()], "o_orderstatus string, valid array<string>")
    fields = F.array(*(F.lit(f) for f in ("discount", "quantity", "tax")))
    met = t("orders").select("o_orderkey", "o_orderstatus").join(F.broadcast(valid), "o_orderstatus")
    return met.select("o_orderkey", F.array_join(F.array_intersect(fields, "valid"), ",").alias("kept"), F.array_join(F.array_except(fields, "valid"), ",").alias("dropped"))


_FILES = """SELECT c_custkey AS item, o_orderkey AS file, CASE WHEN o_orderkey % 7 = 0 THEN 'Supplementary Information' WHEN o_orderkey % 7 = 1 THEN 'paper_SI.pdf' WHEN o_orderkey % 7 = 2 THEN 'appendix 2.pdf' ELSE 'Full text ' || o_orderkey || '.pdf' END AS label,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Supporting information for the paper' ELSE repeat('front matter ', 100) || 'supporting information' END AS front, o_orderkey % 4 > 0 AS present FROM customer LEFT JOIN orders ON o_custkey = c_custkey"""


@query(f"""
WITH f AS (SELECT *, regexp_matches(label, '(?i)supplement|supporting|appendix|(^|[^a-z])si([^a-z]|$)') AS by_label, regexp_matches(lower(front[1:1200]), 'supplementa|supporting information') AS by_text FROM ({_FILES})),
c AS (SELECT item, count(file) AS n, count(*) FILTER (file IS NOT NULL AND NOT by_label) AS main, count(*) FILTER (file IS NOT NULL AND NOT by_label AND NOT by_text) AS own, min(file) AS f0, min(file) FILTER (NOT by_label) AS f1, min(file) FILTER (NOT by_label AND NOT by_text) AS f2 FROM f GROUP BY 1),
p AS (SELECT *, CASE WHEN n = 1 THEN f0 WHEN main = 1 THEN f1 WHEN own = 1 THEN f2 END AS file FROM c)
SELECT item, CASE WHEN n = 0 THEN 'noPDF' WHEN p.file IS NULL THEN 'multiplePDFs' WHEN NOT f.present THEN 'missingFile' ELSE 'chosen' END AS choice, CASE WHEN f.present THEN p.file END AS file FROM p LEFT JOIN f USING (item, file)""")
def primary_file(t):
    """Which of several files is the main one: supplements go by their label, then by their front matter."""
    k = F.col("o_orderkey")
    label = F.when(k % 7 == 0, "Supplementary Information").when(k % 7 == 1, "paper_SI.pdf").when(k % 7 == 2, "appendix 2.pdf").otherwise(F.concat(F.lit("Full text "), k.cast("string"), F.lit(".pdf")))
    front = F.when(k % 5 == 0, "Supporting information for the paper").otherwise(F.concat(F.repeat(F.lit("front matter "), 100), F.lit("supporting information")))
    files = t("orders").select(F.col("o_custkey").alias("item"), k.alias("file"), label.alias("label"), front.alias("front"), (k % 4 > 0).alias("present"))
    return aggregates.primary_files(t("customer").select(F.col("c_custkey").alias("item")), files, "item", "file")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'edited' ELSE l_returnflag END AS value FROM lineitem WHERE l_linestatus <> 'F' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P')""")
def recommended_changes(t):
    """Changes without bookkeeping and what is advised against, with a person's value first."""
    rows = t("lineitem").where("l_linestatus <> 'F'").select("l_orderkey", "l_linenumber", "l_returnflag")
    advised = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    edit = F.when(F.col("l_linenumber") % 2 == 0, "edited")
    return rows.join(advised, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", F.coalesce(edit, F.col("l_returnflag")).alias("value"))


@query("""
SELECT doc_id, length(text) BETWEEN 4 AND 200 AND NOT regexp_matches(text, '[.] .*[.] ') AS askable, CASE WHEN text = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' ELSE 'present' END AS state FROM documents""")
def usable_queries(t):
    """Texts short enough to ask for, and states of texts."""
    n = F.char_length("text")
    state = F.when(is_empty(F.col("text")), "empty").when(F.col("n_chars") < 200, "short").otherwise("present")
    return t("documents").select("doc_id", (n.between(4, 200) & ~F.col("text").rlike("[.] .*[.] ")).alias("askable"), state.alias("state"))
