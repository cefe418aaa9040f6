"""Aggregations and audits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import titles
from quire.operators import aggregates
from quire.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
STATES = ("toxic", "good", "poor", "unlabelled")


@query("""
SELECT d.lang, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' ELSE 'unlabelled' END AS state, count(*) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2""")
def audit_document_states(t):
    """Documents by exclusive state."""
    met = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return met.groupBy("lang", _state().alias("state")).agg(F.count(F.lit(1)).alias("n"))


def _state():
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unlabelled")


@query("""
SELECT *, toxic + good + poor + unlabelled = total AS consistent FROM (
  SELECT count(*) FILTER (l.toxic = 1) AS toxic, count(*) FILTER (l.toxic = 0 AND quality = 1) AS good, count(*) FILTER (l.toxic = 0 AND quality = 0) AS poor,
    count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) AS total FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def audit_consistency(t):
    """Exclusive states must add up."""
    met = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return aggregates.state_counts(met, _state(), STATES)


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def count_by_key(t):
    """Counts by key, with exact distinct counts."""
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("""
SELECT count(*) AS rows, CAST(sum(lines) AS BIGINT) AS proposed, CAST(sum(returned) AS BIGINT) AS verified, CAST(sum(lines) FILTER (returned > 0) AS BIGINT) AS held FROM (
  SELECT o_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)""")
def operations_metrics(t):
    """Sums over rows and their changes."""
    by_row = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    met = t("orders").select("o_orderkey").join(by_row, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.agg(F.count(F.lit(1)).alias("rows"), F.sum("lines").alias("proposed"), F.sum("returned").alias("verified"), F.sum(F.when(F.col("returned") > 0, F.col("lines"))).alias("held"))


@query("""SELECT o_orderpriority AS field, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def field_kind_table(t):
    """Counts of kinds for each field."""
    rows = t("orders").select(F.col("o_orderpriority").alias("field"), "o_orderstatus")
    return aggregates.kind_table(rows, "field", "o_orderstatus", ("F", "O", "P"))


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS total FROM orders""")
def field_kind_totals(t):
    """Their totals (A10)."""
    rows = t("orders").select(F.col("o_orderpriority").alias("field"), "o_orderstatus")
    return aggregates.kind_totals(aggregates.kind_table(rows, "field", "o_orderstatus", ("F", "O", "P")), ("F", "O", "P"))


@query("""SELECT o_orderpriority AS field, o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def field_kind_rollup(t):
    """Both levels at once, by ROLLUP (an extra beyond A9 and A10)."""
    return t("orders").rollup(F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT ord AS place, code, n FROM (SELECT o_orderpriority AS code, count(*) AS n FROM orders GROUP BY 1)
JOIN (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW')) o(ord, c) ON c = code""")
def ordered_histogram(t):
    """A histogram in a fixed order of codes."""
    spark = t("orders").sparkSession
    order = spark.createDataFrame(list(enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))), "place int, code string")
    counts = t("orders").groupBy(F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(order), "code").select("place", "code", "n")


@query("""
SELECT user_id, CAST(sum(n) AS BIGINT) AS calls, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS outcomes FROM (
  SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def provider_outcome_summary(t):
    """Calls of each provider with a map of outcomes."""
    each = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["event_type"], p["n"])), ",")
    return each.groupBy("user_id").agg(F.sum("n").alias("calls"), text.alias("outcomes"))


@query("""
SELECT l_orderkey, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS weakest,
  CASE WHEN bool_and(l_linestatus = 'F') THEN 'all' WHEN bool_or(l_linestatus = 'F') THEN 'partial' ELSE 'none' END AS writable FROM lineitem GROUP BY 1""")
def completion_report(t):
    """The weakest part of each record, and whether all, some or none may be written."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    done = F.col("l_linestatus") == "F"
    writable = F.when(F.bool_and(done), "all").when(F.bool_or(done), "partial").otherwise("none")
    return t("lineitem").groupBy("l_orderkey").agg(F.min(rank).alias("weakest"), writable.alias("writable"))


@query("""SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last FROM events GROUP BY user_id""")
def latest_run(t):
    """The latest of some rows, by key."""
    return t("events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"))


@query("""SELECT event_type AS outcome, count(*) AS n, count(DISTINCT user_id) FILTER (value > 50) AS conflicts FROM events GROUP BY 1""")
def run_summary(t):
    """What a run did, by outcome."""
    return t("events").groupBy(F.col("event_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("conflicts"))


@query("""
WITH c AS (SELECT p_type AS kind, count(*) AS n FROM part GROUP BY 1), r AS (SELECT kind, n, row_number() OVER (ORDER BY n DESC, kind) AS k FROM c)
SELECT CASE WHEN k <= 3 THEN kind ELSE '(other)' END AS kind, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top_and_other(t):
    """The most frequent values, and all others as one."""
    return aggregates.top_and_other(t("part").select(F.col("p_type").alias("kind")), "kind", 3)


@query("""
SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang DESC) AS k FROM documents GROUP BY 1, 2) WHERE k = 1""")
def most_frequent_value(t):
    """The most frequent value of each key; the later of equals."""
    return aggregates.most_frequent(t("documents").select("source", "lang"), ["source"], "lang", F.col("lang").desc())


@query("""
SELECT doc_id, word, n FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS k FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents) GROUP BY 1, 2) WHERE k = 1""")
def mode_token_per_document(t):
    """Each document's most frequent word."""
    words = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return aggregates.most_frequent(words, ["doc_id"], "word")


@query("""
SELECT o_custkey, y, n FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, year(o_orderdate)) AS k FROM orders WHERE year(o_orderdate) BETWEEN 1400 AND 2100 GROUP BY 1, 2) WHERE k <= 4""")
def stated_years(t):
    """Up to four most stated years of those that a document can have."""
    y = F.year("o_orderdate")
    counts = t("orders").where(y.between(1400, 2100)).groupBy("o_custkey", y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("o_custkey").orderBy(F.col("n").desc(), "y")
    return counts.withColumn("k", F.row_number().over(w)).where("k <= 4").drop("k").select("o_custkey", F.col("y").cast("long").alias("y"), "n")


@query("""SELECT p_brand, quantile_disc(p_size, 0.5) FILTER (p_size > 0) AS median FROM part GROUP BY 1""")
def lower_median(t):
    """The lower median of positive values."""
    return t("part").groupBy("p_brand").agg(aggregates.lower_median("p_size").cast("int").alias("median"))


@query("""
WITH p AS (SELECT p_type AS doc, p_brand AS line, p_size AS page, min(p_partkey % 10) AS place FROM part GROUP BY 1, 2, 3),
m AS (SELECT doc, line, quantile_disc(place, 0.5) AS mid FROM p GROUP BY 1, 2)
SELECT doc, line, count(DISTINCT page) AS pages FROM p JOIN m USING (doc, line) WHERE abs(place - mid) <= 1 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2""")
def repeated_lines(t):
    """Lines at about the same place on several pages."""
    rows = t("part").select(F.col("p_type").alias("doc"), F.col("p_brand").alias("line"), F.col("p_size").alias("page"), (F.col("p_partkey") % 10).alias("at0"))
    return aggregates.repeated_lines(rows, "doc", "page", "line", "at0")


@query("""
WITH u AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY 1, 2)
SELECT p.p_brand, p.p_partkey, p.p_size FROM part p JOIN u ON u.p_brand = p.p_brand AND k = 1 WHERE abs(p.p_size - u.p_size) > 0.03 * u.p_size""")
def inserted_leaves(t):
    """Pages of another size than most."""
    rows = t("part").select("p_brand", "p_partkey", "p_size")
    return aggregates.inserted_leaves(rows, "p_brand", "p_partkey", "p_size")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey % 10 AS j, o_custkey % 7 AS v, o_orderpriority AS i, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END AS d FROM orders),
g AS (SELECT j, v, d[1:4] AS y, count(DISTINCT i) AS n, count(DISTINCT d[6:7]) AS m FROM r WHERE length(d) = 7 GROUP BY 1, 2, 3)
SELECT o_orderkey, CASE WHEN n >= 2 AND m = 1 AND length(d) = 7 THEN d[1:4] ELSE d END AS d FROM r LEFT JOIN g ON g.j = r.j AND g.v = r.v AND g.y = r.d[1:4]""")
def placeholder_months(t):
    """Months that a registry made up, cut to the year."""
    date = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    rows = t("orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("j"), (F.col("o_custkey") % 7).alias("v"), F.col("o_orderpriority").alias("i"), date.alias("d"))
    return aggregates.placeholder_months(rows, "j", "v", "i", "d").select("o_orderkey", "d")


SIGNALS = (("prose", 3, "the", 5), ("prose", 2, "and", 5), ("list", 4, r"\|", 4), ("code", 5, "[{};]", 6), ("code", 1, "http", 6))


@query("""
SELECT doc_id, type, CASE WHEN score < 0.45 THEN 'unknown' ELSE 'known' END AS verdict, round(score, 6) AS score FROM (
  SELECT doc_id, 'prose' AS type, least(1.0, (3 * (text LIKE '%the%')::INT + 2 * (text LIKE '%and%')::INT) / 5.0::DOUBLE) AS score FROM documents UNION ALL
  SELECT doc_id, 'list', least(1.0, (4 * (text LIKE '%|%')::INT) / 4.0::DOUBLE) FROM documents UNION ALL
  SELECT doc_id, 'code', least(1.0, (5 * regexp_matches(text, '[{};]')::INT + (text LIKE '%http%')::INT) / 6.0::DOUBLE) FROM documents)""")
def type_scores(t):
    """Scores of each type from weighted signals."""
    d = t("documents")
    signals = d.sparkSession.createDataFrame(SIGNALS, "type string, weight int, pattern string, saturation int")
    out = aggregates.type_scores(d, "doc_id", "text", signals)
    return out.select("doc_id", "type", F.when(F.col("score") < 0.45, "unknown").otherwise("known").alias("verdict"), F.round("score", 6).alias("score"))


@query("""
SELECT lang, CASE WHEN n < 120 THEN NULL WHEN ko / n > 0.25 THEN 'ko' WHEN latin / n > 0.6 THEN 'latin' END AS script, count(*) AS docs FROM (
  SELECT lang, ko::DOUBLE AS ko, latin::DOUBLE AS latin, (ko + ja + zh + latin)::DOUBLE AS n FROM (
    SELECT lang, len(regexp_extract_all(text, '[가-힯]')) AS ko, len(regexp_extract_all(text, '[぀-ヿ]')) AS ja, len(regexp_extract_all(text, '[一-鿿]')) AS zh, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents)) GROUP BY 1, 2""")
def dominant_scripts(t):
    """Documents by their letters."""
    return t("documents").groupBy("lang", titles.dominant_script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("docs"))


@query("""
SELECT source, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (n_chars > 5000) AS long, list_sort(list(doc_id))[1:20]::VARCHAR AS sample FROM documents GROUP BY 1""")
def support_counters(t):
    """Counters with a sample of twenty; the cap is the feature."""
    sample = F.slice(F.sort_array(F.collect_set("doc_id")), 1, 20)
    text = F.concat(F.lit("["), F.array_join(sample, ", "), F.lit("]"))
    return t("documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars") > 5000).alias("long"), text.alias("sample"))


@query("""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) BETWEEN 8 AND 70 GROUP BY 1, 2 HAVING count(*) >= 2""")
def repeated_front_titles(t):
    """Lines that a document has twice or more."""
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.char_length("line").between(8, 70))
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
