"""Scans, joins, windows, sorts and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import joins, windows
from quire.plans.registry import Registry
from quire.sources import sinks, tables

REGISTRY = Registry()
query = REGISTRY.query


@query("""
SELECT c_custkey, count(*) AS n_fields, min(field) AS first_field, max(value) AS last_value FROM (
  SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS field, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer)
WHERE value <> '' GROUP BY c_custkey""")
def scan_records(t):
    """Records with maps of fields, from a long table."""
    long = t("customer").select("c_custkey", F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value")) for n, c in (("name", "c_name"), ("segment", "c_mktsegment"), ("nation", "c_nationkey"))))))
    maps = tables.records_from_long(long, "c_custkey", "field", "value")
    return maps.select("c_custkey", F.size("fields").cast("long").alias("n_fields"), F.array_min(F.map_keys("fields")).alias("first_field"), F.array_max(F.map_values("fields")).alias("last_value"))


@query("""
SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), ','), '') AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def identity_projection(t):
    """Sorted child keys of each record."""
    kids = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    out = t("customer").select("c_custkey").join(kids, "c_custkey", "left")
    none = F.array().cast("array<bigint>")
    return out.select("c_custkey", F.size(F.coalesce("ks", none)).cast("long").alias("n_orders"), F.array_join(F.coalesce("ks", none), ",").alias("orders"))


@query("""
SELECT l.doc_id, l.toxic, d.lang FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.n_chars BETWEEN 100 AND 5000""")
def keyed_cache_lookup(t):
    """A cached row counts only if it is valid; the test is in the join."""
    cache = t("documents").select("doc_id", "lang", "n_chars").where(F.col("n_chars").between(100, 5000)).drop("n_chars")
    return t("labels").select("doc_id", "toxic").join(cache, "doc_id", "left")


def looked_up(t, orders):
    people = t("customer").join(joins.small(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return orders.select("o_orderkey", "o_custkey").join(people.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer"), F.col("n_name").alias("nation")), "o_custkey", "left")


@query("""
SELECT o_orderkey, o_custkey, c_name AS customer, n_name AS nation
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def all_attachments_with_lookups(t):
    """Items with scalar lookups, written as joins."""
    return looked_up(t, t("orders"))


@query("""
SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts, count(*) - 1 AS duplicates FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS k FROM events)
WHERE n = 1 OR k > 1 GROUP BY user_id""")
def keep_latest_event_per_user(t):
    """The latest row of each key, with how many it stands for."""
    out = windows.keep_latest(t("events").select("user_id", "event_id", "ts"), ["user_id"], F.col("ts").desc(), F.col("event_id"), extra="duplicates")
    return out


@query("""
WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events),
i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM d),
r AS (SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS length FROM i GROUP BY user_id, run)
SELECT user_id, first, last, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first) AS n FROM r) WHERE n = 1""")
def longest_event_day_run(t):
    """The longest run of consecutive days, the earliest of equals."""
    days = t("events").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day"))
    return windows.longest_island(days, ["user_id"], "day")


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user
FROM conversations""")
def carry_forward_role(t):
    """A state carried on to later rows."""
    rows = t("conversations").select("conv_id", "turn", "role").withColumn("u", F.when(F.col("role") == "user", F.col("turn")))
    return windows.carry_forward(rows, ["conv_id"], ["turn"], "u", "last_user").drop("u")


@query("""
SELECT conv_id, turn, coalesce(next IS NOT NULL AND regexp_matches(next, '^[a-z]'), false) AS continues FROM (
  SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)""")
def line_continuations(t):
    """Whether the next row goes on with a sentence."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t("conversations").select("conv_id", "turn", after.alias("next"))
    return rows.select("conv_id", "turn", F.coalesce(F.col("next").rlike("^[a-z]"), F.lit(False)).alias("continues"))


@query("""
SELECT 'orders_without_customer' AS invariant, count(*) AS broken FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'customers_without_order', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'labels_without_document', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'nations_without_region', count(*) FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey)
UNION ALL SELECT 'documents_without_label', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)""")
def referential_orphans(t):
    """Counts of broken references, as anti joins."""
    pairs = (
        ("orders_without_customer", "orders", "o_custkey", "customer", "c_custkey"),
        ("lines_without_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("customers_without_order", "customer", "c_custkey", "orders", "o_custkey"),
        ("labels_without_document", "labels", "doc_id", "documents", "doc_id"),
        ("nations_without_region", "nation", "n_regionkey", "region", "r_regionkey"),
        ("documents_without_label", "documents", "doc_id", "labels", "doc_id"),
    )
    parts = [joins.orphans(t(a).select(k), t(b), k, p).agg(F.lit(name).alias("invariant"), F.count(F.lit(1)).alias("broken")) for name, a, k, b, p in pairs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("""
WITH b AS (SELECT o_orderkey AS k, unnest(['status', 'priority', 'clerk']) AS field, unnest([o_orderstatus, o_orderpriority, '']) AS value FROM orders),
a AS (SELECT o_orderkey AS k, unnest(['status', 'priority', 'clerk']) AS field,
  unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE '' END]) AS value FROM orders)
SELECT b.k, b.field, b.value AS old, a.value AS new, CASE WHEN a.value = '' THEN 'cleared' WHEN b.value = '' THEN 'added' ELSE 'changed' END AS kind
FROM b JOIN a ON a.k = b.k AND a.field = b.field WHERE a.value <> b.value""")
def outer_field_diff(t):
    """What changed between two versions of records, field by field."""

    def long(df, status, priority, clerk):
        cols = (("status", status), ("priority", priority), ("clerk", clerk))
        return df.select(F.col("o_orderkey").alias("k"), F.inline(F.array(*(F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in cols))))

    o, k = t("orders"), F.col("o_orderkey")
    before = long(o, F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(""))
    after = long(o, F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")), F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")), F.when(k % 7 == 0, "new").otherwise(""))
    return joins.field_diff(before, after, "k", "field", "value")


@query("""
SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey AND l_quantity BETWEEN p_size AND p_size + 4""")
def range_join_quantity(t):
    """Equal keys and a number within a span, in buckets."""
    spans = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_partkey", "p_size", (F.col("p_size") + 4).alias("top"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return joins.range_join(lines, spans, ["l_partkey"], "l_quantity", "p_size", "top", 16).select("l_orderkey", "l_linenumber", "p_partkey")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 7 DAY""")
def range_join_ship_window(t):
    """Rows whose time lies in another's window."""
    met = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.where((F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS"))).select("l_orderkey", "l_linenumber")


@query("""
SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM supplier a JOIN supplier b
ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(floor(a.s_acctbal) - floor(b.s_acctbal)) <= 200""")
def band_join_balances(t):
    """Pairs within a band of each other."""
    s = t("supplier").select("s_nationkey", "s_suppkey", F.floor("s_acctbal").alias("bal"))
    left = s.select("s_nationkey", F.col("s_suppkey").alias("left_key"), F.col("bal").alias("a"))
    right = s.select("s_nationkey", F.col("s_suppkey").alias("right_key"), F.col("bal").alias("b"))
    return joins.band_join(left, right, ["s_nationkey"], "a", "b", 200).where("left_key < right_key").select("left_key", "right_key")


@query("""
SELECT e.event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts) AS last_purchase
FROM events e WHERE e.event_type = 'click'""")
def as_of_last_purchase(t):
    """The latest earlier row of another kind."""
    e = t("events").select("event_id", "user_id", "event_type", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"))
    out = joins.as_of(e.where("event_type = 'click'").drop("event_type"), bought.withColumn("last_purchase", F.col("bought")), ["user_id"], "ts", "bought", ["last_purchase"])
    return out.select("event_id", "last_purchase")


@query("""SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def semi_join_carry(t):
    """Rows that another table keeps."""
    return t("documents").select("doc_id", "lang", "source").join(t("labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_custkey = o_custkey AND c_acctbal < 0)
  AND NOT (o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM customer c WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND c_acctbal >= 0))""")
def anti_join_exclusions(t):
    """An exclusion list by key, or by key and identity, as two anti joins."""
    listed = t("customer").where("c_acctbal < 0 or c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 0, "F").otherwise("").alias("o_orderstatus"))
    return joins.excluded(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), listed, ["o_custkey"], "o_orderstatus")


@query("""
SELECT user_id, count(*) AS runs, CAST(sum(seconds) AS BIGINT) AS covered, max(parts) AS most FROM (
  SELECT user_id, run, date_diff('second', min(s), max(e)) AS seconds, count(*) AS parts FROM (
    SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT user_id, date_trunc('second', ts) AS s, date_trunc('second', ts) + INTERVAL 12 HOUR AS e,
        CASE WHEN date_trunc('second', ts) > max(date_trunc('second', ts) + INTERVAL 12 HOUR) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
             WHEN row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts)) = 1 THEN 1 ELSE 0 END AS opens FROM events))
  GROUP BY user_id, run) GROUP BY user_id""")
def interval_union_events(t):
    """Overlapping intervals as one."""
    rows = t("events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).withColumn("e", F.col("s") + 12 * 3600)
    runs = windows.interval_union(rows, ["user_id"], "s", "e")
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("end") - F.col("start")).alias("covered"), F.max("parts").alias("most"))


@query("""
SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_sum(list_transform(embedding[1:8], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT))) DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 3""")
def top3_per_label(t):
    """The three best of each group, one for each key (T4, T5)."""
    score = F.aggregate(F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double") * 1000).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = t("embeddings").select("label", "vec_id", score.alias("score"))
    return windows.top(rows, ["label"], 3, F.col("score").desc(), F.col("vec_id")).select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT p_brand, p_partkey, price, second, CASE WHEN second IS NOT NULL AND price - second < 1 THEN 'unknown' ELSE 'known' END AS verdict FROM (
  SELECT p_brand, p_partkey, p_retailprice AS price, lead(p_retailprice) OVER w AS second, row_number() OVER w AS n FROM part
  WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) WHERE n = 1""")
def best_second_margin(t):
    """The best of each group, known only by a margin over the second."""
    rows = t("part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("price"))
    best = windows.best_and_second(rows, ["p_brand"], "price", "p_partkey")
    near = F.coalesce(F.col("price") - F.col("second") < 1, F.lit(False))
    return best.withColumn("verdict", F.when(near, "unknown").otherwise("known"))


@query("""
SELECT p_brand, p_partkey, coalesce(abs(lag(p_retailprice) OVER w - p_retailprice) <= 0.5, false) OR coalesce(abs(lead(p_retailprice) OVER w - p_retailprice) <= 0.5, false) AS rival
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)""")
def rival_candidates(t):
    """Rows with another within a band of their score."""
    rows = t("part").select("p_brand", "p_partkey", "p_retailprice")
    return windows.rivals(rows, ["p_brand"], "p_retailprice", 0.5, "p_partkey").select("p_brand", "p_partkey", "rival")


@query("""
SELECT page_id, score, row_number() OVER (ORDER BY skipped, score DESC, page_id) AS place FROM (
  SELECT page_id, CAST(20 * (url LIKE '%example.org%')::INT - 30 * (url LIKE '%utm_%')::INT - 60 * (url LIKE '%spam%')::INT - page_id % 10 AS BIGINT) AS score, url LIKE '%#%' AS skipped FROM pages)""")
def hit_ranking(t):
    """A rank by an additive score (W7), in ranges of it."""
    yes = lambda p: F.contains("url", F.lit(p)).cast("long")
    score = 20 * yes("example.org") - 30 * yes("utm_") - 60 * yes("spam") - F.col("page_id") % 10
    rows = t("pages").select("page_id", score.alias("score"), F.contains("url", F.lit("#")).alias("skipped"))
    key = F.when(F.col("skipped"), 1_000_000).otherwise(0) - F.col("score")
    return windows.in_order(rows, key, "page_id").select("page_id", "score", "place")


@query("""SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal < 0, c_name, c_custkey LIMIT 100 OFFSET 100""")
def list_view_page(t):
    """One page of a sorted list (T1, T2); the limit is the feature."""
    return t("customer").orderBy(F.col("c_acctbal") < 0, "c_name", "c_custkey").offset(100).limit(100).select("c_custkey", "c_name")


@query("""
SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS tone FROM customer""")
def fixed_rank(t):
    """A fixed order of kinds, joined as a small dimension."""
    c = t("customer").select("c_custkey", "c_mktsegment")
    ranks = c.sparkSession.createDataFrame([("BUILDING", 0), ("AUTOMOBILE", 1), ("MACHINERY", 2)], "c_mktsegment string, tone int")
    return c.join(F.broadcast(ranks), "c_mktsegment", "left").withColumn("tone", F.coalesce("tone", F.lit(3)))


@query("""
SELECT o_custkey, arg_min(o_orderkey, (p, o_orderdate, o_orderkey)) AS o_orderkey FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS p FROM orders) GROUP BY o_custkey""")
def first_by_priority(t):
    """The first row by class, then by position."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return t("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(rank, "o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("""
WITH v AS (SELECT doc_id AS k, 'lang' AS field, lang AS value, 2 AS rank, doc_id AS idx FROM documents UNION ALL
  SELECT doc_id, 'lang', CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE '' END, 1, doc_id FROM documents UNION ALL
  SELECT doc_id, 'lang', 'yy', 3, doc_id FROM documents)
SELECT k, field, arg_min(value, rank) AS value, min(rank) AS source, count(DISTINCT value) - 1 AS others FROM v WHERE value <> '' GROUP BY k, field""")
def merge_sources(t):
    """Each field from the first source that states it."""
    d = t("documents").select("doc_id", "lang")

    def part(value, rank):
        return d.select(F.col("doc_id").alias("k"), F.lit("lang").alias("field"), value.alias("value"), F.lit(rank).alias("rank"), F.col("doc_id").alias("idx"))

    values = part(F.col("lang"), 2).unionAll(part(F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(""), 1)).unionAll(part(F.lit("yy"), 3))
    return joins.merge_by_priority(values, "k", "field", "value", "rank", "idx")


@query("""SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""")
def dedupe_exact_documents(t):
    """One row for each distinct text (U4): by digest, so that texts aren't shuffled."""
    return t("documents").select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("""
SELECT nation, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds FROM (
  SELECT c_nationkey AS nation, 'c' AS kind, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 's', count(*) FROM supplier GROUP BY 1) GROUP BY nation""")
def union_of_phases(t):
    """Two phases' results as one, counts added."""
    a = t("customer").select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind"))
    b = t("supplier").select(F.col("s_nationkey").alias("nation"), F.lit("s").alias("kind"))
    return a.unionByName(b).groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"))


@query("""
SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def set_difference(t):
    """Distinct keys of one list and not of another."""
    c = t("customer").select(F.col("c_nationkey").alias("n_nationkey"))
    s = t("supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return t("nation").select("n_nationkey").intersect(c).subtract(s)


@query("""
SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), 'none') AS segment, c_name AS name FROM customer""")
def fill_empty_fields(t):
    """Empty fields of a record filled from another."""
    base = F.create_map(F.lit("segment"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("name"), F.col("c_name"))
    other = F.create_map(F.lit("segment"), F.lit("none"), F.lit("name"), F.lit("nobody"))
    filled = F.map_zip_with(base, other, lambda k, a, b: F.when(F.coalesce(a, F.lit("")) == "", b).otherwise(a))
    return t("customer").select("c_custkey", filled["segment"].alias("segment"), filled["name"].alias("name"))


@query("""
SELECT conv_id, string_agg(coalesce(text, ''), chr(12) ORDER BY turn) AS front FROM conversations WHERE turn <= 5 GROUP BY conv_id""")
def front_matter(t):
    """The first pages of a document as one text."""
    pages = t("conversations").select(F.col("conv_id"), "turn", "text")
    return tables.front_matter(pages, "conv_id", "turn", "text", 5, 10_000_000)


@query("""
SELECT conv_id, part, count(*) AS lines, max(length(line)) AS longest FROM (
  SELECT conv_id, turn AS part, unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY conv_id, part""")
def split_pages(t):
    """Texts cut into lines, numbered (X11)."""
    lines = t("conversations").select("conv_id", F.col("turn").alias("part"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("lines"), F.max(F.char_length("line")).cast("long").alias("longest"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 7200 THEN
  concat_ws(chr(10), substr(text, CAST(floor(length(text) * 0.4::DOUBLE) AS INT) + 1, 2400), substr(text, CAST(floor(length(text) * 0.5::DOUBLE) AS INT) + 1, 2400), substr(text, CAST(floor(length(text) * 0.6::DOUBLE) AS INT) + 1, 2400)) ELSE text END AS sample FROM documents""")
def body_samples(t):
    """Stretches from the middle of long texts."""
    return t("documents").select("doc_id", tables.body_sample(F.col("text")).alias("sample"))


@query("""
SELECT l_orderkey, CAST(l_linenumber % 2 AS INT) AS row, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS line FROM lineitem GROUP BY 1, 2""")
def lines_of_words(t):
    """Lines put together from positioned words."""
    words = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_linenumber") % 2).cast("double").alias("y"), F.col("l_linenumber").alias("x"), F.col("l_returnflag").alias("text"))
    return tables.lines_of_words(words).select(F.col("doc_id").alias("l_orderkey"), F.col("row").cast("int").alias("row"), "line")


@query("""SELECT event_id, user_id, CAST(floor((epoch_us(ts) - epoch_us(prev)) / 1000) AS BIGINT) AS wait_ms FROM (
  SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE floor((epoch_us(ts) - epoch_us(prev)) / 1000) < 3000000""")
def spacing_violations(t):
    """Calls sooner after the last than allowed."""
    return windows.gaps_below(t("events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 3_000_000).select("event_id", "user_id", "wait_ms")


@query("""
SELECT event_id, n <= 6 AND blocked = 0 AS admitted FROM (
  SELECT event_id, row_number() OVER w AS n, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blocked
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def budget_ledger(t):
    """Calls within a budget and before a block, by key."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    blocked = F.sum((F.col("event_type") == "purchase").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t("events").select("event_id", ((F.row_number().over(w) <= 6) & (F.coalesce(blocked, F.lit(0)) == 0)).alias("admitted"))


@query("""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_rows(t):
    """What no run has done yet (R2)."""
    return t("documents").select("doc_id", "lang").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderkey % 2 = 0 AS written FROM orders""")
def guarded_apply(t):
    """Changes written only to records with the expected fingerprint."""
    records = t("orders").select(F.col("o_orderkey").alias("key"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("fields"))
    even = F.col("key") % 2 == 0
    changes = records.select("key", F.when(even, sinks.fingerprint()).otherwise("stale").alias("expected"), F.create_map(F.lit("status"), F.lit("X")).alias("new"))
    written, _ = sinks.apply_changes(records, changes)
    return written.select(F.col("key").alias("o_orderkey"), F.col("fields")["status"].alias("status"), F.col("was").isNotNull().alias("written"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Y' ELSE o_orderstatus END AS status, o_orderkey % 4 = 0 AS conflict FROM orders""")
def guarded_undo(t):
    """An undo that leaves records alone which someone changed since."""
    base = t("orders").select(F.col("o_orderkey").alias("key"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("was"))
    applied = base.withColumn("fields", F.create_map(F.lit("status"), F.lit("X"))).select("key", "was", sinks.fingerprint().alias("after"))
    now = base.select("key", F.create_map(F.lit("status"), F.when(F.col("key") % 4 == 0, "Y").otherwise("X")).alias("fields"))
    restored, conflicts = sinks.undo(now, applied)
    out = restored.join(conflicts.withColumn("conflict", F.lit(True)), "key", "left")
    return out.select(F.col("key").alias("o_orderkey"), F.col("fields")["status"].alias("status"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query("""SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_type DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'logout'""")
def latest_state_of_log(t):
    """The state that a log of upserts and deletes leaves (K2, K5, K6)."""
    log = t("events").select("user_id", "ts", "value", "event_type", "event_id").withColumn("deleted", F.col("event_type") == "logout")
    best = windows.keep_latest(log, ["user_id"], F.col("ts").desc(), F.col("value").desc(), F.col("event_type").desc(), F.col("event_id").desc())
    return best.where(~F.col("deleted")).select("user_id", "event_type", "value")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 10 = 0""")
def upsert_by_key(t):
    """Rows replaced by key (K5, K7)."""
    p = t("part").select("p_partkey", "p_name")
    return sinks.replace_by_key(p, p.where("p_partkey % 10 = 0").select("p_partkey", F.lit("new").alias("p_name")), ["p_partkey"])


@query("""SELECT doc_id, CASE WHEN length(text) > 20000 AND lang <> 'fr' THEN substr(text, 1, 20000) || '…[' || (length(text) - 20000) || ' characters omitted]' ELSE text END AS text FROM documents""")
def export_all_rows(t):
    """All rows with texts over 20 000 characters cut and the rest counted, but for kinds that never are (K3, K4)."""
    return t("documents").select("doc_id", sinks.cut_text(F.col("text"), F.col("lang") == "fr").alias("text"))


@query("""SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus))[1] AS first, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey""")
def distinct_queries(t):
    """Distinct values of a key in order of first use."""
    return t("orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("first"), F.count_distinct("o_orderpriority").alias("kinds"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 8""")
def capped_lists(t):
    """The first eight of each list; the cap is the feature."""
    return windows.top(t("documents").select("doc_id", "source", "n_chars"), ["source"], 8, F.col("n_chars").desc(), F.col("doc_id"), rank="place").select("doc_id", F.col("place").cast("long").alias("place"))
