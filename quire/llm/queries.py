"""The thin queries over whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    decontaminate,
    fingerprints,
    mixing,
    secret_scan,
    separator_scan,
    simhash,
    token_output,
    toxicity,
    url_filter,
    warc,
)
from quire.llm.storage import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents, by a new blob ledger."""
    docs = table(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    found = secret_scan.scan_versions(versions, scratch(spark, "ledger"))

    def number(kind: str):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [r.kind for r in secret_scan.BASE_RULES]
    base = F.filter("findings", lambda s: s["kind"].isin(kinds))
    return found.select(
        F.col("path").alias("doc_id"),
        *(number(k) for k in kinds),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("findings")).alias("spans"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness."""
    rows = fingerprints.edited_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.printed(F.col("sketch")).alias("fingerprint"),
        fingerprints.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every text of documents."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of documents, counted in flat files by their separators."""
    return separator_scan.count_tokens(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of documents, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    judged = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return judged.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards of a mix of sources by weight take of each of documents."""
    per_doc, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return per_doc.select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text of documents, and its component of near-duplicates."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, from the archives they were written to."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text of documents, from the files they were written to."""
    docs = table(spark, sf_dir, "documents")
    files = token_output.write_tokens(docs, scratch(spark, "tokens"))
    return token_output.read_tokens(files, docs.schema["doc_id"].dataType)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every url of pages."""
    about = url_filter.build_index(url_filter.default_list(spark), scratch(spark, "urls"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), about)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_separator_scan": op2_separator_scan,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_token_output": op9_token_output,
    "op10_url_filter": op10_url_filter,
}

def _spans_sql() -> str:
    parts = []
    for rank, r in enumerate(secret_scan.BASE_RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, unnest(list_transform(range(1, len(found) + 1), lambda i: {{
              's': list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0), 'n': length(found[i]), 'v': length(vals[i])}})) AS m
            FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS found, regexp_extract_all(t, '{p}', {r.group}) AS vals FROM d WHERE regexp_matches(t, '{p}'))"""
        )
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secret_scan.BASE_RULES)
    kept = f"SELECT doc_id, rank, kind, m.s AS s, m.s + m.n AS e FROM ({' UNION ALL '.join(parts)}) WHERE m.v >= CASE kind {least} END"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({kept}),
    j AS (SELECT d.doc_id, {counts}, coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank), '') AS spans FROM d LEFT JOIN k USING (doc_id) GROUP BY 1)
    SELECT *, sha256(spans) AS base_sha256 FROM j"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM i),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, p.n, pos, item_id FROM p JOIN i ON i.win = p.win AND i.n = p.n),
h AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS spot FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, octet_length(encode(p.h)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || sha1(p.h)[1 + 5 * (i // 4):5 + 5 * (i // 4)] AS BIGINT) >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN g ON g.h = p.h"""


def _urls_sql() -> str:
    fits = lambda h: f"(host = '{h}' OR host LIKE '%.{h}')"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h)} AND starts_with(path, '{p}') THEN '{h + p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN '{h + p}' THEN '{a}'" for h, p, a in rules)
    listed = " OR ".join(map(fits, url_filter.LISTED))
    return f"""SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN {listed} THEN 'block' ELSE 'allow' END END AS verdict FROM (
      SELECT page_id, host, path, CASE {rule} END AS rule FROM (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages))"""


#: Hashes by XXH64 (3, 7), tokenizers (2, 9), training (4) and random orders (6) are beyond SQL.
ORACLE: dict[str, str] = {
    "op1_secret_scan": _spans_sql(),
    "op5_decontamination": _CONTAMINATION_SQL,
    "op8_warc": _WARC_SQL,
    "op10_url_filter": _urls_sql(),
}
