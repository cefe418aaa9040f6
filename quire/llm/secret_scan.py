"""Secret scans over an incremental blob ledger.

Every historical version of a file is addressed by the SHA-256 of its content.
The ledger holds one row for each blob and rule version that was scanned, with
the spans found. A run scans only the pairs that the ledger lacks, appends
them, and joins the findings back to every path and version with that content.

Everything is DataFrame code. Scan order is ``rules`` order; a rule whose
pattern changes gets a new version and is then scanned again, alone. Only texts
with something left to scan are shuffled, once, by their blob; where these are
no more than ``BROADCAST_BLOBS`` their blobs are sent to the tasks that read the
texts, so that the others don't move at all.

Defined cases: null text is the empty text, with no findings. Null paths and
versions are ordinary values. Repeated rows, and rows that share path and
version with others, are each returned; their content is scanned once. Very long
texts are scanned whole. Empty inputs return no rows and leave the ledger as it
was. Columns other than path, version and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.storage import has_files, materialise
from quire.llm.textcols import text_or_empty

SPANS = "array<struct<start:bigint,end:bigint>>"
#: About 200 bytes each in memory: 40 MB.
BROADCAST_BLOBS = 200_000
LEDGER = f"blob string, rule string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` count if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Kinds, patterns and least lengths of the base rules.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)


def spans_of(text: Column, rule: Rule) -> Column:
    """Start and exclusive end, in code points, of the rule's matches in a text.

    The pieces between matches and the matches themselves alternate, so a
    running sum of their lengths gives the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    nothing = F.array().cast(SPANS)
    started = F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["0"])
        end = start + F.coalesce(F.char_length(x["1"]), F.lit(0))
        counts = F.char_length(x["2"]) >= rule.least  # null after the last match
        grown = F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.cast("bigint").alias("at"), F.when(counts, grown).otherwise(state["spans"]).cast(SPANS).alias("spans"))

    walked = F.aggregate(F.arrays_zip(between, found, groups), started, step, lambda s: s["spans"])
    return F.when(F.size(found) > 0, walked).otherwise(nothing)


def blob_of(text: Column) -> Column:
    """The address of a content; never null, so that joins need not compute it twice to see that."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All scanned pairs; none where nothing was scanned yet. Batches that scanned the same pair at the same time agree, so either row does."""
    if not has_files(ledger):
        return spark.createDataFrame([], LEDGER)
    batches = spark.read.schema(LEDGER).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return batches.parquet(ledger).dropDuplicates(["blob", "rule"])


def unseen(paths: DataFrame, known: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The blobs of ``paths`` that lack rules in ``known``, with these as ``todo``."""
    seen = known.where(F.col("rule").isin(*wanted)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    lacking = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("seen", F.array().cast("array<string>")))
    return paths.select("blob").distinct().join(seen, "blob", "left").select("blob", lacking.alias("todo")).where(F.size("todo") > 0)


def scan_versions(versions: DataFrame, ledger: str, rules: Sequence[Rule] = BASE_RULES, most: int = BROADCAST_BLOBS) -> DataFrame:
    """Scan ``versions`` (path, version, text) and return all their findings.

    ``ledger`` is a folder that all machines reach; it is made if absent. The
    result has path, version, blob and ``findings``: an array of kind, start and
    end, ordered by start and then by the rules' order.
    """
    spark = versions.sparkSession
    text = text_or_empty(F.col("text"))
    paths = versions.select("path", "version", blob_of(text).alias("blob"))
    wanted = [r.key for r in rules]
    todo = materialise(unseen(paths, read_ledger(spark, ledger), wanted), "unseen-blobs")
    left = todo.limit(most + 1).count()
    if left:
        held = versions.select(blob_of(text).alias("blob"), text.alias("text"))
        if left <= most:
            held = held.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
        # Copies fold into one text before and after the shuffle, so each blob is scanned once.
        once = held.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
        each = F.array(
            *(F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), spans_of(F.col("text"), r).alias("spans"))) for r in rules)
        )
        # Taken apart where it is made: of a column, the optimiser would test the size first, by a scan more.
        scanned = once.select("blob", F.inline(F.array_compact(each)))
        scanned.write.parquet(f"{ledger}/batch-{uuid.uuid4().hex}")

    order = {r.key: i for i, r in enumerate(rules)}
    kinds = F.create_map(*(F.lit(x) for r in rules for x in (r.key, r.kind)))
    ranks = F.create_map(*(F.lit(x) for r in rules for x in (r.key, order[r.key])))

    def placed(x: Column) -> Column:
        return F.transform(x["spans"], lambda s: F.struct(s["start"].alias("start"), ranks[x["rule"]].alias("rank"), s["end"].alias("end"), kinds[x["rule"]].alias("kind")))

    ordered = F.sort_array(F.flatten(F.transform("by_rule", placed)))
    found = (
        read_ledger(spark, ledger)
        .where(F.col("rule").isin(*wanted) & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.collect_list(F.struct("rule", "spans")).alias("by_rule"))  # one entry for each rule
        .select("blob", F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("findings"))
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return paths.join(found, "blob", "left").select("path", "version", "blob", F.coalesce("findings", none).alias("findings"))


def spans_text(findings: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
