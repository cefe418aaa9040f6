"""Writing: change logs, guarded applies and undos, caches, lists and reports.

Tables are immutable; an update is a new version. Latest states come from a
log by the time of its rows, so a job that ran twice leaves the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.windows import keep_latest

LONGEST = 20_000


def fingerprint(fields: str = "fields") -> Column:
    """A digest of a record's map of fields, whatever its order."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(fields))), 256)


def latest_state(log: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """The last row of each key in a log; rows that say ``deleted`` end a key."""
    last = keep_latest(log, keys, F.col(at).desc(), *[F.col(c).desc() for c in log.columns if c not in (*keys, at)][:1])
    return last.where(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in log.columns else last


def replace_by_key(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def remove_by_key(table: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(keys_of.select(*keys), keys, "left_anti")


def apply_changes(records: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write ``changes`` (key, expected, new: map) to ``records`` (key, fields).

    A record changes only if its fingerprint is the expected one. Returns the new
    version, with ``was`` for an undo, and the changes refused.
    """
    now = records.withColumn("_now", fingerprint())
    met = now.join(changes.select("key", "expected", "new"), "key", "left")
    fits = F.coalesce(F.col("_now") == F.col("expected"), F.lit(False))
    merged = F.map_filter(F.map_concat(F.map_filter("fields", lambda k, v: ~F.map_contains_key("new", k)), F.col("new")), lambda k, v: v != "")
    written = met.select("key", F.when(fits, merged).otherwise(F.col("fields")).alias("fields"), F.when(fits, F.col("fields")).alias("was"))
    refused = met.where(F.col("expected").isNotNull() & ~fits).select("key", "expected", F.col("_now").alias("found"))
    return written, refused


def undo(records: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Restore what ``applied`` (key, after, was: map) says, where a record still has the fingerprint ``after``."""
    now = records.withColumn("_now", fingerprint())
    met = now.join(applied.select("key", "after", F.col("was").alias("_was")), "key", "left")
    fits = F.coalesce(F.col("_now") == F.col("after"), F.lit(False))
    restored = met.select("key", F.when(fits, F.col("_was")).otherwise(F.col("fields")).alias("fields"))
    return restored, met.where(F.col("after").isNotNull() & ~fits).select("key")


def cut_text(text: Column, keep: Column | bool = False, longest: int = LONGEST) -> Column:
    """A text cut to a length with the number of characters left out, unless ``keep``."""
    n = F.char_length(text)
    short = F.concat(F.left(text, F.lit(longest)), F.lit("…["), (n - longest).cast("string"), F.lit(" characters omitted]"))
    return F.when((n > longest) & ~(F.lit(keep) if isinstance(keep, bool) else keep), short).otherwise(text)


def export_selected(rows: DataFrame, path: str, texts: list[str], longest: int = LONGEST) -> int:
    """Write the rows with ``checked`` as JSON lines, long texts cut; an empty selection is an error."""
    chosen = rows.where(F.col("checked").eqNullSafe(True))
    for c in texts:
        chosen = chosen.withColumn(c, cut_text(F.col(c), longest=longest))
    n = chosen.count()
    if not n:
        raise ValueError("no row is selected")
    chosen.write.mode("errorifexists").json(path)
    return n
