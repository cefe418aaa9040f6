"""Aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_counts(df: DataFrame, state: Column, states: Sequence[str]) -> DataFrame:
    """One row: how many rows are in each exclusive state, their total, and whether the parts add up to it."""
    counted = df.select(state.alias("_s")).agg(*(F.count_if(F.col("_s") == s).alias(s) for s in states), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("consistent", sum((F.col(s) for s in states), F.lit(0)) == F.col("total"))


def kind_table(df: DataFrame, field: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """For each field, how many rows are of each kind."""
    return df.groupBy(field).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def kind_totals(table: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row of totals of a ``kind_table``."""
    out = table.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds))
    return out.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0)))


def top_and_other(df: DataFrame, by: str, n: int, other: str = "(other)") -> DataFrame:
    """The ``n`` most frequent values with their counts, the rest as one."""
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    # One row for each value; the window sees only the top and the rest's sum.
    head = counted.orderBy(F.col("n").desc(), F.col(by)).limit(n)
    rest = counted.join(head.select(by), by, "left_anti").agg(F.lit(other).alias(by), F.sum("n").alias("n")).where("n is not null")
    return head.unionByName(rest)


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, *tie: Column) -> DataFrame:
    """Each key's most frequent value; ``tie`` orders equals."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), *(tie or (F.col(value),)))
    return counted.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lower_median(value: str) -> Column:
    """The lower median of the positive values."""
    return F.expr(f"percentile_disc(0.5) within group (order by case when {value} > 0 then {value} end)")


def repeated_lines(lines: DataFrame, document: str, page: str, line: str, rank: str, slack: int = 1, pages: int = 2) -> DataFrame:
    """Lines that run through a document: on enough pages, counting only places within ``slack`` of the line's median place."""
    placed = lines.groupBy(document, line, page).agg(F.min(rank).alias("at"))
    middle = placed.groupBy(document, line).agg(F.expr("percentile_disc(0.5) within group (order by at)").alias("mid"))
    near = placed.join(middle, [document, line]).where(F.abs(F.col("at") - F.col("mid")) <= slack)
    return near.groupBy(document, line).agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= pages)


def inserted_leaves(pages: DataFrame, document: str, page: str, size: str, tolerance: float = 0.03) -> DataFrame:
    """Pages whose size is further than the tolerance from their document's commonest size; the smallest of equals."""
    common = most_frequent(pages, [document], size).select(document, F.col(size).alias("_usual"))
    met = pages.join(common, document)
    return met.where(F.abs(F.col(size) - F.col("_usual")) > tolerance * F.col("_usual")).select(document, page, size)


def placeholder_months(records: DataFrame, journal: str, volume: str, issue: str, date: str) -> DataFrame:
    """Records with month dates that a registry only made up cut to the year: one month for two or more issues of a volume."""
    year = F.substring(date, 1, 4)
    monthly = F.char_length(date) == 7
    groups = records.where(monthly).groupBy(journal, volume, year.alias("_y")).agg(F.count_distinct(issue).alias("_i"), F.count_distinct(F.substring(date, 6, 2)).alias("_m"))
    odd = groups.where("_i >= 2 and _m = 1").select(journal, volume, "_y", F.lit(True).alias("_odd"))
    met = records.withColumn("_y", year).join(odd, [journal, volume, "_y"], "left")
    return met.withColumn(date, F.when(F.col("_odd") & monthly, F.col("_y")).otherwise(F.col(date))).drop("_y", "_odd")


def type_scores(texts: DataFrame, key: str, text: str, signals: DataFrame) -> DataFrame:
    """Each text's score for each type: matched weights over the type's saturation, at most 1.

    ``signals`` has type, weight, pattern and saturation; it is a short list
    that a person wrote, and its patterns become part of the plan.
    """
    out = []
    by_type: dict[tuple, list] = {}
    for r in signals.collect():
        by_type.setdefault((r["type"], r["saturation"]), []).append(r)
    for (kind, saturation), rows in sorted(by_type.items()):
        got = sum((F.when(F.col(text).rlike(r["pattern"]), r["weight"]).otherwise(0) for r in rows), F.lit(0))
        out.append(F.struct(F.lit(kind).alias("type"), F.least(F.lit(1.0), got / F.lit(float(saturation))).alias("score")))
    return texts.select(key, F.inline(F.array(*out)))


#: Words by which a file's label or front matter tells that it supplements another; how far its front matter goes.
SUPPLEMENT_LABEL = r"(?i)supplement|supporting|appendix|(?:^|[^a-z])si(?:[^a-z]|$)"
SUPPLEMENT_TEXT = "supplementa|supporting information"
FRONT = 1200


def primary_files(items: DataFrame, files: DataFrame, item: str, file: str) -> DataFrame:
    """Each item's main file of ``files`` (label, front, present) and how it was chosen: noPDF, chosen, missingFile or multiplePDFs.

    The only file is it; else the only one whose label doesn't call it a
    supplement; else the only one of these whose front matter doesn't either.
    """
    by_label = F.col("label").rlike(SUPPLEMENT_LABEL)
    by_text = F.lower(F.left(F.coalesce("front", F.lit("")), F.lit(FRONT))).rlike(SUPPLEMENT_TEXT)
    one = F.struct(F.col(file).alias("file"), F.col("present").alias("present"))
    levels = {"all": F.lit(True), "main": ~by_label, "own": ~by_label & ~by_text}
    counts = files.groupBy(item).agg(*(F.count_if(c).alias(f"n_{k}") for k, c in levels.items()), *(F.min(F.when(c, one)).alias(k) for k, c in levels.items()))
    met = items.join(counts, item, "left")
    picked = F.when(F.col("n_all") == 1, F.col("all")).when(F.col("n_main") == 1, F.col("main")).when(F.col("n_own") == 1, F.col("own"))
    rows = met.select(item, F.coalesce("n_all", F.lit(0)).alias("n"), picked.alias("p"))
    choice = F.when(F.col("n") == 0, "noPDF").when(F.col("p").isNull(), "multiplePDFs").when(~F.col("p.present"), "missingFile").otherwise("chosen")
    return rows.select(item, choice.alias("choice"), F.when(F.col("p.present"), F.col("p.file")).alias("file"))
