"""Operators that look at a row's neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: Sequence[str], *order: Column, extra: str | None = None) -> DataFrame:
    """The first row of each key in ``order``; ``extra`` names a column for how many more there were."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_n", F.row_number().over(w.orderBy(*order)))
    if extra:
        out = out.withColumn(extra, F.count(F.lit(1)).over(w) - 1)
    return out.where("_n = 1").drop("_n")


def top(df: DataFrame, keys: Sequence[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key in ``order``, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def islands(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Runs of consecutive distinct ``at`` within ``keys``: first, last and length of each."""
    distinct = df.select(*keys, at).where(F.col(at).isNotNull()).distinct()
    placed = distinct.withColumn("_run", F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at)))
    return placed.groupBy(*keys, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def longest_island(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The longest run of each key, the earliest of equals."""
    return keep_latest(islands(df, keys, at), keys, F.col("length").desc(), F.col("first"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, to: str) -> DataFrame:
    """The last value of ``column`` that isn't null, up to and with each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(to, F.last(column, ignorenulls=True).over(w))


def interval_union(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of each key as one: start, end and the number of parts."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col(start) > F.max(end).over(before)).cast("int"), F.lit(1))
    placed = df.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy(*keys, "_run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("parts")).drop("_run")


def best_and_second(df: DataFrame, keys: Sequence[str], score: str, *tie: str) -> DataFrame:
    """The best row of each key with the next best score as ``second`` (null if alone)."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    return df.withColumn("second", F.lead(score).over(w)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rivals(df: DataFrame, keys: Sequence[str], score: str, band: float, *tie: str) -> DataFrame:
    """Each row with whether another of its key is within ``band`` of its score: a neighbour in order of score is the nearest."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    near = lambda c: F.coalesce(F.abs(c - F.col(score)) <= band, F.lit(False))
    return df.withColumn("rival", near(F.lag(score).over(w)) | near(F.lead(score).over(w)))


def _micros(at: Column) -> Column:
    """Microseconds of a time with or without a zone; the session's zone is taken to be UTC."""
    return F.unix_micros(at.cast("timestamp"))


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap_seconds: int) -> DataFrame:
    """Runs of rows with no more than a gap between neighbours: number, begin, end and rows of each."""
    w = Window.partitionBy(*keys).orderBy(at)
    apart = _micros(F.col(at)) - _micros(F.lag(at).over(w)) > gap_seconds * 1_000_000
    numbered = df.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.count(F.lit(1)).alias("rows"))


def gaps_below(df: DataFrame, keys: Sequence[str], at: str, least_ms: int) -> DataFrame:
    """Rows that came sooner after the one before than allowed."""
    w = Window.partitionBy(*keys).orderBy(at, *[c for c in df.columns if c not in (*keys, at)][:1])
    return df.withColumn("wait_ms", F.floor((_micros(F.col(at)) - _micros(F.lag(at).over(w))) / 1000)).where(F.col("wait_ms") < least_ms)


def hits(text: Column, word: str) -> Column:
    """The places, from 1 on, of all occurrences of a plain word that don't overlap."""
    n = F.char_length(F.lit(word))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def go_on(done: Column, piece: Column) -> Column:
        at = done["at"] + F.char_length(piece)
        return F.struct((at + n).alias("at"), F.concat(done["found"], F.array(at)).alias("found"))

    ends = F.aggregate(F.split(text, rf"\Q{word}\E"), start, go_on)["found"]
    return F.slice(ends, 1, F.size(ends) - 1)  # the text's own end is none


def span_cover(positions: DataFrame, keys: Sequence[str], start: str, end: str, word: str, wanted: int, share: float = 0.85) -> DataFrame:
    """Keys for which a stretch of ``max(2n, n + 80)`` units holds enough of ``wanted`` (n) distinct words.

    A hit counts for all stretches that end from its own end to ``reach`` after
    its start. The intervals of each word are joined, so it counts once
    wherever it is; then the most that lie over one place are counted as they
    open and close. Each hit is sorted twice, however many there are of a word.
    """
    reach = max(2 * wanted, wanted + 80)
    spans = positions.select(*keys, word, F.col(end).alias("_from"), (F.col(start) + reach).alias("_to")).where(F.col("_from") <= F.col("_to"))
    joined = interval_union(spans, [*keys, word], "_from", "_to")
    turns = F.array(F.struct(F.col("start").alias("_at"), F.lit(0).alias("_close")), F.struct(F.col("end").alias("_at"), F.lit(1).alias("_close")))
    w = Window.partitionBy(*keys).orderBy("_at", "_close").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = joined.select(*keys, F.inline(turns)).withColumn("_n", F.sum(1 - 2 * F.col("_close")).over(w))
    best = over.groupBy(*keys).agg(F.max("_n").cast("int").alias("covered"))
    return best.withColumn("supported", F.col("covered") >= share * wanted)


#: Rows that a range of ``in_order`` aims to have, and the most ranges.
RANGE_ROWS, MOST_RANGES = 500_000, 1024


def in_order(rows: DataFrame, key: Column, *ties: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their places in the order of ``key`` and ``ties``, from 1 on.

    Rows are dealt into ranges between quantiles of the key, ranked within, and
    the rows of the ranges before are added, so no task sorts them all. The
    driver holds the quantiles.
    """
    keyed = rows.withColumn("_key", key)
    ranges = min(MOST_RANGES, keyed.count() // RANGE_ROWS + 1)
    bounds = sorted(set(keyed.agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or [])) if ranges > 1 else []
    within = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_key"))) if bounds else F.lit(0)
    dealt = keyed.withColumn("_range", within)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # no more rows than ranges
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_key", *ties))
    placed = dealt.withColumn("_own", own).join(F.broadcast(before), "_range")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_own")).cast("long").alias(name))
