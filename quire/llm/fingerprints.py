"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a
text's shingles of five words. The sketch of a union is the bottom-k of the
union of sketches, so parts merge in any order. Where a sketch holds fewer than
``k`` hashes it is the whole set and all estimates are exact; else resemblance
has a standard error of at most ``0.5 / sqrt(k)``.

Everything is DataFrame code. Words are runs of characters other than ASCII
whitespace, as they stand.

Defined cases: fewer than five words are one shingle; an empty or null text has
the empty sketch, which resembles the empty sketch by 1 and any other by 0. Very
long texts are read whole. Null doc_ids come first, repeated ones in order of
their text; repeated rows are all returned, a row after itself. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.textcols import WHITESPACE, let, pieces, shingle_hashes, text_or_empty

WIDTH = 5
K = 128
#: Rows that ``with_next`` aims to have in a bucket, and the most buckets it makes.
BUCKET_ROWS, MOST_BUCKETS = 1024, 65_536


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text, as array of long in ascending order."""
    hashes = shingle_hashes(pieces(text, WHITESPACE), width)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` were made from."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""

    def share(union: Column) -> Column:
        both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
        return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))

    return let(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, as double; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, 0 to 1; 1 if ``a`` has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    """A sketch as base64 of its hashes' bytes, big-endian; the empty sketch as empty string."""
    digits = F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.regexp_replace(F.base64(F.unhex(digits)), r"\s", "")


def merge_sketches(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One merged sketch for each ``keys``, however many rows a key has.

    The distinct hashes of a key are ranked in 64 slices of the hash space, then
    the ``k`` least of each slice in the key. Ranks up to ``k`` are all that
    Spark keeps before and after each shuffle, so no task collects more.
    """
    one = sketches.select(*keys, F.explode(column).alias("h")).distinct()
    sliced = one.withColumn("slice", F.shiftright("h", 58))

    def least(rows: DataFrame, *within: str) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy("h"))).where(F.col("_n") <= k).drop("_n")

    kept = least(least(sliced, *keys, "slice"), *keys)
    merged = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(column))  # no more than k
    bare = sketches.select(*keys).distinct()
    met = [bare[c].eqNullSafe(merged[c]) for c in keys]
    return bare.join(merged, met, "left").select(*(bare[c] for c in keys), F.coalesce(merged[column], F.array().cast("array<bigint>")).alias(column))


def with_next(docs: DataFrame, key: str, carried: list[str], compute: dict[str, Column] | None = None) -> DataFrame:
    """Each row with the ``carried`` columns of the next row by ``key``, as ``next_<column>``; the first follows the last.

    Rows are dealt into ranges of ``key`` between quantiles that are themselves
    keys, and each range also gets the row that opens the next range, so no
    range needs to see another and no task sees all rows. ``compute`` adds
    columns after rows are dealt; they can be carried too.

    Null keys come first; equal keys are ordered by the carried columns. The
    only state on the driver is the boundaries: one for ``BUCKET_ROWS`` rows, at
    most ``MOST_BUCKETS``; beyond that ranges grow.
    """
    stats = docs.agg(F.count(F.lit(1)), F.min(key), F.max(F.col(key).isNull()))
    rows, first, with_null = stats.first()
    buckets = min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS))
    bounds: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = docs.agg(F.percentile_approx(key, shares, 10 * buckets + 1000)).first()[0]
        bounds = sorted(set(found or []))
    span = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + span] for i in range(0, len(bounds), span)]
    id_type = docs.schema[key].dataType.simpleString()

    def at_most(values: list[int]) -> Column:
        literal = F.array(*map(F.lit, values)).cast(f"array<{id_type}>") if values else F.array().cast(f"array<{id_type}>")
        return F.size(F.filter(literal, lambda b: b <= F.col(key)))

    if groups:
        coarse = at_most([g[0] for g in groups])
        table = F.array(*(F.array(*map(F.lit, g)).cast(f"array<{id_type}>") for g in groups))
        fine = F.size(F.filter(F.coalesce(F.get(table, coarse - 1), F.array().cast(f"array<{id_type}>")), lambda b: b <= F.col(key)))
        bucket = F.when(coarse == 0, 0).otherwise((coarse - 1) * span + fine)
    else:
        bucket = F.lit(0)
    literal = F.array(*map(F.lit, bounds)).cast(f"array<{id_type}>") if bounds else F.array().cast(f"array<{id_type}>")
    opens = (F.col("_at") > 0) & (F.get(literal, F.col("_at") - 1) == F.col(key))
    is_first = F.col(key).isNull() if with_null else F.col(key) == F.lit(first)
    place = lambda b, kind: F.struct(b.cast("int").alias("_bucket"), F.lit(kind).alias("_kind"))
    places = F.array_compact(
        F.array(
            place(F.col("_at"), 0),
            F.when(opens, place(F.col("_at") - 1, 1)),
            F.when(is_first, place(F.lit(len(bounds)), 2)),
        )
    )
    dealt = docs.withColumn("_at", bucket).select(*docs.columns, F.inline(places)).repartition("_bucket")
    for name, column in (compute or {}).items():
        dealt = dealt.withColumn(name, column)
    order = Window.partitionBy("_bucket").orderBy(F.col("_kind") == 2, F.col(key).asc_nulls_first(), *carried)
    for c in carried:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where(F.col("_kind") == 0).drop("_bucket", "_kind")


def edited_with_next(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of their edited texts and of the next document.

    The edited text has the last quarter of its code points (rounded down)
    replaced by the first as many, or all, of the next document by doc_id.
    Returns doc_id, n_chars, edited, sketch, edited_sketch, next_sketch. A
    single document follows itself. Other columns are ignored.
    """
    base = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    rows = with_next(base, "doc_id", ["text", "sketch"], {"sketch": sketch(F.col("text"), k, width)})
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    out = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("next_sketch"))
    return out.withColumn("edited_sketch", sketch(F.col("edited"), k, width))
