"""Joins that need more than an equality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a dimension is broadcast; its size is counted first.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it to be small; else for Spark to decide."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tasks(df: DataFrame) -> int:
    """How many tasks dear work is dealt over: the session's shuffle partitions, which stay as many when their bytes are few."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], pieces: int = 16) -> DataFrame:
    """Rows of equal keys, where pairs outnumber rows by far.

    A block's left rows are dealt over ``pieces``, each of which meets all its
    right rows, so that a large block is several tasks' work.
    """
    n = tasks(left)
    dealt = left.withColumn("_piece", F.pmod(F.xxhash64(*(c for c in left.columns if c not in keys)), F.lit(pieces)).cast("int"))
    each = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    on = [*keys, "_piece"]
    return dealt.repartition(n, *on).join(each.repartition(n, *on).hint("merge"), on).drop("_piece")


def class_pairs(rows: DataFrame, keys: Sequence[str], value: str, member: str, dressed: Column, score: Callable[[Column, Column], Column], most: int = 1024) -> DataFrame:
    """All pairs a < b of ``member`` with equal ``keys``, and the symmetric ``score`` of what ``dressed`` makes of their values.

    Rows of one value are a class: it is dressed once, and each pair of classes
    is scored once, however many members both have. Classes of more than
    ``most`` members are held in parts.
    """
    by = Window.partitionBy(*keys, value)
    placed = rows.select(*keys, value, member).where(F.col(member).isNotNull()).withColumn("_part", F.floor((F.row_number().over(by.orderBy(member)) - 1) / most))
    parts = placed.groupBy(*keys, value, "_part").agg(F.collect_list(member).alias("_all"), F.min(member).alias("_id")).withColumn("_d", dressed)
    side = lambda s: parts.select(*keys, *(F.col(c).alias(f"{c}{s}") for c in ("_all", "_id", "_d")))
    met = dealt_join(side("x"), side("y"), keys).where("_idx <= _idy").withColumn("score", score(F.col("_dx"), F.col("_dy")))
    few = met.select("score", (F.col("_idx") == F.col("_idy")).alias("_own"), "_allx", "_ally").repartition(tasks(rows))
    each = few.select("score", "_own", "_ally", F.explode("_allx").alias("x")).select("score", "_own", "x", F.explode("_ally").alias("y"))
    # Two parts meet once, a part meets itself in both orders of its members.
    return each.where("x <> y AND (NOT _own OR x < y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def by_value(rows: DataFrame, inputs: Sequence[str], **outputs: Column) -> DataFrame:
    """``rows`` with ``outputs``, which depend on ``inputs`` alone and are worked out once for each of their values."""
    values = rows.select(*inputs).distinct().repartition(tasks(rows)).select(*(F.col(c).alias(f"_{c}") for c in inputs), *(F.col(c) for c in inputs))
    found = values.select(*(f"_{c}" for c in inputs), *(c.alias(n) for n, c in outputs.items()))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in inputs]
    return rows.join(small(found), same).drop(*(f"_{c}" for c in inputs))


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Rows of ``points`` with the ``spans`` of equal keys that hold ``at``, ends included.

    Spans are cut into buckets of ``width``, so the join is on keys and bucket
    and the comparison is left for rows that met. No point is in two buckets,
    so no pair comes twice.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*keys, "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, most: int) -> DataFrame:
    """Pairs of equal keys whose ``a`` and ``b`` are at most ``most`` apart."""
    width = max(1, most)
    near = left.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col(a) / width) + d for d in (-1, 0, 1)))))
    own = right.withColumn("_bucket", F.floor(F.col(b) / width))
    return near.join(own, [*keys, "_bucket"]).where(F.abs(F.col(a) - F.col(b)) <= most).drop("_bucket")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, carried: Sequence[str]) -> DataFrame:
    """Each left row with the carried columns of the latest right row before it.

    Both sides go through one window in time order, so a hot key costs a sort
    and not a join.
    """
    l_side = left.select("*", F.lit(1).alias("_side"), F.col(at).alias("_at"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in carried))
    r_side = right.select(*keys, F.lit(0).alias("_side"), F.col(other).alias("_at"), *(F.col(c).alias(f"_{c}") for c in carried))
    both = l_side.unionByName(r_side, allowMissingColumns=True).withColumn("_row", F.when(F.col("_side") == 0, F.struct(*(f"_{c}" for c in carried))))
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_last", F.last("_row", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*left.columns, *(F.col("_last")[f"_{c}"].alias(c) for c in carried))


def field_diff(before: DataFrame, after: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """What changed between two long tables (key, field, value): changed, added or cleared. Null and empty are equal."""
    b = before.select(key, field, F.coalesce(value, F.lit("")).alias("old"))
    a = after.select(key, field, F.coalesce(value, F.lit("")).alias("new"))
    both = b.join(a, [key, field], "full_outer").select(key, field, F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))
    kind = F.when(F.col("new") == "", "cleared").when(F.col("old") == "", "added").otherwise("changed")
    return both.where("old <> new").withColumn("kind", kind)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` that refer to no row of ``parent``."""
    return child.join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def excluded(rows: DataFrame, list_: DataFrame, keys: Sequence[str], identity: str) -> DataFrame:
    """Rows without those on an exclusion list: by key alone where it states no identity, else by both."""
    by_key = list_.where(F.coalesce(identity, F.lit("")) == "").select(*keys)
    by_both = list_.where(F.coalesce(identity, F.lit("")) != "").select(*keys, identity)
    return rows.join(by_key, list(keys), "left_anti").join(by_both, [*keys, identity], "left_anti")


def merge_by_priority(values: DataFrame, key: str, field: str, value: str, rank: str, order: str) -> DataFrame:
    """For each key and field the first value that isn't empty, by rank and then order, with its rank and how many disagree."""
    stated = values.where(F.coalesce(value, F.lit("")) != "")
    best = F.min(F.struct(F.col(rank), F.col(order), F.col(value).alias("v")))
    out = stated.groupBy(key, field).agg(best.alias("_b"), F.count_distinct(value).alias("_d"))
    return out.select(key, field, F.col("_b.v").alias("value"), F.col(f"_b.{rank}").alias("source"), (F.col("_d") - 1).alias("others"))


def blocked_pairs(left: DataFrame, right: DataFrame, key: str, tokens: str, most_common: int | None = None) -> DataFrame:
    """Pairs of rows that share a token, each pair once, as (left_key, right_key, shared).

    Tokens that more than ``most_common`` right rows have are left out of
    blocking if that is set.
    """
    r = right.select(F.col(key).alias("right_key"), F.explode(F.array_distinct(tokens)).alias("token"))
    if most_common:
        usual = r.groupBy("token").count().where(F.col("count") <= most_common).select("token")
        r = r.join(usual, "token")
    token_rows = left.select(F.col(key).alias("left_key"), F.explode(F.array_distinct(tokens)).alias("token"))
    return token_rows.join(r, "token").groupBy("left_key", "right_key").agg(F.count(F.lit(1)).alias("shared"))


def greedy_shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many of each left list find a partner in the right list that no earlier one took."""

    def one(left, right) -> int:
        free, n = list(right), 0
        for x in left:
            if x in free:
                free.remove(x)
                n += 1
        return n

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


greedy_shared_udf = F.pandas_udf(greedy_shared, T.IntegerType())


def creators_differ(stored: Column, read: Column) -> Column:
    """Whether less than half of the longer list is shared, each name used once; unknown lists don't differ."""
    shared = greedy_shared_udf(stored, read)
    return (F.size(stored) > 0) & (F.size(read) > 0) & (shared / F.greatest(F.size(stored), F.size(read)) < 0.5)


def choose_target(linked: DataFrame, document: str) -> DataFrame:
    """The record that a document is tied to: the best of the links, if it is of the same edition.

    ``linked`` has relation, stage, identifier_match, provider, title_line,
    missing_people, exact_year, title_score, n_evidence and record.
    """
    stage = F.when(F.col("stage") == "versionOfRecord", 3).when(F.col("stage") == "acceptedManuscript", 2).when(F.col("stage") == "unknown", 1).otherwise(0)
    order = [
        (F.col("relation") == "sameEdition").desc(), stage.desc(), F.col("identifier_match").desc(), (F.col("provider") != "google").desc(),
        F.col("title_line").desc(), F.col("missing_people"), F.col("exact_year").desc(), F.col("title_score").desc(), F.col("n_evidence").desc(), F.col("record"),
    ]
    first = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    best = linked.where(F.col("relation").isin("sameEdition", "sameWork")).withColumn("_n", first).where("_n = 1").drop("_n")
    return best.where("relation = 'sameEdition'")
