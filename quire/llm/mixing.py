"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents stand in a seeded random order and are cut into blocks
of about ``BLOCK_WORDS`` words. A source that takes more words than it has goes
through its blocks again, so its quota is a number of block draws: whole passes,
whole blocks of the last pass, and the part of one block that makes the words
come out. The tree hands the draws to output shards: each node splits the draws
that each source has in it between its two halves by one multivariate
hypergeometric draw, so shards are of equal size and every source's quota is
met exactly. A node's draws of a source are a range of the source's permuted
list, its halves' are the two parts of that range, so shards draw disjoint
blocks. A shard orders its documents at random. What a document gives to the mix
is the sum of what the shards drew of it.

The driver holds one row for each source and the tree's upper nodes, ``CELLS``
numbers of draws at most or one for each source; tasks split on from there, each
below one node, whose random generator depends on its place alone. Documents,
blocks and draws stay in tables; positions in a source come from sums over
blocks, and blocks of a hot source are as small as others, so no task sees a
whole source.

Defined cases: null and empty texts have size 0, and documents of size 0 are
taken 0 words and belong to no draw. A very long document is a large block,
and may be cut where its source's quota ends. A null source is a source, last in
order. Null and repeated doc_ids are told apart by their text; rows equal in
both are drawn alike, and their takes come one after another. An empty table
gives no rows. Other columns are ignored, or kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.storage import local_table, materialise
from quire.llm.textcols import WHITESPACE, text_or_empty, word_count

#: The weights that sources take in turn, the mix's size and the most repeats.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words and documents that a block aims to have at most, and draws that a shard aims to have.
BLOCK_WORDS, BLOCK_DOCS, SHARD_DRAWS = 100_000, 10_000, 64
#: Nodes that the driver splits the tree into at most, and the numbers of draws in them.
NODES, CELLS = 64, 1_000_000
#: Sources up to which their table is broadcast: 10 MB.
BROADCAST_SOURCES = 100_000
#: Blocks that one prefix sum runs over before sums of such spans are summed in turn.
SPAN = 4096
SEED = 7


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Targets in proportion to ``weights`` that add up to ``total``, none above ``most`` times its size.

    What a capped source gives up is shared again by weight among the others.
    """
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), total
    while open_:
        heft = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / heft > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / heft
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split(kinds: np.ndarray, draws: np.ndarray, begins: np.ndarray, shards: int, most: int = 1, seed: int = SEED, first: int = 0, path: int = 1) -> Iterator[tuple]:
    """The nodes of at most ``most`` shards below one with ``draws`` of ``kinds``, which begin at ``begins`` of each kind's list.

    Gives path, first shard, shards, kinds, draws and begins; kinds without
    draws are left out. ``path`` numbers the tree's nodes; each has a generator
    of its own, so any subtree can be made again alone.
    """
    if shards <= most:
        yield path, first, shards, kinds, draws, begins
        return
    left = shards // 2
    took = _hypergeometric(np.random.default_rng([seed, path]), draws, int(draws.sum()) * left // shards)
    rest = draws - took
    a, b = took > 0, rest > 0
    yield from split(kinds[a], took[a], begins[a], left, most, seed, first, 2 * path)
    yield from split(kinds[b], rest[b], (begins + took)[b], shards - left, most, seed, first + left, 2 * path + 1)


def _hypergeometric(generator: np.random.Generator, draws: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among ``n`` draws without replacement; kind by kind, each given those before."""
    out = np.zeros_like(draws)
    rest = int(draws.sum())
    for i, have in enumerate(draws):
        rest -= int(have)
        out[i] = generator.hypergeometric(int(have), rest, n) if have and n else 0
        n -= int(out[i])
    return out


def shard_draws(spark: SparkSession, draws: Sequence[int], shards: int, seed: int = SEED) -> DataFrame:
    """What each shard draws: kind (the place in ``draws``), shard, begin and n, a range of the kind's list."""
    counts = np.array(draws, dtype=np.int64)
    kinds = np.flatnonzero(counts > 0)
    nodes = max(1, min(NODES, shards, CELLS // max(1, len(kinds))))
    top = split(kinds, counts[kinds], np.zeros(len(kinds), dtype=np.int64), shards, -(-shards // nodes), seed)
    rows = [(p, f, n, *(x.tolist() for x in arrays)) for p, f, n, *arrays in top] if len(kinds) else []

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                arrays = [np.array(row[c], dtype=np.int64) for c in ("kinds", "draws", "begins")]
                for _, shard, _, k, n, begin in split(*arrays, row["shards"], 1, seed, row["first"], row["path"]):
                    yield pa.record_batch([pa.array(k), pa.array(np.full(len(k), shard)), pa.array(begin), pa.array(n)], names=["kind", "shard", "begin", "n"])

    table = local_table(spark, rows, "path long, first long, shards long, kinds array<long>, draws array<long>, begins array<long>")
    return table.repartition(max(1, len(rows))).mapInArrow(below, "kind long, shard long, begin long, n long")


def _random(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _with_begin(cut: DataFrame) -> DataFrame:
    """The words of a source before each of its blocks, as ``begin``; by sums of spans, so that no task has all blocks of a source."""
    cut = cut.withColumn("span", F.floor(F.col("block") / SPAN))
    earlier = Window.partitionBy("kind").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("kind", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    spans = cut.groupBy("kind", "span").agg(F.sum("block_size").alias("n"))
    spans = spans.select(F.col("kind").alias("k"), F.col("span").alias("p"), F.coalesce(F.sum("n").over(earlier), zero).alias("first"))
    inner = cut.withColumn("inner", F.coalesce(F.sum("block_size").over(within), zero))
    met = inner.join(spans, (inner["kind"] == spans["k"]) & (inner["span"] == spans["p"]))
    return met.withColumn("begin", F.col("first") + F.col("inner")).drop("k", "p", "first", "inner", "span")


def plan_sources(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple]:
    """(source, size, docs, target, words, passes, rest) for each source, by code point, null last.

    ``words`` is the whole number of words to take: ``passes`` times all and ``rest`` more.
    """
    found = sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()  # one row for each source
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] or 0 for r in found]
    turn = [weights[i % len(weights)] for i in range(len(sizes))]
    out = []
    for r, size, target in zip(found, sizes, share_out(sizes, turn, share * sum(sizes), most), strict=True):
        words = min(round(target), int(most * size))
        out.append((r[0], size, r[2], target, words, *(divmod(words, size) if size else (0, 0))))
    return out


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of ``docs`` (doc_id, source, text), and in what order.

    First result, one row for each document: doc_id, source, sha, size,
    source_size, target, taken, and shards, which took it, in order of passes.
    Second, one row for each time that a document is taken: doc_id, source, sha,
    pass, words (size but for the documents where quotas end), shard, place.
    ``sha`` is the text's SHA-256.
    """
    spark = docs.sparkSession
    sized = materialise(docs.select("doc_id", "source", F.sha2(text_or_empty(F.col("text")), 256).alias("sha"), word_count(F.col("text")).alias("size")), "sizes")
    plan = plan_sources(sized, weights, share, most)
    schema = "kind long, s string, source_size long, docs long, target double, words long, passes long, rest long"
    sources = local_table(spark, [(k, *row) for k, row in enumerate(plan)], schema)

    # Blocks: ranges of the random order, in number as the source has words and documents.
    number = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long")
    order = _random(seed, "source", "doc_id", "sha")
    rows = (
        sized.join(F.broadcast(sources) if len(plan) <= BROADCAST_SOURCES else sources, F.col("source").eqNullSafe(F.col("s")))
        .select("kind", "doc_id", "source", "sha", "size", "source_size", "target", "passes", "rest", number.alias("blocks"), order.alias("order"))
        .withColumn("block", F.floor(F.shiftrightunsigned("order", 11) / F.lit(2.0**53) * F.col("blocks")).cast("long"))
    )
    rows = materialise(rows, "ordered")
    cut = rows.groupBy("kind", "block").agg(
        F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.first("blocks").alias("blocks")
    )
    cut = materialise(_with_begin(cut), "blocks")

    # A source's draws are numbered pass by pass, block by block; the rest reaches a first part of the blocks.
    drawn = cut.select("kind", "block", "begin", "blocks", "passes", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"))
    drawn = drawn.where((F.col("pass") < F.col("passes")) | (F.col("begin") < F.col("rest")))
    drawn = drawn.select("kind", "block", "begin", "pass", (F.col("pass") * F.col("blocks") + F.col("block")).alias("draw"))
    counts = {r[0]: r[1] + 1 for r in drawn.groupBy("kind").agg(F.max("draw")).collect()}  # one row for each source
    draws = [counts.get(k, 0) for k in range(len(plan))]
    shards = max(1, sum(draws) // SHARD_DRAWS)
    ranges = shard_draws(spark, draws, shards, seed)
    each_draw = ranges.select("kind", "shard", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)).alias("draw"))
    given = materialise(drawn.join(each_draw, ["kind", "draw"]).select(F.col("kind").alias("k"), F.col("block").alias("b"), "begin", "pass", "shard"), "draws")

    # Documents: where each one's words lie in its source's order.
    inside = Window.partitionBy("kind", "block").orderBy("order", "doc_id", "sha").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    by_block = given.groupBy("k", "b").agg(F.first("begin").alias("begin"), F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))  # one for each pass
    met = placed.join(by_block, (F.col("kind") == F.col("k")) & (F.col("block") == F.col("b")), "left")
    rest_words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("begin") - F.col("before")))

    def words(p: Column) -> Column:
        return F.when(p < F.col("passes"), F.col("size")).otherwise(rest_words)

    took = F.filter(
        F.transform("draws", lambda d: F.struct(d["pass"].alias("pass"), words(d["pass"]).alias("words"), d["shard"].alias("shard"))),
        lambda d: d["words"] > 0,
    )
    none = F.array().cast("array<struct<pass:bigint,words:bigint,shard:bigint>>")
    held = materialise(
        met.select("doc_id", "source", "sha", "size", "source_size", "target", F.coalesce(took, none).alias("draws")), "taken"
    )
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    per_doc = held.select("doc_id", "source", "sha", "size", "source_size", "target", taken.alias("taken"), F.col("draws.shard").alias("shards"))
    each = held.select("doc_id", "source", "sha", F.inline("draws"))
    return per_doc, each.withColumn("place", _random(seed + 1, "shard", "pass", "source", "doc_id", "sha"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word."""
    parts = F.split(text, WHITESPACE)
    lead = F.when(F.get(parts, 0) == "", F.lit(1)).otherwise(F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), n + lead), " ")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each time, cut after ``words`` words, shard by shard in shard order.

    A document cut short has its words joined by single spaces and its n_chars, if any, counted anew.
    """
    _, each = mix(docs, **options)
    takes = F.collect_list(F.struct(F.col("words").alias("_words"), F.col("shard").alias("_shard"), F.col("place").alias("_place"))).alias("_takes")
    each = each.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("sha").alias("_sha")).agg(takes)
    key = docs.select("*", F.sha2(text_or_empty(F.col("text")), 256).alias("_of"))
    repeated = materialise(key.select("doc_id", "source", "_of"), "keys").groupBy("doc_id", "source", "_of").count().where("count > 1")
    if repeated.limit(1).count():
        key = key.dropDuplicates(["doc_id", "source", "_of"])
    met = key.join(each, key["doc_id"].eqNullSafe(each["_id"]) & (key["_of"] == each["_sha"]) & key["source"].eqNullSafe(each["_source"]))
    rows = met.select(*(key[c] for c in docs.columns), F.inline("_takes"))
    size = word_count(F.col("text"))
    text = F.when(size > F.col("_words"), first_words(F.col("text"), F.col("_words").cast("int"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.repartition("_shard").sortWithinPartitions("_shard", "_place").select(*docs.columns)
