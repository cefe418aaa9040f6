"""SimHash near-duplicates, linked through BK-trees.

Distinct fingerprints are dealt into shards. Cutting 64 bits into ``radius + 2``
blocks, two fingerprints within ``radius`` differing bits agree on two blocks at
least, so every link has both ends in the shard of some pair of blocks. Each
shard gets a BK-tree: children hang on their parent by the integer Hamming
distance to it, and a search follows only edges within the radius of its own
distance. Trees of all shards of a task are built and searched level by level
as arrays. A shard beyond ``PIECE`` fingerprints is cut into pieces, and each
piece's tree goes to every piece that has to search it, so no task holds a
whole hot shard and no link is left out.

Only a spanning forest of each shard's links leaves its task. Components come
from alternating large-star and small-star steps over tables in the shared
folder, so neither links nor fingerprints meet on the driver.

``similar_roots`` links by likeness of sets of five-word shingles. Texts whose
SimHashes of these sets the trees link are a group of candidates. Likeness 0.8
still lets SimHashes differ in some ten bits, beyond any radius that trees serve
well, so texts that share a band of a MinHash are candidates too: pairs of
likeness 0.8 do so with a probability of 0.9996. Groups with the same members
count once. The sets of a group's texts go to its task, and every pair that
isn't already linked there through others is measured exactly. Hot groups are
cut into pieces likewise.

Defined cases: null and empty texts have fingerprint zero, linked like any
other. Very long texts are read whole. Null doc_ids are returned, and are no
component's id unless all its doc_ids are null. Repeated rows are all returned;
``keep_one`` keeps one of them. Empty tables give no rows. Other columns are
ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.storage import few, materialise
from quire.llm.textcols import WHITESPACE, ascii_lower, pieces, text_or_empty
from quire.llm.textcols import shingle_hashes as jvm_shingles

WIDTH, RADIUS, SEED = 4, 4, 42
#: For likeness of shingle sets: five words, 0.8, and a MinHash of 20 bands of 5.
SIMILAR_WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
#: Rows up to which a table of keys is broadcast, about 20 MB; counted first.
BROADCAST_KEYS = 300_000
PIECE = 4096
QUERIES = 2048
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: For each byte value, its bits from the lowest on.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The SimHash of a UTF-8 text, unsigned."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    return majority(shingle_hashes(words, b" ".join(words), width))


def shingle_hashes(words: list[bytes], joined: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats kept; of all words where there are fewer."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    k = min(width, len(words))
    of = xxhash.xxh64_intdigest
    return np.array([of(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), stops[k - 1 :].tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in more than half of ``hashes``."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(columns[:, j], minlength=256) @ BITS for j in range(8)])
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as long, for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype="<u8")
            yield pa.record_batch([batch.column(0), pa.array(found.view("<i8"))], names=["doc_id", "fp"])

    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())]))


class Forest:
    """BK-trees of many groups at once, as arrays; node k is ``fps[k]``.

    ``fps`` are distinct within a group, and ``groups`` is sorted.
    """

    def __init__(self, groups: np.ndarray, fps: np.ndarray):
        n = len(fps)
        self.fps, self.groups = fps, groups
        self.edge = np.zeros(n, dtype=np.int64)
        parent = np.full(n, -1, dtype=np.int64)
        opens = np.ones(n, dtype=bool)
        opens[1:] = groups[1:] != groups[:-1]
        self.roots = np.flatnonzero(opens)
        here = self.roots[np.cumsum(opens) - 1]
        going = np.flatnonzero(~opens)
        here = here[going]
        while len(going):  # each round is one level of every tree
            far = np.bitwise_count(fps[going] ^ fps[here]).astype(np.int64)
            places, first, of = np.unique(here * 65 + far, return_index=True, return_inverse=True)
            parent[going[first]], self.edge[going[first]] = here[first], places % 65
            child = going[first]
            stay = np.ones(len(going), dtype=bool)
            stay[first] = False
            going, here = going[stay], child[of][stay]
        self.children = np.argsort(parent, kind="stable")[len(self.roots) :]
        self.count = np.bincount(parent[self.children], minlength=n) if n else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.count) - self.count

    def search(self, groups: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of query and node within ``radius``, block by block of queries."""
        own = self.groups[self.roots]
        for at in range(0, len(fps), QUERIES):
            g = groups[at : at + QUERIES]
            spot = np.minimum(np.searchsorted(own, g), max(0, len(own) - 1))
            query = np.flatnonzero(own[spot] == g) if len(own) else np.zeros(0, np.int64)
            node = self.roots[spot[query]] if len(own) else query
            query = query + at
            while len(query):
                far = np.bitwise_count(fps[query] ^ self.fps[node]).astype(np.int64)
                near = far <= radius
                yield query[near], node[near]
                n = self.count[node]
                begin = np.repeat(self.begin[node] - (np.cumsum(n) - n), n)
                below = self.children[begin + np.arange(n.sum())]
                follow = np.abs(self.edge[below] - np.repeat(far, n)) <= radius
                query, node = np.repeat(query, n)[follow], below[follow]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put a and b of each pair in one set; ``root`` names each element's set, by its least element."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def shard_links(groups: np.ndarray, fps: np.ndarray, roles: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in groups of fingerprints.

    roles: 0 is in the tree and searches it, 1 is only in the tree, 2 only searches.
    """
    order = np.lexsort((fps, groups))
    groups, fps, roles = groups[order], fps[order], roles[order]
    root = np.arange(len(fps))
    inside, asks = np.flatnonzero(roles != 2), np.flatnonzero(roles != 1)
    forest = Forest(groups[inside], fps[inside])
    for query, node in forest.search(groups[asks], fps[asks], radius):
        unite(root, asks[query], inside[node])
    linked = np.flatnonzero(root != np.arange(len(root)))
    return fps[linked], fps[root[linked]]


def block_pairs(radius: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Two (first bit, bits) of each pair of blocks."""
    n = radius + 2
    stops = [64 * i // n for i in range(n + 1)]
    return list(combinations([(a, b - a) for a, b in zip(stops, stops[1:], strict=False)], 2))


def links(fps: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """Links (a, b) between distinct ``fps`` (fp) whose components are those of all pairs within ``radius``."""

    def bits(at: tuple[int, int]):
        return F.shiftrightunsigned("fp", at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))

    shards = [
        F.struct(F.lit(k).alias("pair"), F.shiftleft(bits(a), 32).bitwiseOR(bits(b)).alias("value"))
        for k, (a, b) in enumerate(block_pairs(radius))
    ]
    keyed = fps.select("fp", F.inline(F.array(*shards)))
    hot = materialise(keyed.groupBy("pair", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece), "hot-shards")
    last = F.ceil(F.coalesce("n", F.lit(1)) / piece) - 1
    cut = (
        keyed.join(hot, ["pair", "value"], "left")
        .withColumn("last", last)
        .withColumn("mine", F.when(F.col("last") > 0, F.pmod(F.xxhash64("fp"), F.col("last") + 1)).otherwise(F.lit(0).cast("long")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    )
    role = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    dealt = cut.select("pair", "value", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "fp", role.alias("role"))
    group = F.xxhash64("pair", "value", "low", "high")
    # Groups whose hashes collide are searched as one, which can only find true links.
    rows = dealt.select(group.alias("g"), "fp", "role").repartition("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if held:
            g, fp, roles = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = shard_links(g, fp.view(np.uint64), roles, radius)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The least node (root) of each node's component, for nodes with an edge (a, b)."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state = materialise(down, "edges")
    mark = None
    while True:
        # Large star: neighbours above a node go to the least around it.
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        # Small star: neighbours below a node, and it, go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        state = materialise(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id reachable, for each row of ``docs`` (doc_id, text)."""
    fps = materialise(fingerprints(docs, width), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius, piece))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Only components of two or more are joined back, by one row each; a component's root has no row of its own in ``roots``.
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "component_id")
    of_fp = placed.join(few(materialise(named, "named"), BROADCAST_KEYS), "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(materialise(of_fp, "components"), "fp").select("doc_id", "fp", "component_id")


def signature(text: bytes, width: int, keys: np.ndarray) -> tuple[int, int, list[int]]:
    """Of a text: a hash of its words, the SimHash of its set of shingles, and a hash for each band of its MinHash."""
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    own = xxhash.xxh64_intdigest(joined, SEED)
    if not words:
        return own, 0, [0] * BANDS
    hashes = np.unique(shingle_hashes(words, joined, width))
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(keys), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), 4096):
        least = np.minimum(least, (short[at : at + 4096, None] * keys[None, :]).min(axis=0))
    return own, majority(hashes), [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def signatures(docs: DataFrame, width: int = SIMILAR_WIDTH) -> DataFrame:
    """doc_id, key (equal for texts of equal words), fp and bands for each row of ``docs``."""
    keys = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t, width, keys) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            own, fps = (np.array([x[k] for x in found], dtype="<u8").view("<i8") for k in (0, 1))
            bands = np.array([x for *_, b in found for x in b], dtype="<u8").view("<i8")
            yield pa.record_batch(
                [batch.column(0), pa.array(own), pa.array(fps), pa.ListArray.from_arrays(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32), pa.array(bands))],
                names=["doc_id", "key", "fp", "bands"],
            )

    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    longs = [T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *longs]))


def words_of(text: Column) -> Column:
    return pieces(ascii_lower(text_or_empty(text)), WHITESPACE)


def key_of(text: Column) -> Column:
    """The key that ``signatures`` gives a text."""
    return F.xxhash64(F.array_join(words_of(text), " "))


def alike(starts: np.ndarray, tokens: np.ndarray, roles: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a group of sets, enough of them to join what all pairs of ``similarity`` or more join.

    Set i is ``tokens[starts[i]:starts[i + 1]]``, without repeats. roles: 0 meets
    all others, 1 only those of 2, 2 only those of 1. Only pairs whose ends are
    linked already, or whose sizes rule it out, aren't measured.
    """
    n, sizes = len(roles), np.diff(starts)
    values, of = np.unique(tokens, return_inverse=True)
    mark, root, found = np.zeros(len(values), dtype=bool), np.arange(n), []
    place = np.arange(n)
    for i in np.flatnonzero(roles != 1):
        fits = (root != root[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        others = np.flatnonzero(fits & (place > i) & (roles == 0) if roles[i] == 0 else fits & (roles == 1))
        if not len(others):
            continue
        mine = of[starts[i] : starts[i + 1]]
        mark[mine] = True
        ends = np.cumsum(sizes[others])
        at = np.arange(ends[-1]) + np.repeat(starts[others] - (ends - sizes[others]), sizes[others])
        hits = np.concatenate([[0], np.cumsum(mark[of[at]])])
        mark[mine] = False
        shared = hits[ends] - hits[ends - sizes[others]]
        near = others[shared >= similarity * (sizes[i] + sizes[others] - shared)]
        if len(near):
            sets, first = np.unique(root[near], return_index=True)
            found += [(int(i), int(j)) for j in near[first]]
            root[np.isin(root, sets)] = root[i]
    return found


def candidate_groups(distinct: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """key, shard and n (members of the shard) of all groups of ``distinct`` (key, fp, bands) with two members or more."""
    roots = components(links(distinct.select("fp").distinct(), radius, piece))
    trees = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("key", F.xxhash64(F.lit(-1), F.coalesce("root", "fp")).alias("shard"))
    bands = distinct.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("shard"))
    keyed = materialise(trees.unionAll(bands), "bands")
    members = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"m{k}") for k in range(2)]
    shared = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *members).where("n > 1")
    once = shared.groupBy("n", "m0", "m1").agg(F.min("shard").alias("shard"))
    return keyed.join(once.select("shard", "n"), "shard")


def similar_links(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY, width: int = SIMILAR_WIDTH, piece: int = PIECE) -> DataFrame:
    """Links (a, b) of keys, whose components are those of all pairs that share a group and are ``similarity`` alike or more.

    ``found`` are the signatures of ``docs``.
    """
    distinct = materialise(found.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    met = materialise(candidate_groups(distinct, piece=piece), "shared-groups")
    wanted = materialise(met.select("key").distinct(), "met")
    texts = docs.select(key_of(F.col("text")).alias("key"), "text").join(few(wanted, BROADCAST_KEYS), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = materialise(texts.select("key", F.array_distinct(jvm_shingles(words_of(F.col("text")), width)).alias("set")), "shingle-sets")
    last = F.ceil(F.col("n") / piece) - 1
    cut = (
        met.withColumn("last", last)
        .withColumn("mine", F.when(F.col("last") > 0, F.pmod(F.xxhash64("key"), F.col("last") + 1)).otherwise(F.lit(0).cast("long")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    )
    role = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    group = F.xxhash64("shard", F.least("mine", "other"), F.greatest("mine", "other"))
    # Groups whose hashes collide are measured as one, which can only find true links.
    rows = cut.select(group.alias("g"), "key", role.alias("role")).join(sets, "key").select("g", "key", "role", "set").repartition("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        g, key, roles = (table.column(c).to_numpy() for c in ("g", "key", "role"))
        lists = table.column("set").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        starts, tokens = lists.offsets.to_numpy(), lists.values.to_numpy()
        order = np.lexsort((key, g))
        bounds = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1], [True]]))
        pairs = []
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if end - begin > 1:
                own = order[begin:end]
                parts = [tokens[starts[k] : starts[k + 1]] for k in own]
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                pairs += [(key[own[i]], key[own[j]]) for i, j in alike(at, np.concatenate(parts), roles[own], similarity)]
        ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def similar_roots(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key, root of its component, n rows and the least doc_id of them (null only if all are), for each key of ``found``, the signatures of ``docs``."""
    roots = components(similar_links(docs, found, similarity))
    rows = found.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    return rows.join(roots, F.col("key") == F.col("node"), "left").select("key", "least", "n", F.coalesce("root", "key").alias("root"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one with the least doc_id, nulls last.

    Groups are of rows, by their texts alone: rows that share a doc_id, or have
    none, are told apart by their words.
    """
    found = materialise(signatures(docs), "signatures")
    placed = materialise(similar_roots(docs, found, similarity), "similar")
    best = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("key").alias("key"))).alias("best")
    groups = placed.groupBy("root").agg(best, F.sum("n").alias("n")).where("n > 1").select("root", "best")
    decided = placed.join(groups, "root").select(F.col("key").alias("_key"), F.col("best.id").alias("_id"), (F.col("best.key") == F.col("key")).alias("_first"))
    twice = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("_key2"), F.col("doc_id").alias("_id2"))
    again = decided.join(twice, (F.col("_key") == F.col("_key2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left")
    decided = materialise(again.select("_key", "_id", "_first", F.col("_key2").isNotNull().alias("_again")), "decided")
    met = docs.withColumn("_own", key_of(F.col("text"))).join(few(decided, BROADCAST_KEYS), F.col("_own") == F.col("_key"), "left")
    kept = met.where(F.col("_key").isNull() | (F.col("_first") & F.col("doc_id").eqNullSafe(F.col("_id"))))
    if not decided.where("_first and _again").limit(1).count():
        return kept.select(*docs.columns)
    repeated = F.coalesce("_again", F.lit(False))
    return kept.where(~repeated).select(*docs.columns).unionByName(kept.where(repeated).dropDuplicates(["_own"]).select(*docs.columns))
