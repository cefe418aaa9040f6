"""URL filters over sorted digest arrays.

A list of keys, each a host or a host with the start of a path, becomes index
shards: the XXH64 digests of its keys in ascending order, next to offsets into
the keys' full texts and a byte of what each does. Workers map a shard into
memory, look all candidates of a batch up by one vectorised binary search, and
compare the stored text before they believe a digest.

A URL's candidates are its host and each parent domain, alone and with every
length of path start that the list has. The longest key that fits decides;
``listed`` keys only give the verdict where no rule fits.

Up to ``OPEN_SHARDS`` shards are mapped by every worker, next to the pages. Of a
larger index each shard is mapped by one task: the distinct hosts and paths send
their candidates to the shards of their digests, and what fits is joined back.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and no rule. Very long URLs have as many candidates as labels and lengths of
path starts in the list. Of equally long keys the one with the longer host
decides. Keys repeated in a list count once, ``block`` before ``allow`` before
``listed``. An empty list allows everything, an empty table gives no rows.
Repeated rows and null page_ids are returned as they are. Other columns are
ignored.
"""

from __future__ import annotations

import json
import string
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.storage import AtomicFile, filesystem, local_table, make_dir, materialise, read_bytes

ACTIONS = ("block", "allow", "listed")
#: Keys in a shard: at 40 bytes a key, about 60 MB mapped.
SHARD_KEYS = 1_000_000
#: Shards that a worker maps at most: 500 MB of a shared page cache, or of its own memory where the folder isn't local.
OPEN_SHARDS = 8
#: The rules (host, path start, what it does) and the listed hosts.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LISTED = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
    for top in ("com", "net", "org")
)


def default_list(spark: SparkSession) -> DataFrame:
    rows = [(h, p, a) for h, p, a in RULES] + [(h, "", "listed") for h in LISTED]
    return local_table(spark, rows, "host string, path string, action string")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def build_index(keys: DataFrame, folder: str, shard_keys: int = SHARD_KEYS) -> dict:
    """Write ``keys`` (host, path, action) as index shards in ``folder``; returns what readers need."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")) - 1
    rows = keys.select("host", F.coalesce("path", F.lit("")).alias("path"), rank.alias("rank")).where("host is not null and rank >= 0")
    rows = materialise(rows.groupBy("host", "path").agg(F.min("rank").cast("int").alias("rank")), "url-keys")
    total = rows.count()
    lengths = sorted(r[0] for r in rows.select(F.char_length("path")).distinct().collect())
    shards = max(1, -(-total // shard_keys))
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list] = {}
        for batch in batches:
            for host, path, rank in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                full = f"{host}\n{path}".encode()
                digest = xxhash.xxh64_intdigest(full)
                by_shard.setdefault(digest % shards, []).append((digest, full, rank))
        for shard, found in by_shard.items():
            found.sort()
            digests = np.array([d for d, _, _ in found], dtype="<u8")
            offsets = np.cumsum([0] + [len(t) for _, t, _ in found], dtype="<u8")
            with AtomicFile(f"{folder}/shard-{shard:05d}") as out:
                out.write(struct.pack("<Q", len(found)) + digests.tobytes() + offsets.tobytes())
                out.write(bytes(r for _, _, r in found) + b"".join(t for _, t, _ in found))
            yield pa.record_batch([pa.array([shard], pa.int32())], names=["shard"])

    own = rows.withColumn("shard", F.lit(0)) if shards == 1 else rows.withColumn("shard", _shard(shards)(F.col("host"), F.col("path")))
    written = own.repartition(shards, "shard").mapInArrow(write, "shard int")
    present = sorted({r[0] for r in materialise(written, "url-shards").collect()})
    about = {"folder": folder, "shards": shards, "present": present, "lengths": lengths}
    with AtomicFile(f"{folder}/about.json") as out:
        out.write(json.dumps(about).encode())
    return about


def _shard(shards: int):
    @F.pandas_udf(T.IntegerType())
    def of(host, path):
        return (host + "\n" + path).map(lambda k: xxhash.xxh64_intdigest(k.encode()) % shards).astype("int32")

    return of


class Shard:
    """One mapped shard."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.data = np.memmap(path, mode="r", dtype=np.uint8) if fs.type_name == "local" else np.frombuffer(read_bytes(uri), dtype=np.uint8)
        n = int(self.data[:8].view("<u8")[0])
        self.digests = self.data[8 : 8 + 8 * n].view("<u8")
        self.offsets = self.data[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.ranks = self.data[16 + 16 * n : 16 + 17 * n]
        self.texts = self.data[16 + 17 * n :]

    def find(self, digests: np.ndarray, keys: Sequence[bytes]) -> np.ndarray:
        """The rank of each key, or -1. Equal digests stand together, so a collision looks on to the next."""
        out = np.full(len(keys), -1, dtype=np.int64)
        at = np.searchsorted(self.digests, digests)
        for k in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests):
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == digests[k]:
                if self.texts[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes() == keys[k]:
                    out[k] = self.ranks[i]
                    break
                i += 1
        return out


@lru_cache(maxsize=OPEN_SHARDS)
def _open(folder: str, shard: int) -> Shard:
    return Shard(f"{folder}/shard-{shard:05d}")


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """The keys that may fit a URL."""
    labels = host.split(".")
    for i in range(len(labels)):
        parent = ".".join(labels[i:])
        if parent:
            for length in lengths:
                if length <= len(path):
                    yield f"{parent}\n{path[:length]}"


def judge(rows: list[tuple[str, str]], about: dict) -> list[tuple[str | None, str]]:
    """Rule (or None) and verdict for each host and path."""
    keys, owners = [], []
    for n, (host, path) in enumerate(rows):
        own = list(candidates(host, path, about["lengths"]))
        keys += own
        owners += [n] * len(own)
    full = [k.encode() for k in keys]
    digests = np.array([xxhash.xxh64_intdigest(k) for k in full], dtype="<u8")
    ranks = np.full(len(full), -1, dtype=np.int64)
    for shard in about["present"]:
        mine = np.flatnonzero(digests % np.uint64(about["shards"]) == shard)
        if len(mine):
            ranks[mine] = _open(about["folder"], shard).find(digests[mine], [full[k] for k in mine])
    best: dict[int, tuple] = {}
    listed = set()
    for k in np.flatnonzero(ranks >= 0):
        n, action = owners[k], ACTIONS[ranks[k]]
        if action == "listed":
            listed.add(n)
        else:
            host, _, path = keys[k].partition("\n")
            best[n] = max(best.get(n, ((-1, -1),)), ((len(host) + len(path), len(host)), host + path, action), key=lambda x: x[0])
    return [best[n][1:] if n in best else (None, "block" if n in listed else "allow") for n in range(len(rows))]


def by_shard(rows: DataFrame, about: dict) -> DataFrame:
    """``rows`` (with host and path) with rule and verdict; each shard is searched by the tasks that its candidates go to."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, p, k, xxhash.xxh64_intdigest(k.encode())) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in candidates(h, p, about["lengths"])]
            h, p, k, d = zip(*found, strict=True) if found else ([], [], [], [])
            digests = np.array(d, dtype="<u8")
            shards = (digests % np.uint64(about["shards"])).astype(np.int32)
            yield pa.record_batch([pa.array(h, pa.string()), pa.array(p, pa.string()), pa.array(k, pa.string()), pa.array(digests.view("<i8")), pa.array(shards)], names=["host", "path", "key", "digest", "shard"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, digests = batch.column(4).to_numpy(), batch.column(3).to_numpy().view("<u8")
            keys = [k.encode() for k in batch.column(2).to_pylist()]
            ranks = np.full(len(keys), -1, dtype=np.int64)
            for shard in np.intersect1d(shards, about["present"]).tolist():
                mine = np.flatnonzero(shards == shard)
                ranks[mine] = _open(about["folder"], shard).find(digests[mine], [keys[k] for k in mine])
            hit = pa.array(ranks >= 0)
            yield pa.record_batch([*(c.filter(hit) for c in batch.columns[:3]), pa.array(ranks[ranks >= 0].astype(np.int32))], names=["host", "path", "key", "rank"])

    sites = rows.where("host <> ''").select("host", "path").distinct()
    asked = sites.mapInArrow(spread, "host string, path string, key string, digest long, shard int")
    found = asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(probe, "host string, path string, key string, rank int")
    action = F.get(F.array(*map(F.lit, ACTIONS)), F.col("rank"))
    length, own = F.char_length("key") - 1, F.instr("key", "\n") - 1
    rule = F.max(F.when(action != "listed", F.struct(length.alias("n"), own.alias("h"), F.regexp_replace("key", "\n", "").alias("rule"), action.alias("action")))).alias("best")
    decided = found.groupBy("host", "path").agg(rule, F.max(action == "listed").alias("listed"))
    verdict = F.when(F.col("best").isNotNull(), F.col("best.action")).when(F.col("listed"), "block").otherwise("allow")
    return rows.join(decided, ["host", "path"], "left").select(*rows.columns, F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def filter_urls(pages: DataFrame, about: dict) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of ``pages`` (page_id, url)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), about)
            yield pa.record_batch(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if about["shards"] > OPEN_SHARDS:
        return by_shard(rows, about)
    strings = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    return rows.mapInArrow(run, T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), *strings]))
