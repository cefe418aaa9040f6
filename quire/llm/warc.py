"""Dictionary-compressed WARC archives.

An archive opens with a skippable frame that holds a Zstandard dictionary,
trained on a bounded sample of the records, and goes on with one frame for each
record, so any record opens with the dictionary and its own bytes. Pages with
equal payloads are stored once: that with the largest page_id as a response,
the others as revisits that refer to it.

Defined cases: null html is the empty payload, which is deduplicated like any
other unless ``least`` forbids. Very long payloads are records like others. Null
page_ids are never larger than another. Every row is a record: of rows equal in
page_id and payload, where that is the group's largest page_id, all are
responses. An empty table writes no archives. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.storage import AtomicFile, make_dir, materialise, read_bytes, scratch
from quire.llm.textcols import text_or_empty

#: Fixed value: the magic number of a dictionary frame.
DICTIONARY_MAGIC = 0x184D2A5D
LEVEL = 3
#: The dictionary's size, and the bound of its sample: records, and characters of each.
DICTIONARY, SAMPLE, SAMPLE_CHARS = 64 << 10, 400, 16_384
#: Bytes of an archive that one reading task takes.
READ = 16 << 20
PLACED = "file string, at long, length long"


def train(sample: list[bytes]) -> bytes:
    """A dictionary, or no bytes where the sample is too small for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, sample).as_bytes() if sample else b""
    except zstandard.ZstdError:
        return b""


def record(kind: str, page_id, url: str | None, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    """A WARC record. Revisits have no block; the size of the payload they stand for has a header of its own."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, sha and ``first``: the response's page_id of each payload group, null for payloads below ``least``."""
    payload = text_or_empty(F.col("html"))
    seen = pages.select("page_id", F.sha2(payload, 256).alias("sha"), (F.octet_length(payload) >= least).alias("shared")).distinct()
    groups = seen.where("shared").groupBy("sha").agg(F.max("page_id").alias("first"))
    return seen.join(groups, "sha", "left").select("page_id", "sha", "first", F.coalesce(F.col("shared"), F.lit(False)).alias("shared"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder``; file, at and length of each record."""
    make_dir(folder)
    payload = text_or_empty(F.col("html"))
    # Chosen by id alone, so that tasks send no payloads but the sample's.
    chosen = pages.select("page_id").where("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    chosen = materialise(chosen.distinct(), "warc-sample")
    drawn = pages.join(F.broadcast(chosen), "page_id").select(F.substring(payload, 1, SAMPLE_CHARS)).limit(SAMPLE)
    dictionary = train([r[0].encode() for r in drawn.collect() if r[0]])
    known = roles(pages, least).select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "first", "shared")
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("sha"))
    met = rows.join(known, rows["page_id"].eqNullSafe(known["r_id"]) & (rows["sha"] == known["r_sha"]))
    revisit = F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first"))
    met = met.select("page_id", "url", "html", F.unhex(F.sha1("html")).alias("digest"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        with AtomicFile(uri) as out:
            at = out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
            for batch in batches:
                places = []
                for page_id, url, html, digest, kind, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in batch.columns[3:]), strict=True):
                    body = html if kind == "response" else b""
                    data = packer.compress(record(kind, page_id, url, base64.b32encode(digest).decode(), len(html), first, body))
                    places.append((at, out.write(data)))
                    at += len(data)
                yield pa.record_batch([pa.array([uri] * len(places)), pa.array([a for a, _ in places], pa.int64()), pa.array([n for _, n in places], pa.int64())], names=["file", "at", "length"])

    return materialise(met.mapInArrow(write, PLACED), "warc-records")


@lru_cache(maxsize=4)
def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


@lru_cache(maxsize=4)
def _reader(uri: str) -> zstandard.ZstdDecompressor:
    magic, size = struct.unpack("<II", read_bytes(uri, 0, 8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError(f"{uri} doesn't open with a dictionary")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(read_bytes(uri, 8, size)))


def _urn(text: str, number: bool):
    found = text.removeprefix("<urn:page:").removesuffix(">")
    return None if not found else int(found) if number else found


def read_archives(placed: DataFrame, page_id_type: T.DataType) -> DataFrame:
    """Read the records at ``placed`` (file, at, length); the payloads of responses must have their digest."""
    number = isinstance(page_id_type, (T.LongType, T.IntegerType, T.ShortType))
    runs = placed.groupBy("file", F.floor(F.col("at") / READ).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("at", "length"))).alias("places")  # no more than READ bytes of records
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places, plain = row["places"], _reader(row["file"])
                start = places[0]["at"]
                data = memoryview(read_bytes(row["file"], start, places[-1]["at"] + places[-1]["length"] - start))
                out = []
                for p in places:
                    fields, body = parse(plain.decompress(data[p["at"] - start : p["at"] - start + p["length"]]))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and base64.b32encode(_sha1(body)).decode() != digest:
                        raise ValueError(f"a payload in {row['file']} doesn't have its digest")
                    refers = fields.get("WARC-Refers-To")
                    out.append((_urn(fields["WARC-Record-ID"], number), int(fields["WARC-Payload-Length"]), digest, fields["WARC-Type"], None if refers is None else _urn(refers, number)))
                ids, sizes, digests, kinds, refers = zip(*out, strict=True)
                kind = pa.int64() if number else pa.string()
                yield pa.record_batch([pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, kind)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    wide = T.LongType() if number else T.StringType()
    schema = T.StructType([T.StructField("page_id", wide), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", wide)])
    return runs.repartition("file", "block").mapInArrow(read, schema)


def _sha1(data: bytes) -> bytes:
    return hashlib.sha1(data, usedforsecurity=False).digest()


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` and read the archives back."""
    placed = write_archives(pages, folder or scratch(pages.sparkSession, "warc"), least)
    return read_archives(placed, pages.schema["page_id"].dataType)
