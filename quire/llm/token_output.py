"""Token-id files of independent Zstandard frames with a trailing seek table.

A file holds documents in ascending doc_id: one frame of ids for each, with a
stop id at its end, after a skippable frame of JSON (number type, tokenizer)
and before a skippable frame with the doc_ids as an Arrow stream. The last,
skippable frame is the seek table of the Zstandard seekable format: compressed
size, decompressed size and the low 32 bits of XXH64 for each frame. Readers
fetch the table, then only the frames they want, and check their sums.

Defined cases: null and empty texts are the stop id alone. Very long texts are
one frame like others. Null doc_ids come first; repeated ones stand in order of
their text. An empty table writes no frames. Other columns are ignored. A task
that runs again writes the same bytes under a new temporary name and renames it,
so lost executors leave no part files.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import tokenizing
from quire.llm.storage import AtomicFile, filesystem, local_table, make_dir, materialise
from quire.llm.textcols import text_or_empty

STOP = 1
LEVEL = 3
#: Fixed values of the Zstandard formats.
HEAD_MAGIC, IDS_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
#: Frames that one reading task takes, and the packed bytes that it reads at a time (one frame at least).
FRAMES, READ = 8192, 4 << 20
SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class FrameFile:
    """Writes documents' frames, then their ids and the seek table."""

    def __init__(self, stream, dtype: str, about: dict):
        self.stream, self.compressor = stream, zstandard.ZstdCompressor(level=LEVEL)
        self.seek = array("I")
        self.size = self._put(skippable(HEAD_MAGIC, json.dumps({"dtype": dtype} | about).encode()))

    def _put(self, data: bytes) -> int:
        self.stream.write(data)
        return len(data)

    def add(self, ids: bytes) -> None:
        packed = self.compressor.compress(ids)
        self.seek.extend((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.size += self._put(packed)

    def close(self, doc_ids: pa.Array) -> int:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", doc_ids.type)])) as out:
            out.write_batch(pa.record_batch([doc_ids], names=["doc_id"]))
        self.size += self._put(skippable(IDS_MAGIC, sink.getvalue().to_pybytes()))
        table = np.array(self.seek, dtype="<u4").tobytes() + struct.pack("<IBI", len(self.seek) // 3, 0x80, SEEK_END)
        return self.size + self._put(skippable(SEEK_MAGIC, table))


class FrameReader:
    """Reads single documents of a file, each by its frame alone."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_END or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with sums")
        table = 12 * count
        self.seek = np.frombuffer(self.file.read_at(table, size - 9 - table), dtype=SEEK)
        head = struct.unpack("<II", self.file.read_at(8, 0))[1]
        self.about = json.loads(self.file.read_at(head, 8))
        self.dtype = np.dtype(self.about["dtype"])
        self.at = 8 + head + np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        self.counts = self.seek["plain"] // self.dtype.itemsize
        self.plain = zstandard.ZstdDecompressor()

    def doc_ids(self) -> pa.Array:
        at = int(self.at[-1])
        length = struct.unpack("<II", self.file.read_at(8, at))[1]
        return pa.ipc.open_stream(self.file.read_at(length, at + 8)).read_all()["doc_id"].combine_chunks()

    def ids(self, first: int, count: int = 1) -> Iterator[np.ndarray]:
        """The ids of ``count`` documents from the ``first`` on, read ``READ`` bytes at a time."""
        start = end = int(self.at[first])
        for k in range(first, first + count):
            a, b = int(self.at[k]), int(self.at[k + 1])
            if b > end:
                last = int(np.searchsorted(self.at[: first + count + 1], a + READ, side="right")) - 1
                start, end = a, int(self.at[max(last, k + 1)])
                data = memoryview(self.file.read_at(end - start, start))
            out = self.plain.decompress(data[a - start : b - start], max_output_size=int(self.seek["plain"][k]))
            if xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.seek["sum"][k]:
                raise ValueError(f"frame {k} doesn't have its sum")
            yield np.frombuffer(out, dtype=self.dtype)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, stop: int = STOP) -> DataFrame:
    """Write ``docs`` (doc_id, text) to files in ``folder``; one row of file, part, docs and tokens for each file.

    Parts are ranges of doc_id, so their order and that within them is ascending.
    Any file of the tokenizers library serves.
    """
    tokenizer = tokenizer or tokenizing.default_path()
    dtype = tokenizing.id_type(tokenizer)
    end = np.array([stop], dtype=dtype).tobytes()
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = tokenizing.memo_tokenizer(tokenizer, dtype).encode
        uri, ids, tokens = f"{folder}/part-{part:06d}.tok.zst", [], 0
        with AtomicFile(uri) as stream:
            out = FrameFile(stream, dtype, {"stop": stop, "tokenizer": tokenizer.rpartition("/")[2]})
            kind = None
            for batch in batches:
                kind = batch.column(0).type
                ids.append(pa.array(batch.column(0).to_pylist(), kind))  # a slice would keep the whole batch alive
                for text in batch.column(1).cast(pa.binary()):
                    data = encode(text.as_py()) + end
                    tokens += len(data) // len(end)
                    out.add(data)
            out.close(pa.concat_arrays(ids) if ids else pa.array([], kind or pa.int64()))
        yield pa.record_batch(
            [pa.array([uri]), pa.array([part], pa.int32()), pa.array([sum(map(len, ids))]), pa.array([tokens])],
            names=["file", "part", "docs", "tokens"],
        )

    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(dealt.mapInArrow(write, "file string, part int, docs long, tokens long"), "token-files")


def read_tokens(files: DataFrame, doc_id_type: T.DataType) -> DataFrame:
    """Each document of ``files``, as ``write_tokens`` returns them: doc_id, start, n_tokens, ids_crc32.

    The driver holds one row for each file.
    """
    spark, start, blocks = files.sparkSession, 0, []
    for file, docs, tokens in files.orderBy("part").select("file", "docs", "tokens").collect():
        blocks += [(file, start, first, min(FRAMES, docs - first)) for first in range(0, docs, FRAMES)]
        start += tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = FrameReader(row["file"])
                first, count = row["first"], row["count"]
                counts = reader.counts[first : first + count].astype(np.int64)
                before = row["start"] + int(reader.counts[:first].sum(dtype=np.int64))
                starts = before + np.cumsum(counts) - counts
                sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in reader.ids(first, count)]
                yield pa.record_batch(
                    [reader.doc_ids().slice(first, count), pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = T.StructType([T.StructField("doc_id", doc_id_type)] + [T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")])
    table = local_table(spark, blocks, "file string, start long, first long, count long")
    return table.repartition(max(1, len(blocks))).mapInArrow(read, schema)


def read_file(uri: str) -> list[np.ndarray]:
    """All documents' ids of a small file."""
    reader = FrameReader(uri)
    return list(reader.ids(0, len(reader.counts)))
