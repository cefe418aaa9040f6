"""Token counts of flat, unindexed token files, by a scan for end-of-document ids.

A file is nothing but ids of one number type. It is cut into blocks of equal
length, without regard to documents. One pass finds each block's separators and
keeps their number and the last one's place; a prefix scan over the blocks of a
file carries both forward, so that a second pass numbers every document and
knows where one began that spans blocks, however many.

Defined cases: ids after the last separator are a document that is not
``ended``. Two separators in a row enclose an empty document, which counts its
separator. An empty file has no documents, an empty table no files. Null texts
are written as empty ones, very long ones over as many blocks as they fill; rows
are written in the order they are read, null and repeated doc_ids too. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import tokenizing
from quire.llm.storage import AtomicFile, make_dir, materialise, read_bytes, scratch
from quire.llm.textcols import text_or_empty

#: Ids in a block: 8 MB of two-byte ids.
BLOCK = 4_000_000
#: <|endoftext|> in the default vocabulary.
END = 49407


def write_flat(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` (doc_id, text) as flat files in ``folder``, without a shuffle.

    Returns the files (file, part, ids) and, apart from them, who was written
    where (part, ordinal, doc_id).
    """
    tokenizer = tokenizer or tokenizing.default_path()
    dtype = tokenizing.id_type(tokenizer)
    tail = np.array([end], dtype=dtype).tobytes()
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = tokenizing.memo_tokenizer(tokenizer, dtype, True).encode
        uri, written, done = f"{folder}/part-{part:06d}.bin", 0, 0
        with AtomicFile(uri) as out:
            for batch in batches:
                for text in batch.column(1).cast(pa.binary()):
                    written += out.write(encode(text.as_py()) + tail)
                n = batch.num_rows
                yield pa.record_batch(
                    [pa.array([uri] * n), pa.array([part] * n, pa.int32()), pa.array(np.arange(done, done + n)), batch.column(0), pa.array([written // len(tail)] * n)],
                    names=["file", "part", "ordinal", "doc_id", "ids"],
                )
                done += n

    schema = T.StructType(
        [T.StructField("file", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("ordinal", T.LongType())]
        + [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.LongType())]
    )
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    placed = materialise(rows.mapInArrow(write, schema), "flat-files")
    files = placed.groupBy("file", "part").agg(F.max("ids").alias("ids"))
    return files, placed.select("part", "ordinal", "doc_id")


def scan_separators(files: DataFrame, ends: Sequence[int] = (END,), dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """The documents of flat ``files`` (file, part, ids): part, ordinal, start, n_tokens, ended."""
    width = np.dtype(dtype).itemsize
    wanted = np.array(sorted(ends), dtype=dtype)

    def separators(row: dict) -> np.ndarray:
        data = read_bytes(row["file"], row["at"] * width, row["length"] * width)
        ids = np.frombuffer(data, dtype=dtype)
        found = ids == wanted[0] if len(wanted) == 1 else np.isin(ids, wanted)
        return np.flatnonzero(found) + row["at"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [separators(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(x) for x in found], pa.int64()), pa.array([int(x[-1]) if len(x) else None for x in found], pa.int64())],
                names=[*batch.schema.names, "ends", "last"],
            )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stops = separators(row)
                if row["closes"] and (len(stops) or row["before"] + 1 < row["ids"]) and (stops[-1] if len(stops) else row["before"]) + 1 < row["ids"]:
                    stops = np.append(stops, row["ids"] - 1)
                    ended = np.arange(len(stops)) < len(stops) - 1
                else:
                    ended = np.ones(len(stops), dtype=bool)
                starts = np.concatenate([[row["before"]], stops[:-1]])[: len(stops)] + 1
                yield pa.record_batch(
                    [pa.array(np.full(len(stops), row["part"], np.int32)), pa.array(row["ordinal"] + np.arange(len(stops))), pa.array(starts.astype(np.int64)), pa.array((stops - starts + 1).astype(np.int64)), pa.array(ended)],
                    names=["part", "ordinal", "start", "n_tokens", "ended"],
                )

    cut = files.where("ids > 0").select("file", "part", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ids") - 1, F.lit(block).cast("long"))).alias("at"))
    blocks = cut.withColumn("length", F.least(F.lit(block).cast("long"), F.col("ids") - F.col("at"))).repartition("part", "at")
    counted = materialise(blocks.mapInArrow(count, T.StructType([*blocks.schema.fields, T.StructField("ends", T.LongType()), T.StructField("last", T.LongType())])), "blocks")
    earlier = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = counted.select(
        *counted.columns,
        F.coalesce(F.sum("ends").over(earlier), F.lit(0).cast("long")).alias("ordinal"),
        F.coalesce(F.max("last").over(earlier), F.lit(-1).cast("long")).alias("before"),
        (F.col("at") + F.col("length") == F.col("ids")).alias("closes"),
    )
    return carried.repartition("part", "at").mapInArrow(number, "part int, ordinal long, start long, n_tokens long, ended boolean")


def count_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """Write ``docs`` flat, scan the files, and name the documents found: doc_id, part, start, n_tokens, ended."""
    tokenizer = tokenizer or tokenizing.default_path()
    files, placed = write_flat(docs, folder or scratch(docs.sparkSession, "flat"), tokenizer)
    found = scan_separators(files, (END,), tokenizing.id_type(tokenizer), block)
    return placed.join(found.hint("merge"), ["part", "ordinal"]).select("doc_id", "part", "start", "n_tokens", "ended")
