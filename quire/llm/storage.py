"""The folder that driver and executors share, and files in it.

Every intermediate result goes below ``spark.checkpoint.dir``. A session on one
machine (tests, notebooks) that has no such setting uses one local folder per
application instead; on a cluster the setting must be there. Binary files are opened through ``pyarrow.fs``, so the folder may
be ``file:``, ``hdfs:``, ``s3:`` or ``gs:``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a final slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls give the same. It is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/quire/{spark.sparkContext.applicationId}"
    if folder not in _own:
        _own[folder] = folder
        atexit.register(remove, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(uri: str) -> None:
    """Delete a folder and all in it, if it is there."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what is
    above, and ids drawn while writing are fixed from then on.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with a broadcast hint if a count shows them to be no more than ``most``; take written tables, they are read twice."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of the driver's rows, through Arrow: rows as Python objects would start more Python workers to read them."""
    kind = T.StructType.fromDDL(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in kind]
    arrays = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, kind.names), kind)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)


def has_files(uri: str) -> bool:
    """Whether a folder is there and has something in it."""
    fs, path = filesystem(uri)
    return bool(fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)))


class AtomicFile:
    """An output stream whose file appears under its name only when whole.

    Each attempt writes to a name of its own, and the last rename wins, so a
    task that runs twice leaves one complete file.
    """

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.stream = self.fs.open_output_stream(self.temporary)
        return self.stream

    def __exit__(self, kind, value, trace):
        self.stream.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)


def read_bytes(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    """``length`` bytes from ``offset`` on, or all to the end."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)
