"""Shared helpers of the corpus operators: shared storage, batch slicing, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python step handles at a time, whatever size the Arrow batch has.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where nothing is set, a fresh local one serves a
    local master, as in tests; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts the lineage,
    and a lost executor costs a re-read, not a recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the folders of materialized tables that nothing reads any more, once what is made of them is written."""
    for df in tables:
        path = getattr(df, "folder", None)
        if path:
            jvm = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(jvm, True)


def learn_split(doc_id: Column | str) -> Column:
    """True for the held-out rows: crc32 of the id as text leaves the remainder 1 modulo 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_holding: dict[str, Callable[[], None]] = {}


def hold(name: str, forget: Callable[[], None]) -> None:
    """Tells a Python worker that it is about to remember things for an operator; what it remembers for others goes.

    Workers live on from stage to stage, and their memories would add up."""
    if name not in _holding:
        for f in _holding.values():
            f()
        _holding.clear()
        _holding[name] = forget
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can, freed pages go back to the system
            ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with about `limit` bytes of `column` each."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start, size = 0, 0
        lengths = [n or 0 for n in pc.binary_length(values).to_pylist()]
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


#: Rows of a table of a few numbers each that may be sent to every task.
BROADCAST_ROWS = 500_000


def if_small(narrow: DataFrame, name: str, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """narrow (a few numbers a row), written once, to be broadcast if it is counted to have at most so many rows;
    beyond that it is joined by shuffle. size: how many rows' worth a row is, where a column is an array."""
    written = materialize(narrow, name)
    n = written.agg(F.coalesce(F.sum(F.lit(1) if size is None else 1 + size), F.lit(0))).first()[0]
    out = F.broadcast(written) if n <= rows else written
    out.folder = written.folder
    return out
