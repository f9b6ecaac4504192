"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a Python function handles at once; bounds what is held as Python objects.
CHUNK_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary
    one where none is set and all tasks run on this machine (a local test)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tillroll-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the shared one; it goes, with what is written there, when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def make(files, at) -> None:
        files.mkdirs(at)  # only what exists can be registered
        files.deleteOnExit(at)

    _files(spark, path, make)
    return path


def _files(spark: SparkSession, path: str, action: Callable) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    action(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


#: Folders of the innermost temporary() block that is open in this thread.
_open: ContextVar[list[str] | None] = ContextVar("open", default=None)


@contextmanager
def temporary(spark: SparkSession):
    """What :func:`cut` writes inside the block, in the same thread, is deleted at its end, but for what it was told to keep."""
    token = _open.set([])
    try:
        yield
    finally:
        folders = _open.get()
        _open.reset(token)
        for path in folders:
            _files(spark, path, lambda fs, at: fs.delete(at, True))


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` as a written table in the shared folder: lost executors cost nothing
    that lies before it, and its size is known to the planner."""
    folder = new_folder(df.sparkSession, "cut")
    here = _open.get()
    if here is not None and not keep:
        here.append(folder)
    df.write.parquet(f"{folder}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def vocabulary(name: str, path: str | None) -> str:
    """The place of a public vocabulary file; ``path`` overrides the default."""
    if path is not None:
        return os.fspath(path)
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in small slices, so that few of them are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def size_chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of the text in ``column``; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            held += int(n)
            if held >= most or i - start >= 4 * CHUNK_ROWS:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def whole(column: pa.Array) -> pa.Array:
    """A text column as 64-bit text without nulls, in buffers of its own.

    Some of Arrow's ASCII kernels misread a converted slice, so slices are copied.
    """
    return pc.fill_null(column.take(pa.array(range(len(column)), pa.int64())).cast(pa.large_string()), "")


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (where that path exists)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def release() -> None:
    """Give freed memory back to the system; reused workers and the driver would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_arrow(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow``, with this package importable in the workers, which keep no freed memory."""
    find_package(df.sparkSession)

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row.  Spark hashes no maps or variants; their text stands for them."""
    plain = lambda f: "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    columns = [F.col(f"`{f.name}`") if plain(f) else F.col(f"`{f.name}`").cast("string") for f in df.schema]
    # A null adds nothing to a hash, so the nulls' places are hashed as well.
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def text_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the identifier and the text, by position safe names, null text as empty."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
