"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of a text, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``, whatever store the path is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: a local one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="proofloom-")


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> "F.Column":
    """All columns as one struct: beside it, no name of theirs can clash with another one."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/proofloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` wrote and that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def unit(*cols) -> "F.Column":
    """A reproducible number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / float(1 << 40)


@contextmanager
def frugal(spark: SparkSession, rows: int = 2000):
    """Batches of texts for Python in few rows, so that a worker holds little at a time; a smaller setting stays.

    Holds for what is run inside, and for plans that are made and run later only if the session says so itself.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidied(run):
    """``run``, a function over batches, whose worker gives memory back when it ends: workers live on from task to task."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # only glibc has it
                pass

    return whole
