"""Helpers shared by the corpus operators: input tables, shared-folder tables, small expressions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where
    the session names none (single-machine runs and tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("/tmp/checkpoints/tidewater")
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a reliable checkpoint; for narrow tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_stage: ContextVar[str | None] = ContextVar("stage", default=None)


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[str]:
    """Within it, tables made by ``stored`` go into one folder, which is deleted at the end: for callers of operators that
    have written the result elsewhere by then. Its name is the context's value."""
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = _stage.set(path)
    try:
        yield path
    finally:
        _stage.reset(before)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def stored(df: DataFrame, name: str, codec: str = "snappy", folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder (or that of ``stage_tables``, or the one named) and read again. Cuts
    the lineage like a checkpoint, but columnar and compressed, so wide tables stay small and columns can be pruned."""
    path = f"{folder or _stage.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` once nothing reads it any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows."""
    return df.count() <= max_rows


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text (null: of the empty text), modulo ``n``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def parts_of(batch: pa.RecordBatch | pa.Array, rows: int = 500) -> Iterator[pa.RecordBatch | pa.Array]:
    """Short slices of a batch or column; what was needed for one goes back to the system before the next."""
    pool = pa.system_memory_pool()
    pa.set_memory_pool(pool)
    for lo in range(0, len(batch) if isinstance(batch, pa.Array) else batch.num_rows, rows):
        yield batch.slice(lo, rows)
    pool.release_unused()


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches cut into short ones."""
    for b in batches:
        yield from parts_of(b, rows)
