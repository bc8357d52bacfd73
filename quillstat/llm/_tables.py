"""Shared storage and size-checked joins."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most a few dozen bytes that may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); one of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillstat-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send at most ``rows`` rows at a time to Python, for rows that hold whole texts; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`store` wrote for ``tables``, of which nothing may be read again, and let Spark drop the shuffle files of plans that are gone."""
    for t in tables:
        forget(t.stored_at, t.sparkSession)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def forget(df_path: str, spark: SparkSession) -> None:
    """Delete a table written by :func:`store` that nothing will read again."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a count proves ``df`` is small; otherwise leave the join to shuffle. ``df`` should be stored."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lower_az(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(column, m: int):
    """crc32 of a value as text, modulo m."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % m


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def keyed_rows(docs: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """(row, own_id, own_digest): each row whole, so that no column of docs can clash with ours; ``row.*`` gives docs back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), digest.alias("own_digest"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """:func:`keyed_rows` without those of the stored table ``gone`` (gone_id, gone_digest)."""
    return rows.join(small(gone), F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_digest") == F.col("gone_digest")), "left_anti")
