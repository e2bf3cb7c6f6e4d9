"""Reading tables and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.session import ensure_checkpoint_dir

BATCH_BYTES = str(8 << 20)
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_BYTES`` for the jobs inside: buffers outside the heap are several times a batch."""
    before = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_KEY)
        else:
            spark.conf.set(_BATCH_KEY, before)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from files, so a lost executor costs no recomputation."""
    folder = new_folder(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows still know their place in Parquet files, else a stored copy."""
    try:
        _places(docs)
    except AnalysisException:
        return keep(docs, "stored")
    return docs


def _places(docs: DataFrame, *columns) -> DataFrame:
    place = docs.metadataColumn("_metadata")
    return docs.select(*columns, place["file_path"].alias("__file"), place["row_index"].alias("__at"))


def row_numbers(docs: DataFrame) -> Callable[..., DataFrame]:
    """A function that selects columns of ``docs`` (see :func:`stored`) and adds ``row``, the number of the row.

    File and place in the file make the number, so every job gives a row the same one, however the files are split.
    The numbers rise with the paths of the files and the places in them.
    """
    files = sorted(r[0] for r in _places(docs).select("__file").distinct().collect())  # one path per file
    known = pa.table({"__file": pa.array(files, pa.string()), "__number": pa.array(range(len(files)), pa.int64())})
    known = F.broadcast(docs.sparkSession.createDataFrame(known))

    def select(*columns) -> DataFrame:
        placed = _places(docs, *columns).join(known, "__file")
        return placed.withColumn("row", F.shiftleft("__number", 40) + F.col("__at")).drop("__file", "__number", "__at")

    return select


def partitions_for(df: DataFrame, units: int, per_task: int) -> int:
    """Shuffle partitions for ``units`` of work, ``per_task`` each, never fewer than the session asks for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units // per_task))


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
