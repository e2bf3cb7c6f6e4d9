"""Operator 9: two-pass external shuffle into shards.

Pass one scatters every record by seeded hashes: its shard follows from doc_id and the shard count alone, its bucket
within the shard from a hash of the record, with as many buckets as keep each within ``bucket_bytes``.  Pass two
shuffles each bucket by Fisher-Yates and writes it; a record's slot is its place in the bucket behind the buckets before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.registry import query
from kinweave.llm.store import new_folder, partitions_for, small_batches, table

SHARDS = 40
SEED = 20240607
BUCKET_BYTES = 16 << 20
TASK_BUCKETS = 8  # that a task of the second pass shuffles one after the other
RECORD_OVERHEAD = 16


def shard_of(column: str, shards: int, seed: int):
    """Highest random weight: each shard draws a hash for the key and the largest wins, so another shard only takes rows."""
    draws = f"transform(sequence(0, {shards - 1}), k -> struct(xxhash64({seed}L, k, `{column}`) as weight, k as shard))"
    return F.expr(f"array_max({draws}).shard")


def fisher_yates(n: int, *key: int) -> np.ndarray:
    """A uniform permutation drawn from ``key`` (NumPy's ``shuffle`` is the Fisher-Yates algorithm)."""
    places = np.arange(n)
    np.random.default_rng(np.random.SeedSequence(key)).shuffle(places)
    return places


def external_shuffle(
    docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Write ``docs`` to ``folder`` as shuffled shards (``shard_dir=N`` folders) and return the written rows.

    Columns: ``record`` (all columns of the row), ``size`` (UTF-8 bytes of the text plus 16; null text: 16),
    ``text_crc32``, ``shard``, ``grown_shard`` (with one more shard) and ``slot`` (0, 1, ... in each shard).  A null
    doc_id is a key of its own; rows that repeat share a shard and are spread over its buckets.  An empty table writes
    no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    total = sized.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    placed = sized.withColumns({"shard": shard_of("id", shards, seed), "grown_shard": shard_of("id", shards + 1, seed)})
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "id", "text_crc32", "row"), F.lit(buckets)))

    def shuffled(group: pa.Table) -> pa.Table:
        shard, bucket = group.column("shard")[0].as_py(), group.column("bucket")[0].as_py()
        order = np.lexsort([group.column(c).to_numpy() for c in ("row", "text_crc32")])
        order = order[fisher_yates(len(group), seed, shard, bucket)]
        return group.take(pa.array(order)).append_column("place", pa.array(np.arange(len(group)), pa.int64()))

    schema = T.StructType([*placed.schema.fields, T.StructField("place", T.LongType())])
    tasks = partitions_for(docs, shards * buckets, TASK_BUCKETS)
    done = placed.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").applyInArrow(shuffled, schema).drop("row", "id").withColumn("shard_dir", F.col("shard"))
    done = done.sortWithinPartitions("shard_dir", "bucket", "place")
    with small_batches(docs.sparkSession):
        done.write.option("compression", "zstd").partitionBy("shard_dir").parquet(folder)
    back = docs.sparkSession.read.schema(done.schema).parquet(folder).drop("shard_dir")
    counts = back.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))  # one row per bucket
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    out = back.join(starts, ["shard", "bucket"])
    return out.select("record", "size", "text_crc32", "shard", "grown_shard", (F.col("before") + F.col("place")).alias("slot"))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = external_shuffle(docs, new_folder(spark, "shards"))
    return out.select(
        F.col("record.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"),
    )
