"""Operator 3: conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity``; full pieces fill a bin of their own, the others are packed
best-fit-decreasing.  A bin carries a bitmap of its sources and one of its duplicate clusters; a piece may not join a
bin that already holds its source or its cluster.  Bins are ordered by residual space, and the search starts at the
smallest residual that fits and goes on to the successor until the bin is compatible, hence the tightest compatible bin.

Packing is sequential, so the corpus is dealt by hash into groups of about ``GROUP_ROWS`` rows that are packed side by
side; a hot source or cluster is spread over all groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.registry import query
from kinweave.llm.store import row_numbers, stored, table

CAPACITY = 8192
GROUP_ROWS = 4096
SEED = 20240607


def best_fit(lengths: Sequence[int], sources: Sequence[int], clusters: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the given order.  Sources and clusters are small non-negative numbers."""
    residual_order: list[tuple[int, int]] = []  # (residual, bin), ascending
    in_source: list[int] = []
    in_cluster: list[int] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        source_bit, cluster_bit = 1 << source, 1 << cluster
        at = bisect_left(residual_order, (length, -1))
        while at < len(residual_order):
            b = residual_order[at][1]
            if not (in_source[b] & source_bit or in_cluster[b] & cluster_bit):
                break
            at += 1
        if at < len(residual_order):
            residual, b = residual_order.pop(at)
        else:
            residual, b = capacity, len(in_source)
            in_source.append(0)
            in_cluster.append(0)
        in_source[b] |= source_bit
        in_cluster[b] |= cluster_bit
        bins.append(b)
        offsets.append(capacity - residual)
        if residual > length:
            insort(residual_order, (residual - length, b))
    return bins, offsets


def _numbered(column: pa.ChunkedArray) -> list[int]:
    """Values as numbers 0, 1, ...; null is a value of its own."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist()


def pack(
    docs: DataFrame, length: str, source: str, cluster: str, keys: Sequence[str], capacity: int = CAPACITY, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per piece: ``keys``, ``piece, piece_start, piece_length, bin_group, bin, bin_offset``.

    A null or negative length counts as 0; pieces of length 0 still occupy a place.  Null sources and clusters are
    values of their own.  Rows may repeat; ties are packed in the order of the keys, then of the input.
    """
    docs = stored(docs)
    rows = row_numbers(docs)(
        *keys, F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("__length"),
        F.col(source).cast("string").alias("__source"), F.col(cluster).cast("string").alias("__cluster"),
    ).withColumnRenamed("row", "__row")
    groups = max(1, -(-docs.count() // group_rows))
    rows = rows.withColumn("bin_group", F.pmod(F.xxhash64(F.lit(SEED), *keys, "__row"), F.lit(groups)))
    cut = F.expr(f"sequence(0L, greatest(0L, (__length - 1) div {capacity}))")
    pieces = rows.withColumn("piece", F.explode(cut)).withColumn("piece_start", F.col("piece") * capacity)
    pieces = pieces.withColumn("piece_length", F.least(F.col("__length") - F.col("piece_start"), F.lit(capacity)))
    shape = pieces.drop("__length", "__source", "__cluster", "__row").schema.add("bin", "long").add("bin_offset", "long")

    def packed(group: pa.Table) -> pa.Table:
        order = [("piece_length", "descending"), *[(k, "ascending") for k in keys], ("__row", "ascending"), ("piece", "ascending")]
        group = group.sort_by(order)
        bins, offsets = best_fit(
            group.column("piece_length").to_pylist(), _numbered(group.column("__source")), _numbered(group.column("__cluster")), capacity
        )
        group = group.append_column("bin", pa.array(bins, pa.int64())).append_column("bin_offset", pa.array(offsets, pa.int64()))
        return group.select([f.name for f in shape.fields])

    return pieces.groupBy("bin_group").applyInArrow(packed, shape)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``documents`` by UTF-8 length plus an end mark; copies up to the case of A-Z are one duplicate cluster."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = docs.select("doc_id", "source", (F.octet_length(text) + 1).alias("length"), F.sha2(lowered.cast("binary"), 256).alias("cluster"))
    return pack(known, "length", "source", "cluster", ["doc_id"], capacity).select(
        "doc_id", "piece", "piece_start", "piece_length", "bin_group", "bin", "bin_offset"
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
