"""Global order, ranks and running sums without a single-task window.

``row_number() over (order by ...)`` and windows over one hot key put the whole
group into one task.  Here rows are range-partitioned and sorted, stored once
(so a lost executor cannot move the boundaries), and the totals of each range -
one row per partition - turn local positions into global ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.literals import array_of
from kinweave.session import cut

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _add_local_sums(df: DataFrame, sums: Sequence[str]) -> DataFrame:
    schema = T.StructType(df.schema.fields + [T.StructField(f"__run_{c}", df.schema[c].dataType) for c in sums])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        carry = dict.fromkeys(sums, 0)
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for c in sums:
                values = batch.column(c)
                total = pc.cumulative_sum(values, start=pa.scalar(carry[c], values.type), skip_nulls=True)
                if len(total):
                    carry[c] = total[-1].as_py()
                columns.append(total)
                names.append(f"__run_{c}")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def with_position(
    df: DataFrame, order: Sequence[str | Column], sums: Sequence[str] = (), position: str = "position"
) -> DataFrame:
    """Add the 0-based global ``position`` of each row in ``order``.

    For every column in ``sums`` (non-null integers or doubles) also add
    ``run_<column>``, its inclusive running sum in that order.  Rows that tie in ``order`` are told apart by their
    place in the input, so that a frequent value is dealt to several tasks.
    """
    df = df.withColumn("__tie", F.monotonically_increasing_id())
    order = [*order, "__tie"]
    for c in sums:
        wide = "double" if df.schema[c].dataType.typeName() in ("double", "float") else "bigint"
        df = df.withColumn(c, F.coalesce(F.col(c).cast(wide), F.lit(0).cast(wide)))
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if sums:
        laid = _add_local_sums(laid, sums)
    stored = cut(laid.drop("__tie").withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", _LOCAL_BITS)
    # one row per partition reaches the driver
    totals = (
        stored.groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
        .orderBy("part")
        .collect()
    )
    width = int(totals[-1]["part"]) + 1 if totals else 1
    before = {name: [0] * width for name in ("n", *sums)}
    running = dict.fromkeys(before, 0)
    by_part = {int(r["part"]): r for r in totals}
    for p in range(width):
        for name in before:
            before[name][p] = running[name]
            if p in by_part:
                running[name] += by_part[p][name]
    slot = (part + 1).cast("int")

    def offset(name: str, kind: str) -> Column:
        return F.element_at(array_of(before[name]), slot).cast(kind)

    out = stored.withColumn(
        position, offset("n", "bigint") + F.col("__mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    )
    for c in sums:
        out = out.withColumn(f"run_{c}", offset(c, out.schema[c].dataType.simpleString()) + F.col(f"__run_{c}"))
    return out.drop("__mid", *[f"__run_{c}" for c in sums])


def with_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    sums: Sequence[str] = (),
    rank: str = "rank",
) -> DataFrame:
    """1-based ``rank`` inside each group, and group-wise running sums ``run_<column>``.

    A group may be arbitrarily large: only its start offset is looked up.
    """
    placed = with_position(df, [*group, *order], sums=sums, position="__position")
    starts = placed.groupBy(*group).agg(
        F.min("__position").alias("__first"),
        *[F.min_by(F.col(f"run_{c}") - F.col(c), F.col("__position")).alias(f"__start_{c}") for c in sums],
    )
    out = placed.join(starts, list(group)).withColumn(rank, F.col("__position") - F.col("__first") + 1)
    for c in sums:
        out = out.withColumn(f"run_{c}", F.col(f"run_{c}") - F.col(f"__start_{c}"))
    return out.drop("__position", "__first", *[f"__start_{c}" for c in sums])


def dense_ids(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Surrogate keys ``start, start+1, ...`` in the given order."""
    return with_position(df, order, position=name).withColumn(name, F.col(name) + F.lit(start))


def exact_quantiles(df: DataFrame, column: str, levels: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles from global positions; two rows per level reach the driver."""
    placed = with_position(df.select(column).where(F.col(column).isNotNull()), [column])
    n = placed.count()
    if n == 0:
        return [float("nan")] * len(levels)
    at = [level * (n - 1) for level in levels]
    wanted = sorted({p for h in at for p in (int(h), min(int(h) + 1, n - 1))})
    values = {r["position"]: r[column] for r in placed.where(F.col("position").isin(wanted)).collect()}
    out = []
    for h in at:
        low, high = values[int(h)], values[min(int(h) + 1, n - 1)]
        out.append(low + (high - low) * (h - int(h)))
    return out
