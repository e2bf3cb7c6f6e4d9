"""Schema and value profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.specs import CONTINUOUS, DISCRETE, Domain, RelationalDataset, TableSpec


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), kind: str = "string") -> DataFrame:
    """One row per (row, column): ``keep..., column, value``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def _stack(df: DataFrame, entries: Sequence[tuple[Column, ...]], names: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(*[v.alias(n) for v, n in zip(e, names)]) for e in entries])
    return df.select(F.inline(rows))


def domain_table(df: DataFrame, spec: TableSpec, approximate: bool = False) -> DataFrame:
    """M4: (table, column, role, size); a null counts as one more value.

    ``approximate`` swaps the exact distinct count for HyperLogLog on very wide scans.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    columns = list(spec.domain.columns)
    sizes = df.agg(
        *[(distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).cast("bigint").alias(c) for c in columns]
    )
    return _stack(
        sizes,
        [(F.lit(spec.name), F.lit(c), F.lit(spec.domain.role(c)), F.col(c)) for c in columns],
        ["table_name", "column", "role", "size"],
    )


def dataset_domains(data: RelationalDataset) -> DataFrame:
    return reduce(DataFrame.unionByName, [domain_table(data.tables[t], data.specs[t]) for t in data.graph.tables])


def infer_domain(df: DataFrame, spec: TableSpec, approximate: bool = False) -> Domain:
    sizes = {r["column"]: r["size"] for r in domain_table(df, spec, approximate).collect()}
    return Domain({c: (int(sizes[c]), role) for c, (_, role) in spec.domain.columns.items()})


def numeric_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min_value, max_value, value_range, nulls) in one pass."""
    stats = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns],
        *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"na_{c}") for c in columns],
    )
    return _stack(
        stats,
        [
            (F.lit(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.col(f"na_{c}"))
            for c in columns
        ],
        ["column", "min_value", "max_value", "value_range", "nulls"],
    )


def bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Min and max per column as driver scalars (one row)."""
    if not columns:
        return {}
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns],
    ).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column as driver scalars (one row)."""
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for all categorical columns in one aggregate (A10, M5)."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def frequency_ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Categories by falling frequency, ties by value; runs over the aggregated counts."""
    from pyspark.sql import Window

    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return category_counts(df, columns).withColumn("code", F.row_number().over(order) - 1)


def integer_like(df: DataFrame, columns: Sequence[str], limit: int = 32) -> DataFrame:
    """(column, n_distinct, is_integer_like)."""
    stats = df.agg(
        *[F.count_distinct(c).alias(f"n_{c}") for c in columns],
        *[F.every(F.col(c) == F.rint(F.col(c))).alias(f"i_{c}") for c in columns],
    )
    return _stack(
        stats,
        [(F.lit(c), F.col(f"n_{c}"), (F.col(f"n_{c}") <= limit) & F.col(f"i_{c}")) for c in columns],
        ["column", "n_distinct", "is_integer_like"],
    )


def category_sizes(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """Distinct categories per split and column."""
    return long_form(df, columns, keep=[split]).groupBy(split, "column").agg(F.count_distinct("value").alias("size"))


def split_sizes(df: DataFrame, spec: TableSpec, split: str) -> DataFrame:
    """Rows per split next to the feature counts."""
    n_num, n_cat = len(spec.domain.continuous), len(spec.domain.discrete)
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_num).cast("bigint").alias("n_numeric"),
        F.lit(n_cat).cast("bigint").alias("n_categorical"),
        F.lit(n_num + n_cat).cast("bigint").alias("n_features"),
    )


def split_coverage(df: DataFrame, columns: Sequence[str], split: str, part: str = "train") -> DataFrame:
    """Does ``part`` contain every category of each column?"""
    cells = long_form(df, columns, keep=[split])
    return cells.groupBy("column").agg(
        F.count_distinct("value").alias("n_all"),
        F.count_distinct(F.when(F.col(split) == part, F.col("value"))).alias("n_part"),
    ).withColumn("covered", F.col("n_all") == F.col("n_part"))


def key_check(data: RelationalDataset) -> DataFrame:
    """M6: (table, key, kind, violations): repeated primary keys, orphan and null foreign keys."""
    checks = []
    for name in data.graph.tables:
        spec, df = data.specs[name], data.tables[name]
        if spec.primary_key:
            repeated = df.groupBy(spec.primary_key).count().where("count > 1")
            checks.append(_tally(repeated, name, spec.primary_key, "repeated"))
        for parent, fk in spec.foreign_keys.items():
            checks.append(_tally(df.where(F.col(fk).isNull()), name, fk, "missing"))
            pk = data.specs[parent].primary_key
            owners = data.tables[parent].select(F.col(pk).alias(fk))
            checks.append(_tally(df.where(F.col(fk).isNotNull()).join(owners, fk, "left_anti"), name, fk, "orphan"))
    return reduce(DataFrame.unionByName, checks)


def _tally(df: DataFrame, table: str, key: str, kind: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(key).alias("key"), F.lit(kind).alias("kind"), "violations"
    )


def task_types(domains: DataFrame) -> DataFrame:
    """M3 over an M4 table."""
    kind = (
        F.when(F.col("role") == CONTINUOUS, "regression").when(F.col("size") == 2, "binclass").otherwise("multiclass")
    )
    return domains.withColumn("task", kind)


def override_wide_roles(domains: DataFrame, limit: int = 1000) -> DataFrame:
    """M7 over an M4 table."""
    wide = (F.col("role") == DISCRETE) & (F.col("size") >= limit)
    return domains.withColumn("role", F.when(wide, CONTINUOUS).otherwise(F.col("role")))
