"""Missing values, rare categories, casts and clamps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import bound
from kinweave.functions.literals import array_of
from kinweave.specs import TableSpec

# fixed values: sentinels of the data format
UNKNOWN = "?"
MISSING = "nan"
RARE = "__rare__"


def drop_keys(df: DataFrame, spec: TableSpec) -> DataFrame:
    """By declared keys, never by a substring of the name."""
    return df.drop(*spec.key_columns)


def sentinels_to_missing(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Unknown marker -> null (numeric) or the ``nan`` category."""
    changes: dict[str, Column] = {c: F.nullif(F.col(c).cast("string"), F.lit(UNKNOWN)).try_cast("double") for c in numeric}
    for c in categorical:
        changes[c] = F.coalesce(F.nullif(F.col(c).cast("string"), F.lit(UNKNOWN)), F.lit(MISSING))
    return df.withColumns(changes)


def cast_roles(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Numerics to double (null when not a number), categoricals to string."""
    return df.withColumns(
        {**{c: F.col(c).try_cast("double") for c in numeric}, **{c: F.col(c).cast("string") for c in categorical}}
    )


def codes_to_int(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Generated category codes back to whole numbers."""
    return df.withColumns({c: F.bround(F.col(c).cast("double")).cast("int") for c in columns})


def drop_missing(df: DataFrame, columns: Sequence[str], split: str | None = None, protected: str = "test") -> DataFrame:
    """Drop rows with a missing value; refuses to touch the protected split."""
    if split is not None:
        hit = df.where(F.col(split) == protected).where(~_complete(columns)).limit(1).count()
        if hit:
            raise ValueError(f"rows of split {protected!r} have missing values and must not be dropped")
    return df.dropna(subset=list(columns))


def _complete(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def discard_incomplete(df: DataFrame, columns: Sequence[str], max_share: float = 0.0) -> DataFrame:
    """Drop generated rows with null or NaN; raise when their share exceeds ``max_share``."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("bigint")).alias("bad")).first()
    if row["bad"] and row["bad"] > max_share * row["n"]:
        raise ValueError(f"{row['bad']} of {row['n']} generated rows are incomplete")
    return df.where(~bad) if row["bad"] else df


def impute_mean(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Mean over the train rows."""
    means = df.agg(*[F.avg(F.when(train, F.col(c))).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Most frequent train category, smallest on ties."""
    counts = category_table(df.where(train), columns).where(F.col("value").isNotNull())
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    modes = {r["column"]: r["value"] for r in best.collect()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes.get(c))) for c in columns})


def category_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from kinweave.operators.profile import category_counts

    return category_counts(df, columns)


def collapse_rare(df: DataFrame, column: str, min_share: float, train: Column) -> DataFrame:
    """Categories with fewer than round(n_train * share) train rows become one bucket."""
    n_train = df.where(train).count()
    least = round(n_train * min_share)
    popular = (
        df.where(train).groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    )
    known = popular.withColumn("__popular", F.lit(True))
    return (
        df.join(known, column, "left")
        .withColumn(column, F.when(F.col("__popular"), F.col(column)).otherwise(F.lit(RARE)))
        .drop("__popular")
    )


def clamp(column: Column, low: float, high: float) -> Column:
    """P10."""
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def clamp_to(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clamp(F.col(c), lo, hi) for c, (lo, hi) in limits.items()})


def snap(column: Column, levels: Sequence[float]) -> Column:
    """Nearest observed level, the smaller one on ties (few levels: see ``integer_like``)."""
    known = array_of([float(v) for v in levels])
    near = lambda x: F.array_min(
        F.transform(known, lambda v: F.struct(F.abs(v - x).alias("gap"), v.alias("level")))
    )
    return F.when(column.isNotNull(), bound(column, near)["level"])


def levels_of(df: DataFrame, columns: Sequence[str], limit: int = 32) -> dict[str, list[float]]:
    """Observed levels of integer-like columns (at most ``limit`` values each)."""
    from kinweave.operators.profile import integer_like

    if not columns:
        return {}
    few = [r["column"] for r in integer_like(df, columns, limit).collect() if r["is_integer_like"]]
    if not few:
        return {}
    row = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("double"))).alias(c) for c in few]).first()
    return {c: list(row[c]) for c in few}


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Earliest row of every key; a min-by aggregate, so a hot key combines map-side."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(key, *[F.col("__row")[c].alias(c) for c in rest])
    )
