"""Encoders and scalers (W1, W2, W4, W7, F4-F10, L32), fitted with aggregates and applied as expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.literals import array_of
from kinweave.operators import clean as C
from kinweave.operators.ordering import dense_ids
from kinweave.operators.profile import bounds, category_counts, moments

DRIVER_DICTIONARY = 100_000  # larger dictionaries are numbered on the cluster


def dictionary(df: DataFrame, column: str, limit: int = DRIVER_DICTIONARY) -> DataFrame:
    """(value, code) with codes 0..K-1 in value order."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    head = values.limit(limit + 1).count()
    if head > limit:
        return dense_ids(values, ["value"], "code").withColumn("code", F.col("code").cast("int"))
    # bounded by ``limit`` rows, checked above
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)


def encode(df: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """Replace ``column`` by its code; values outside the dictionary become null."""
    name = out or column
    pairs = codes.select(F.col("value").alias(column), F.col("code").alias("__code"))
    joined = df.join(pairs, column, "left")
    return (joined if out else joined.drop(column)).withColumnRenamed("__code", name)


def ordinal_encode(df: DataFrame, column: str, train: Column, limit: int = DRIVER_DICTIONARY) -> DataFrame:
    """Codes from the train rows; values unseen there get the largest code + 1."""
    codes = dictionary(df.where(train), column, limit)
    top = codes.agg(F.max("code")).first()[0]
    unseen = 0 if top is None else int(top) + 1
    return encode(df, column, codes).withColumn(column, F.coalesce(F.col(column), F.lit(unseen)).cast("int"))


def categories(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted category list for one-hot encoding; raises beyond ``limit``."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(values)


def narrow_categories(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    """Category lists of the columns that stay within ``limit``; wider columns are left out."""
    return category_lists(category_counts(df, columns), len(columns), limit) if columns else {}


def category_lists(counts: DataFrame, n_columns: int, limit: int = 1000) -> dict[str, list[str]]:
    """Sorted categories per ``column`` of a (column, value, n) table, columns wider than ``limit`` left out.

    At most ``(limit + 1) * n_columns`` rows are read first; only if that cut something off are the
    sizes counted on the cluster and the narrow columns read on their own.
    """
    filled = counts.where(F.col("value").isNotNull()).select("column", "value")
    cap = (limit + 1) * n_columns
    rows = filled.limit(cap).collect()
    if len(rows) == cap:
        narrow = filled.groupBy("column").count().where(F.col("count") <= limit).select("column")
        rows = filled.join(narrow, "column", "left_semi").collect()
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r["column"], []).append(r["value"])
    return {c: sorted(values) for c, values in found.items() if len(values) <= limit}


def one_hot(column: Column, values: Sequence, scale: float = 1.0) -> Column:
    """F8: 0/1 vector over ``values``; unknown values give all zeros."""
    if not values:
        return F.array().cast("array<double>")
    text = column.cast("string")
    return F.transform(
        array_of([str(v) for v in values]), lambda v: F.when(v == text, F.lit(scale)).otherwise(F.lit(0.0))
    )


def from_one_hot(vector: Column, values: Sequence) -> Column:
    """F8 inverse: category of the largest entry, the first one on ties."""
    return F.element_at(array_of(list(values)), F.array_position(vector, F.array_max(vector)).cast("int"))


def minmax(column: Column, low: float, high: float, to: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """a constant column maps to the lower bound."""
    if high == low:
        return F.when(column.isNotNull(), F.lit(to[0]))
    return (column - F.lit(low)) / F.lit(high - low) * F.lit(to[1] - to[0]) + F.lit(to[0])


def minmax_inverse(column: Column, low: float, high: float, to: tuple[float, float] = (-1.0, 1.0)) -> Column:
    return (column - F.lit(to[0])) / F.lit(to[1] - to[0]) * F.lit(high - low) + F.lit(low)


def standardise(column: Column, mean: float, deviation: float) -> Column:
    """deviation 0 divides by 1."""
    return (column - F.lit(mean)) / F.lit(deviation or 1.0)


def standardise_inverse(column: Column, mean: float, deviation: float) -> Column:
    return column * F.lit(deviation or 1.0) + F.lit(mean)


def efficacy_scale(column: Column, low: float, high: float) -> Column:
    """log scale for large non-negative columns, else min-max times five."""
    if low >= 0 and high >= 1000:
        return F.log(F.greatest(column.cast("double"), F.lit(0.01)))
    if high == low:
        return F.when(column.isNotNull(), F.lit(0.0))
    return (column - F.lit(low)) / F.lit(high - low) * F.lit(5.0)


def leave_one_out(df: DataFrame, column: str, target: str, train: Column, out: str) -> DataFrame:
    """Mean target of the other train rows of the category; other splits use the plain train mean.

    Sums per category are joined back, so a category holding most rows never meets in one task.
    """
    overall = df.where(train).agg(F.avg(target)).first()[0]
    stats = df.where(train).groupBy(column).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    inside = F.when(F.col("__n") > 1, (F.col("__s") - F.col(target)) / (F.col("__n") - 1))
    value = F.when(train, inside).otherwise(F.col("__s") / F.col("__n"))
    return df.join(stats, column, "left").withColumn(out, F.coalesce(value, F.lit(overall))).drop("__s", "__n")


def gan_scale(column: Column, low: float, high: float, act: str = "tanh") -> Column:
    """F10 forward, continuous side."""
    return minmax(column, low, high, (-1.0, 1.0) if act == "tanh" else (0.0, 1.0))


def gan_scale_inverse(column: Column, low: float, high: float, act: str = "tanh") -> Column:
    """F10 inverse with the clip to [0, 1]."""
    unit = (column + 1) / 2 if act == "tanh" else column
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit)) * F.lit(high - low) + F.lit(low)


# --- W4: quantile <-> standard normal ------------------------------------------------------------

_CLIP = 1e-7  # keeps the normal scores inside +-5.2


@lru_cache(maxsize=1)
def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    """Normal quantiles on an even log-odds grid; smooth enough for linear interpolation to 1e-7."""
    odds = np.linspace(-17.0, 17.0, 20001)
    inverse = NormalDist().inv_cdf
    return odds, np.array([inverse(1.0 / (1.0 + math.exp(-x))) for x in odds])


def normal_quantile(p: np.ndarray) -> np.ndarray:
    odds, scores = _normal_table()
    q = np.clip(p, _CLIP, 1.0 - _CLIP)
    return np.interp(np.log(q) - np.log1p(-q), odds, scores)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    odds, scores = _normal_table()
    return 1.0 / (1.0 + np.exp(-np.interp(z, scores, odds)))


def quantile_grid(df: DataFrame, columns: Sequence[str], n_quantiles: int, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Reference quantiles per column (``n_quantiles`` numbers each reach the driver)."""
    if not columns:
        return {}
    levels = array_of([i / (n_quantiles - 1) for i in range(n_quantiles)])
    row = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), levels, accuracy).alias(c) for c in columns]
    ).first()
    return {c: list(row[c] or []) for c in columns}


def default_quantiles(n_rows: int) -> int:
    """Second configuration of W4: max(min(n // 30, 1000), 10)."""
    return max(min(n_rows // 30, 1000), 10)


def uniform_scores(values: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Position of each value on the grid; ties take the middle of their lowest and highest level."""
    levels = np.linspace(0.0, 1.0, len(grid))
    up = np.interp(values, grid, levels)
    down = np.interp(-values, -grid[::-1], -levels[::-1])
    out = 0.5 * (up - down)
    out[values <= grid[0]] = 0.0 if grid[0] < grid[-1] else 0.5
    out[(values >= grid[-1]) & (grid[0] < grid[-1])] = 1.0
    return out


def quantile_normal(column: Column, grid: Sequence[float]) -> Column:
    """W4 forward."""
    fixed = np.asarray(grid, dtype=float)

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        x = values.to_numpy(dtype=float)
        out = normal_quantile(uniform_scores(x, fixed))
        out[np.isnan(x)] = np.nan
        return pd.Series(out)

    return score(column.cast("double"))


def quantile_normal_inverse(column: Column, grid: Sequence[float]) -> Column:
    """W4 inverse."""
    fixed = np.asarray(grid, dtype=float)
    levels = np.linspace(0.0, 1.0, len(fixed))

    @F.pandas_udf("double")
    def restore(values: pd.Series) -> pd.Series:
        return pd.Series(np.interp(normal_cdf(values.to_numpy(dtype=float)), levels, fixed))

    return restore(column)


# --- L32: the whole chain -------------------------------------------------------------------------


@dataclass(frozen=True)
class Transformations:
    """Policies by name; ``None`` skips a step.  ``seed`` only matters for the counter noise."""

    normalization: str | None = None  # standard | minmax | quantile
    num_nan_policy: str | None = None  # drop-rows | mean
    cat_nan_policy: str | None = None  # most_frequent
    cat_min_frequency: float | None = None
    cat_encoding: str | None = None  # None (ordinal) | one-hot | counter
    y_policy: str | None = "default"
    seed: int = 0

    def __post_init__(self) -> None:
        allowed = {
            "normalization": (None, "standard", "minmax", "quantile"),
            "num_nan_policy": (None, "drop-rows", "mean"),
            "cat_nan_policy": (None, "most_frequent"),
            "cat_encoding": (None, "one-hot", "counter"),
            "y_policy": (None, "default"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"unknown {name}: {getattr(self, name)!r}")


@dataclass(frozen=True)
class Transformed:
    df: DataFrame
    numeric: list[str]
    categorical: list[str]
    target_scale: tuple[float, float] | None = None
    fitted: dict = field(default_factory=dict)


def transform_features(
    df: DataFrame,
    numeric: Iterable[str],
    categorical: Iterable[str],
    target: str,
    task: str,
    policy: Transformations,
    split: str = "split",
) -> Transformed:
    """Missing numerics, scaling, missing categories, rare categories, encoding, target - in this order.

    Statistics come from the train rows only; transformed columns keep their names.
    """
    numeric, categorical = list(numeric), list(categorical)
    train = F.col(split) == "train"
    fitted: dict = {}
    if policy.num_nan_policy == "drop-rows":
        df = C.drop_missing(df, numeric, split=split)
    elif policy.num_nan_policy == "mean" and numeric:
        df = C.impute_mean(df, numeric, train)

    if numeric and policy.normalization == "standard":
        fitted["moments"] = moments(df.where(train), numeric)
        df = df.withColumns({c: standardise(F.col(c), *fitted["moments"][c]) for c in numeric})
    elif numeric and policy.normalization == "minmax":
        fitted["bounds"] = bounds(df.where(train), numeric)
        df = df.withColumns({c: minmax(F.col(c), *fitted["bounds"][c], (0.0, 1.0)) for c in numeric})
    elif numeric and policy.normalization == "quantile":
        n = default_quantiles(df.where(train).count())
        fitted["grids"] = quantile_grid(df.where(train), numeric, n)
        df = df.withColumns({c: quantile_normal(F.col(c), fitted["grids"][c]) for c in numeric})

    if categorical and policy.cat_nan_policy == "most_frequent":
        df = C.impute_mode(df, categorical, train)
    if policy.cat_min_frequency is not None:
        for c in categorical:
            df = C.collapse_rare(df, c, policy.cat_min_frequency, train)
    if policy.cat_encoding is None:
        for c in categorical:
            df = ordinal_encode(df, c, train)
    elif policy.cat_encoding == "one-hot":
        fitted["categories"] = {c: categories(df.where(train), c) for c in categorical}
        df = df.withColumns({c: one_hot(F.col(c), fitted["categories"][c]) for c in categorical})
    else:
        for c in categorical:
            df = leave_one_out(df, c, target, train, c + "__loo").drop(c).withColumnRenamed(c + "__loo", c)
        numeric, categorical = numeric + categorical, []

    scale = None
    if policy.y_policy == "default" and task == "regression":
        scale = moments(df.where(train), [target])[target]
        df = df.withColumn(target, standardise(F.col(target), *scale))
    return Transformed(df, numeric, categorical, scale, fitted)
