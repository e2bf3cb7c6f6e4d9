"""Noise schedules, column perturbation and divergences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.literals import array_of
from kinweave.functions.hashing import gumbel, hash_normal, hash_uniform


def schedule(spark: SparkSession, steps: int, kind: str = "cosine") -> DataFrame:
    """(t, beta, alpha, alpha_bar, alpha_bar_prev, alpha_bar_next) over ``steps`` steps.

    The table has ``steps`` rows (thousands), so its running product is a small window.
    """
    t = F.col("id").cast("double")
    if kind == "linear":
        low, high = 0.1 / steps, 20.0 / steps
        beta = F.lit(low) + t * F.lit((high - low) / max(steps - 1, 1))
    elif kind == "cosine":
        def bar(x: Column) -> Column:
            return F.pow(F.cos((x + 0.008) / 1.008 * (math.pi / 2)), F.lit(2.0))

        beta = F.least(1 - bar((t + 1) / steps) / bar(t / steps), F.lit(0.999))
    else:
        raise ValueError(f"unknown schedule {kind!r}")
    base = spark.range(0, steps, 1, 1).select(F.col("id").alias("t"), beta.alias("beta"))
    base = base.withColumn("alpha", 1 - F.col("beta"))
    order = Window.orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    product = base.withColumn("alpha_bar", F.exp(F.sum(F.log("alpha")).over(upto)))
    return product.withColumn("alpha_bar_prev", F.lag("alpha_bar", 1, 1.0).over(order)).withColumn(
        "alpha_bar_next", F.lead("alpha_bar", 1, 0.0).over(order)
    )


def gaussian_noise(value: Column, alpha_bar: Column, *keys: str, salt: str, seed: int = 0) -> Column:
    """sqrt(a) x + sqrt(1 - a) e."""
    return F.sqrt(alpha_bar) * value + F.sqrt(1 - alpha_bar) * hash_normal(*keys, salt=salt, seed=seed)


def category_probabilities(value: Column, categories: Sequence[str], alpha_bar: Column) -> Column:
    """alpha_bar on the own category plus an even share of the rest."""
    share = (1 - alpha_bar) / len(categories)
    return F.transform(
        array_of(list(categories)), lambda c: F.when(c == value, alpha_bar + share).otherwise(share)
    )


def randomised_response(
    value: Column, categories: Sequence, alpha_bar: Column | float, *keys: str, salt: str, seed: int = 0
) -> Column:
    """F18 as a draw: keep the category with probability alpha_bar, else an even one."""
    keep = hash_uniform(*keys, salt=salt, seed=seed, part=0)
    return respond(value, categories, alpha_bar, keep, hash_uniform(*keys, salt=salt, seed=seed, part=1))


def respond(value: Column, categories: Sequence, alpha_bar: Column | float, keep: Column, pick: Column) -> Column:
    at = F.floor(pick * len(categories)).cast("int") + 1
    return F.when(keep < alpha_bar, value).otherwise(F.element_at(array_of(list(categories)), at))


def code_noise(code: Column, deviation: float, *keys: str, salt: str, seed: int = 0) -> Column:
    """label code plus N(0, deviation)."""
    return code + deviation * hash_normal(*keys, salt=salt, seed=seed) if deviation else code


def gumbel_choice(categories: Sequence[str], log_probabilities: Column, *keys: str, salt: str, seed: int = 0) -> Column:
    """Category of the largest log probability plus Gumbel noise; one number per category and row."""
    noise = F.array(
        *[gumbel(hash_uniform(*keys, salt=f"{salt}-{i}", seed=seed)) for i in range(len(categories))]
    )
    scores = F.zip_with(log_probabilities, noise, lambda p, g: p + g)
    return F.element_at(F.lit(list(categories)), F.array_position(scores, F.array_max(scores)).cast("int"))


def normal_cdf_tanh(x: Column) -> Column:
    """F16."""
    return 0.5 * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * F.pow(x, F.lit(3.0)))))


def gaussian_kl(mean1: Column, logvar1: Column, mean2: Column, logvar2: Column) -> Column:
    """F14."""
    gap = F.pow(mean1 - mean2, F.lit(2.0)) * F.exp(-logvar2)
    return 0.5 * (-1 + logvar2 - logvar1 + F.exp(logvar1 - logvar2) + gap)


def column_drift(real: DataFrame, fake: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F14 per numeric column: KL between the fitted normals of both tables."""
    stats = real.agg(
        *[F.struct(F.avg(c).alias("m"), F.log(F.var_pop(c)).alias("v")).alias(f"r_{c}") for c in columns]
    ).first()
    other = fake.agg(*[F.struct(F.avg(c).alias("m"), F.log(F.var_pop(c)).alias("v")).alias(c) for c in columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                gaussian_kl(
                    F.lit(stats[f"r_{c}"]["m"]), F.lit(stats[f"r_{c}"]["v"]), F.col(f"{c}.m"), F.col(f"{c}.v")
                ).alias("kl"),
            )
            for c in columns
        ]
    )
    return other.select(F.inline(rows))


def categorical_kl(real: DataFrame, fake: DataFrame, column: str, epsilon: float = 1e-9) -> DataFrame:
    """sum p (ln p - ln q) over the union of categories, empty cells lifted to ``epsilon``."""
    both = (
        real.select(F.col(column).alias("value"), F.lit(1).alias("r"))
        .unionByName(fake.select(F.col(column).alias("value"), F.lit(0).alias("r")))
        .groupBy("value")
        .agg(F.sum("r").alias("n_real"), F.sum(1 - F.col("r")).alias("n_fake"))
    )
    totals = both.agg(F.sum("n_real").alias("a"), F.sum("n_fake").alias("b")).first()
    p = F.greatest(F.col("n_real") / totals["a"], F.lit(epsilon))
    q = F.greatest(F.col("n_fake") / totals["b"], F.lit(epsilon))
    return both.agg(F.sum(p * (F.log(p) - F.log(q))).alias("kl"))


def log_add_exp(a: Column, b: Column) -> Column:
    """F19, two columns."""
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def log_sum_exp(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """F19 per group: the maximum first, then the shifted sum; both combine map-side."""
    top = df.groupBy(*by).agg(F.max(value).alias("__top"))
    shifted = df.join(top, list(by)).groupBy(*by, "__top").agg(F.sum(F.exp(F.col(value) - F.col("__top"))).alias("__s"))
    return shifted.select(*by, (F.col("__top") + F.log("__s")).alias("log_sum_exp"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(scores: Column) -> Column:
    """stable softmax of a score vector."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda e: e / total)


def label_of(probabilities: Column) -> Column:
    """0-based arg-max, first on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """F20."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
