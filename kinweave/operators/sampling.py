"""Samples, splits and permutations driven by key hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import gumbel, hash_uniform
from kinweave.operators.ordering import with_position, with_rank
from kinweave.operators.profile import long_form
from kinweave.session import cut

SMALL_SAMPLE = 100_000  # up to here a top-n (one task for the final merge) is cheaper than a full order


def sample_n(df: DataFrame, key: str, n: int, salt: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all) without replacement."""
    keyed = df.withColumn("__u", hash_uniform(key, salt=salt, seed=seed))
    if n <= SMALL_SAMPLE:
        return keyed.orderBy("__u", key).limit(n).drop("__u")
    placed = with_position(keyed.select(key, "__u"), ["__u", key], position="__at").where(F.col("__at") < n)
    return df.join(placed.select(key), key, "left_semi")


def equalise(left: DataFrame, right: DataFrame, key: str, cap: int, salt: str) -> tuple[DataFrame, DataFrame, int]:
    """O3: both tables cut to min(cap, |left|, |right|) rows."""
    n = min(cap, left.count(), right.count())
    return sample_n(left, key, n, salt), sample_n(right, key, n, salt), n


def sample_with_replacement(df: DataFrame, key: str, n: int, salt: str, seed: int = 0) -> DataFrame:
    """``n`` draws; each draw picks a row position by hash."""
    placed = with_position(df, [key], position="__at")
    total = df.count()
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), F.floor(hash_uniform("id", salt=salt, seed=seed) * total).alias("__at")
    )
    return draws.join(placed, "__at").drop("__at")


def shuffled_order(df: DataFrame, key: str, salt: str, seed: int = 0, position: str = "position") -> DataFrame:
    """A random permutation as an explicit position column."""
    keyed = df.withColumn("__u", hash_uniform(key, salt=salt, seed=seed))
    return with_position(keyed, ["__u", key], position=position).drop("__u")


def ratio_split(
    df: DataFrame, key: str, ratios: Mapping[str, float], salt: str, seed: int = 0, out: str = "split"
) -> DataFrame:
    """Every row gets a part by thresholds on its hash; a narrow projection."""
    u = hash_uniform(key, salt=salt, seed=seed)
    upto, choice = 0.0, None
    names = list(ratios)
    for name in names[:-1]:
        upto += ratios[name]
        choice = F.when(u < upto, name) if choice is None else choice.when(u < upto, name)
    last = F.lit(names[-1])
    return df.withColumn(out, last if choice is None else choice.otherwise(last))


def stratified_split(
    df: DataFrame, key: str, stratum: str, share: float, salt: str, seed: int = 0, out: str = "split"
) -> DataFrame:
    """The last ``share`` of every stratum in hash order becomes validation.

    Ranks come from the range-ordered layout, so one dominant class is still spread over tasks.
    """
    keyed = df.withColumn("__u", hash_uniform(key, salt=salt, seed=seed))
    ranked = with_rank(keyed, [stratum], ["__u", key], rank="__rank")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    cut = F.floor(F.col("__n") * F.lit(1.0 - share))
    return (
        ranked.join(sizes, stratum)
        .withColumn(out, F.when(F.col("__rank") <= cut, "train").otherwise("val"))
        .drop("__u", "__rank", "__n")
    )


def hold_out(df: DataFrame, key: str, parts: int, salt: str, seed: int = 0, out: str = "split") -> DataFrame:
    """floor(n / parts) rows in hash order become validation, the rest train."""
    n_val = df.count() // parts
    placed = shuffled_order(df, key, salt, seed, position="__at")
    return placed.withColumn(out, F.when(F.col("__at") < n_val, "val").otherwise("train")).drop("__at")


def covering_split(
    df: DataFrame,
    key: str,
    categorical: Sequence[str],
    n_train: int,
    salt: str,
    first_seed: int = 1234,
    out: str = "split",
    attempts: int = 5,
) -> tuple[DataFrame, int]:
    """A split whose train part holds every category; returns it and its seed.

    ``attempts`` random seeds are tried in turn; where none of them covers, :func:`cover_split` builds the split with the
    first seed.  A train part that no split can make large enough raises at once.
    """
    wanted = {r["column"]: r["n"] for r in _distinct_values(df, categorical).collect()}
    if max(wanted.values(), default=0) > n_train or _rows_alone(df, key, categorical) > n_train:
        raise ValueError("the train part is too small for every category")
    for seed in range(first_seed, first_seed + attempts):
        placed = shuffled_order(df.select(key, *categorical), key, salt, seed, position="__at")
        train = placed.where(F.col("__at") < n_train)
        seen = {r["column"]: r["n"] for r in _distinct_values(train, categorical).collect()}
        if seen == wanted:
            parts = placed.select(key, F.when(F.col("__at") < n_train, "train").otherwise("test").alias(out))
            return df.join(parts, key), seed
    return cover_split(df, key, categorical, n_train, salt, first_seed, out), first_seed


def cover_split(
    df: DataFrame, key: str, categorical: Sequence[str], n_train: int, salt: str, seed: int = 0, out: str = "split"
) -> DataFrame:
    """O7 without retries: ``n_train`` rows that hold every category, then the rest.

    Column by column every value that no reserved row holds yet reserves its row of smallest hash; further train rows follow
    in hash order.  The reserved rows need not be the fewest that cover; where they are more than ``n_train`` this raises.
    Nulls are no category.  Keys must be unique; one column costs one aggregate with a row per value.
    """
    keyed = df.withColumn("__u", hash_uniform(key, salt=salt, seed=seed))
    kept = None
    for c in categorical:
        open_rows = keyed.where(F.col(c).isNotNull())
        if kept is not None:
            open_rows = open_rows.join(kept.where(F.col(c).isNotNull()).select(c).distinct(), c, "left_anti")
        first = open_rows.groupBy(c).agg(F.min(F.struct("__u", key)).alias("first")).select(F.col("first")[key].alias(key))
        fresh = keyed.join(first, key, "left_semi").select(key, *categorical)
        kept = cut(fresh if kept is None else kept.unionByName(fresh).dropDuplicates([key]))
    if kept is not None and kept.count() > n_train:
        raise ValueError("the train part is too small for the rows that cover every category")
    marks = keyed.select(key, "__u", F.lit(1).alias("__rest")) if kept is None else (
        keyed.select(key, "__u").join(kept.select(key, F.lit(0).alias("__rest")), key, "left").fillna(1, "__rest")
    )
    placed = with_position(marks, ["__rest", "__u", key], position="__at")
    parts = placed.select(key, F.when(F.col("__at") < n_train, "train").otherwise("test").alias(out))
    return df.join(parts, key)


def _rows_alone(df: DataFrame, key: str, columns: Sequence[str]) -> int:
    """Rows that hold the only occurrence of some value."""
    alone = long_form(df, columns, [key]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.first(key).alias("k"))
    return alone.where((F.col("n") == 1) & F.col("value").isNotNull()).select("k").distinct().count()


def _distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return long_form(df, columns).groupBy("column").agg(F.count_distinct("value").alias("n"))


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, salt: str, seed: int = 0) -> DataFrame:
    """O11 with replacement: ``n`` draws proportional to weight, with importance weight 1/(N p).

    Row intervals of the running weight are cut into equal cells, so draws meet rows by an equi-join.
    """
    total = df.agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")).first()
    n_rows, mass = total["n"], float(total["w"])
    run = with_position(df.withColumn("__w", F.col(weight).cast("double")), [key], sums=["__w"])
    cells = max(n_rows, 1)
    # one cell per row on average; a heavy row spans many cells and a hot cell cannot form as draws are uniform
    low, high = (F.col("run___w") - F.col("__w")) / mass, F.col("run___w") / mass
    first = F.floor(low * cells).cast("bigint")
    last = F.least(F.floor(high * cells), F.lit(cells - 1)).cast("bigint")
    spans = run.withColumns({"__low": low, "__high": high}).where(F.col("__w") > 0)
    spans = spans.withColumn("__cell", F.explode(F.sequence(F.least(first, last), last)))
    u = hash_uniform("id", salt=salt, seed=seed)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), u.alias("__u"))
    draws = draws.withColumn("__cell", F.floor(F.col("__u") * cells).cast("bigint"))
    # rounding may leave the last interval just under 1
    inside = (F.col("__u") >= F.col("__low")) & ((F.col("__u") < F.col("__high")) | (F.col("position") == n_rows - 1))
    hit = draws.join(spans, "__cell").where(inside)
    importance = F.lit(mass) / (F.lit(float(n_rows)) * F.col("__w"))
    return hit.withColumn("importance", importance).drop("__u", "__cell", "__low", "__high", "__w", "run___w", "position")


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, salt: str, seed: int = 0) -> DataFrame:
    """O11 without replacement: Gumbel top-n on log weights."""
    score = F.log(weight) + gumbel(hash_uniform(key, salt=salt, seed=seed))
    scored = df.withColumn("__score", score)
    if n <= SMALL_SAMPLE:
        return scored.orderBy(F.desc("__score"), key).limit(n).drop("__score")
    placed = with_position(scored.select(key, "__score"), [F.desc("__score"), key], position="__at")
    return df.join(placed.where(F.col("__at") < n).select(key), key, "left_semi")


def generated_rows(spark, n: int, scale: float = 1.0) -> DataFrame:
    """Exactly ``int(scale * n)`` row ids, whatever the number of tasks."""
    return spark.range(int(scale * n)).withColumnRenamed("id", "row_id")
