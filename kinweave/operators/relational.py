"""Joins along foreign keys and group-size statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.hashing import bound, hash_uniform
from kinweave.functions.literals import array_of
from kinweave.operators.ordering import with_position
from kinweave.session import cut
from kinweave.specs import RelationalDataset


def denormalise(child: DataFrame, fk: str, parent: DataFrame, pk: str, drop: Sequence[str] = ()) -> DataFrame:
    """Child LEFT JOIN parent, keys dropped afterwards."""
    return child.join(parent.withColumnRenamed(pk, fk), fk, "left").drop(*drop)


def pair_join(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Each child row next to its parent row."""
    return child.join(parent.withColumnRenamed(pk, fk), fk)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Children whose (non-null) key has no parent."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def assert_integrity(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> None:
    lost = orphans(child, fk, parent, pk).limit(1).count()
    if lost:
        raise ValueError(f"foreign key {fk} has values without a parent row")


def chain_join(data: RelationalDataset, path: Sequence[str], columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Bottom table of ``path`` LEFT JOIN every ancestor; columns come out as ``table__column``.

    Only ``columns`` (default: the domain columns of all tables) and the keys are read.
    """
    wanted = columns or {t: list(data.specs[t].domain.columns) for t in path}

    def part(i: int) -> DataFrame:
        name = path[i]
        spec, df = data.specs[name], data.tables[name]
        cols: list[Column] = [F.col(c).alias(f"{name}__{c}") for c in wanted.get(name, ())]
        if i > 0:
            cols.append(F.col(spec.foreign_keys[path[i - 1]]).alias(f"__up{i}"))
        if i < len(path) - 1:
            cols.append(F.col(spec.primary_key).alias(f"__up{i + 1}"))
        return df.select(*cols)

    joined = part(len(path) - 1)
    for i in range(len(path) - 2, -1, -1):
        joined = joined.join(part(i), f"__up{i + 1}", "left")
    return joined.drop(*[f"__up{i}" for i in range(len(path))])


def children_per_parent(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """A2: (parent key, n_children), parents without children included."""
    counts = group_sizes(child, fk).withColumnRenamed(fk, pk)
    return (
        parent.select(pk)
        .join(counts, pk, "left")
        .select(pk, F.coalesce(F.col("group_size"), F.lit(0).cast("bigint")).alias("n_children"))
    )


def group_sizes(child: DataFrame, fk: str) -> DataFrame:
    """A3: (fk, group_size), non-empty groups only."""
    return child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("group_size"))


def size_distribution(sizes: DataFrame, label: str | None = None) -> DataFrame:
    """A4/A5: (label, group_size, n, prob).

    The window runs over distinct sizes - at most sqrt(2 * rows) of them - not over rows.
    """
    by = [label] if label else []
    counts = sizes.groupBy(*by, "group_size").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def vote(children: DataFrame, fk: str, cluster: str, label: str = "label") -> DataFrame:
    """Most frequent child cluster per parent, smallest on ties (k clusters bound the state per key)."""
    return children.groupBy(fk).agg(F.mode(F.col(cluster), True).alias(label))


def agree_rates(children: DataFrame, fk: str, cluster: str) -> DataFrame:
    """(fk, label, agree_rate)."""
    counts = children.groupBy(fk, cluster).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(fk).agg(
        F.min_by(F.col(cluster), F.struct(-F.col("n"), F.col(cluster))).alias("label"),
        (F.max("n") / F.sum("n")).alias("agree_rate"),
    )


def draw_from_array(weights: Column, uniform: Column) -> Column:
    """W3 on an array of probabilities: first 0-based index whose cumulative sum reaches ``uniform``."""
    total = F.transform(
        F.sequence(F.lit(1), F.size(weights)),
        lambda i: F.aggregate(F.slice(weights, 1, i), F.lit(0.0), lambda a, x: a + x),
    )
    return bound(uniform, lambda u: F.least(F.size(F.filter(total, lambda s: s < u)), F.size(weights) - 1))


def soft_vote(children: DataFrame, fk: str, probabilities: str, size: int, salt: str, seed: int = 0) -> DataFrame:
    """Mean of the children's probability vectors, a label drawn from it, agree rate = largest mean."""
    mean = children.groupBy(fk).agg(*[F.avg(F.col(probabilities)[i]).alias(f"__p{i}") for i in range(size)])
    packed = mean.select(fk, F.array(*[F.col(f"__p{i}") for i in range(size)]).alias("mean_probabilities"))
    return packed.select(
        fk,
        "mean_probabilities",
        draw_from_array(F.col("mean_probabilities"), hash_uniform(fk, salt=salt, seed=seed)).alias("label"),
        F.array_max("mean_probabilities").alias("agree_rate"),
    )


def label_children(child: DataFrame, fk: str, labels: DataFrame, label: str = "label") -> DataFrame:
    """Keyed by the parent, so no join on the child key is needed."""
    return child.join(labels.select(fk, label), fk, "left")


def label_parents(parent: DataFrame, pk: str, labels: DataFrame, fk: str, label: str = "label") -> DataFrame:
    """Childless parents get ``max(label) + 1``."""
    top = labels.agg(F.max(label)).first()[0]
    childless = 0 if top is None else int(top) + 1
    return parent.join(labels.select(F.col(fk).alias(pk), label), pk, "left").withColumn(
        label, F.coalesce(F.col(label), F.lit(childless)).cast("int")
    )


def add_columns(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Bring the columns only ``right`` has over an explicit row id.

    A row id present on one side only fails the job while it runs; no extra counting pass.
    """
    new = [c for c in right.columns if c not in left.columns]
    marked = left.withColumn("__l", F.lit(1)).join(right.select(on, *new, F.lit(1).alias("__r")), on, "full_outer")
    paired = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    check = F.assert_true(paired, F.lit(f"row ids of {on} differ between both sides"))
    return marked.where(check.isNull()).drop("__l", "__r")


def decode(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Code -> value through a (value, code) dictionary."""
    pairs = dictionary.select(F.col("code").alias(column), F.col("value").alias("__value"))
    return df.join(pairs, column, "left").drop(column).withColumnRenamed("__value", column)


def pack_distribution(dist: DataFrame, label: str | None, value: str, prob: str = "prob") -> DataFrame:
    """Cumulative probabilities of a small distribution as two aligned arrays per label."""
    by = [label] if label else []
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    steps = dist.withColumn("__upto", F.sum(prob).over(run))
    packed = steps.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col(value).alias("value"), F.col("__upto").alias("upto")))).alias("steps")
    )
    return packed.select(*by, F.col("steps.value").alias("values"), F.col("steps.upto").alias("upto"))


def draw_packed(uniform: Column) -> Column:
    """Inverse CDF over ``values``/``upto``; the last bin reaches 1."""
    at = bound(uniform, lambda u: F.size(F.filter("upto", lambda s: s < u)))
    return F.element_at("values", F.least(at + 1, F.size("values")))


GUIDE_SIZES = 64  # values of a distribution that a draw may scan; longer ones are drawn through a guide table


def guide_table(dist: DataFrame, by: list[str], value: str, prob: str = "prob") -> DataFrame:
    """``by, __cells, __cell, steps``: [0, 1) in as many cells as a distribution has values, each with the steps that meet it.

    A draw looks at the steps of one cell, which are two on average whatever the number of values.
    """
    inside, run = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(value)
    steps = dist.select(
        *by,
        F.col(value).alias("value"),
        F.sum(prob).over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.lead(value).over(run).isNull().alias("__last"),
        F.count(F.lit(1)).over(inside).alias("__cells"),
    )
    low = F.coalesce(F.lag("upto").over(Window.partitionBy(*by).orderBy("value")), F.lit(0.0))
    top = F.col("__cells") - 1
    first = F.least(F.floor(low * F.col("__cells")), top)
    last = F.when(F.col("__last"), top).otherwise(F.least(F.floor(F.col("upto") * F.col("__cells")), top))
    met = steps.withColumns({"__first": first, "__to": last}).withColumn("__cell", F.explode(F.sequence("__first", "__to")))
    step = F.struct(F.when(F.col("__last"), F.lit(2.0)).otherwise(F.col("upto")).alias("upto"), "value")
    return met.groupBy(*by, "__cells", "__cell").agg(F.sort_array(F.collect_list(step)).alias("steps"))


def draw_guided(rows: DataFrame, uniform: Column, guide: DataFrame, by: list[str], out: str) -> DataFrame:
    """W3 through a guide table: the value that :func:`draw_packed` draws, null where ``by`` has no distribution.

    ``guide`` is read twice, so it should be stored.
    """
    kept = rows.columns
    asked = rows.withColumn("__u", uniform).join(guide.select(*by, "__cells").distinct(), by, "left")
    asked = asked.withColumn("__cell", F.least(F.floor(F.col("__u") * F.col("__cells")), F.col("__cells") - 1))
    met = asked.join(guide.drop("__cells"), [*by, "__cell"], "left")
    held = F.filter("steps", lambda s: s["upto"] >= F.col("__u"))
    return met.select(*[F.col(c) for c in kept], F.get(held, 0)["value"].alias(out))


EXPLODE_ROWS = 100_000  # copies one task makes of one row


def repeat_rows(df: DataFrame, count: str, out: str, largest: int) -> DataFrame:
    """Every row ``count`` times, numbered 1..count in ``out``; rows with count 0 vanish.

    A row with very many copies is first cut into pieces that are spread over the cluster.
    """
    rows = df.where(F.col(count) > 0)
    n = F.col(count).cast("bigint")
    if largest <= EXPLODE_ROWS:
        return rows.withColumn(out, F.explode(F.sequence(F.lit(1).cast("bigint"), n)))
    pieces = rows.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("bigint"), n, F.lit(EXPLODE_ROWS).cast("bigint"))))
    spread = pieces.repartition(*df.columns, "__from")
    last = F.least(n, F.col("__from") + EXPLODE_ROWS - 1)
    return spread.withColumn(out, F.explode(F.sequence(F.col("__from"), last))).drop("__from")


def expand_children(
    parents: DataFrame, pk: str, label: str, dist: DataFrame, salt: str, seed: int = 0
) -> DataFrame:
    """(pk, label, slot): every parent draws a group size from its label; unknown labels get none."""
    dist = cut(dist)  # labels x distinct sizes
    most = dist.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.max("group_size").alias("m")).agg(F.max("n"), F.max("m")).first()
    largest, u = most[1] or 0, hash_uniform(pk, salt=salt, seed=seed)
    if (most[0] or 0) > GUIDE_SIZES:
        drawn = draw_guided(parents.select(pk, label), u, cut(guide_table(dist, [label], "group_size")), [label], "size").fillna(0, "size")
    else:
        sized = parents.select(pk, label).join(pack_distribution(dist, label, "group_size"), label, "left")
        drawn = sized.select(pk, label, F.coalesce(draw_packed(u), F.lit(0)).alias("size"))
    return repeat_rows(drawn, "size", "slot", largest).select(pk, label, "slot")


def synthetic_keys(dist: DataFrame, n: int, spark, salt: str, seed: int = 0) -> DataFrame:
    """(row_id 0..n-1, parent_key): keys 0, 1, 2, ... repeated a drawn size, shuffled and cut to n."""
    dist = cut(dist)
    known = dist.agg(F.count(F.lit(1)), F.sum(F.col("group_size") * F.col("prob")), F.max("group_size")).first()
    mean, largest = known[1] or 0.0, int(known[2] or 0)
    if n <= 0 or mean <= 0:
        raise ValueError("synthetic keys need rows and non-empty groups")
    if known[0] > GUIDE_SIZES:
        guide = cut(guide_table(dist.select(F.lit(0).alias("__all"), "group_size", "prob"), ["__all"], "group_size"))
        u = hash_uniform("id", salt=f"{salt}-size", seed=seed)

        def sized(candidates: int) -> DataFrame:
            asked = spark.range(candidates).withColumn("__all", F.lit(0))
            return draw_guided(asked, u, guide, ["__all"], "size").select("id", F.col("size").cast("bigint").alias("size"))

    else:
        rows = dist.orderBy("group_size").collect()  # at most GUIDE_SIZES
        values, upto = [int(r["group_size"]) for r in rows], list(accumulate(r["prob"] for r in rows))

        def sized(candidates: int) -> DataFrame:
            u = hash_uniform("id", salt=f"{salt}-size", seed=seed)
            at = bound(u, lambda v: F.size(F.filter(array_of(upto), lambda s: s < v)))
            pick = F.element_at(array_of(values), F.least(at + 1, F.lit(len(values))))
            return spark.range(candidates).select("id", pick.cast("bigint").alias("size"))

    candidates = int(1.2 * n / mean) + 64
    while (sized(candidates).agg(F.sum("size")).first()[0] or 0) < n:
        candidates *= 2
    placed = with_position(sized(candidates), ["id"], sums=["size"])
    kept = placed.where(F.col("run_size") - F.col("size") < n).where("size > 0")
    copies = repeat_rows(kept.select(F.col("id").alias("parent_key"), "size"), "size", "copy", largest).drop("size")
    keyed = copies.withColumn("__u", hash_uniform("parent_key", "copy", salt=f"{salt}-shuffle", seed=seed))
    shuffled = with_position(keyed, ["__u", "parent_key", "copy"], position="row_id")
    return shuffled.where(F.col("row_id") < n).select("row_id", "parent_key")
