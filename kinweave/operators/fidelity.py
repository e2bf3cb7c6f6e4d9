"""Fidelity of a synthetic dataset.

Real and synthetic rows are stacked with a flag and scored together: one pass
per property, whatever the number of columns.  Scores come out as flat rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.ordering import with_position
from kinweave.operators.profile import bounds, long_form
from kinweave.operators.relational import chain_join, children_per_parent
from kinweave.session import cut
from kinweave.specs import RelationalDataset

N_BINS = 10


def stacked(real: DataFrame, fake: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of both tables plus ``__fake``."""
    return real.select(*columns, F.lit(False).alias("__fake")).unionByName(
        fake.select(*columns, F.lit(True).alias("__fake"))
    )


def value_counts(both: DataFrame, columns: Sequence[str], kind: str, prefix: str = "") -> DataFrame:
    """(column, value, n_real, n_fake) for all columns in one aggregate; nulls and NaN are left out."""
    cells = long_form(both, columns, keep=["__fake"], kind=kind).where(F.col("value").isNotNull())
    if kind == "double":
        cells = cells.where(~F.isnan("value"))
    counts = cells.groupBy("column", "value").agg(
        F.count_if(~F.col("__fake")).alias("n_real"), F.count_if(F.col("__fake")).alias("n_fake")
    )
    return counts.withColumn("column", F.concat(F.lit(prefix), F.col("column"))) if prefix else counts


def ks_scores(counts: DataFrame, few_values: bool = False) -> DataFrame:
    """(column, score = 1 - KS) from value counts.

    Running counts follow the range-ordered layout, so a column with billions of distinct values is
    never windowed in one task.  ``few_values`` is for counts known to be short, such as group sizes.
    """
    if few_values:
        counts = cut(counts)  # few rows, read twice
        run = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumns({"run_n_real": F.sum("n_real").over(run), "run_n_fake": F.sum("n_fake").over(run)})
    else:
        placed = with_position(counts, ["column", "value"], sums=["n_real", "n_fake"])
        counts = placed  # stored; the totals need not count the tables again
        starts = placed.groupBy("column").agg(
            F.min(F.col("run_n_real") - F.col("n_real")).alias("s_real"),
            F.min(F.col("run_n_fake") - F.col("n_fake")).alias("s_fake"),
        )
        placed = placed.join(starts, "column").withColumns(
            {"run_n_real": F.col("run_n_real") - F.col("s_real"), "run_n_fake": F.col("run_n_fake") - F.col("s_fake")}
        )
    totals = counts.groupBy("column").agg(F.sum("n_real").alias("t_real"), F.sum("n_fake").alias("t_fake"))
    gap = F.abs(F.col("run_n_real") / F.col("t_real") - F.col("run_n_fake") / F.col("t_fake"))
    return placed.join(totals, "column").groupBy("column").agg((1 - F.max(gap)).alias("score"))


def tv_scores(counts: DataFrame, keys: Sequence[str] = ("column",)) -> DataFrame:
    """(keys, score = 1 - total variation) from value counts."""
    keys = list(keys)
    counts = cut(counts)
    totals = counts.groupBy(*keys).agg(F.sum("n_real").alias("t_real"), F.sum("n_fake").alias("t_fake"))
    gap = F.abs(F.col("n_real") / F.col("t_real") - F.col("n_fake") / F.col("t_fake"))
    return counts.join(totals, keys).groupBy(*keys).agg((1 - F.sum(gap) / 2).alias("score"))


def column_shapes(real: RelationalDataset, fake: RelationalDataset) -> DataFrame:
    """(table_name, column, metric, score) for every domain column of every table."""
    numeric, categorical = [], []
    for t in real.graph.tables:
        spec = real.specs[t]
        both = stacked(real.tables[t], fake.tables[t], list(spec.domain.columns))
        if spec.domain.continuous:
            numeric.append(value_counts(both, spec.domain.continuous, "double", f"{len(t)}.{t}."))
        if spec.domain.discrete:
            categorical.append(value_counts(both, spec.domain.discrete, "string", f"{len(t)}.{t}."))
    parts = []
    if numeric:
        parts.append(ks_scores(reduce(DataFrame.unionByName, numeric)).withColumn("metric", F.lit("ks")))
    if categorical:
        parts.append(tv_scores(reduce(DataFrame.unionByName, categorical)).withColumn("metric", F.lit("tv")))
    # "<length of the table's name>.<table>.<column>" holds whatever characters the names have
    table = F.expr("substr(column, length(substring_index(column, '.', 1)) + 2, int(substring_index(column, '.', 1)))")
    column = F.expr("substr(column, length(substring_index(column, '.', 1)) + 3 + int(substring_index(column, '.', 1)))")
    return reduce(DataFrame.unionByName, parts).select(table.alias("table_name"), column.alias("column"), "metric", "score")


def equal_width_bin(value: Column, low: float | None, high: float | None, n: int = N_BINS) -> Column:
    """0..n-1 over the real range; values outside go to the end bins."""
    if low is None or high == low:
        return F.when(value.isNotNull(), F.lit(0))
    at = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(n))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("int")


def pair_trends(
    real: DataFrame, fake: DataFrame, pairs: Iterable[tuple[str, str]], numeric: Iterable[str]
) -> DataFrame:
    """(column_1, column_2, score); numeric pairs by correlation, others by contingency.

    Contingency cells of all pairs are counted by one aggregate that combines map-side.
    """
    pairs, numeric = list(pairs), set(numeric)
    by_corr = [p for p in pairs if p[0] in numeric and p[1] in numeric]
    by_cell = [p for p in pairs if p not in set(by_corr)]
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    both = stacked(real, fake, columns)
    parts = []
    if by_corr:
        def part(c: str, flag: bool) -> Column:
            return F.when(F.col("__fake") == flag, F.col(c).cast("double"))

        stats = both.agg(
            *[
                F.corr(part(a, flag), part(b, flag)).alias(f"{'f' if flag else 'r'}{i}")
                for i, (a, b) in enumerate(by_corr)
                for flag in (False, True)
            ]
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(a).alias("column_1"),
                    F.lit(b).alias("column_2"),
                    (1 - F.abs(F.col(f"r{i}") - F.col(f"f{i}")) / 2).alias("score"),
                )
                for i, (a, b) in enumerate(by_corr)
            ]
        )
        scored = stats.select(F.inline(rows))
        parts.append(scored.where(F.col("score").isNotNull() & ~F.isnan("score")))
    if by_cell:
        binned = sorted({c for p in by_cell for c in p} & numeric)
        limits = bounds(real, binned)
        coded = both.select(
            "__fake",
            *[
                (equal_width_bin(F.col(c), *limits[c]) if c in numeric else F.col(c)).cast("string").alias(c)
                for c in dict.fromkeys(c for p in by_cell for c in p)
            ],
        )
        cells = coded.select(
            "__fake",
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(a).alias("column_1"),
                            F.lit(b).alias("column_2"),
                            F.col(a).alias("v1"),
                            F.col(b).alias("v2"),
                        )
                        for a, b in by_cell
                    ]
                )
            ),
        ).where("v1 is not null and v2 is not null")
        counts = cells.groupBy("column_1", "column_2", "v1", "v2").agg(
            F.count_if(~F.col("__fake")).alias("n_real"), F.count_if(F.col("__fake")).alias("n_fake")
        )
        parts.append(tv_scores(counts, ["column_1", "column_2"]))
    if not parts:
        return real.sparkSession.createDataFrame([], "column_1 string, column_2 string, score double")
    return reduce(DataFrame.unionByName, parts)


def _scored(hop: int, path: Sequence[str], trends: DataFrame) -> DataFrame:
    plain = lambda c: F.element_at(F.split(c, "__"), -1)
    return trends.select(
        F.lit(hop).alias("hop"),
        F.lit(">".join(path)).alias("path"),
        F.lit(path[0]).alias("top_table"),
        F.lit(path[-1]).alias("bottom_table"),
        plain("column_1").alias("column_1"),
        plain("column_2").alias("column_2"),
        "score",
    )


def table_trends(real: RelationalDataset, fake: RelationalDataset, table: str) -> DataFrame:
    """L17 (hop 0) for one table."""
    spec = real.specs[table]
    pairs = list(combinations(spec.domain.columns, 2))
    return _scored(0, [table], pair_trends(real.tables[table], fake.tables[table], pairs, spec.domain.continuous))


def path_trends(real: RelationalDataset, fake: RelationalDataset, path: Sequence[str]) -> DataFrame:
    """L18 (one edge) and L20 (longer paths): pairs of one top-table and one bottom-table column.

    Tables in between contribute their keys only.
    """
    top, bottom = real.specs[path[0]], real.specs[path[-1]]
    wanted = {path[0]: list(top.domain.columns), path[-1]: list(bottom.domain.columns)}
    pairs = [(f"{top.name}__{a}", f"{bottom.name}__{b}") for a in top.domain.columns for b in bottom.domain.columns]
    numeric = [f"{s.name}__{c}" for s in (top, bottom) for c in s.domain.continuous]
    trends = pair_trends(chain_join(real, path, wanted), chain_join(fake, path, wanted), pairs, numeric)
    return _scored(len(path) - 1, path, trends)


def cardinality_shapes(real: RelationalDataset, fake: RelationalDataset) -> DataFrame:
    """(parent, child, score) from children per parent, zeros included."""
    parts = []
    for parent, child in real.graph.relations:
        fk, pk = real.foreign_key(parent, child), real.specs[parent].primary_key
        sides = [
            children_per_parent(data.tables[parent], pk, data.tables[child], fk).select("n_children")
            for data in (real, fake)
        ]
        parts.append(value_counts(stacked(*sides, ["n_children"]), ["n_children"], "double", f"{parent}>{child}."))
    # distinct group sizes: at most sqrt(2 * rows) values per relation
    scores = ks_scores(reduce(DataFrame.unionByName, parts), few_values=True)
    edge = F.split_part("column", F.lit("."), F.lit(1))
    return scores.select(
        F.split_part(edge, F.lit(">"), F.lit(1)).alias("parent"),
        F.split_part(edge, F.lit(">"), F.lit(2)).alias("child"),
        "score",
    )


def coverage(real: RelationalDataset, fake: RelationalDataset, table: str) -> DataFrame:
    """Share of real categories seen, share of the real range spanned (never below 0)."""
    domain = real.specs[table].domain
    both = stacked(real.tables[table], fake.tables[table], list(domain.columns))
    parts = []
    if domain.discrete:
        counts = value_counts(both, domain.discrete, "string").where("n_real > 0")
        parts.append(counts.groupBy("column").agg((F.count_if(F.col("n_fake") > 0) / F.count(F.lit(1))).alias("score")))
    if domain.continuous:
        side = lambda c, flag: F.when(F.col("__fake") == flag, F.col(c).cast("double"))
        stats = both.agg(
            *[F.min(side(c, f)).alias(f"lo{int(f)}_{c}") for c in domain.continuous for f in (False, True)],
            *[F.max(side(c, f)).alias(f"hi{int(f)}_{c}") for c in domain.continuous for f in (False, True)],
        )

        def score(c: str) -> Column:
            lo, hi = F.col(f"lo0_{c}"), F.col(f"hi0_{c}")
            width = hi - lo
            missed = F.greatest(F.lit(0.0), (F.col(f"lo1_{c}") - lo) / width) + F.greatest(
                F.lit(0.0), (hi - F.col(f"hi1_{c}")) / width
            )
            return F.when(width > 0, F.greatest(F.lit(0.0), 1 - missed))

        rows = F.array(*[F.struct(F.lit(c).alias("column"), score(c).alias("score")) for c in domain.continuous])
        parts.append(stats.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts).select(F.lit(table).alias("table_name"), "column", "score")


def latest_path(scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of several paths between the same two columns keep the last one in path order."""
    rank = F.array_position(F.lit(list(order)), F.col("path"))
    keys = ["hop", "top_table", "bottom_table", "column_1", "column_2"]
    return scores.groupBy(*keys).agg(F.max_by(F.struct("path", "score"), rank).alias("s")).select(*keys, "s.*")


def hop_averages(scores: DataFrame) -> DataFrame:
    """(hop, n, mean_score); hop -1 is the mean over all pairs."""
    return (
        scores.where(F.col("score").isNotNull())
        .select(F.explode(F.array(F.col("hop"), F.lit(-1))).alias("hop"), "score")
        .groupBy("hop")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    )


def trend_scores(real: RelationalDataset, fake: RelationalDataset, long_range: bool = True) -> DataFrame:
    """Hop 0, hop 1 and (optionally) longer paths as one score table."""
    parts = [table_trends(real, fake, t) for t in real.graph.tables if len(real.specs[t].domain.columns) > 1]
    paths = list(real.graph.relations) + (real.graph.long_paths() if long_range else [])
    for path in paths:
        if real.specs[path[0]].domain.columns and real.specs[path[-1]].domain.columns:
            parts.append(path_trends(real, fake, path))
    return reduce(DataFrame.unionByName, parts)
