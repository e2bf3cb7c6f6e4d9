"""Row synthesisers and table synthesis.

The copula stands in for a generative network: same contract - rows for a relation label, decoded and
snapped - fitted with aggregates.  It does not claim the quality of a trained network.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.hashing import hash_uniform
from kinweave.functions.literals import array_of
from kinweave.operators import clean as C
from kinweave.operators.encode import (
    default_quantiles,
    dictionary,
    encode,
    minmax,
    minmax_inverse,
    normal_cdf,
    narrow_categories,
    normal_quantile,
    one_hot,
    quantile_grid,
)
from kinweave.operators.features import split_widths, with_codes
from kinweave.operators.knn import knn_join
from kinweave.operators.ordering import exact_quantiles, with_position, with_rank
from kinweave.operators.profile import bounds
from kinweave.operators.relational import decode
from kinweave.session import cut, spread
from kinweave.specs import Domain

MAX_LABELS = 2000  # parameters of up to so many labels travel with the tasks; more are joined to the slots
SHARE_TABLE = 100_000  # category shares of up to so many values travel with the tasks; more are joined by range
SLOT_CHUNK = 100_000  # slots that one row expands to


class Synthesizer(Protocol):
    """Fit on real rows, then fill slots (any frame with ``slot_id`` and, if conditional, the label)."""

    def fit(self, df: DataFrame, domain: Domain, label: str | None = None) -> Synthesizer: ...

    def sample(self, slots: DataFrame, seed: int = 0) -> DataFrame: ...


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser: a counter-based random number per (row, column)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def counter_uniforms(keys: np.ndarray, width: int, seed: int) -> np.ndarray:
    """(rows x width) uniforms that depend on the row key, the column and the seed only."""
    base = _mix(keys.astype(np.int64).view(np.uint64) ^ _mix(np.array([seed], dtype=np.uint64)))
    out = np.empty((len(keys), width))
    with np.errstate(over="ignore"):
        for j in range(width):
            out[:, j] = (_mix(base + np.uint64(j + 1)) >> np.uint64(11)).astype(float) / 2.0**53
    return out


def interval_scores(values: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second moment of the normal score of each value.

    A value holding a whole stretch of the grid stands for every score in it, so its moments are those of the
    normal cut to that stretch.  Over the table the scores then have mean 0 and variance 1, ties or not.
    """
    levels = np.linspace(0.0, 1.0, len(grid))
    half = 0.5 / (len(grid) - 1)
    left = np.searchsorted(grid, values, side="left")
    right = np.searchsorted(grid, values, side="right")
    at = normal_quantile(np.interp(values, grid, levels))
    first, second = at, at**2
    tied = right - left > 1
    if tied.any():
        low = np.clip(levels[left[tied]] - half, 0.0, 1.0)
        high = np.clip(levels[right[tied] - 1] + half, 0.0, 1.0)
        a, b = normal_quantile(low), normal_quantile(high)
        fa, fb = (np.exp(-(x**2) / 2) / np.sqrt(2 * np.pi) for x in (a, b))
        first[tied] = (fa - fb) / (high - low)
        second[tied] = 1 + (a * fa - b * fb) / (high - low)
    return first, second


@dataclass
class CopulaSynthesizer:
    """Numeric marginals by quantile grids, categories by their exact shares, dependence by a normal copula
    per label.  Missing values come back at the rate of their column.

    ``guidance`` in [0, 1] moves the parameters of a label from the overall ones (0) to its own (1);
    labels with few rows are pulled back by ``pseudo_rows`` either way.
    """

    guidance: float = 1.0
    pseudo_rows: float = 20.0
    state: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, domain: Domain, label: str | None = None) -> CopulaSynthesizer:
        exclude = [label] if label else []
        numeric, categorical = domain.split(df.columns, exclude)
        columns = numeric + categorical
        work = spread(df.select(*columns, *exclude))
        # short category lists become an expression; only wide ones need a dictionary join
        lists = narrow_categories(work, categorical)
        codes: dict[str, DataFrame] = {c: dictionary(work, c) for c in categorical if c not in lists}
        for c, codebook in codes.items():
            work = encode(work, c, codebook)
        work = work.withColumns(
            {c: F.nullif(F.array_position(array_of(v), F.col(c).cast("string")), F.lit(0)) - 1 for c, v in lists.items() if v}
        )
        n_rows = work.count()
        n_quantiles = max(201, default_quantiles(n_rows))
        grids = quantile_grid(work, columns, n_quantiles)
        sizes = {c: len(lists[c]) if c in lists else int(codes[c].count()) for c in categorical}
        fixed = {c: np.asarray(grids[c] or [0.0, 0.0], dtype=float) for c in columns}
        shares: dict[str, np.ndarray] = {}
        spans: dict[str, DataFrame] = {}
        for c in categorical:
            counts = work.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("bigint").alias("code")).agg(F.count(F.lit(1)).alias("n"))
            if sizes[c] <= SHARE_TABLE:
                found = {r["code"]: r["n"] for r in counts.collect()}  # at most SHARE_TABLE rows
                shares[c] = np.cumsum([found.get(k, 0) for k in range(sizes[c])], dtype=float)
            else:
                spans[c] = _share_spans(counts, sizes[c])
        gaps = work.agg(F.lit(0).alias("__none"), *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
        d = len(columns)
        upper = [(i, j) for i in range(d) for j in range(i, d)]
        first = np.array([u[0] for u in upper], dtype=int)
        second = np.array([u[1] for u in upper], dtype=int)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
            for pdf in batches:
                z, zz = np.zeros((len(pdf), d)), np.ones((len(pdf), d))
                for j, c in enumerate(columns):
                    x = pdf[c].to_numpy(dtype=float)
                    known = ~np.isnan(x)
                    z[known, j], zz[known, j] = interval_scores(x[known], fixed[c])
                labels = pdf["__label"].to_numpy()
                for value in np.unique(labels):
                    mine = labels == value
                    part = z[mine]
                    products = (part[:, first] * part[:, second]).sum(axis=0)
                    products[first == second] = zz[mine].sum(axis=0)
                    n, s, p = held.get(int(value), (0.0, np.zeros(d), np.zeros(len(upper))))
                    held[int(value)] = (n + len(part), s + part.sum(axis=0), p + products)
            for value, (n, s, p) in held.items():
                yield pd.DataFrame(
                    {
                        "__label": value,
                        "entry": np.arange(1 + d + len(upper)),
                        "value": np.concatenate([[n], s, p]),
                    }
                )

        labelled = work.withColumn("__label", F.col(label).cast("int") if label else F.lit(0)).where("__label is not null")
        entries = 1 + d + len(upper)
        sums = labelled.select("__label", *columns).mapInPandas(partial, "__label int, entry int, value double")
        sums = sums.groupBy("__label", "entry").agg(F.sum("value").alias("value"))
        stats: dict[int, np.ndarray] = {}
        many = None
        if label and labelled.select("__label").distinct().count() > MAX_LABELS:
            sums = cut(sums)
            total = np.zeros(entries)
            for r in sums.groupBy("entry").agg(F.sum("value").alias("value")).collect():
                total[r["entry"]] = r["value"]
            stats[-1] = total
            many = self._label_parameters(sums, total, d, first, second)
        else:
            for r in sums.collect():  # labels x (1 + d + d (d + 1) / 2) numbers
                stats.setdefault(r["__label"], np.zeros(entries))[r["entry"]] = r["value"]
        self.state = {
            "numeric": numeric,
            "categorical": categorical,
            "label": label,
            "codes": codes,
            "lists": lists,
            "sizes": sizes,
            "grids": fixed,
            "shares": shares,
            "spans": spans,
            "gaps": {c: float(gaps[c] or 0.0) for c in columns},
            "many": many,
            "levels": C.levels_of(df, numeric),
            "params": self._parameters(stats, d, first, second),
            "rows": {k: float(entry[0]) for k, entry in stats.items()},
            "kinds": {c: df.schema[c].dataType.simpleString() for c in columns},
        }
        return self

    def _label_parameters(self, sums: DataFrame, total: np.ndarray, d: int, first: np.ndarray, second: np.ndarray) -> DataFrame:
        """``__label, __mean, __root`` of every label, for more labels than the driver should hold."""
        lists = sums.groupBy("__label").agg(F.sort_array(F.collect_list(F.struct("entry", "value")))["value"].alias("entries"))
        solver = CopulaSynthesizer(self.guidance, self.pseudo_rows)  # without fitted tables

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                means, roots = [], []
                for entries in pdf["entries"]:
                    mean, root = solver._parameters({0: np.asarray(entries, dtype=float)}, d, first, second, total)[0]
                    means.append(mean.tolist())
                    roots.append(root.ravel().tolist())
                yield pd.DataFrame({"__label": pdf["__label"], "__mean": means, "__root": roots})

        return cut(lists.mapInPandas(solve, "__label int, __mean array<double>, __root array<double>"))

    def _parameters(self, stats, d, first, second, total=None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        def moments(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = max(entry[0], 1.0)
            mean = entry[1 : 1 + d] / n
            cov = np.zeros((d, d))
            cov[first, second] = entry[1 + d :] / n
            cov[second, first] = cov[first, second]
            return mean, cov - np.outer(mean, mean)

        if total is None:
            total = sum(stats.values()) if stats else np.zeros(1 + d + len(first))
        all_mean, all_cov = moments(total)
        out = {-1: (all_mean, _root(all_cov))}
        for value, entry in stats.items():
            mean, cov = moments(entry)
            own = self.guidance * entry[0] / (entry[0] + self.pseudo_rows)
            out[value] = (own * mean + (1 - own) * all_mean, _root(own * cov + (1 - own) * all_cov))
        return out

    def sample(self, slots: DataFrame, seed: int = 0) -> DataFrame:
        s = self.state
        columns, label, params, grids = s["numeric"] + s["categorical"], s["label"], s["params"], s["grids"]
        shares, spans, gaps, many = s["shares"], s["spans"], s["gaps"], s["many"]
        wide, joined = set(spans), many is not None  # tables stay out of the function that travels
        d = len(columns)
        holed = [c for c in columns if gaps[c] > 0]
        keyed = slots.select(
            "*",
            F.xxhash64(F.col("slot_id").cast("string")).alias("__key"),
            (F.col(label).cast("int") if label else F.lit(0)).alias("__label"),
        )
        carried = slots.columns
        if many is not None:
            keyed = keyed.join(many, "__label", "left")

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                u = counter_uniforms(pdf["__key"].to_numpy(), d + len(holed), seed)
                e = normal_quantile(u[:, :d]) if d else np.zeros((len(pdf), 0))
                z = np.zeros_like(e)
                labels = pdf["__label"].to_numpy()
                for value in np.unique(labels):
                    at = labels == value
                    mean, root = params.get(int(value), params[-1])
                    if joined and pdf["__mean"].to_numpy()[at][0] is not None:
                        mean = np.asarray(pdf["__mean"].to_numpy()[at][0], dtype=float)
                        root = np.asarray(pdf["__root"].to_numpy()[at][0], dtype=float).reshape(d, d)
                    z[at] = mean + e[at] @ root.T
                out = {c: pdf[c] for c in carried}
                for j, c in enumerate(columns):
                    p = normal_cdf(z[:, j])
                    if c in shares:
                        upto = shares[c]
                        last = int(np.searchsorted(upto, upto[-1])) if len(upto) else 0
                        value = np.minimum(np.searchsorted(upto, p * upto[-1], side="right"), last).astype(float) if len(upto) else p * 0
                    elif c in wide:
                        value = p  # the range join below finds the category
                    else:
                        value = np.interp(p, np.linspace(0.0, 1.0, len(grids[c])), grids[c])
                    if c in holed:
                        value = np.where(u[:, d + holed.index(c)] < gaps[c], np.nan, value)
                    out[c] = value
                yield pd.DataFrame(out)

        kept = [f"`{c}` {slots.schema[c].dataType.simpleString()}" for c in carried]
        schema = ", ".join([*kept, *[f"`{c}` double" for c in columns]])
        rows = keyed.mapInPandas(draw, schema)
        rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in holed})
        for c, levels in s["levels"].items():
            rows = rows.withColumn(c, C.snap(F.col(c), levels))
        for c in s["categorical"]:
            if c in spans:
                rows = _draw_code(rows, c, spans[c], s["sizes"][c])
            code = F.col(c).cast("int")
            if c in s["codes"]:
                rows = decode(rows.withColumn(c, code), c, s["codes"][c])
            elif s["lists"][c]:
                # element_at does not pass on a null index that comes from a case expression
                rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.element_at(array_of(s["lists"][c]), F.coalesce(code, F.lit(0)) + 1)))
            else:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        kinds = s["kinds"]
        return rows.select(*carried, *[F.col(c).cast(kinds[c]).alias(c) for c in columns])


def _share_spans(counts: DataFrame, size: int) -> DataFrame:
    """``code, low, high`` by cell: the part of [0, 1) that each category covers, cut into ``size`` cells."""
    placed = with_position(counts, ["code"], sums=["n"])
    total = placed.agg(F.sum("n")).first()[0]
    spans = placed.select("code", ((F.col("run_n") - F.col("n")) / total).alias("__low"), (F.col("run_n") / total).alias("__high"))
    spans = spans.withColumn("__high", F.when(F.col("__high") >= 1, F.lit(2.0)).otherwise(F.col("__high")))
    top = F.lit(size - 1)
    first, last = (F.least(F.floor(F.col(x) * size), top) for x in ("__low", "__high"))
    return cut(spans.withColumn("__cell", F.explode(F.sequence(first, last))))


def _draw_code(rows: DataFrame, column: str, spans: DataFrame, size: int) -> DataFrame:
    """Replace the uniform number in ``column`` by the code of the category that covers it; null stays null."""
    u = F.col(column)
    asked = rows.withColumn("__at", F.least(F.floor(u * size), F.lit(size - 1)))
    met = asked.join(spans, (F.col("__at") == F.col("__cell")) & (u >= F.col("__low")) & (u < F.col("__high")), "left")
    return met.withColumn(column, F.col("code")).drop("__at", "__cell", "__low", "__high", "code")


def _root(cov: np.ndarray) -> np.ndarray:
    """Square root of a covariance; tiny negative eigenvalues are cut off."""
    if not len(cov):
        return cov
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return vectors * np.sqrt(np.maximum(values, 0.0))


@dataclass
class BootstrapSynthesizer:
    """Whole real rows drawn with replacement, inside the label when there is one."""

    state: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, domain: Domain, label: str | None = None) -> BootstrapSynthesizer:
        numeric, categorical = domain.split(df.columns, [label] if label else [])
        columns = numeric + categorical
        work = df.select(*columns, (F.col(label).cast("int") if label else F.lit(0)).alias("__label"))
        ranked = with_rank(work, ["__label"], columns or ["__label"], rank="__rank")
        sizes = ranked.groupBy("__label").agg(F.count(F.lit(1)).alias("__n"))
        self.state = {"rows": ranked, "sizes": sizes, "columns": columns, "label": label}
        return self

    def sample(self, slots: DataFrame, seed: int = 0) -> DataFrame:
        s, label = self.state, self.state["label"]
        keyed = slots.withColumn("__label", F.col(label).cast("int") if label else F.lit(0)).join(s["sizes"], "__label")
        pick = F.floor(hash_uniform("slot_id", salt="bootstrap", seed=seed) * F.col("__n")) + 1
        drawn = keyed.withColumn("__rank", pick).join(s["rows"], ["__label", "__rank"])
        return drawn.select(*slots.columns, *s["columns"])


# --- L13 ------------------------------------------------------------------------------------------

_APART = 1e6  # rows of different classes must never be neighbours
_LEAST_PENALTY = 1e-4  # below it numerics would be stretched beyond the distance of classes


def class_neighbours(df: DataFrame, key: str, vector: str, class_code: str, k: int, metric: str = "l2") -> DataFrame:
    """(key, neighbour_id) inside the own class: the class code is one more, far-stretched coordinate."""
    placed = df.select(
        key, F.concat(F.array(F.col(class_code).cast("double") * F.lit(_APART)), F.col(vector)).alias("__v")
    )
    near = knn_join(placed, placed, key, key, "__v", "__v", k, metric, exclude_same_id=True)
    return near.where(F.col("distance") < F.lit((_APART / 2) ** 2)).select(key, "neighbour_rank", "neighbour_id", "distance")


def interpolate(x: Column, neighbour: Column, step: Column) -> Column:
    return x + step * (neighbour - x)


def smote(
    df: DataFrame,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str,
    regression: bool = False,
    k: int = 5,
    frac: float = 1.0,
    frac_lam_del: float = 0.0,
    seed: int = 0,
    total: int | None = None,
) -> DataFrame:
    """floor(frac * class size) new rows per class: ``new_id``, the features and the target.

    With ``total`` the classes share exactly so many rows by largest remainder instead.  A row without a neighbour in
    its class - a class of one row - is copied.  Numerics move towards a neighbour by a step in [del/2, 1 - del/2]; categoricals take the majority of the
    neighbours (smallest on ties).  For regression the classes are the halves at the target's median and the
    target is synthesised as one more numeric column.
    """
    numeric, categorical = list(numeric), list(categorical)
    if regression:
        middle = exact_quantiles(df, target, [0.5])[0]
        work = df.withColumn("__class", (F.col(target) > middle).cast("int").cast("string"))
        moved = [*numeric, target]
    else:
        work, moved = df.withColumn("__class", F.col(target).cast("string")), numeric
    read = work.select(F.col(key).cast("bigint").alias("__id"), *dict.fromkeys([*moved, *categorical, target]), "__class")
    codes = dictionary(read, "__class")
    work = encode(spread(read), "__class", codes, out="__code")
    limits = bounds(work, moved)
    scaled = {f"__x{i}": minmax(F.col(c).cast("double"), *limits[c], (0.0, 1.0)) for i, c in enumerate(moved)}
    unit = work.withColumns(scaled)
    xs = [f"__x{i}" for i in range(len(moved))]
    vector, metric = F.array(*[F.col(x) for x in xs]).cast("array<double>"), "l2"
    if categorical:
        values, wide = split_widths([work], categorical)
        # a differing category costs as much as the median deviation of the class's numerics
        if xs:
            # over the rows as they are read: sums in another order would change its last digits
            deviation = encode(read, "__class", codes, out="__code").withColumns(scaled).groupBy("__code").agg(
                F.sort_array(F.array(*[F.coalesce(F.stddev_pop(x), F.lit(0.0)) for x in xs])).alias("s")
            )
            lower, upper = F.col("s")[(len(xs) - 1) // 2], F.col("s")[len(xs) // 2]
            unit = unit.join(deviation.select("__code", ((lower + upper) / 4).alias("__penalty")), "__code")
        else:
            unit = unit.withColumn("__penalty", F.lit(1.0))
        hots = [one_hot(F.col(c), values[c]) for c in categorical if c in values]
        if wide:
            # codes weigh what one-hot blocks of length 1 do, so the numerics are stretched instead; the order within a class
            # stays.  Without spread in the numerics, categories do not count, as in the other form
            counts = F.col("__penalty") > 0
            stretch = F.when(counts, 1 / F.greatest("__penalty", F.lit(_LEAST_PENALTY))).otherwise(F.lit(1.0))
            unit = with_codes(unit, wide)
            codes = [F.when(counts, F.coalesce(F.col(f"`__code_{c}`").cast("double"), F.lit(-1.0))).otherwise(F.lit(-1.0)) for c in wide]
            hots = [F.transform(h, lambda x: F.when(counts, x).otherwise(F.lit(0.0))) for h in hots]
            vector = F.concat(F.transform(vector, lambda x: x * stretch), *hots, F.array(*codes))
            metric = f"l2+{len(wide)}"
        else:
            vector = F.concat(vector, *[F.transform(h, lambda x: x * F.col("__penalty")) for h in hots])
    unit = unit.withColumn("__vector", vector)
    near = class_neighbours(unit, "__id", "__vector", "__code", k, metric)
    carried = [*xs, *categorical]
    other = unit.select(F.col("__id").alias("neighbour_id"), F.struct(*carried).alias("__row"))
    # at most k structs per row
    lists = near.join(other, "neighbour_id").groupBy("__id").agg(
        F.sort_array(F.collect_list(F.struct("neighbour_rank", "__row"))).alias("__near")
    )
    based = with_rank(
        unit.join(lists, "__id", "left").select("__id", "__code", target, *carried, "__near"), ["__code"], ["__id"], rank="__rank"
    )
    sizes = work.groupBy("__code").agg(F.count(F.lit(1)).alias("__bases"))
    slots = _class_slots(_quotas(sizes, frac, total))
    u = lambda salt: hash_uniform("__code", "__slot", salt=f"smote-{salt}", seed=seed)
    drawn = slots.select("__code", "__slot", (F.floor(u("base") * F.col("__bases")) + 1).alias("__rank"))
    rows = drawn.join(based, ["__code", "__rank"])
    low, high = frac_lam_del / 2, 1.0 - frac_lam_del / 2
    chosen = F.element_at("__near", (F.floor(u("neighbour") * F.size("__near")) + 1).cast("int"))["__row"]
    chosen = F.when(F.col("__near").isNotNull(), chosen).otherwise(F.struct(*carried))
    rows = rows.withColumn("__pick", chosen).withColumn("__step", F.lit(low) + F.lit(high - low) * u("step"))
    levels = C.levels_of(df, moved)

    def number(i: int, c: str) -> Column:
        value = minmax_inverse(interpolate(F.col(xs[i]), F.col("__pick")[xs[i]], F.col("__step")), *limits[c], (0.0, 1.0))
        value = C.snap(value, levels[c]) if c in levels else value
        kind = df.schema[c].dataType
        return (F.round(value) if kind.typeName() in ("byte", "short", "integer", "long") else value).cast(kind)

    def majority(c: str) -> Column:
        seen = F.transform("__near", lambda n: n["__row"][c])
        counted = F.transform(
            F.array_distinct(seen), lambda v: F.struct((-F.size(F.filter(seen, lambda w: w == v))).alias("n"), v.alias("v"))
        )
        return F.when(F.col("__near").isNotNull(), F.array_min(counted)["v"]).otherwise(F.col(c))

    out = [number(i, c).alias(c) for i, c in enumerate(moved)] + [majority(c).alias(c) for c in categorical]
    if not regression:
        out.append(F.col(target))
    return rows.select(F.concat_ws("-", "__code", "__slot").alias("new_id"), *out)


def _quotas(sizes: DataFrame, frac: float, total: int | None) -> DataFrame:
    """``__code, __bases, __n``: new rows per class, by ``frac`` or as largest-remainder shares of ``total``."""
    if total is None:
        return sizes.withColumn("__n", F.floor(F.col("__bases") * F.lit(float(frac))).cast("bigint"))
    real = sizes.agg(F.sum("__bases")).first()[0] or 1
    parts = sizes.withColumn("__all", F.col("__bases") * F.lit(total))
    parts = parts.withColumns({"__n": F.expr(f"__all div {real}"), "__rest": F.col("__all") % real})
    missing = total - (parts.agg(F.sum("__n")).first()[0] or 0)
    placed = with_position(parts, [F.desc("__rest"), F.asc("__code")], position="__turn")
    return placed.select("__code", "__bases", (F.col("__n") + (F.col("__turn") < missing).cast("bigint")).alias("__n"))


def _class_slots(classes: DataFrame) -> DataFrame:
    """(__code, __bases, __slot) with ``__n`` slots per class; large classes are spread over all tasks in chunks."""
    chunks = classes.where("__n > 0").withColumn("__chunk", F.explode(F.expr(f"sequence(0L, (__n - 1) div {SLOT_CHUNK})")))
    chunks = chunks.repartition("__code", "__chunk")
    last = F.least(F.col("__n"), (F.col("__chunk") + 1) * SLOT_CHUNK)
    return chunks.select("__code", "__bases", F.explode(F.sequence(F.col("__chunk") * SLOT_CHUNK + 1, last)).alias("__slot"))


@dataclass
class SmoteSynthesizer:
    """X1 over :func:`smote`: oversamples the whole table once and hands rows out by slot order."""

    target: str
    k: int = 5
    state: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, domain: Domain, label: str | None = None) -> SmoteSynthesizer:
        if label is not None:
            raise ValueError("SMOTE is an unconditional baseline")
        numeric, categorical = domain.split(df.columns, [self.target])
        self.state = {"df": df, "numeric": numeric, "categorical": categorical, "regression": self.target in domain.continuous}
        return self

    def sample(self, slots: DataFrame, seed: int = 0) -> DataFrame:
        s = self.state
        n = slots.count()
        keyed = cut(s["df"].withColumn("__row_id", F.monotonically_increasing_id()))  # stored, so the ids hold
        made = smote(
            keyed, "__row_id", s["numeric"], s["categorical"], self.target, s["regression"], self.k, seed=seed, total=n
        )
        numbered = with_position(made, ["new_id"], position="__at").drop("new_id")
        order = with_position(slots, ["slot_id"], position="__at")
        return order.join(numbered, "__at").drop("__at")
