"""Cells inside cells: the part of the nearest-neighbour index that grows with the table.

The top cells are few, so that their pivots can travel with the tasks.  Cells of more than ``CELL_ROWS`` points are split
by pivots of their own, level by level, until they are small; pivots below the top are rows that meet points and queries
in groups of bounded size.  A query first walks down to its home cell, whose size bounds the distances that matter, and
then visits the cells within that bound alone.

Cells that draw no two pivots, or lie ``MAX_LEVELS`` deep, stay as they are; the join deals their points to blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.metric import as_matrix, distances, limits, reachable, true_metric
from kinweave.session import cut

CELL_ROWS = 10_000  # points that a cell may hold without being split
FANOUT = 64  # cells that one is split into, on average
MAX_LEVELS = 5
POINT_ROWS = 20_000  # points that a task deals to cells at once
QUERY_ROWS = 2_000  # queries that a task takes down a level at once
_NUMBERS = 1_024  # more than the pivots a cell can draw; child = parent * _NUMBERS + 1, 2, ...

_POINT = "__bid bigint, __p array<double>, __cell bigint, __n bigint, __child bigint, __gap double"


@dataclass(frozen=True)
class CellTree:
    """``points``: __bid, __p, __cell, __n (size of the cell); ``levels``: __cell, __child, __pivot, __n, __radius, __open.

    ``split`` says of every top cell whether it was large enough to be split.
    """

    points: DataFrame
    levels: list[DataFrame]
    split: np.ndarray


def grow(assigned: DataFrame, counts: np.ndarray, metric: str, width: int) -> CellTree | None:
    """Split the cells of ``assigned`` (__bid, __p, __cell) with more than ``CELL_ROWS`` points; None if there are none.

    Cell i of the table becomes cell i + 1 of the tree.
    """
    if counts.max(initial=0) <= CELL_ROWS:
        return None
    sizes = [(i + 1, int(n)) for i, n in enumerate(counts) if n]
    sizes = assigned.sparkSession.createDataFrame(sizes, "__cell bigint, __n bigint")
    numbered = assigned.select("__bid", "__p", (F.col("__cell").cast("bigint") + 1).alias("__cell")).join(sizes, "__cell")
    columns = ["__bid", "__p", "__cell", "__n"]
    done = numbered.where(F.col("__n") <= CELL_ROWS).select(*columns)
    rows = numbered.where(F.col("__n") > CELL_ROWS).select(*columns)
    levels = []
    for level in range(1, MAX_LEVELS + 1):
        pivots = cut(_pivots(rows))
        placed = cut(_deal(rows, pivots, metric, width))
        stats = placed.where("__child >= 0").groupBy("__child").agg(F.count(F.lit(1)).alias("__m"), F.max("__gap").alias("__radius"))
        more = (F.col("__m") > CELL_ROWS) & F.lit(level < MAX_LEVELS)
        cells = cut(pivots.drop("__n").join(stats, "__child").withColumn("__open", more))
        levels.append(cells.select("__cell", "__child", "__pivot", F.col("__m").alias("__n"), "__radius", "__open"))
        done = done.unionByName(placed.where("__child < 0").select(*columns))
        known = placed.where("__child >= 0").select("__bid", "__p", "__child").join(cells.select("__child", "__m", "__open"), "__child")
        below = known.select("__bid", "__p", F.col("__child").alias("__cell"), F.col("__m").alias("__n"), "__open")
        done = done.unionByName(below.where("not __open").select(*columns))
        rows = below.where("__open").select(*columns)
        if not cells.where("__open").limit(1).count():
            break
    return CellTree(cut(done), levels, counts > CELL_ROWS)


def _pivots(rows: DataFrame) -> DataFrame:
    """``__cell, __n, __pivot, __child``: points of small hash, for every cell that draws two different ones or more."""
    u = F.shiftrightunsigned(F.xxhash64("__p", "__cell"), 11) / F.lit(float(1 << 53))
    wanted = F.least(F.lit(FANOUT), F.greatest(F.lit(8), 2 * F.ceil(F.col("__n") / CELL_ROWS)))
    drawn = rows.where(u * F.col("__n") < wanted).select(*[F.col(c).alias(n) for c, n in (("__cell", "__cell"), ("__n", "__n"), ("__p", "__pivot"))])
    drawn = drawn.distinct()  # renamed columns, as these rows meet those they come from
    mine = Window.partitionBy("__cell")  # some FANOUT rows
    ranked = drawn.withColumn("__at", F.row_number().over(mine.orderBy("__pivot"))).withColumn("__all", F.count(F.lit(1)).over(mine))
    ranked = ranked.where(f"__all > 1 and __at < {_NUMBERS}")
    return ranked.select("__cell", "__n", "__pivot", (F.col("__cell") * _NUMBERS + F.col("__at")).alias("__child"))


def _deal(rows: DataFrame, pivots: DataFrame, metric: str, width: int) -> DataFrame:
    """Points with the nearest pivot of their cell (``__child``, ``__gap``); -1 where the cell has no pivots."""
    parts = F.ceil(F.col("__n") / POINT_ROWS).cast("int")
    left = rows.withColumn("__chunk", F.pmod(F.xxhash64("__bid"), parts).cast("int"))
    right = pivots.withColumn("__chunk", F.explode(F.sequence(F.lit(0), parts - 1)))

    def nearest(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = p[["__bid", "__p", "__cell", "__n"]]
        if not len(p) or not len(c):
            return out.assign(__child=np.full(len(p), -1, "int64"), __gap=np.zeros(len(p)))
        d = distances(as_matrix(p["__p"], width), as_matrix(c["__pivot"], width), metric)
        at = d.argmin(axis=1)
        return out.assign(__child=c["__child"].to_numpy()[at], __gap=true_metric(d[np.arange(len(at)), at], metric))

    return left.groupBy("__cell", "__chunk").cogroup(right.groupBy("__cell", "__chunk")).applyInPandas(nearest, _POINT)


def visit_schema(extra: str, kind: str) -> str:
    return f"__q array<double>, {extra} {kind}, __limit double, __cell bigint, __n bigint, __open boolean"


def no_visits(extra: str) -> pd.DataFrame:
    none = pd.Series([], dtype=object)
    numbers = {c: np.array([], "int64") for c in (extra, "__cell", "__n")}
    return pd.DataFrame({"__q": none, **numbers, "__limit": np.array([], float), "__open": np.array([], bool)})


def chunks(rows: DataFrame, most: int) -> DataFrame:
    """``__cell, __parts`` of the cells with more than ``most`` rows."""
    return rows.groupBy("__cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__parts")).where("__parts > 1")


def parts() -> Column:
    return F.coalesce(F.col("__parts"), F.lit(1))


def walk(visits: DataFrame, tree: CellTree, metric: str, width: int, extra: str, home: bool) -> DataFrame:
    """Take visits of top cells down to last cells.

    ``home``: to the one nearest cell, with the bound that its level gives; else to all cells within the bound of the visit.
    """
    done = None
    for cells in tree.levels:
        settled = visits.where("not __open")
        done = settled if done is None else done.unionByName(settled)
        visits = cut(_down(cut(visits.where("__open")), cells, metric, width, extra, home))
    return done.unionByName(visits)


def _down(visits: DataFrame, cells: DataFrame, metric: str, width: int, extra: str, home: bool) -> DataFrame:
    heavy = chunks(visits, QUERY_ROWS)
    left = visits.join(heavy, "__cell", "left").withColumn("__chunk", F.pmod(F.xxhash64("__q"), parts()).cast("int")).drop("__parts")
    right = cells.join(heavy, "__cell", "left").withColumn("__chunk", F.explode(F.sequence(F.lit(0), parts() - 1))).drop("__parts")
    columns = ["__q", extra, "__limit", "__cell", "__n", "__open"]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return no_visits(extra)[columns]
        if not len(c):
            return q[columns].assign(__open=False)  # a cell that could not be split
        x = as_matrix(q["__q"], width)[:, :width]
        size, radius, limit = c["__n"].to_numpy(), c["__radius"].to_numpy(), q["__limit"].to_numpy()
        d = true_metric(distances(x, as_matrix(c["__pivot"], width), metric), metric)
        if home:
            limit = np.minimum(limit, limits(d, q[extra].to_numpy(), size, radius))
            at, cell = np.arange(len(q)), d.argmin(axis=1)
        else:
            at, cell = np.nonzero(reachable(d, limit, size, radius))
        return pd.DataFrame(
            {
                "__q": q["__q"].to_numpy()[at],
                extra: q[extra].to_numpy()[at],
                "__limit": limit[at],
                "__cell": c["__child"].to_numpy()[cell],
                "__n": size[cell],
                "__open": c["__open"].to_numpy()[cell],
            }
        )

    group = ["__cell", "__chunk"]
    schema = visit_schema(extra, visits.schema[extra].dataType.simpleString())
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(run, schema)
