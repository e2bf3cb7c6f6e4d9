"""Exact nearest-neighbour join without pairing everything with everything.

* Points are assigned to pivot cells; the triangle inequality names the cells that can hold one of a
  query's k nearest points, and only those are visited (an equi-join on the cell).
* Cells that grow large are split again (``cell_tree``), so the points a query meets do not grow with the table.
* What cannot be split is cut into blocks of bounded size, and queries into chunks, so no task sees an unbounded group.
* Copies of one vector are reduced first: only the k smallest ids of a vector can ever be among k nearest,
  and equal queries are answered once.
* Beyond one block of points a query is answered at home first: its true k-th distance there bounds the rest of the search,
  so on structured rows few queries visit a second place.  Small cells that lie together are packed into units of one block,
  which a query meets once; inside a unit small cells are searched by the same rule (``nearest_within``).
* Each task returns its best k per query; pairs never leave the task.

Ties go to the smaller id, so results do not depend on pivots, blocks or partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.literals import array_of
from kinweave.operators.cell_tree import CellTree, chunks, grow, parts, visit_schema, walk
from kinweave.operators.metric import as_matrix, distances, limits, near_products, pair_distances, reachable, true_metric
from kinweave.session import cut

BLOCK_ROWS = 20_000  # points or queries per task group
MAX_PIVOTS = 512
_CHUNK_CELLS = 4_000_000  # distances held at once inside a task
_MAX_SMALL = 256  # small cells inside a block
_WIDE = 8  # from so many coordinates on, squared distances are first estimated by a matrix product


def nearest_in_block(
    queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: np.ndarray, metric: str
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query index, ids, distances) of the k[i] nearest points by (distance, id)."""
    order = np.argsort(ids, kind="stable")
    points, ids = points[order], ids[order]
    step = max(1, _CHUNK_CELLS // max(1, len(points)))
    for start in range(0, len(queries), step):
        block = distances(queries[start : start + step], points, metric)
        top = int(min(k[start : start + step].max(), len(ids)))
        if top < len(ids):
            bound = np.partition(block, top - 1, axis=1)[:, top - 1]
        for i, row in enumerate(block):
            want = int(min(k[start + i], len(ids)))
            if top < len(ids):
                near = np.flatnonzero(row <= bound[i])
                near = near[np.argsort(row[near], kind="stable")][:want]
            else:
                near = np.argsort(row, kind="stable")[:want]
            yield start + i, ids[near], row[near]


def _small_cells(points: np.ndarray, metric: str, wanted: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Row numbers, pivots and radii of at most ``wanted`` cells inside one block."""
    drawn = np.random.default_rng(0).choice(len(points), min(wanted, len(points)), replace=False)
    pivots = np.unique(points[np.sort(drawn)], axis=0)
    at, gap = np.zeros(len(points), dtype=int), np.zeros(len(points))
    step = max(1, _CHUNK_CELLS // len(pivots))
    for start in range(0, len(points), step):
        d = distances(points[start : start + step], pivots, metric)
        near = d.argmin(axis=1)
        at[start : start + step] = near
        gap[start : start + step] = true_metric(d[np.arange(len(near)), near], metric)
    order = np.argsort(at, kind="stable")
    held = np.split(order, np.searchsorted(at[order], np.arange(1, len(pivots))))
    full = [i for i, rows in enumerate(held) if len(rows)]
    return [held[i] for i in full], pivots[full], np.array([gap[held[i]].max() for i in full])


def nearest_within(
    queries: np.ndarray, k: np.ndarray, limit: np.ndarray, points: np.ndarray, ids: np.ndarray, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of the k[i] nearest points by (distance, id), sorted in that order.

    ``limit`` bounds the true distance of what is wanted.  Each query meets its nearest small cell first, whose k-th
    distance bounds the cells it meets then; a block of rows never yields more than k and its ties per query.
    """
    wanted = int(min(_MAX_SMALL, math.sqrt(len(points)), 1 + len(queries) / 8))
    held, pivots, radii = _small_cells(points, metric, max(1, wanted))
    counts = np.array([len(rows) for rows in held])
    gaps = true_metric(distances(queries, pivots, metric), metric)
    home, limit = gaps.argmin(axis=1), limit.copy()
    few = np.flatnonzero(counts[home] < k)  # the others get a bound in their home
    limit[few] = np.minimum(limit[few], limits(gaps[few], k[few], counts, radii))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    most, waiting, products = 0, 0, metric == "l2" and points.shape[1] >= _WIDE

    def settle() -> None:
        """Keep the best k of what is found so far."""
        at, name, d = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((name, d, at))
        at, name, d = at[order], name[order], d[order]
        start = np.searchsorted(at, np.arange(len(queries)))
        kept = np.arange(len(at)) - start[at] < k[at]
        found[:] = [(at[kept], name[kept], d[kept])]
        full = np.flatnonzero(np.bincount(at, minlength=len(queries)) >= k)
        limit[full] = np.minimum(limit[full], true_metric(d[start[full] + k[full] - 1], metric))

    def meet(asked: np.ndarray, cell: int, first: bool) -> None:
        nonlocal waiting, most
        rows = held[cell]
        step = max(1, _CHUNK_CELLS // len(rows))
        for start in range(0, len(asked), step):
            some = asked[start : start + step]
            d, error = near_products(queries[some], points[rows]) if products else (distances(queries[some], points[rows], metric), 0.0)
            top = int(k[some].max())
            if first and top < len(rows):
                best = np.sort(np.partition(d, top - 1, axis=1)[:, :top], axis=1)
                kth = np.maximum(best[np.arange(len(some)), k[some] - 1] + error, 0.0)
                limit[some] = np.minimum(limit[some], true_metric(kth, metric))
            edge = limit[some] * (1 + 1e-9) + 1e-12
            at, column = np.nonzero(d <= ((edge if metric.startswith("l1") else edge * edge) + error)[:, None])
            exact = pair_distances(queries, points, some[at], rows[column]) if products else d[at, column]
            found.append((some[at], ids[rows[column]], exact))
            waiting += len(at)
            if waiting > 2 * most + 32 * len(queries):
                settle()
                waiting = most = len(found[0][0])

    for cell in range(len(held)):
        if len(asked := np.flatnonzero(home == cell)):
            meet(asked, cell, True)
    for cell in range(len(held)):
        # ``reachable`` cell by cell, with the limits as they have shrunk by now
        low = np.maximum(gaps[:, cell] - radii[cell], (gaps[:, cell] - gaps[np.arange(len(gaps)), home]) / 2)
        asked = np.flatnonzero((low <= limit + 1e-9 * (1 + np.abs(limit))) & (home != cell))
        if len(asked):
            meet(asked, cell, False)
    settle()
    return found[0]


@dataclass(frozen=True)
class _Cells:
    """Pivots with the size and radius of their cells; at most ``MAX_PIVOTS`` entries."""

    pivots: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    metric: str

    def blocks(self) -> np.ndarray:
        return np.maximum(1, np.ceil(self.counts / BLOCK_ROWS)).astype(int)

    def gaps(self, queries: np.ndarray) -> np.ndarray:
        return true_metric(distances(queries, self.pivots, self.metric), self.metric)

    def reach(self, queries: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Boolean (queries x cells): cells that may hold one of the k nearest points."""
        d = self.gaps(queries)
        return reachable(d, limits(d, k, self.counts, self.radii), self.counts, self.radii)


def _choose_pivots(points: DataFrame) -> np.ndarray:
    """Distinct vectors of smallest hash, about sqrt(n) / 2 and at most ``MAX_PIVOTS`` of them.

    The sample also tells n: with m values kept, the m-th smallest of n uniform hashes is near m / n.
    Results do not depend on the pivots, only the amount of pruning does.
    """
    sample = 4 * MAX_PIVOTS
    hashed = points.select("__p", F.xxhash64("__p").alias("h"))
    total = points.count()
    if total > 4 * sample:  # few vectors per partition beyond the smallest hashes reach the merge
        near = hashed.where(F.col("h") < int(-(2**63) + 2**64 * (2 * sample / total)))
        rows = near.orderBy("h", "__p").limit(sample).collect()
        if len(rows) < sample:
            rows = hashed.orderBy("h", "__p").limit(sample).collect()
    else:
        rows = hashed.orderBy("h", "__p").limit(sample).collect()
    n_points = len(rows)
    if n_points == sample:
        n_points = sample / max((rows[-1]["h"] + 2**63) / 2**64, 1e-18)
    wanted = int(min(MAX_PIVOTS, max(1, round(math.sqrt(n_points) / 2))))
    seen: dict[tuple, None] = {}
    for r in rows:
        seen.setdefault(tuple(r["__p"]))
    return np.array(list(seen)[:wanted], dtype=float)


def _assign(points: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = as_matrix(pdf["__p"], pivots.shape[1])
            if not len(x):
                continue
            cells, gaps = [], []
            step = max(1, _CHUNK_CELLS // len(pivots))
            for start in range(0, len(x), step):
                d = distances(x[start : start + step], pivots, metric)
                at = d.argmin(axis=1)
                cells.append(at)
                gaps.append(true_metric(d[np.arange(len(at)), at], metric))
            yield pdf.assign(__cell=np.concatenate(cells).astype("int32"), __gap=np.concatenate(gaps))

    return points.mapInPandas(run, "__bid bigint, __p array<double>, __cell int, __gap double")


@dataclass(frozen=True)
class Layout:
    """Points with their cell, the cell table, and the cells inside large cells."""

    assigned: DataFrame
    cells: _Cells
    tree: CellTree | None = None

    def groups(self) -> int:
        """Blocks of points, at most so many of which a query can visit."""
        if self.tree is None:
            return int(self.cells.blocks().sum())
        last = self.tree.points.select("__cell", "__n").distinct()
        return int(last.agg(F.sum(F.ceil(F.col("__n") / BLOCK_ROWS))).first()[0] or 0)


    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """For every top cell the number of its place in the tree's numbering and the points there.

        A cell that is split keeps its number; the others are packed into units of at most ``BLOCK_ROWS`` points or one
        cell, which have numbers below 0.
        """
        cells = self.cells
        number, size = np.arange(len(cells.pivots)) + 1, cells.counts.copy()
        split = self.tree.split if self.tree is not None else np.zeros(len(number), dtype=bool)
        open_sets, unit = [np.flatnonzero(~split & (cells.counts > 0))], 0
        while open_sets:
            mine = open_sets.pop()
            if len(mine) > 1 and cells.counts[mine].sum() > BLOCK_ROWS:
                # two halves by the difference of the distances to two pivots far apart
                far = lambda i: mine[np.nan_to_num(cells.gaps(cells.pivots[[i]])[0][mine]).argmax()]
                one = far(mine[0])
                between = np.nan_to_num(np.subtract(*cells.gaps(cells.pivots[[one, far(one)]])))[mine]
                mine = mine[np.argsort(between, kind="stable")]
                upto = np.cumsum(cells.counts[mine])
                half = int(np.clip(np.searchsorted(upto, upto[-1] / 2) + 1, 1, len(mine) - 1))
                open_sets += [mine[:half], mine[half:]]
            elif len(mine):
                unit -= 1
                number[mine], size[mine] = unit, cells.counts[mine].sum()
        return number, size


def lay_out_points(points: DataFrame, metric: str) -> Layout | None:
    """Cells of ``points`` (__bid, __p); None for an empty table."""
    pivots = _choose_pivots(points)
    if not len(pivots):
        return None
    assigned = cut(_assign(points, pivots, metric))  # read again by the cell statistics and the join
    counts, radii = np.zeros(len(pivots), dtype=int), np.zeros(len(pivots))
    for r in assigned.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), F.max("__gap").alias("r")).collect():
        counts[r["__cell"]], radii[r["__cell"]] = r["n"], r["r"]
    return Layout(assigned, _Cells(pivots, counts, radii, metric), grow(assigned, counts, metric, pivots.shape[1]))


def _meet(
    asked: DataFrame, extra: str, layout: Layout, reach: Callable, kernel: Callable, schema: str, most: int
) -> DataFrame:
    """Bring queries (__q and the number ``extra``) and points together in bounded blocks.

    ``reach(vectors, extra)`` names the cells a query must visit; ``kernel(q, p)`` sees one chunk of
    queries and one block of points.  ``most`` bounds the number of queries from above.
    """
    if layout.tree is not None:
        return _meet_deep(deep_visits(asked, extra, layout), layout.tree, kernel, schema)
    cells, width = layout.cells, layout.cells.pivots.shape[1]
    blocks = cells.blocks()
    kind = asked.schema[extra].dataType.simpleString()
    step = max(1, _CHUNK_CELLS // len(cells.pivots))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                number = part[extra].to_numpy()
                at, cell = np.nonzero(reach(as_matrix(part["__q"], width), number))
                copies = blocks[cell]
                first = np.repeat(np.cumsum(copies) - copies, copies)
                at, cell = np.repeat(at, copies), np.repeat(cell, copies)
                block = np.arange(len(at)) - first
                yield pd.DataFrame(
                    {
                        "__q": part["__q"].to_numpy()[at],
                        extra: number[at],
                        "__cell": cell.astype("int32"),
                        "__block": block.astype("int32"),
                    }
                )

    visits = asked.select("__q", extra).mapInPandas(
        visit, f"__q array<double>, {extra} {kind}, __cell int, __block int"
    )
    chunks = np.ones(len(cells.pivots), dtype=int)
    if most > BLOCK_ROWS:
        for r in visits.where("__block = 0").groupBy("__cell").count().collect():
            chunks[r["__cell"]] = math.ceil(r["count"] / BLOCK_ROWS)
    # at most MAX_PIVOTS cells, so these lookup arrays stay small
    chunk_of = F.element_at(array_of([int(c) for c in chunks]), F.col("__cell") + 1)
    block_of = F.element_at(array_of([int(b) for b in blocks]), F.col("__cell") + 1)
    left = visits.withColumn("__chunk", F.pmod(F.xxhash64("__q"), chunk_of).cast("int"))
    right = layout.assigned.select(
        "__bid",
        "__p",
        "__cell",
        F.pmod(F.xxhash64("__bid"), block_of).cast("int").alias("__block"),
        F.explode(F.sequence(F.lit(0), chunk_of - 1)).alias("__chunk"),
    )
    group = ["__cell", "__block", "__chunk"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(kernel, schema)


def deep_visits(asked: DataFrame, extra: str, layout: Layout) -> DataFrame:
    """Last cells of the tree that each query must visit.

    ``extra`` is ``__k``, the number of neighbours, or else the radius of the query.
    """
    cells, tree = layout.cells, layout.tree
    width, metric, step = cells.pivots.shape[1], cells.metric, max(1, _CHUNK_CELLS // len(cells.pivots))
    split = tree.split
    schema = visit_schema(extra, asked.schema[extra].dataType.simpleString())

    def top(home: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), step):
                    part = pdf.iloc[start : start + step]
                    d = cells.gaps(as_matrix(part["__q"], width)[:, :width])
                    if home:
                        limit = limits(d, part[extra].to_numpy(), cells.counts, cells.radii)
                        at, cell = np.arange(len(part)), np.where(cells.counts > 0, d, np.inf).argmin(axis=1)
                    else:
                        limit = part["__limit"].to_numpy()
                        at, cell = np.nonzero(reachable(d, limit, cells.counts, cells.radii))
                    yield pd.DataFrame(
                        {
                            "__q": part["__q"].to_numpy()[at],
                            extra: part[extra].to_numpy()[at],
                            "__limit": limit[at],
                            "__cell": cell.astype("int64") + 1,
                            "__n": cells.counts[cell].astype("int64"),
                            "__open": split[cell],
                        }
                    )

        return run

    if extra == "__k":
        homes = asked.select("__q", extra).mapInPandas(top(True), schema)
        bounded = walk(homes, tree, metric, width, extra, True).select("__q", extra, "__limit")
    else:
        bounded = asked.select("__q", extra, (F.col(extra) * (1 + 1e-9) + 1e-9).alias("__limit"))
    return walk(bounded.mapInPandas(top(False), schema), tree, metric, width, extra, False)


def _meet_deep(visits: DataFrame, tree: CellTree, kernel: Callable, schema: str) -> DataFrame:
    """Visits of last cells meet their points, in blocks and chunks where a cell has many."""
    return _meet_cells(visits.drop("__limit", "__open"), tree.points, kernel, schema)


def _meet_cells(visits: DataFrame, points: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``visits`` (__q, __cell, __n, ...) meet ``points`` (__bid, __p, __cell, __n)."""
    visits = cut(visits)
    heavy = chunks(visits, BLOCK_ROWS)
    blocks = F.ceil(F.col("__n") / BLOCK_ROWS).cast("int")
    left = visits.join(heavy, "__cell", "left").withColumn("__chunk", F.pmod(F.xxhash64("__q"), parts()).cast("int"))
    left = left.withColumn("__block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("__parts", "__n")
    right = points.join(heavy, "__cell", "left").select(
        "__bid",
        "__p",
        "__cell",
        F.pmod(F.xxhash64("__bid"), blocks).cast("int").alias("__block"),
        F.explode(F.sequence(F.lit(0), parts() - 1)).alias("__chunk"),
    )
    group = ["__cell", "__block", "__chunk"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(kernel, schema)


_LIST_SCHEMA = "__q array<double>, __k bigint, __limit double, __home bigint, __block int, __ids array<bigint>, __gaps array<double>"


def nearest_lists(queries: DataFrame, layout: Layout) -> DataFrame:
    """(__q, near): the k nearest points of every query, ``near`` an array of (distance, __bid) in order.

    ``queries`` has distinct vectors ``__q`` and ``__k``.  A query is answered in its home unit or cell first; what it
    finds there bounds the units and cells it visits then.
    """
    cells, width, metric = layout.cells, layout.cells.pivots.shape[1], layout.cells.metric
    number, size = layout.units()
    split = layout.tree.split if layout.tree is not None else np.zeros(len(number), dtype=bool)
    usable, step = (cells.counts > 0) & ~np.isnan(cells.radii), max(1, _CHUNK_CELLS // len(cells.pivots))
    # the number of a query travels as one more number of its vector
    numbered = cut(queries.withColumn("__at", F.monotonically_increasing_id()))
    asked = numbered.select(F.concat("__q", F.array(F.col("__at").cast("double"))).alias("__q"), "__k")
    schema = visit_schema("__k", "bigint")

    def visit(part: pd.DataFrame, at: np.ndarray, cell: np.ndarray, limit: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "__q": part["__q"].to_numpy()[at],
                "__k": part["__k"].to_numpy()[at],
                "__limit": limit[at],
                "__cell": number[cell].astype("int64"),
                "__n": size[cell].astype("int64"),
                "__open": split[cell],
            }
        )

    def to_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                d = cells.gaps(as_matrix(part["__q"], width)[:, :width])
                at = np.flatnonzero(~np.isnan(d).any(axis=1) & usable.any())  # a gap in a vector has no distance
                cell, k = np.where(usable, d, np.inf).argmin(axis=1), part["__k"].to_numpy()
                limit, few = np.full(len(part), np.inf), np.flatnonzero(size[cell] < k)
                limit[few] = limits(d[few], k[few], cells.counts, cells.radii)  # the others get a bound in their home
                yield visit(part, at, cell[at], limit)

    def to_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                d, limit = cells.gaps(as_matrix(part["__q"], width)[:, :width]), part["__limit"].to_numpy()
                at, cell = np.nonzero(reachable(d, limit, cells.counts, cells.radii))
                pairs = at * (2 * len(number) + 1) + number[cell] + len(number)
                first = np.unique(pairs, return_index=True)[1]  # a unit is visited once
                first = first[number[cell[first]] != part["__home"].to_numpy()[at[first]]]
                yield visit(part, at[first], cell[first], limit)

    def kernel(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        x, k = as_matrix(q["__q"], width + 1)[:, :width], q["__k"].to_numpy()
        limit = q["__limit"].to_numpy(dtype=float).copy()
        points, ids = as_matrix(p["__p"], width), p["__bid"].to_numpy()
        whole = ~np.isnan(points).any(axis=1)
        points, ids = points[whole], ids[whole]
        if len(points) and len(x):
            at, name, d = nearest_within(x, k, np.where(np.isnan(limit), np.inf, limit), points, ids, metric)
        else:
            at, name, d = np.array([], int), np.array([], "int64"), np.array([], float)
        ends = np.searchsorted(at, np.arange(1, len(q)))
        n = np.bincount(at, minlength=len(q))
        full = np.flatnonzero(n >= k)
        limit[full] = np.fmin(limit[full], true_metric(d[(np.cumsum(n) - n + k - 1)[full]], metric))
        out = q[["__q", "__k"]].assign(__limit=limit, __home=q["__cell"], __block=q["__block"])
        lists = lambda v: pd.Series([*np.split(v, ends), None][: len(q)], index=q.index, dtype=object)
        return out.assign(__ids=lists(name), __gaps=lists(d))

    if layout.tree is None:
        place = F.element_at(array_of([int(u) for u in number]), F.col("__cell") + 1).cast("bigint")
        held = F.element_at(array_of([int(n) for n in size]), F.col("__cell") + 1).cast("bigint")
        points = layout.assigned.select("__bid", "__p", place.alias("__cell"), held.alias("__n"))
        down = lambda visits, home: visits
    else:
        top = F.col("__cell").between(1, len(number)) & ~F.element_at(array_of([bool(x) for x in split]), F.least(F.greatest("__cell", F.lit(1)), F.lit(len(number))).cast("int"))
        slot = F.least(F.greatest("__cell", F.lit(1)), F.lit(len(number))).cast("int")
        place = F.when(top, F.element_at(array_of([int(u) for u in number]), slot)).otherwise(F.col("__cell")).cast("bigint")
        held = F.when(top, F.element_at(array_of([int(n) for n in size]), slot)).otherwise(F.col("__n")).cast("bigint")
        points = layout.tree.points.select("__bid", "__p", place.alias("__cell"), held.alias("__n"))
        down = lambda visits, home: walk(visits, layout.tree, metric, width, "__k", home)

    homes = down(asked.mapInPandas(to_home, schema), True).drop("__open")
    first = cut(_meet_cells(homes, points, kernel, _LIST_SCHEMA))
    # so does its home, which it need not visit again; every block of a home gives a bound, one is enough
    bounded = first.where("__block = 0").select(
        F.concat("__q", F.array(F.col("__home").cast("double"))).alias("__q"), "__k", "__limit", "__home"
    )
    others = down(bounded.mapInPandas(to_others, schema), False).drop("__open").where(F.element_at("__q", -1) != F.col("__cell"))
    second = _meet_cells(others, points, kernel, _LIST_SCHEMA).where(F.size("__ids") > 0)
    both = first.unionByName(second).select(
        F.element_at("__q", width + 1).cast("bigint").alias("__at"),
        F.arrays_zip(F.col("__gaps").alias("distance"), F.col("__ids").alias("__bid")).alias("found"),
    )
    merged = both.groupBy("__at").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return numbered.join(merged, "__at").select("__q", F.slice("found", F.lit(1), F.col("__k").cast("int")).alias("near"))


_NEAR_SCHEMA = "__q array<double>, __bid bigint, distance double"


def nearest_rows(
    queries: DataFrame,
    points: DataFrame,
    k: int | None,
    metric: str = "l2",
    most: int | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """(__q, __bid, distance) rows holding at least every query's k nearest points.

    ``queries`` has distinct vectors ``__q`` (and a ``__k`` column when k varies), ``points`` has
    ``__bid`` and ``__p``.  The caller ranks the rows and cuts them to k.
    """
    layout = layout or lay_out_points(points, metric)
    if layout is None:
        return points.sparkSession.createDataFrame([], _NEAR_SCHEMA)
    asked = queries if k is None else queries.withColumn("__k", F.lit(k).cast("bigint"))
    if layout.cells.counts.sum() > BLOCK_ROWS:
        lists = nearest_lists(asked.select("__q", "__k"), layout)
        return lists.select("__q", F.inline("near")).select("__q", "__bid", "distance")
    width = layout.cells.pivots.shape[1]

    def kernel(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            none = pd.Series([], dtype=object)
            return pd.DataFrame({"__q": none, "__bid": np.array([], "int64"), "distance": np.array([], float)})
        found = list(
            nearest_in_block(
                as_matrix(q["__q"], width), as_matrix(p["__p"], width), p["__bid"].to_numpy(), q["__k"].to_numpy(), metric
            )
        )
        at = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
        return pd.DataFrame(
            {
                "__q": q["__q"].to_numpy()[at],
                "__bid": np.concatenate([f[1] for f in found]),
                "distance": np.concatenate([f[2] for f in found]),
            }
        )

    most = queries.count() if most is None else most
    return _meet(asked, "__k", layout, layout.cells.reach, kernel, _NEAR_SCHEMA, most)


def count_balls(balls: DataFrame, others: DataFrame, key: str, metric: str = "l2") -> DataFrame:
    """(key, hits): how many Euclidean balls (``vector``, ``radius``) strictly contain each row of ``others``.

    Exact; a task returns counts per point, so pairs never leave it.  Rows in no ball are left out.
    Equal balls are counted once with their weight and equal points once for all.
    """
    vectors = others.select(F.col(key).cast("bigint").alias("__aid"), F.col("vector").cast("array<double>").alias("__p"))
    points = vectors.groupBy("__p").agg(F.min("__aid").alias("__bid"))
    layout = lay_out_points(points.select("__bid", "__p"), metric)
    schema = "__bid bigint, hits bigint"
    if layout is None:
        return others.sparkSession.createDataFrame([], f"{key} bigint, hits bigint")
    cells, width = layout.cells, layout.cells.pivots.shape[1]
    weighted = balls.groupBy(F.col("vector").cast("array<double>").alias("c"), "radius").agg(
        F.count(F.lit(1)).alias("w")
    )
    # the weight travels as one more number of the query vector
    asked = weighted.select(
        F.concat("c", F.array(F.col("w").cast("double"))).alias("__q"), F.col("radius").cast("double").alias("__r")
    )

    def reach(q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        d = np.sqrt(distances(q[:, :width], cells.pivots, metric))
        return (d - cells.radii[None, :] <= (radius * (1 + 1e-9) + 1e-9)[:, None]) & (cells.counts[None, :] > 0)

    def kernel(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"__bid": np.array([], "int64"), "hits": np.array([], "int64")})
        x, radius = as_matrix(q["__q"], width + 1), q["__r"].to_numpy()
        points = as_matrix(p["__p"], width)
        hits = np.zeros(len(points))
        step = max(1, _CHUNK_CELLS // len(points))
        for start in range(0, len(x), step):
            part = x[start : start + step]
            inside = np.sqrt(distances(part[:, :width], points, metric)) < radius[start : start + step, None]
            hits += part[:, width] @ inside
        out = pd.DataFrame({"__bid": p["__bid"].to_numpy(), "hits": hits.astype("int64")})
        return out[out["hits"] > 0]

    met = _meet(asked, "__r", layout, reach, kernel, schema, balls.count())
    counted = met.groupBy("__bid").agg(F.sum("hits").alias("hits"))
    by_vector = points.join(counted, "__bid").select("__p", "hits")
    return vectors.join(by_vector, "__p").select(F.col("__aid").alias(key), "hits")


def knn_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_vector: str,
    right_vector: str,
    k: int,
    metric: str = "l2",
    exclude_same_id: bool = False,
) -> DataFrame:
    """(left_id, neighbour_rank, neighbour_id, distance); ``l2`` gives squared distances.

    ``exclude_same_id`` leaves a row out of its own neighbours in a self-join.
    """
    need = k + 1 if exclude_same_id else k
    points = right.select(
        F.col(right_id).cast("bigint").alias("__bid"), F.col(right_vector).cast("array<double>").alias("__p")
    )
    # rank <= need is cut before the shuffle too, so copies of one vector never pile up in a task
    copies = Window.partitionBy("__p").orderBy("__bid")
    points = points.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= need).drop("__copy")
    asked = left.select(
        F.col(left_id).cast("bigint").alias("__aid"), F.col(left_vector).cast("array<double>").alias("__q")
    )
    layout = lay_out_points(cut(points), metric)
    queries = asked.select("__q").distinct()
    if layout is not None and layout.cells.counts.sum() > BLOCK_ROWS:
        best = nearest_lists(queries.withColumn("__k", F.lit(need).cast("bigint")), layout)
    else:
        rows = nearest_rows(queries, points, need, metric, most=left.count(), layout=layout)
        best = rows.groupBy("__q").agg(
            F.slice(F.array_sort(F.collect_list(F.struct("distance", "__bid"))), 1, need).alias("near")
        )
    joined = asked.join(best, "__q")
    near = F.col("near")
    if exclude_same_id:
        near = F.filter(near, lambda n: n["__bid"] != F.col("__aid"))
    return joined.select(
        F.col("__aid").alias(left_id), F.posexplode(F.slice(near, 1, k)).alias("__at", "n")
    ).select(
        left_id,
        (F.col("__at") + 1).alias("neighbour_rank"),
        F.col("n.__bid").alias("neighbour_id"),
        F.col("n.distance").alias("distance"),
    )
