import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators.knn import knn_join
from kinweave.operators.matching import greedy_match, iterative_match, match_with_repair, reconcile_parents, shuffled_match


def frame(spark, rows, key):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rows)], f"{key} bigint, vector array<double>")


def loop_match(a, b):
    """The sequential definition: every row takes the nearest unused b, smaller index on ties."""
    free, out = set(range(len(b))), {}
    for i, x in enumerate(a):
        if not free:
            out[i] = None
            continue
        j = min(free, key=lambda j: (sum((p - q) ** 2 for p, q in zip(x, b[j])), j))
        out[i] = j
        free.discard(j)
    return out


@pytest.mark.parametrize("seed,n_a,n_b,span", [(1, 12, 15, 3), (2, 30, 30, 4), (3, 25, 20, 3)])
def test_greedy_equals_the_loop_on_tied_grids(spark, seed, n_a, n_b, span):
    rng = random.Random(seed)
    a = [(rng.randrange(span), rng.randrange(span)) for _ in range(n_a)]
    b = [(rng.randrange(span), rng.randrange(span)) for _ in range(n_b)]
    got = {r["a_id"]: r["b_id"] for r in greedy_match(frame(spark, a, "a_id"), frame(spark, b, "b_id"), slack=2).collect()}
    assert got == loop_match(a, b)


def test_greedy_with_one_hot_group(spark):
    a = [(0, 0)] * 40 + [(5, 5)] * 5
    b = [(i * 0.1, 0) for i in range(50)]
    got = {r["a_id"]: r["b_id"] for r in greedy_match(frame(spark, a, "a_id"), frame(spark, b, "b_id"), slack=1).collect()}
    assert got == loop_match(a, b)


def test_repair_moves_later_rows_to_the_smallest_unused(spark):
    a = frame(spark, [(0,), (0,), (9,), (0,)], "a_id")
    b = frame(spark, [(50,), (0,), (60,), (9,), (70,)], "b_id")
    got = {r["a_id"]: (r["b_id"], r["repaired"]) for r in match_with_repair(a, b).collect()}
    assert got == {0: (1, False), 1: (0, True), 2: (3, False), 3: (2, True)}


def test_iterative_and_shuffled_are_one_to_one(spark):
    rng = random.Random(5)
    a = frame(spark, [(rng.random(), rng.random()) for _ in range(20)], "a_id")
    b = frame(spark, [(rng.random(), rng.random()) for _ in range(25)], "b_id")
    for pairs in (iterative_match(a, b), shuffled_match(a, b, salt="t")):
        rows = pairs.collect()
        assert len(rows) == 20 and len({r["b_id"] for r in rows}) == 20


def test_reconcile_uses_the_smallest_copy_as_anchor(spark):
    left = spark.createDataFrame([(0, 1.0, 10), (1, 2.0, 11), (2, 3.0, 12)], "id bigint, x double, p_id int")
    right = spark.createDataFrame([(0, 3.1, 7), (1, 1.1, 8)], "id bigint, x double, q_id int")
    out = reconcile_parents({"p": left, "q": right}, "id", {"p": "p_id", "q": "q_id"}, F.array("x"))
    assert {(r["id"], r["q_id"], r["p_id"]) for r in out.collect()} == {(0, 7, 12), (1, 8, 10)}


def small_cells(monkeypatch):
    """Few top cells, and cells inside cells already for some hundred points."""
    from kinweave.operators import cell_tree, knn

    monkeypatch.setattr(knn, "MAX_PIVOTS", 4)
    for name, value in dict(CELL_ROWS=12, FANOUT=8, QUERY_ROWS=7, POINT_ROWS=30).items():
        monkeypatch.setattr(cell_tree, name, value)


@pytest.mark.parametrize("metric,deep", [("l1", False), ("l2", False), ("l1", True), ("l2", True), ("l2+1", True)])
def test_knn_against_brute_force_with_copies(spark, monkeypatch, metric, deep):
    from kinweave.operators import knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 15)  # several blocks and chunks
    if deep:
        small_cells(monkeypatch)
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(0, 6, (60, 3)), np.full((40, 3), 2)]).astype(float)
    queries = np.concatenate([rng.integers(0, 6, (20, 3)), np.full((10, 3), 2)]).astype(float)
    got = {}
    for r in knn_join(
        frame(spark, queries, "q"), frame(spark, points, "p"), "q", "p", "vector", "vector", 7, metric
    ).collect():
        got.setdefault(r["q"], []).append((r["neighbour_rank"], r["distance"], r["neighbour_id"]))
    gaps = np.abs(queries[:, None] - points[None])
    d = gaps.sum(-1) if metric == "l1" else (gaps**2).sum(-1)
    if metric == "l2+1":
        d = (gaps[..., :2] ** 2).sum(-1) + 2.0 * (gaps[..., 2] > 0)
    for i in range(len(queries)):
        best = sorted((d[i, j], j) for j in range(len(points)))[:7]
        assert [(x[1], x[2]) for x in sorted(got[i])] == [(float(a), b) for a, b in best]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_cells_inside_cells_against_brute_force(spark, monkeypatch, k):
    """Clusters of unequal width, one point far away, a k beyond the table."""
    small_cells(monkeypatch)
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, w, (n, 3)) for c, w, n in ((0, 1, 150), (5, 0.01, 120), (9, 3, 60))] + [np.full((1, 3), 1e4)])
    got = {}
    rows = frame(spark, points, "id")
    for r in knn_join(rows, rows, "id", "id", "vector", "vector", k, exclude_same_id=True).collect():
        got.setdefault(r["id"], []).append((r["neighbour_rank"], r["neighbour_id"]))
    d = np.zeros((len(points), len(points)))
    for j in range(3):
        d += (points[:, None, j] - points[None, :, j]) ** 2
    for i in range(len(points)):
        best = sorted((d[i, j], j) for j in range(len(points)) if j != i)[:k]
        assert [x[1] for x in sorted(got[i])] == [j for _, j in best]


def test_balls_meet_cells_inside_cells(spark, monkeypatch):
    from kinweave.operators.knn import count_balls

    small_cells(monkeypatch)
    rng = np.random.default_rng(9)
    points, centres, radii = rng.normal(0, 2, (300, 2)), rng.normal(0, 2, (80, 2)), rng.uniform(0, 2, 80)
    balls = spark.createDataFrame([(c.tolist(), float(r)) for c, r in zip(centres, radii)], "vector array<double>, radius double")
    got = {r["id"]: r["hits"] for r in count_balls(balls, frame(spark, points, "id"), "id").collect()}
    inside = np.sqrt(((points[:, None] - centres[None]) ** 2).sum(-1)) < radii
    assert got == {i: int(n) for i, n in enumerate(inside.sum(axis=1)) if n}


def test_comparisons_grow_with_the_rows_and_not_with_their_square(spark, monkeypatch):
    from kinweave.operators import knn

    small_cells(monkeypatch)

    def compared(n):
        rng = np.random.default_rng(10)
        x = rng.integers(0, 12, (n, 1)) * 10 + rng.normal(0, 1, (n, 2))
        points = frame(spark, x, "id").select(F.col("id").alias("__bid"), F.col("vector").alias("__p"))
        asked = points.select(F.col("__p").alias("__q"), F.lit(3).cast("bigint").alias("__k"))
        layout = knn.lay_out_points(points, "l2")
        return knn.deep_visits(asked, "__k", layout).agg(F.sum("__n")).first()[0], int((layout.cells.counts**2).sum())

    (few, flat), (many, flat_many) = compared(800), compared(2_400)
    assert many < 4.5 * few and flat_many > 7 * flat  # a single level would compare nine times as many
    assert many < flat_many / 10


@pytest.mark.parametrize("deep", [False, True])
def test_queries_are_bounded_by_what_they_find_at_home(spark, monkeypatch, deep):
    """Rows brought back are those asked for, not k of every cell visited; copies of an id stay, gaps have no neighbours."""
    from kinweave.operators import knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    if deep:
        small_cells(monkeypatch)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 8, (400, 1)) * 10.0 + rng.normal(0, 1, (400, 2))
    points = frame(spark, x, "id").select((F.col("id") % 390).alias("__bid"), F.col("vector").alias("__p"))
    asked = points.select(F.col("__p").alias("__q")).unionByName(spark.createDataFrame([([None, 1.0],)], "__q array<double>"))
    got = {}
    for r in knn.nearest_rows(asked, points, 3).collect():
        got.setdefault(tuple(r["__q"]), []).append((r["distance"], r["__bid"]))
    d = (x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2
    assert len(got) == 400
    for i, v in enumerate(x):
        assert sorted(got[tuple(v)]) == sorted((d[i, j], j % 390) for j in range(400))[:3]


def test_a_block_is_searched_by_small_cells(monkeypatch):
    from kinweave.operators import knn

    pairs, plain = [], knn.distances

    def counted(queries, points, metric):
        pairs.append(len(queries) * len(points))
        return plain(queries, points, metric)

    monkeypatch.setattr(knn, "distances", counted)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 10, (4_000, 1)) * 10.0 + rng.normal(0, 1, (4_000, 2))
    at, ids, d = knn.nearest_within(x, np.full(4_000, 4), np.full(4_000, np.inf), x, np.arange(4_000), "l2")
    assert sum(pairs) < 4_000**2 / 8 and (np.bincount(at) == 4).all()
    for i in range(0, 4_000, 97):
        gaps = plain(x[i : i + 1], x, "l2")[0]
        order = np.lexsort((np.arange(4_000), gaps))[:4]
        assert ids[at == i].tolist() == order.tolist() and d[at == i].tolist() == gaps[order].tolist()
