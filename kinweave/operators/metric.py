"""Distances between vectors and what the triangle inequality says about cells of points."""

from __future__ import annotations

import numpy as np
import pandas as pd

_CACHED = 65_536  # distances summed at once, so that they stay in a core's cache


def distances(queries: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    """Dense (queries x points) distances, summed dimension by dimension.

    ``l1+3`` or ``l2+3`` says that the last three coordinates are category codes.  Different codes cost 2, as their
    one-hot vectors would, and a code against a missing one (negative) costs 1.
    """
    out = np.zeros((len(queries), len(points)))
    columns, step = np.ascontiguousarray(points.T), max(1, _CACHED // max(1, len(points)))
    for start in range(0, len(queries), step):
        _add_distances(out[start : start + step], queries[start : start + step], columns, metric)
    return out


def _add_distances(out: np.ndarray, queries: np.ndarray, columns: np.ndarray, metric: str) -> None:
    kind, _, codes = metric.partition("+")
    numbers = queries.shape[1] - int(codes or 0)
    for j in range(numbers):
        gap = queries[:, j, None] - columns[None, j]
        out += np.abs(gap) if kind == "l1" else gap * gap
    for j in range(numbers, queries.shape[1]):
        q, p = queries[:, j, None], columns[None, j]
        out += (q != p) * (2.0 - (q < 0) - (p < 0))


def near_products(queries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and by how much those of each query may be off."""
    a, b = queries - points[0], points - points[0]
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 8 * (queries.shape[1] + 4) * np.finfo(float).eps * (aa + bb.max())
    return aa[:, None] + bb[None, :] - 2 * (a @ b.T), error


def pair_distances(queries: np.ndarray, points: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (q[i], p[i]), summed as :func:`distances` sums them."""
    out = np.zeros(len(q))
    for j in range(queries.shape[1]):
        gap = queries[q, j] - points[p, j]
        out += gap * gap
    return out


def true_metric(values: np.ndarray, metric: str) -> np.ndarray:
    return values if metric.startswith("l1") else np.sqrt(values)


def as_matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


def limits(d: np.ndarray, k: np.ndarray, counts: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of each query's k-th smallest distance, from its distances ``d`` to the pivots of some cells."""
    far = d + radii[None, :]
    order = np.argsort(far, axis=1)
    enough = np.cumsum(counts[order], axis=1) >= k[:, None]
    sorted_far = np.take_along_axis(far, order, axis=1)
    limit = np.where(enough.any(axis=1), sorted_far[np.arange(len(d)), enough.argmax(axis=1)], np.inf)
    # pivots are points themselves, so the k-th nearest pivot bounds the k-th nearest point
    ranked = np.sort(d, axis=1)
    few = np.flatnonzero(k <= d.shape[1])
    limit[few] = np.minimum(limit[few], ranked[few, k[few] - 1])
    return limit


def reachable(d: np.ndarray, limit: np.ndarray, counts: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Boolean (queries x cells): cells that may hold a point within ``limit``.

    The cells must be those of one set of pivots, every point in the cell of its nearest one.
    """
    low = np.maximum(d - radii[None, :], (d - d.min(axis=1)[:, None]) / 2)
    slack = 1e-9 * (1 + np.abs(limit))
    return (low <= (limit + slack)[:, None]) & (counts[None, :] > 0)
