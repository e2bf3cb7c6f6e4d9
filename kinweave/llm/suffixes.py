"""Suffix arrays in NumPy: refinement by doubling (Larsson-Sadakane) and common prefixes (Kasai)."""

from __future__ import annotations

import numpy as np

_SMALL = 21  # texts below 2**21 positions sort (rank, rank, position) packed into one 63-bit number


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (uint8) ordered by their first ``depth`` bytes at least, ties by position.

    Groups that a round has sorted apart are left alone; only larger groups are refined by the rank of the suffix
    ``h`` bytes on, and ``h`` doubles every round.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # four bytes of nine bits each, 0 being the end of the text, in front of a 28-bit position
    b = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)])
    key = (b[:n] << np.uint64(27)) | (b[1 : n + 1] << np.uint64(18)) | (b[2 : n + 2] << np.uint64(9)) | b[3 : n + 3]
    packed = np.sort((key << np.uint64(28)) | np.arange(n, dtype=np.uint64))
    order = (packed & np.uint64((1 << 28) - 1)).astype(np.int64)
    key = packed >> np.uint64(28)
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots, h = np.arange(n), 4
    while h < depth:
        # groups of one are final
        last = np.ones(len(slots), bool)
        last[:-1] = head[1:]
        slots = slots[~(head & last)]
        if not len(slots):
            break
        at = order[slots]
        first = rank[at]
        beyond = at + h
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        if n < (1 << _SMALL) - 1:
            packed = np.sort((first << (2 * _SMALL)) | (second << _SMALL) | at)
            at = packed & ((1 << _SMALL) - 1)
            key = packed >> _SMALL
        else:
            turn = np.lexsort((at, second, first))
            at = at[turn]
            key = first[turn] * (n + 2) + second[turn]
        order[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, of the prefix that each suffix shares with its predecessor in ``order``.

    Kasai's inequality - the suffix d bytes on shares at least d bytes less with its predecessor - gives most positions
    a head start.  It needs suffixes that ``order`` tells apart, so positions behind a full-depth match start at zero.
    """
    n = len(text)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    b = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    word = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        word |= b[k : k + len(word)].astype(np.uint64) << np.uint64(56 - 8 * k)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    limits = np.array([1 << (64 - 8 * k) for k in range(1, 8)], np.uint64)

    def extend(at: np.ndarray, length: np.ndarray) -> None:
        other = before[at]
        room = np.minimum(depth, n - np.maximum(at, other))
        room[other < 0] = 0
        live = np.flatnonzero(length < room)
        while len(live):
            x = word[at[live] + length[live]] ^ word[other[live] + length[live]]
            same = x == 0
            part = live[~same]
            length[part] += 7 - np.searchsorted(limits[::-1], x[~same], side="right")
            live = live[same]
            length[live] += 8
            live = live[length[live] < room[live]]
        shared[at] = np.minimum(length, room)

    stride = 32
    extend(np.arange(0, n, stride), np.zeros(len(range(0, n, stride)), np.int64))
    while stride > 1:
        step = stride // 2
        at = np.arange(step, n, stride)
        known = shared[at - step]
        extend(at, np.where(known < depth, np.maximum(known - step, 0), 0))
        stride = step
    return shared[order]


def repeated_windows(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Of the window starts (flags over ``text``), those whose ``window`` bytes also begin at an earlier flagged start."""
    out = np.zeros(len(text), bool)
    if not starts.any():
        return out
    depth = 8
    while depth < window:
        depth *= 2
    order = suffix_array(text, depth)
    new = common_prefixes(text, order, depth) < window
    new[0] = True
    place = np.where(starts[order], order, len(text))
    heads = np.flatnonzero(new)
    first = np.minimum.reduceat(place, heads)
    first = np.repeat(first, np.diff(np.append(heads, len(order))))
    again = starts[order] & (order != first)
    out[order[again]] = True
    return out
