"""Operator 11: periodic runs of words, by seeds that are extended along diagonals.

In a run of smallest period q every word equals the one q places on, over ``max(24 - q, 2 * q)`` places at least.  Lags
are taken in classes that double, 1 to 15, 16 to 31, 32 to 63 and so on; in a class that ends below k every run keeps an
overlap of k words or more, and k reaches the period.  Two neighbouring occurrences of one k-gram inside a run are
therefore exactly q places apart, so it is enough to pair every k-gram with its next occurrence in the same document:
at most one seed per word and class, however often a word or phrase repeats.

Seeds are visited by lag and place.  A table keeps, per lag, how far the last extension has covered its diagonal; seeds
below that are not extended again.  K-grams carry exact names (pairs of the names of their halves, renumbered), no
hashes; grams that occur once in their document drop out of all longer ones.  Documents are worked off in blocks inside
the scan's own tasks, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.registry import query
from kinweave.llm.store import table, text_bytes
from kinweave.llm.words import over_batches, ragged_bytes, word_spans
from kinweave.session import spread

LEAST_LENGTH = 24  # words of a run
LEAST_TURNS = 3  # periods of a run
FIRST_GRAM = 16  # the overlap that every run keeps: the least of max(24 - q, 2 q)
_NOTHING = hashlib.sha256(b"").hexdigest()


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    at, letters = ragged_bytes(data, starts, ends)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) from which a document of ``n`` words is made to repeat, if the contract's rule picks it."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _renamed(keys: np.ndarray) -> np.ndarray:
    """Numbers from 1 for keys that occur twice or more, 0 for the others."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    often = count > 1
    number = np.where(often, np.cumsum(often), 0)
    return number[name]


class GramNames:
    """Names of the repeated k-grams of a block, k doubling; the name 0 stands for a gram that occurs once in its row."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.length = 1
        self.at = np.arange(len(words))  # places of the repeated grams
        self.names = _renamed(owner * (int(words.max(initial=0)) + 1) + words)
        self._thin()

    def _thin(self) -> None:
        keep = self.names > 0
        self.at, self.names = self.at[keep], self.names[keep]

    def double(self) -> None:
        """Go on to grams of twice the length; names tell rows apart, so no gram crosses the border of a row."""
        if len(self.at):
            second = np.searchsorted(self.at, self.at + self.length)
            fits = second < len(self.at)
            fits[fits] = self.at[second[fits]] == self.at[fits] + self.length
            first = self.names[fits]
            self.names = _renamed(first * (int(self.names.max()) + 1) + self.names[second[fits]])
            self.at = self.at[fits]
            self._thin()
        self.length *= 2

    def seeds(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, lag) of the grams whose next occurrence is ``low`` to ``high`` places on, by lag and place."""
        order = np.lexsort([self.at, self.names])
        at, names = self.at[order], self.names[order]
        lag = at[1:] - at[:-1]
        near = (names[1:] == names[:-1]) & (lag >= low) & (lag <= high)
        place, lag = at[:-1][near], lag[near]
        order = np.lexsort([place, lag])
        return place[order], lag[order]


def _matching(words: np.ndarray, place: int, lag: int, least: int, most: int, step: int) -> int:
    """Places from ``place`` on (``step`` 1) or before it (-1), inside ``least <= x < most - lag``, whose words match."""
    room = most - lag - place if step > 0 else place - least
    done, chunk = 0, 64
    while done < room:
        size = min(chunk, room - done)
        a = place + done if step > 0 else place - done - size
        same = words[a : a + size] == words[a + lag : a + lag + size]
        if not same.all():
            broken = np.flatnonzero(~same)
            return done + (int(broken[0]) if step > 0 else size - 1 - int(broken[-1]))
        done, chunk = done + size, 2 * chunk
    return done


def runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of a block, by place; ``words`` are numbers, ``bounds`` the rows' first words."""
    found: list[tuple[int, int, int]] = []
    longest = int(np.diff(bounds).max(initial=0))
    grams = GramNames(words, bounds)
    while grams.length < FIRST_GRAM:
        grams.double()
    low = 1
    while low * LEAST_TURNS <= longest and len(grams.at):
        covered: dict[int, int] = {}  # per lag, the end of the furthest extension
        place, lag = grams.seeds(low, grams.length - 1)
        follows = np.zeros(len(place), bool)  # a seed next to its predecessor lies on the same extension
        follows[1:] = (lag[1:] == lag[:-1]) & (place[1:] == place[:-1] + 1)
        for i, d in zip(place[~follows].tolist(), lag[~follows].tolist()):
            if i < covered.get(d, 0):
                continue
            row = int(np.searchsorted(bounds, i, side="right")) - 1
            first, last = int(bounds[row]), int(bounds[row + 1])
            start = i - _matching(words, i, d, first, last, -1)
            end = i + grams.length
            end += _matching(words, end, d, first, last, 1)
            covered[d] = end
            if end + d - start >= max(LEAST_LENGTH, LEAST_TURNS * d):
                found.append((start, end + d - start, d))
        low = grams.length
        grams.double()
    found.sort()
    start, length, period = (np.array([f[k] for f in found], np.int64) for k in range(3))
    return start, length, period


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; of equals the first, then the one of smallest period."""
    top = None
    for start, length, period in found:  # by start, then period
        if top is None or length * top[2] > top[1] * period:
            top = start, length, period
    return top


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given words with a blank after each, and the place of each word in them (with the end)."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    source = np.repeat(starts - at[:-1], ends - starts + 1) + np.arange(at[-1])
    blank = np.zeros(at[-1], bool)
    blank[at[1:] - 1] = True
    return np.where(blank, np.uint8(32), data[np.minimum(source, max(len(data) - 1, 0))]), at


_SHAPE = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, plant: bool, whole: bool) -> pa.RecordBatch:
    starts, ends, bounds = word_spans(data, offsets)
    numbers = word_numbers(data, starts, ends)
    ids, counts = rows.column("doc_id").to_pylist(), np.diff(bounds)
    source = np.arange(len(starts))  # the word of the text that stands at each place
    if plant:
        for k, doc in enumerate(ids):
            rule = planted(doc, int(counts[k]))
            if rule:
                a, p = rule
                tail = np.arange(counts[k] - a)
                source[bounds[k] + a : bounds[k + 1]] = bounds[k] + a + tail % p
    numbers = numbers[source]
    start, length, period = runs(numbers, bounds)
    kept = _kept(len(source), start, length, period)
    text, at = _joined(data, starts[source[kept]], ends[source[kept]])
    text = text.tobytes()
    cut = at[np.concatenate([[0], np.cumsum(kept)])[bounds]]  # first byte of each row's kept words
    own = np.searchsorted(start, bounds)
    out: dict[str, list] = {n: [] for n in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")}
    for k in range(len(ids)):
        a, b = own[k], own[k + 1]
        found = list(zip((start[a:b] - bounds[k]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
        top = best(found) or (None, None, None)
        out["n_runs"].append(len(found))
        for name, value in zip(("start", "length", "period"), top):
            out[name].append(value)
        out["exponent_milli"].append(1000 * top[1] // top[2] if found else None)
        out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest() if found else _NOTHING)
        left = text[cut[k] : max(cut[k], cut[k + 1] - 1)]
        out["collapsed_sha256"].append(hashlib.sha256(left).hexdigest())
        out["runs"].append([{"start": s, "length": m, "period": q} for s, m, q in found] if whole else None)
        out["collapsed"].append(left if whole else None)
    types = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": _RUNS, "collapsed": pa.binary()}
    arrays = [rows.column("doc_id"), pa.array(counts, pa.int64()), *[pa.array(v, types.get(n, pa.int64())) for n, v in out.items()]]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", *out])


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plant: bool = False, whole: bool = True) -> DataFrame:
    """Runs of every row of ``docs``, and its text without their repetitions.

    A run is a stretch of words of smallest period q (words q apart are equal) with at least ``max(24, 3 q)`` words that no
    neighbouring word extends.  Columns: ``doc_id, n_words, n_runs``; start, length, period and ``exponent_milli`` of the run
    of greatest length / period (ties: smallest start, then period; null without runs); ``runs_sha256`` of all runs as
    ``start,length,period`` lines; ``collapsed_sha256`` of the words that no run contains after its first q words, joined
    by one blank; and, with ``whole``, these ``runs`` and the ``collapsed`` bytes themselves.

    With ``plant``, rows whose doc_id the contract's rule picks are made to repeat first (a null doc_id never is).  Null and
    empty texts have no words and no runs.  Rows are judged on their own: repeated doc_ids and texts give a row each, an
    empty table none; other columns are not read.  A very long text is a block of its own.
    """
    rows = spread(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, data, offsets in over_batches(batches, "text"):
            yield _block(some, data, offsets, plant, whole)

    return rows.mapInArrow(run, _SHAPE)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), plant=True, whole=False)
    return found.drop("n_words", "runs", "collapsed")
