"""Operator 1: removal of repeated byte strings with per-shard suffix arrays.

Each shard of documents sorts the suffixes of the stretches that recur within it (Larsson-Sadakane refinement), and
runs of common prefixes of ``window`` bytes or more (Kasai) tell which windows have an earlier one in the shard.  What is
left is compared across shards: sorted runs of content-defined anchors are merged by binary search
(:mod:`kinweave.llm.passages`), and contexts at the borders of repeats meet in a suffix array again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.passages import NO_ID, Anchors, Corpus, covered, repeated_spans, unpress
from kinweave.llm.registry import query
from kinweave.llm.store import table
from kinweave.llm.suffixes import repeated_windows
from kinweave.llm.words import BYTE_VALUES

WINDOW = 100
GRAM = 24


def _joined(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Indices of the ranges [first, stop), one after the other."""
    n = stop - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def byte_corpus(window: int = WINDOW, gram: int = GRAM) -> Corpus:
    def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return BYTE_VALUES[data], offsets

    def text(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray):
        return lambda a, b: data[a:b].tobytes()

    def resolve(contexts: list[bytes], group: np.ndarray) -> list[np.ndarray]:
        size = np.array([len(c) for c in contexts])
        stop = np.cumsum(size)
        starts = np.zeros(int(stop[-1]), bool)
        starts[_joined(stop - size, stop - window + 1)] = True
        again = repeated_windows(np.frombuffer(b"".join(contexts), np.uint8), starts, window)
        at = np.flatnonzero(again)
        owner = np.searchsorted(stop, at, side="right")
        return np.split(at - (stop - size)[owner], np.searchsorted(owner, np.arange(1, len(contexts))))

    def local(data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, row: np.ndarray, a: Anchors) -> np.ndarray:
        """Repeated starts within a shard; only stretches whose anchors recur in it are sorted."""
        out = np.zeros(len(data), bool)
        _, which, count = np.unique(a.fingerprint, return_inverse=True, return_counts=True)
        twice = count[which] > 1
        if not twice.any():
            return out
        lo, stop, owner = a.lo[twice], a.hi[twice] + window, a.owner[twice]
        new = np.concatenate([[True], (lo[1:] > stop[:-1]) | (owner[1:] != owner[:-1])])
        heads = np.flatnonzero(new)
        lo, stop, owner = lo[heads], stop[np.append(heads[1:] - 1, len(stop) - 1)], owner[heads]
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((row, doc))] = np.arange(len(doc))
        turn = np.lexsort((lo, rank[owner]))  # in the order of the positions
        lo, stop = lo[turn], stop[turn]
        place = _joined(lo, stop)
        starts = np.zeros(len(place), bool)
        ends = np.cumsum(stop - lo)
        starts[_joined(ends - (stop - lo), ends - window + 1)] = True
        out[place[repeated_windows(data[place], starts, window)]] = True
        return out

    return Corpus(window, gram, units, text, resolve, local)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", **limits) -> DataFrame:
    """Per row of ``docs`` (a stored table): ``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256``.

    ``kept`` has the remaining bytes.  Null texts are empty; texts shorter than the window stay whole.  Rows that repeat
    a doc_id are documents of their own, in input order; null ids rank last.  An empty table gives no rows.
    """
    texts, spans = repeated_spans(docs, byte_corpus(window, gram), id_column, text_column, **limits)
    met = texts.join(spans, "row", "left").select("doc", "packed", "ranges")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                data, offsets = unpress(batch.column("packed"))
                gone = covered(batch.column("ranges"), offsets)
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                edges = offsets[:-1][offsets[:-1] < len(data)]
                first[edges] = gone[edges]
                removed, spans_ = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(first)])
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc"), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(spans_[offsets])),
                        pa.array(kept, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                    ],
                    names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    out = met.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
