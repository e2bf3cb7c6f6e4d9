"""Operator 6: removal of repeated phrases with sharded Aho-Corasick automata.

The corpus is cut by content into overlapping passages (:mod:`kinweave.llm.passages`); copies of a whole passage are
settled where the runs of all shards meet.  The passages that recur with other surroundings are dealt by fingerprint to
shards.  A shard confirms which phrases of ``window`` words recur among its passages, compiles them into one automaton
over word numbers, and streams the passages of all documents through it in the order of their positions: the first
occurrence of a phrase stays, every later one goes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.passages import NO_ID, Corpus, covered, repeated_spans, unpress
from kinweave.llm.registry import query
from kinweave.llm.store import table
from kinweave.llm.words import span_hashes, word_spans

WINDOW = 20
GRAM = 8


def compile_phrases(phrases: Iterable[tuple[int, ...]]) -> ahocorasick.Automaton:
    """Automaton over word numbers; a match gives the phrase's number and the place of its last word."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, phrase in enumerate(phrases):
        automaton.add_word(phrase, k)
    automaton.make_automaton()
    return automaton


def word_corpus(window: int = WINDOW, gram: int = GRAM) -> Corpus:
    def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, bounds = word_spans(data, offsets)
        return span_hashes(data, starts, ends), bounds

    def text(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray):
        starts, ends, _ = word_spans(data, offsets)
        return lambda a, b: data[starts[a] : ends[b - 1]].tobytes()

    def resolve(contexts: list[bytes], group: np.ndarray) -> list[np.ndarray]:
        number: dict[bytes, int] = {}
        passages = [tuple(number.setdefault(w, len(number)) for w in c.split()) for c in contexts]  # bytes.split: \x20 \x09-\x0D
        seen = Counter(p[k : k + window] for p in passages for k in range(len(p) - window + 1))
        confirmed = [phrase for phrase, n in seen.items() if n > 1]
        if not confirmed:
            return [np.zeros(0, np.int64)] * len(contexts)
        automaton = compile_phrases(confirmed)
        first = bytearray(len(confirmed))
        out = []
        for p in passages:
            again = []
            for end, phrase in automaton.iter(p):
                if first[phrase]:
                    again.append(end - window + 1)
                first[phrase] = 1
            out.append(np.array(again, np.int64))
        return out

    return Corpus(window, gram, units, text, resolve)


def remove_phrases(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", **limits) -> DataFrame:
    """Per row of ``docs`` (a stored table): ``doc_id, n_words, n_removed, kept, kept_sha256``.

    ``kept`` has the remaining words joined by one space.  Null texts and texts without words have none; texts with fewer
    words than the window stay whole.  Rows that repeat a doc_id are documents of their own, in input order; null ids
    rank last.  An empty table gives no rows.
    """
    texts, spans = repeated_spans(docs, word_corpus(window, gram), id_column, text_column, **limits)
    met = texts.join(spans, "row", "left").select("doc", "packed", "ranges")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                data, offsets = unpress(batch.column("packed"))
                _, _, bounds = word_spans(data, offsets)
                gone = covered(batch.column("ranges"), bounds)
                removed = np.concatenate([[0], np.cumsum(gone)])
                kept = []
                for a, b, c, d in zip(offsets[:-1], offsets[1:], bounds[:-1], bounds[1:]):
                    words = data[a:b].tobytes().split()
                    if removed[d] > removed[c]:
                        words = [w for w, g in zip(words, gone[c:d].tolist()) if not g]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc"), pa.array(np.diff(bounds)), pa.array(np.diff(removed[bounds])), pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                    ],
                    names=["doc", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    out = met.mapInArrow(run, "doc long, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256")


@query("op6_phrases")
def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_phrases(table(spark, sf_dir, "documents")).drop("kept")
