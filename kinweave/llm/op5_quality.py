"""Operator 5: quality classifier of histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed once, in Arrow batches; the trees are fitted in NumPy on a bounded sample of
labelled rows and flattened into arrays, which score all documents level by level without a branch per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.registry import query
from kinweave.llm.store import keep, table, text_bytes
from kinweave.llm.words import over_batches, sequence_hash, word_hashes

TRAIN_ROWS = 20_000  # bound of the labelled rows that the fit sees
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = {
    "upper": np.arange(65, 91), "lower": np.arange(97, 123), "digit": np.arange(48, 58), "stop": np.frombuffer(b".,;:", np.uint8),
    "quote": np.frombuffer(b"\"'`()-", np.uint8), "mark": np.frombuffer(b"!?", np.uint8), "symbol": np.frombuffer(b"#$%&*+/<=>@[\\]^_{|}~", np.uint8),
    "space": np.array([32]), "line": np.array([10, 13]), "control": np.array([*range(0, 9), *range(14, 32), 127]), "wide": np.arange(128, 256),
}
_CLASS_OF = np.zeros(256, dtype=np.uint8)
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[_members] = _k
FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "distinct_words", "distinct_pairs", "repeated_next", "shouted", "ending_symbol",
    "log_lines", "line_length", "distinct_lines", *_CLASSES,
]


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per row; the row number replaces the top bits of the hash."""
    key = np.sort((values >> np.uint64(20)) | (rows.astype(np.uint64) << np.uint64(44)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text gives zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = np.maximum(size, 1)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * len(_CLASSES) + _CLASS_OF[data], minlength=n * len(_CLASSES)).reshape(n, -1) / per[:, None]
    words, starts, ends, bounds = word_hashes(data, offsets, lower=True)
    count = np.diff(bounds)
    some = np.maximum(count, 1)
    row = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(float)
    mean = np.bincount(row, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, n) / some - mean**2, 0))
    inside = np.zeros(len(words), bool)
    inside[:-1] = row[:-1] == row[1:]  # the next word is in the same text
    pairs = np.zeros(len(words), np.uint64)
    pairs[:-1] = sequence_hash(words, 2)
    again = np.zeros(len(words), bool)
    again[:-1] = inside[:-1] & (words[:-1] == words[1:])
    upper = np.concatenate([[0], np.cumsum(_CLASS_OF[data] == 0)])
    letters = upper[ends] - upper[starts]
    odd = np.isin(_CLASS_OF[data[ends - 1]], [5, 6]) if len(ends) else np.zeros(0, bool)
    breaks = np.flatnonzero(data == 10)
    line_row = owner[breaks]
    lines = np.bincount(line_row, minlength=n) + (size > 0)
    # lines as byte ranges between breaks and text borders
    cuts = np.unique(np.concatenate([offsets, breaks + 1]))
    cuts = cuts[cuts <= len(data)]
    if len(cuts) > 1:
        from kinweave.llm.words import prefix_sums, range_hash

        line_hash = range_hash(prefix_sums(data), cuts[:-1], cuts[1:] - (data[cuts[1:] - 1] == 10))
        distinct_lines = _distinct(line_hash, owner[cuts[:-1]], n)
        line_count = np.bincount(owner[cuts[:-1]], minlength=n)
    else:
        distinct_lines = line_count = np.zeros(n)
    share = lambda flags: np.bincount(row, flags, n) / some
    return np.column_stack(
        [
            np.log1p(size), np.log1p(count), mean, spread, _distinct(words, row, n) / some, _distinct(pairs[inside], row[inside], n) / some,
            share(again), share((letters >= 2) & (letters >= 0.6 * length)), share(odd),
            np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), distinct_lines / np.maximum(line_count, 1), kinds,
        ]
    )


@dataclass
class Trees:
    """Complete trees of equal depth as arrays: node k has the children 2k+1 (value <= cut) and 2k+2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (len(feature))]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, smooth: float = 1.0, least: float = 2.0
) -> Trees:
    """Newton boosting of the logistic loss on binned features.  Without rows of both labels the score is constant."""
    inner, width = 2**depth - 1, x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth)
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    places = codes + np.arange(width) * bins
    total = np.full(len(y), model.start)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, code, limit = np.zeros(inner, np.int64), np.full(inner, bins), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = (((node - first)[:, None] * (width * bins)) + places).ravel()
            size = many * width * bins
            sg = np.bincount(at, np.repeat(g, width), size).reshape(many, width, bins).cumsum(axis=2)
            sh = np.bincount(at, np.repeat(h, width), size).reshape(many, width, bins).cumsum(axis=2)
            tg, th = sg[:, :1, -1:], sh[:, :1, -1:]
            gain = sg**2 / (sh + smooth) + (tg - sg) ** 2 / (th - sh + smooth) - tg**2 / (th + smooth)
            gain[(sh < least) | (th - sh < least)] = 0
            flat = gain.reshape(many, -1)
            best = flat.argmax(axis=1)
            for k in range(many):
                f, c = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-6 and c < len(cuts[f]):
                    feature[first + k], code[first + k], limit[first + k] = f, c, cuts[f][c]
            node = 2 * node + 1 + (codes[np.arange(len(y)), feature[node]] > code[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + smooth)
        total += leaf[slot]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(model.start, np.array(features), np.array(limits), np.array(leaves), depth)


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in over_batches(batches, "__text"):
            x = statistics(data, offsets).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([rows.column("__id"), lists], names=["__id", "features"])

    chosen = docs.select(F.col(id_column).alias("__id"), text_bytes(text_column).alias("__text"))
    return chosen.mapInArrow(run, f"__id {chosen.schema['__id'].dataType.simpleString()}, features array<float>")


def held_out(column: str):
    """Whether a row is kept from the fit: crc32 of the id as text, modulo ``FOLDS``, is 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_labels(labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``train_rows`` rows ``doc_id, quality`` outside the held-out fold, those of the smallest id hashes; no nulls."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "quality")
    n = usable.count()
    if n > train_rows:  # a little more than needed by hash, then exactly the smallest hashes of these
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * train_rows / n)))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)


def fit_quality(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on the statistics (``__id, features``) of the rows of :func:`training_labels`."""
    usable = training_labels(labels, train_rows)
    rows = stats.join(usable, stats["__id"] == usable["doc_id"]).select("doc_id", "features", "quality")
    # ids that repeat give more rows than labels; in a full order the same ones are taken in every run
    rows = rows.orderBy("doc_id", "features", "quality").limit(train_rows).toArrow()
    x = np.array(rows.column("features").to_pylist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, (rows.column("quality").to_numpy() == 1).astype(float))


def score_documents(stats: DataFrame, model: Trees) -> DataFrame:
    """``__id, score`` of every row of ``stats``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(model.score(x), pa.float64())], names=["__id", "score"])

    return stats.mapInArrow(run, f"__id {stats.schema['__id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts get the score of an all-zero statistic; repeated rows get equal scores; an empty table gives no
    rows.  Columns other than doc_id and text are never read.
    """
    stats = keep(document_statistics(docs), "statistics")
    scored = score_documents(stats, fit_quality(stats, labels, train_rows))
    return scored.select(
        F.col("__id").alias("doc_id"), held_out("__id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns and rows stay as they are otherwise."""
    usable = training_labels(labels, train_rows).select("doc_id").distinct()
    # at most train_rows ids, hence a bounded broadcast
    known = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id", "left_semi")
    model = fit_quality(document_statistics(known), labels, train_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in over_batches(batches, "text"):
            good = model.score(statistics(data, offsets).astype(np.float32).astype(float)) >= threshold
            yield rows.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
