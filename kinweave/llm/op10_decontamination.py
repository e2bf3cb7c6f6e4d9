"""Operator 10: benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over the whole corpus give the inverse document frequencies.  2. The TF-IDF
passages are dealt by hash into spaces of some ``SPACE_PASSAGES`` passages; a randomised SVD of each space's own rows
keeps every direction they span, so that no passage loses a part of its norm, whatever the size of the benchmark.
3. Every document is cut into overlapping windows of words at the scales of the passages; windows whose cosine with a
passage reaches ``COSINE`` are candidates.  4. The longest common subsequence of passage and surrounding words decides:
nearly verbatim passages are leaks, looser ones only if the passage's answer (its last sentence) is found there too.
An item of fewer than ``SHORT_WORDS`` words, whose words come together by chance, must stand there word for word.

Words are lower-cased (A-Z) runs of bytes without white space and ASCII punctuation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.registry import query
from kinweave.llm.store import keep, row_numbers, stored, table, text_bytes
from kinweave.llm.words import ARE_PLAIN, over_batches, text_block, word_hashes

FEATURES = 1 << 16  # hashed words
SPACE_PASSAGES = 96  # passages that share a latent space, on average
OVERSAMPLE = 10
PASSAGE_WORDS = 64
MARGIN_WORDS = 8  # words beside a window that are compared too, besides half a passage
WINDOWS = (2, 4, 8, 16, 32, 64)  # words in a window, by scale; the hop is half a window
COSINE = 0.35
SHORT_COSINE = 0.1  # in windows of up to SHORT_WORDS words, where one rare neighbour outweighs an item
SHORT_WORDS = 8
VERBATIM = 0.8  # share of a passage's words in the common subsequence
PARAPHRASE = 0.6
ANSWER = 0.8
SEARCH_PASSAGES = 2_048  # passages looked for in one pass over the corpus


def features_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a:
        return 0
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def inverse_frequencies(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """log((N + 1) / (df + 1)) + 0.01 of every hashed word, df counted over all documents; one number per feature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(FEATURES, np.int64), 0
        for batch, data, offsets in over_batches(batches, "__text"):
            words, _, _, bounds = word_hashes(data, offsets, True, ARE_PLAIN)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            key = np.sort((owner << 16) | features_of(words))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            counts += np.bincount(key[new] & (FEATURES - 1), minlength=FEATURES)
            rows += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], rows))], names=["feature", "n"])

    partial = docs.select(text_bytes(text_column).alias("__text")).mapInArrow(run, "feature long, n long")
    found = partial.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most FEATURES + 1 rows
    at, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    total = int(n[at < 0].sum())
    df = np.zeros(FEATURES)
    df[at[at >= 0]] = n[at >= 0]
    return np.log((total + 1) / (df + 1)) + 0.01


def passages_of(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``item_id, scale, words, answer``: items in passages of up to ``PASSAGE_WORDS`` words, half overlapping."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, passages, answers = [], [], []
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = _plain_words(text)
                sentences = [w for w in map(_plain_words, re.split(r"[.!?\n]+", text)) if w]
                for start in range(0, max(1, len(words) - PASSAGE_WORDS // 2), PASSAGE_WORDS // 2):
                    part = words[start : start + PASSAGE_WORDS]
                    if part:
                        items.append(item)
                        passages.append(part)
                        answers.append(sentences[-1] if start + PASSAGE_WORDS >= len(words) else part[-8:])
        long = pa.list_(pa.int64())
        scales = np.searchsorted(WINDOWS[:-1], [len(p) for p in passages])
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(scales, pa.int32()), pa.array(passages, long), pa.array(answers, long)], names=["item_id", "scale", "words", "answer"]
        )

    rows = benchmark.select(F.col(id_column).cast("long").alias("item_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, scale int, words array<long>, answer array<long>")


def _plain_words(text: str) -> list[int]:
    data, offsets = text_block(pa.array([text]))
    return word_hashes(data, offsets, True, ARE_PLAIN)[0].view(np.int64).tolist()


def _weighted(words: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, TF-IDF weights) of each word list."""
    out = []
    for w in words.to_pylist():
        f, n = np.unique(features_of(np.array(w, np.int64).view(np.uint64)), return_counts=True)
        out.append((f, n * idf[f]))
    return out


def dealt(passages: DataFrame) -> DataFrame:
    """``passages`` with their ``space``: a hash of the passage deals those of a scale into spaces of one size."""
    counts = {r["scale"]: r["count"] for r in passages.groupBy("scale").count().collect()}
    at, space = 0, F.lit(None).cast("int")
    for scale, n in sorted(counts.items()):
        spaces = -(-n // SPACE_PASSAGES)
        place = F.pmod(F.xxhash64("item_id", "words", "answer"), F.lit(spaces)).cast("int") + F.lit(at)
        space = F.when(F.col("scale") == scale, place).otherwise(space)
        at += spaces
    return passages.withColumn("space", space)


def latent_basis(weighted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(features, basis lines) of the right singular vectors of TF-IDF rows, by randomised projection.

    The projection is wider than the number of rows, so all directions of the rows are kept.
    """
    features = np.unique(np.concatenate([f for f, _ in weighted]))
    rows = np.zeros((len(weighted), len(features)))
    for k, (f, w) in enumerate(weighted):
        rows[k, np.searchsorted(features, f)] = w
    q = np.linalg.qr(rows @ _gaussian(features, len(rows) + OVERSAMPLE))[0]
    _, sigma, vectors = np.linalg.svd(q.T @ rows, full_matrices=False)
    return features, vectors[sigma > 1e-9 * sigma[0]].T


def _gaussian(features: np.ndarray, wide: int) -> np.ndarray:
    """Rows of the random test matrix, the same in every task."""
    return np.array([np.random.default_rng(int(f)).standard_normal(wide) for f in features]).reshape(-1, wide)


_SPACE = "space int, scale int, items array<long>, words array<array<long>>, answers array<array<long>>, features array<int>, basis binary, unit binary"


def latent_spaces(passages: DataFrame, idf: np.ndarray) -> DataFrame:
    """One row per space: its passages, the features they use, a basis line of each and the unit vectors of the passages."""

    def fit(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        weighted = _weighted(group.column("words"), idf)
        features, basis = latent_basis(weighted)
        v = np.array([w @ basis[np.searchsorted(features, f)] for f, w in weighted])
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        row = {"space": group.column("space")[0].as_py(), "scale": group.column("scale")[0].as_py()}
        row |= {"items": group.column("item_id").to_pylist(), "words": group.column("words").to_pylist(), "answers": group.column("answer").to_pylist()}
        row |= {"features": features.tolist(), "basis": basis.astype(np.float32).tobytes(), "unit": unit.astype(np.float32).tobytes()}
        return pa.Table.from_pylist([row], shape)

    long = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int32(), long, pa.list_(long), pa.list_(long), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    shape = pa.schema(list(zip(["space", "scale", "items", "words", "answers", "features", "basis", "unit"], kinds)))
    return passages.groupBy("space").applyInArrow(fit, _SPACE)


@dataclass
class Space:
    """Passages looked for together; ``weighted`` has the basis line times the weight of each feature, and a zero line."""

    scale: int
    items: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    features: np.ndarray
    weighted: np.ndarray
    unit: np.ndarray


def _space(row, idf: np.ndarray) -> Space:
    features = np.array(row["features"], np.int64)
    basis = np.frombuffer(row["basis"], np.float32).reshape(len(features), -1)
    weighted = np.vstack([basis * idf[features][:, None], np.zeros((1, basis.shape[1]), np.float32)])
    unit = np.frombuffer(row["unit"], np.float32).reshape(len(row["items"]), -1)
    return Space(row["scale"], row["items"], row["words"], row["answers"], features, weighted, unit)


def candidates(words: np.ndarray, bounds: np.ndarray, idf: np.ndarray, spaces: list[Space]) -> Iterator[tuple]:
    """(space, row, first word, end, passage, cosine) of every window and passage with enough cosine.

    Rows are laid out in half-windows, padded to whole ones and one more, so that the sums over windows are sums of
    neighbouring array lines.
    """
    if not len(words):
        return
    count = np.diff(bounds)
    owner = np.repeat(np.arange(len(count)), count)
    f = features_of(words)
    for scale, window in enumerate(WINDOWS):
        mine = [s for s in spaces if s.scale == scale]
        if not mine:
            continue
        hop = window // 2
        padded = np.where(count > 0, -(-count // hop) + 1, 0)
        base = np.cumsum(padded) - padded
        place = base[owner] * hop + np.arange(len(words)) - bounds[owner]
        squares = np.zeros((int(padded.sum()), hop), np.float32)
        squares.ravel()[place] = idf[f] ** 2
        squares = squares.sum(axis=1)
        n = np.where(count > 0, np.maximum(padded - 2, 1), 0)
        row = np.repeat(np.arange(len(count)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        q = base[row] + step
        length = np.sqrt(np.maximum(squares[q] + squares[q + 1], 1e-12))
        for space in mine:
            row_of = np.full(FEATURES, len(space.features), np.int32)
            row_of[space.features] = np.arange(len(space.features))
            at = np.full((len(squares), hop), len(space.features), np.int32)  # the zero line
            at.ravel()[place] = row_of[f]
            half = space.weighted[at[:, 0]]
            for k in range(1, hop):
                half += space.weighted[at[:, k]]
            cosine = ((half[q] + half[q + 1]) @ space.unit.T) / length[:, None]
            for w, p in np.argwhere(cosine >= (SHORT_COSINE if window <= SHORT_WORDS else COSINE)):
                first = int(bounds[row[w]] + step[w] * hop)
                yield space, int(row[w]), first, min(first + window, int(bounds[row[w] + 1])), int(p), float(cosine[w, p])


def judged(passage: list[int], answer: list[int], around: list[int]) -> tuple[bool, float, float]:
    """(leak, share of the passage, share of the answer) of the words around a candidate window."""
    if len(passage) < SHORT_WORDS:
        whole = float(any(around[k : k + len(passage)] == passage for k in range(len(around) - len(passage) + 1)))
        return whole == 1.0, whole, whole
    share = common_subsequence(passage, around) / len(passage)
    found = common_subsequence(answer, around) / len(answer) if share >= PARAPHRASE else 0.0
    return share >= VERBATIM or (share >= PARAPHRASE and found >= ANSWER), share, found


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, item_id, cosine, share, answer_share`` of every document and benchmark item found in it, once each.

    Null and empty texts hold nothing; items without words are not looked for; items of one to seven words are found word
    for word, which a frequent word alone can meet anywhere; repeated documents or items give one row per pair of ids;
    empty tables give no rows.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("__text"))
    shape = "doc_id long, item_id long, cosine double, share double, answer_share double"
    passages = dealt(keep(passages_of(benchmark).distinct(), "passages"))
    total = passages.count()
    if not total:
        return spark.createDataFrame([], shape)
    idf = inverse_frequencies(docs, text_column).astype(np.float32)
    spaces = keep(latent_spaces(passages, idf), "spaces")
    found = None
    turns = -(-total // SEARCH_PASSAGES)
    for k in range(turns):  # some spaces at a time, each against all documents
        rows = spaces.where(F.col("space") % turns == k).orderBy("space").collect()
        some = _search(known, rows, idf, shape)
        found = some if found is None else found.unionByName(some)
    best = F.max(F.struct("share", "cosine", "answer_share")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.share", "best.answer_share")


def _search(known: DataFrame, rows: list, idf: np.ndarray, shape: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces = [_space(r, idf) for r in rows]
        for batch, data, offsets in over_batches(batches, "__text"):
            words, _, _, bounds = word_hashes(data, offsets, True, ARE_PLAIN)
            out: dict[tuple[int, int], tuple] = {}
            for space, row, first, end, p, cosine in candidates(words, bounds, idf, spaces):
                passage, key = space.words[p], (row, space.items[p])
                if key in out and out[key][1] >= 1.0:
                    continue
                margin = len(passage) // 2 + MARGIN_WORDS
                around = words[max(bounds[row], first - margin) : min(bounds[row + 1], end + margin)].view(np.int64).tolist()
                leak, share, found = judged(passage, space.answers[p], around)
                if leak and (key not in out or share > out[key][1]):
                    out[key] = (cosine, share, found)
            ids = batch.column("doc_id")
            columns = list(zip(*[(ids[r].as_py(), i, *v) for (r, i), v in out.items()])) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "cosine", "share", "answer_share"])

    return known.mapInArrow(run, shape)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (a stored table) without the rows that hold a benchmark item; columns and rows stay as they are otherwise.

    Rows are judged on their own: one that shares the doc_id of a leak, or a null doc_id, stays if its text is clean.
    """
    docs = stored(docs)
    numbers = row_numbers(docs)
    found = leaks(numbers(F.col("text").alias("__body")).select("row", "__body"), benchmark, "row", "__body")
    hit = keep(found.select(F.col("doc_id").alias("row")).distinct(), "leaks")
    whole = numbers(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    return whole.join(hit, "row", "left_anti").select("record.*")


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
