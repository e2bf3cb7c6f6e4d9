"""Operator 13: near-duplicate detection by one-permutation MinHash with optimal densification.

One hash orders all shingles.  Its high bits throw a document's shingles into ``BINS`` bins and the smallest hash of each
bin is kept; an empty bin takes the value of the first bin with one in its own fixed random order of all bins, the same
for every document, so that equal bins stay as likely as the sets are similar.  Bands of ``BINS / BANDS`` bins make the keys of
buckets: sets at the threshold of 85 % share one or more of the 32 keys but for a chance below 1e-8.

Buckets become stars: every member is paired with the bucket's hub alone, so pairs are as many as members.  Links are
confirmed on the full sets.  A member that fails its hub may still link with others that do; buckets that hold several
components after the stars compare those inside the task (see ``near_copies``), so a bucket loses no link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.components import components
from kinweave.llm.near_copies import block_links, components_sql, joined_links, named, open_blocks, shared_keys, verified
from kinweave.llm.passages import numbered
from kinweave.llm.registry import query
from kinweave.llm.store import keep, row_numbers, stored, table, text_bytes
from kinweave.llm.words import mix, over_batches, ragged, shingles, word_hashes

BINS = 160
BANDS = 32
_EMPTY = np.uint64((1 << 64) - 1)
_SEED = 13


def donor_order(bins: int) -> np.ndarray:
    """For every bin, the order in which it looks for a value when it is empty."""
    rng = np.random.default_rng(_SEED)
    return np.array([rng.permutation(bins) for _ in range(bins)])


def signatures(values: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One line of ``len(order)`` bins per set; ``values`` are the shingle hashes of all sets, none of them empty."""
    bins = len(order)
    hashes = mix(values ^ np.uint64(0xA0761D6478BD642F))
    owner = np.repeat(np.arange(len(counts)), counts)
    place = owner * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    low = np.full(len(counts) * bins, _EMPTY)
    np.minimum.at(low, place, hashes)
    low = low.reshape(len(counts), bins)
    empty = low == _EMPTY
    line, column = np.nonzero(empty)
    out, step = low.copy(), 0
    while len(line):
        donor = order[column, step]
        full = ~empty[line, donor]
        out[line[full], column[full]] = low[line[full], donor[full]]
        line, column, step = line[~full], column[~full], step + 1
    return out


def band_keys(lines: np.ndarray, bands: int) -> np.ndarray:
    """A key per set and band; the band is part of the key."""
    rows = lines.shape[1] // bands
    parts = lines.reshape(-1, rows)
    keys = parts[:, 0].copy()
    for k in range(1, rows):
        keys = mix(keys) + parts[:, k]
    return mix(keys.reshape(-1, bands) ^ mix(np.arange(1, bands + 1, dtype=np.uint64)))


def _described(docs: DataFrame, n: int, bins: int, bands: int) -> DataFrame:
    """Per row: set size, set digest and band keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = donor_order(bins)
        for rows, data, offsets in over_batches(batches, "text"):
            words, _, _, bounds = word_hashes(data, offsets, lower=True)
            sets = list(shingles(words, bounds, n))
            sizes = np.array([len(s) for s in sets], np.int64)
            some = sizes > 0
            lines = signatures(np.concatenate([*sets, np.zeros(0, np.uint64)]), sizes[some], order)
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = ragged(band_keys(lines, bands).ravel().view(np.int64), np.where(some, bands, 0), pa.int64())
            columns = [rows.column("doc_id"), rows.column("row"), pa.array(sizes), pa.array(marks, pa.binary()), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_shingles", "mark", "keys"])

    return docs.mapInArrow(run, "doc_id long, row long, n_shingles long, mark binary, keys array<long>")


def minhash_components(
    docs: DataFrame, n: int = 3, percent: int = 85, bins: int = BINS, bands: int = BANDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, row, n_shingles, component_id, component, kept`` per row of ``docs``.

    Words are lower-cased (A-Z); a text with fewer than ``n`` words has its whole sequence as one shingle; null texts and
    texts without words have the empty set, are linked with nothing and have a null ``component``.  component_id is the
    smallest doc_id reachable by links, the row's own included.  Of every component one row is kept: that of the smallest
    doc_id, and of rows that repeat it the first in the input; rows with empty sets are all kept.  Rows that repeat a doc_id
    are documents of their own; a null doc_id is larger than any other.  Equal sets are one node, so copies cost nothing
    more.  An empty table gives no rows; other columns are not read.
    """
    docs = stored(docs)
    known = row_numbers(docs)(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")).select("doc_id", "row", "text")
    described = keep(_described(known, n, bins, bands), "minhash-sets")
    nodes = described.where("mark is not null").groupBy("mark").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    nodes = keep(nodes, "minhash-nodes")
    firsts = described.select(F.col("row").alias("node"), "keys").join(nodes.select("node", "copies"), "node")
    shared = keep(shared_keys(firsts), "minhash-shared")
    texts = numbered(docs, id_column, text_column).select(F.col("row").alias("node"), F.col("packed").alias("text"))
    met = shared.select("node").distinct()
    texts = keep(texts.join(met, "node", "left_semi"), "minhash-texts")

    stars = shared.where("rep <> node").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    of = components(verified(stars, texts, n, percent))
    members = keep(open_blocks(shared, of), "minhash-members")
    found = named(described, nodes, joined_links(of, block_links(members, texts, n, percent)))
    found = keep(found, "minhash-found")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    first = found.where("component is not null").groupBy("component").agg(F.min(place).alias("first")).select("component", F.col("first")["row"].alias("__first"))
    out = found.join(first, "component", "left")
    return out.select("doc_id", "row", "n_shingles", "component_id", "component", F.coalesce(F.col("row") == F.col("__first"), F.lit(True)).alias("kept"))


SQL = components_sql(3, 85, ", doc_id = component_id as kept")


@query("op13_minhash", SQL)
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents")).drop("row", "component")
