"""Operator 8: n-gram Jaccard join with an R-tree over count vectors.

A document's shingles are hashed into groups; the counts per group are its point (``GROUPS`` dimensions in the tree,
more for large sets where pairs are compared).  Two sets share at most the
sum over the groups of the smaller count, so an R-tree node whose upper corner cannot reach the required overlap holds no
partner.  Count points of unrelated texts lie close together, so one tree over a corpus would visit most of its nodes;
sets that link must share one of their first ``n - ceil(t * n) + 1`` shingles in any common order, and these keys deal
the work into blocks first.  The order puts shingles that a sample finds in many documents last; it only steers the
load, every order gives the same links.

1. Equal sets become one node.  2. Each block links its members with the member that stands for most copies (verified).
3. Blocks that still hold several components search them with the R-tree for members with a possible partner in another
component, by coarse vectors first and by fine ones among those that are left.  4. These are verified inside the block on the shingle sets of the whole texts; only links leave it, and
components are closed over all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.components import components
from kinweave.llm.near_copies import (
    MEMBER,
    block_links,
    components_sql,
    joined_links,
    least_overlap,
    named,
    open_blocks,
    per_block,
    shared_keys,
    verified,
)
from kinweave.llm.passages import numbered
from kinweave.llm.registry import query
from kinweave.llm.store import keep, row_numbers, stored, table, text_bytes
from kinweave.llm.words import over_batches, ragged, shingles, word_hashes

GROUPS = 16  # dimensions of the R-tree
COARSE = 32  # shingles per group in the vectors that pairs are first tried with
FINE = 2  # and in those that decide whether a pair's texts are compared
SAMPLE_DOCS = 20_000  # documents whose shingle frequencies order the keys
FREQUENT_SHARE = 0.001  # of the sample
FREQUENT_MOST = 65_536  # shingles in the broadcast list; only the order of keys depends on it
BLOCK_ROWS = 4_096  # members of a block that one R-tree holds; larger blocks are split into pairs of parts
LEAF = 16


def counted(s: np.ndarray, per_group: int) -> np.ndarray:
    """Count vector of a set, with a power of two of groups that have about ``per_group`` shingles each."""
    groups = max(GROUPS, 1 << max(0, int(np.ceil(np.log2(max(len(s), 1) / per_group)))))
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The same set counted in fewer groups (the group is the low bits of the hash)."""
    return vector.reshape(-1, groups).sum(axis=0, dtype=np.int64)


def reachable(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sets with these count vectors can link."""
    n, m, groups = int(a.sum()), int(b.sum()), min(len(a), len(b))
    if 100 * n < percent * m or 100 * m < percent * n:
        return False
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum()) >= -(-percent * (n + m) // (100 + percent))


class CountTree:
    """Static R-tree over count vectors, packed in the order of set size and then of the counts."""

    def __init__(self, points: np.ndarray) -> None:
        self.given = points
        self.size = points.sum(axis=1)
        self.order = np.lexsort([*points.T[:3], self.size])
        self.points = points[self.order]
        upper, sizes = self.points, self.size[self.order]
        low, high = sizes, sizes
        self.levels = []  # from the leaves up: (upper corner, smallest size, largest size) of each node
        while len(upper) > 1 or not self.levels:
            cuts = np.arange(0, len(upper), LEAF)
            upper = np.maximum.reduceat(upper, cuts)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((upper, low, high))

    def search(self, point: np.ndarray, percent: int) -> np.ndarray:
        """Indices of the points whose overlap with ``point`` may be large enough."""
        size = int(point.sum())
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high = (part[nodes] for part in self.levels[depth])
            bound = np.minimum(upper, point).sum(axis=1)
            nodes = nodes[(bound >= least_overlap(size, low, percent)) & (100 * high >= percent * size) & (100 * size >= percent * low)]
            children = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = children[children < (len(self.levels[depth - 1][0]) if depth else len(self.points))]
        bound = np.minimum(self.points[nodes], point).sum(axis=1)
        found = nodes[bound >= least_overlap(size, self.points[nodes].sum(axis=1), percent)]
        return self.order[found]


class VectorBlock:
    """Fine count vectors of a block's members, compared one against many."""

    def __init__(self, vectors: list[np.ndarray]) -> None:
        self.vectors = vectors
        self.groups = np.array([len(v) for v in vectors])
        self.sizes = np.array([int(v.sum()) for v in vectors])
        self._folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each member, lines) of the members that have at least ``groups`` groups, folded to these."""
        if groups not in self._folded:
            have = self.groups >= groups
            lines = np.array([folded(v, groups) for v in self.vectors if len(v) >= groups], np.int32)
            self._folded[groups] = np.cumsum(have) - 1, lines
        return self._folded[groups]

    def reachable(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``others`` whose sets can link with that of member ``i``."""
        fit = []
        least = np.minimum(self.groups[others], self.groups[i])
        for groups in np.unique(least):
            mine = folded(self.vectors[i], int(groups)).astype(np.int32)
            place, lines = self._at(int(groups))
            some = others[least == groups]
            for k in range(0, len(some), 512):
                part = some[k : k + 512]
                bound = np.minimum(lines[place[part]], mine).sum(axis=1)
                fit.append(part[bound >= least_overlap(self.sizes[i], self.sizes[part], percent)])
        return np.concatenate(fit) if fit else others[:0]


def _frequent(docs: DataFrame, n: int, sample_docs: int) -> np.ndarray:
    """Sorted hashes of the shingles that many sampled documents hold (at most ``FREQUENT_MOST``)."""
    total = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(total, 1))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in over_batches(batches, "text"):
            words, _, _, bounds = word_hashes(data, offsets, lower=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*shingles(words, bounds, n), np.zeros(0, np.uint64)]).view(np.int64))], names=["s"])

    counts = picked.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    limit = max(8, int(FREQUENT_SHARE * min(total, sample_docs)))
    rows = counts.where(F.col("n") >= limit).orderBy(F.desc("n"), "s").limit(FREQUENT_MOST).select("s").toArrow()
    return np.sort(rows.column("s").to_numpy().astype(np.int64).view(np.uint64))


def _described(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per row: set size, set digest, count vector and the keys under which the set must meet its partners."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in over_batches(batches, "text"):
            words, _, _, bounds = word_hashes(data, offsets, lower=True)
            sizes, marks, points, fines, keys, key_counts = [], [], [], [], [], []
            for s in shingles(words, bounds, n):
                sizes.append(len(s))
                marks.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                points.append(_stored(counted(s, COARSE)))
                fines.append(_stored(counted(s, FINE)))
                prefix = len(s) - (-(-percent * len(s) // 100)) + 1 if len(s) else 0
                # by frequency class, then by hash; the low bits chose the group, so the order reads the high bits
                late = np.zeros(len(s), bool)
                if len(frequent) and len(s):
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                first = np.concatenate([s[~late], s[late]])[:prefix]
                keys.append(first)
                key_counts.append(len(first))
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("row"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                    pa.array(points, pa.binary()), pa.array(fines, pa.binary()), ragged(flat, np.array(key_counts, np.int64), pa.int64()),
                ],
                names=["doc_id", "row", "n_shingles", "mark", "point", "fine", "keys"],
            )

    shape = "doc_id long, row long, n_shingles long, mark binary, point binary, fine binary, keys array<long>"
    return docs.mapInArrow(run, shape)


def _stored(vector: np.ndarray) -> bytes:
    """Counts in as few bytes as they need; the first byte says how many."""
    width = 1 if vector.max() < 256 else 4
    return bytes([width]) + vector.astype(f"<u{width}").tobytes()


def _vector(data: bytes) -> np.ndarray:
    """The counts as wide as they are stored; sums of them need a wider type."""
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _bounded(pairs: DataFrame, sets: DataFrame, vector: str, percent: int) -> DataFrame:
    """Pairs (a, b) whose count vectors allow enough overlap."""
    one = sets.select(F.col("node").alias("a"), F.col(vector).alias("p"), F.col("n_shingles").alias("n"))
    two = sets.select(F.col("node").alias("b"), F.col(vector).alias("q"), F.col("n_shingles").alias("m"))
    found = pairs.join(one, "a").join(two, "b").where((100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = [reachable(_vector(p), _vector(q), percent) for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return found.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def _tree_links(shared: DataFrame, sets: DataFrame, of: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between components that meet under a key: members that the R-tree cannot rule out are verified in their block."""
    held = open_blocks(shared, of, BLOCK_ROWS)
    # members without a possible partner leave before the texts are attached; few need their long vector for that
    for vector in ("point", "fine"):
        met = held.join(sets.select("node", F.col(vector).alias("vector")), "node")
        held = keep(per_block(met, partial(_partnered, percent), MEMBER), "jaccard-members")
    wanted = keep(held.select("node").distinct(), "jaccard-wanted")  # a stored list of known size: a short one need not move the texts
    known = keep(texts.join(wanted, "node", "left_semi"), "jaccard-texts")
    return block_links(held, known, n, percent)


def _block(rows: pa.Table) -> tuple[VectorBlock, CountTree, Callable[[int, np.ndarray], np.ndarray]]:
    """Vectors and tree of a block, and which of some members are in another component (and part) than a member."""
    component, side = rows.column("component").to_numpy(), rows.column("mine").to_numpy()
    halves = rows.column("p")[0].as_py() != rows.column("q")[0].as_py()
    block = VectorBlock([_vector(v) for v in rows.column("vector").to_pylist()])

    def apart(i: int, others: np.ndarray) -> np.ndarray:
        others = others[(others > i) & (component[others] != component[i])]
        return others[side[others] != side[i]] if halves else others

    return block, CountTree(np.array([folded(v, GROUPS) for v in block.vectors])), apart


def _partnered(percent: int, rows: pa.Table) -> pa.RecordBatch | None:
    """Members of a block that may link with some other member."""
    block, tree, apart = _block(rows)
    near = np.zeros(len(rows), bool)
    for i in range(len(rows)):
        found = apart(i, tree.search(tree.given[i], percent))
        fit = block.reachable(i, found[~near[found]] if near[i] else found, percent)
        near[fit] = True
        near[i] |= len(fit) > 0
    names = ["key", "p", "q", "mine", "node", "component"]
    return rows.select(names).filter(pa.array(near)).combine_chunks().to_batches(max_chunksize=len(rows))[0] if near.any() else None


def jaccard_components(docs: DataFrame, n: int, percent: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, row, n_shingles, component_id, component`` per row of ``docs`` (a stored table).

    ``component`` numbers the components; it is null for rows that are linked with nothing because their set is empty.

    Words are lower-cased (A-Z); a text with fewer than ``n`` words has its whole sequence as one shingle; null texts and
    texts without words have the empty set and are linked with nothing.  component_id is the smallest doc_id reachable by
    links, the row's own id included.  Rows that repeat a doc_id are documents of their own; a null doc_id is larger than
    any other, and alone it is its own (null) component.  An empty table gives no rows.
    """
    docs = stored(docs)
    known = row_numbers(docs)(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")).select("doc_id", "row", "text")
    frequent = _frequent(known, n, SAMPLE_DOCS)
    described = keep(_described(known, n, percent, frequent), "jaccard-sets")
    # one node per distinct set: its first row
    nodes = described.where("mark is not null").groupBy("mark").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    nodes = keep(nodes, "jaccard-nodes")
    firsts = described.select(F.col("row").alias("node"), "keys").join(nodes.select("node", "copies"), "node")
    shared = keep(shared_keys(firsts), "jaccard-shared")
    sets = described.select(F.col("row").alias("node"), "n_shingles", "point", "fine")
    texts = numbered(docs, id_column, text_column).select(F.col("row").alias("node"), F.col("packed").alias("text"))

    stars = shared.where("rep <> node").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    near = keep(_bounded(stars, sets, "point", percent), "jaccard-candidates")
    of = components(verified(_bounded(near, sets, "fine", percent), texts, n, percent))
    return named(described, nodes, joined_links(of, _tree_links(shared, sets, of, texts, n, percent)))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (a stored table) with one row of each component, that of the smallest doc_id; null ids rank last.

    Rows with empty sets all stay; columns stay as they are.
    """
    docs = stored(docs)
    found = keep(jaccard_components(docs, n, percent).where("component is not null"), "jaccard-found")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    stay = found.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min(place).alias("first")).where("members > 1")
    gone = found.join(stay, "component").where(F.col("row") != F.col("first")["row"]).select("row")
    gone = keep(gone, "jaccard-gone")  # a stored list of known size: a short one need not move the texts
    whole = row_numbers(docs)(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    return whole.join(gone, "row", "left_anti").select("record.*")


SQL = components_sql(3, 90)


@query("op8_jaccard", SQL)
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90).drop("row", "component")
