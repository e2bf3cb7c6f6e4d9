"""What the near-copy operators share: stars, verification on whole texts, and search inside blocks.

Nodes that may link meet in blocks (one per key).  Each block first links its members with one of them; these star
edges are as many as the members.  Blocks that still hold several components compare the members that are left inside
the task: overlaps of all their sets at once, a union-find per block, and only links between components leave it, at most
one less than the members.  No candidate pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.components import components
from kinweave.llm.passages import unpress
from kinweave.llm.store import keep, partitions_for
from kinweave.llm.words import shingles, word_hashes

BLOCK_ROWS = 2_048  # members that are compared at once; larger blocks are split into pairs of parts
BLOCK = ["key", "p", "q"]
MEMBER = "key long, p int, q int, mine int, node long, component long"
CARRIED_KEYS = 64  # smallest keys of a node that its members know
_COLUMNS = 4_096  # shingles of an overlap step


def components_sql(n: int, percent: int, more: str = "") -> str:
    """SQL of ``doc_id, n_shingles, component_id`` over ``documents``, by all pairs that share a shingle."""
    return f"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w from documents
), s as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + {n - 1}], ' ') for i in range(1, len(w) - {n - 2})] end) as g from d
), z as materialized (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
l as materialized (
  select a, b from p join z x on x.doc_id = a join z y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)
), r(a, b) as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as b from r group by 1),
o as (
  select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id
  from d left join z on z.doc_id = d.doc_id left join m on m.a = d.doc_id
)
select *{more} from o
"""


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection with which sets of sizes a and b link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _runs(column: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, with the length at the end."""
    return np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]]) if len(column) else np.zeros(1, np.int64)


def shared_keys(nodes: DataFrame) -> DataFrame:
    """``key, rep, node``: members of the keys that two nodes or more have; rep stands for the most copies."""
    pairs = nodes.select(F.explode("keys").alias("key"), "node", "copies")
    laid = pairs.repartition("key").sortWithinPartitions("key", F.desc("copies"), "node").select("key", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0 = rep0 = None  # key and representative of the last row seen
        shown = False  # whether that key is known to be shared
        for batch in batches:
            key, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
            if not len(key):
                continue
            runs = _runs(key)
            sizes = np.diff(runs)
            reps = node[runs[:-1]].copy()
            extra = None
            if key0 is not None and key[0] == key0:
                reps[0] = rep0
                if not shown:
                    extra = (key0, rep0)
            several = sizes > 1
            if key0 is not None and key[0] == key0:
                several[0] = True
            last_several = bool(several[-1])
            key0, rep0, shown = key[-1], reps[-1], last_several
            rows = np.repeat(several, sizes)
            # a run that reaches the end of the batch may go on: its first row is emitted with the next batch
            out = [key[rows], np.repeat(reps, sizes)[rows], node[rows]]
            if extra:
                out = [np.concatenate([[e], o]) for e, o in zip((extra[0], extra[1], extra[1]), out)]
            yield pa.RecordBatch.from_arrays([pa.array(o.astype(np.int64)) for o in out], names=["key", "rep", "node"])

    return laid.mapInArrow(run, "key long, rep long, node long")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose shingle sets link.  ``texts`` has ``node, text``, the text compressed."""
    pairs = keep(pairs, "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    known = keep(texts.join(wanted, "node", "left_semi"), "jaccard-texts")
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    both = both.join(known.select(F.col("node").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                linked = []
                for s, t in zip(_sets(batch.column("s"), n), _sets(batch.column("t"), n)):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    linked.append(100 * common >= percent * (len(s) + len(t) - common))
                yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return keep(both.mapInArrow(run, "a long, b long"), "jaccard-links")


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Shingle set of every compressed text."""
    data, offsets = unpress(column)
    words, _, _, bounds = word_hashes(data, offsets, lower=True)
    return shingles(words, bounds, n)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of different sets, by products of 0/1 matrices over the shingles that two sets or more hold."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = held > 1
    number = np.cumsum(common) - 1
    fits = common[column]
    member, column = member[fits], number[column[fits]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact up to 2**24 shingles
    total = int(common.sum())
    for first in range(0, total, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        part = np.zeros((len(sets), min(_COLUMNS, total - first)), np.float32)
        part[member[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out.astype(np.int64)


def links_between(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Verified links that join all components of a block whose members link; ``side``: only members of different sides do."""
    common = overlaps(sets)
    size = np.array([len(s) for s in sets])
    label, found = np.unique(component, return_inverse=True)[1], []
    for i in range(len(sets)):
        linked = 100 * common[i] >= percent * (size[i] + size - common[i])
        if side is not None:
            linked &= side != side[i]
        others, first = np.unique(label[linked], return_index=True)
        partner = np.flatnonzero(linked)[first]
        fresh = others != label[i]
        if fresh.any():
            found += [(i, int(j)) for j in partner[fresh]]
            label[np.isin(label, others)] = label[i]
    return found


def _own_members(rows: pa.Table, halves: bool) -> np.ndarray:
    """Members of a block with a partner that they meet in no block of a smaller key, as far as the carried keys show."""
    component, side, key = rows.column("component").to_numpy(), rows.column("mine").to_numpy(), rows.column("key")[0].as_py()
    keys = [np.array(k, np.int64) for k in rows.column("keys").to_pylist()]
    pending = (overlaps([k[k < key] for k in keys]) == 0) & (component[:, None] != component)
    if halves:
        pending &= side[:, None] != side
    return pending.any(axis=1)


def _linked(n: int, percent: int, rows: pa.Table) -> pa.RecordBatch | None:
    """Links (a, b) of a block of members with their compressed texts."""
    halves = rows.column("p")[0].as_py() != rows.column("q")[0].as_py()
    rows = rows.filter(pa.array(_own_members(rows, halves))).combine_chunks()
    if len(rows) < 2:
        return None
    node, component, side = (rows.column(c).to_numpy() for c in ("node", "component", "mine"))
    found = links_between(list(_sets(rows.column("vector"), n)), component, side if halves else None, percent)
    if not found:
        return None
    ends = [pa.array(node[[f[k] for f in found]], pa.int64()) for k in range(2)]
    return pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def open_blocks(shared: DataFrame, of: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """Members (``key, p, q, mine, node, component``) of the blocks that may still hold links between components.

    ``shared`` has ``key, rep, node``; links with ``rep`` are settled, so it takes no part.  Keys with the same members are
    one block.
    """
    placed = shared.where("node <> rep").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = keep(placed.select("key", "node", "component"), "near-placed")
    blocks = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("alike"),
    )
    blocks = blocks.where("low < high").groupBy("members", "alike").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("members") / most).cast("int")
    rows = placed.join(blocks.select("key", parts.alias("parts")), "key")
    mine = rows.withColumn("mine", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")))
    met = mine.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    part = lambda c, name: c.cast("int").alias(name)
    return met.select(
        "key", part(F.least("mine", "other"), "p"), part(F.greatest("mine", "other"), "q"), part(F.col("mine"), "mine"), "node", "component"
    )


def block_links(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links (a, b) between the components of every block of ``members``; ``texts`` has ``node, text``."""
    # two members that meet under several keys are compared under the smallest one; the carried keys are a bounded part, so
    # that a pair may be compared more often than once, never less
    keys = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, CARRIED_KEYS).alias("keys"))
    full = members.join(texts.select("node", F.col("text").alias("vector")).join(keys, "node"), "node")
    return keep(per_block(full, partial(_linked, n, percent), "a long, b long", ("keys",)).distinct(), "near-links")


def per_block(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], shape: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Run ``work`` on every block (key, p, q) of ``rows``, sorted by node; a task streams its blocks."""
    order = BLOCK
    tasks = partitions_for(rows, 1, 1)
    laid = rows.select(*order, "mine", "node", "component", "vector", *more).repartition(tasks, *order).sortWithinPartitions(*order, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Work off the complete blocks; the last one may go on in the next batch."""
            rows = pa.concat_tables(held).combine_chunks()
            held.clear()
            mark = np.zeros(max(len(rows) - 1, 0), bool)
            for c in order:
                values = rows.column(c).to_numpy()
                mark |= values[1:] != values[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(mark) + 1, [len(rows)]])
            done = [work(rows.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:] if last else cuts[1:-1])]
            done = [x for x in done if x is not None and x.num_rows]
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            if not last:
                held.append(rows.slice(cuts[-2]))

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                yield from flush(False)
        if held:
            yield from flush(True)

    return laid.mapInArrow(run, shape)


def named(described: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    """``doc_id, row, n_shingles, component_id, component`` of every row of ``described`` (``doc_id, row, n_shingles, mark``).

    ``nodes`` has ``mark, node, least`` of every different set, ``of`` the components of the nodes that have links.
    """
    placed = nodes.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "component").select("mark", "component_id", "component")
    out = described.select("doc_id", "row", "n_shingles", "mark").join(known, "mark", "left")
    nearest = F.when(F.col("mark").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row", "n_shingles", nearest.alias("component_id"), "component")


def joined_links(of: DataFrame, links: DataFrame) -> DataFrame:
    """Components over earlier components and more links."""
    return keep(components(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "near-components")
