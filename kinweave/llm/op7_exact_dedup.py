"""Operator 7: exact deduplication through a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z.  Every input task keeps a cuckoo index of the digests
it has seen and merges copies on the spot; what is left (one row per distinct text and task) is dealt by digest to the
tasks that merge it again.  A hot group is therefore at most one row per task when it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.registry import query
from kinweave.llm.store import keep, partitions_for, row_numbers, stored, table, text_bytes

FLUSH_KEYS = 200_000  # an index that holds more live digests is emptied into the shuffle

SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), h as (select doc_id, sha256(t) as text_sha256 from d),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from h group by 1)
select h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id as kept, h.text_sha256 from h join g using (text_sha256)
"""


class CuckooIndex:
    """Cuckoo filter over 32-byte digests with a value per live digest.

    The filter has buckets of four 16-bit fingerprints; a digest may sit in either of two buckets.  A fingerprint hit is
    only a hint: it is verified against the digests stored in the content bucket of the same home slot.  When an
    insertion finds no room after ``MAX_MOVES`` displacements, the filter doubles and is rebuilt from the stored digests.
    """

    SLOTS = 4
    MAX_MOVES = 64

    def __init__(self, buckets: int = 256) -> None:
        self._live = 0
        self._build(buckets, {})

    def __len__(self) -> int:
        return self._live

    def _build(self, buckets: int, stored: dict[bytes, object]) -> None:
        while True:
            self._mask = buckets - 1
            self._filter: list[list[int]] = [[] for _ in range(buckets)]
            self._content: list[dict[bytes, object] | None] = [None] * buckets
            self._turn = 0
            if all(self._place(digest) for digest in stored):
                break
            buckets *= 2
        for digest, value in stored.items():
            self._put(digest, value)

    def _slots(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        home = int.from_bytes(digest[2:10], "big") & self._mask
        return mark, home, self._other(home, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self._mask)

    def _place(self, digest: bytes) -> bool:
        mark, home, other = self._slots(digest)
        for bucket in (home, other):
            if len(self._filter[bucket]) < self.SLOTS:
                self._filter[bucket].append(mark)
                return True
        bucket = other
        for _ in range(self.MAX_MOVES):
            self._turn += 1
            slot = self._turn % self.SLOTS
            self._filter[bucket][slot], mark = mark, self._filter[bucket][slot]
            bucket = self._other(bucket, mark)
            if len(self._filter[bucket]) < self.SLOTS:
                self._filter[bucket].append(mark)
                return True
        return False

    def _put(self, digest: bytes, value: object) -> None:
        home = self._slots(digest)[1]
        if self._content[home] is None:
            self._content[home] = {}
        self._content[home][digest] = value

    def get(self, digest: bytes) -> object | None:
        """Value of a live digest, or None."""
        mark, home, other = self._slots(digest)
        if mark not in self._filter[home] and mark not in self._filter[other]:
            return None
        return (self._content[home] or {}).get(digest)

    def insert(self, digest: bytes, value: object) -> None:
        """Add a digest that is not live."""
        self._put(digest, value)
        self._live += 1
        if not self._place(digest):  # one displaced mark has no room: rebuild from the stored digests
            self._build(2 * (self._mask + 1), dict(self.items()))

    def delete(self, digest: bytes) -> object:
        """Remove a live digest and return its value."""
        mark, home, other = self._slots(digest)
        value = self._content[home].pop(digest)
        self._filter[home if mark in self._filter[home] else other].remove(mark)
        self._live -= 1
        return value

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self._content:
            if bucket:
                yield from bucket.items()


def _rank(row: tuple) -> tuple:
    """Order of the rows of a group: null doc_id lowest, then doc_id, then the row's place in the input."""
    return (row[0] is not None, row[0] or 0, row[1])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge rows (digest, keep_id, keep_row, group_size) of equal digests."""
    index = CuckooIndex()

    def emptied() -> pa.RecordBatch:
        rows = list(index.items())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in rows], pa.binary()),
                pa.array([v[0] for _, v in rows], pa.int64()),
                pa.array([v[1] for _, v in rows], pa.int64()),
                pa.array([v[2] for _, v in rows], pa.int64()),
            ],
            names=["digest", "keep_id", "keep_row", "group_size"],
        )

    for batch in batches:
        for digest, doc, row, n in zip(*[batch.column(c).to_pylist() for c in ("digest", "keep_id", "keep_row", "group_size")]):
            live = index.get(digest)
            if live is None:
                index.insert(digest, (doc, row, n))
            else:  # the superseded row leaves the index, the one that stays enters it
                index.delete(digest)
                best = max(live[:2], (doc, row), key=_rank)
                index.insert(digest, (*best, live[2] + n))
    if len(index):
        yield emptied()


def _merge_bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_merge`, for a task of any size: the index is emptied whenever it has ``FLUSH_KEYS`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FLUSH_KEYS:
            yield from _merge(held)
            held, rows = [], 0
    yield from _merge(held)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashlib.sha256(t.lower()).digest() for t in batch.column("__text").to_pylist()]  # bytes.lower: A-Z only
        names = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, pa.binary())], names=[*names, "digest"])


def merged_groups(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, keep_row, group_size`` per distinct digest of ``rows`` (doc_id, row, digest)."""
    shape = "digest binary, keep_id long, keep_row long, group_size long"
    single = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    parts = partitions_for(rows, rows.count(), FLUSH_KEYS)
    return single.mapInArrow(_merge_bounded, shape).repartition(parts, "digest").mapInArrow(_merge, shape)


def digested(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, row, digest`` of every row, stored."""
    seen = row_numbers(docs)(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("__text")).select("doc_id", "row", "__text")
    return keep(seen.mapInArrow(_digests, "doc_id long, row long, digest binary"), "exact-rows")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A null or empty text is the empty text and forms a group like any other.  Of equal texts the row with the largest
    doc_id stays; null doc_id ranks lowest, and of rows with the same doc_id and text the last of the input stays.  An
    empty table gives no rows; other columns are not read.
    """
    rows = digested(stored(docs), id_column, text_column)
    several = keep(merged_groups(rows).where("group_size > 1"), "exact-groups")
    found = rows.join(several, "digest", "left")
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` (a stored table) without superseded copies, by the rule of :func:`exact_dedup`; columns stay as they are."""
    docs = stored(docs)
    rows = digested(docs, id_column, text_column)
    several = merged_groups(rows).where("group_size > 1").select("digest", "keep_row")
    gone = keep(rows.join(several, "digest").where(F.col("row") != F.col("keep_row")).select("row"), "exact-gone")
    whole = row_numbers(docs)(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    return whole.join(gone, "row", "left_anti").select("record.*")


@query("op7_exact_dedup", SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
