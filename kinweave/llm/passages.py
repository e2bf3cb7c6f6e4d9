"""Windows of a fixed number of units (bytes or words) that also start earlier in a corpus.

Every window has one anchor: its gram of smallest hash.  Equal windows have equal anchors at equal offsets, so only
anchors travel, one for some tens of windows: the fingerprint of the gram and a hash of the anchor's context, which is
the text of all its windows.

1. Each shard of documents writes its anchors as a run sorted by fingerprint, cut at the borders of the fingerprint
   ranges.  2. The runs of a range are merged by binary search.  Of equal contexts the earliest stays open and all
   windows of the others are repeats.  3. Fingerprints with several contexts (the borders of passages) send these, one
   of each kind, to the operator's own resolver.  4. Fingerprints with more contexts than one task should hold send one
   hash per window instead, which Spark sorts.

Positions are ordered by (doc_id, row, offset); ``row`` tells rows apart that repeat a doc_id, null ids come last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.store import keep, partitions_for, row_numbers, stored, text_bytes
from kinweave.llm.words import blocks, mix, powers, sliding_min, text_block

SHARD_BYTES = 2 << 20
RANGE_ANCHORS = 100_000
HOT_CONTEXTS = 10_000  # contexts of one fingerprint that a task may hold
GROUP_BYTES = 1 << 18  # contexts resolved together
NO_ID = (1 << 63) - 1
_CONTEXT_BITS = np.uint64((1 << 48) - 1)
_FIELDS = [("fingerprint", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<i4"), ("stop", "<i4")]
_SPAN_FIELDS = [("doc", "<i8"), ("row", "<i8"), ("lo", "<i4"), ("stop", "<i4")]


def packed(columns: dict[str, np.ndarray], fields: list[tuple[str, str]]) -> bytes:
    """Columns as byte planes, in which the shuffle's compression finds the constant bytes."""
    planes = [np.ascontiguousarray(columns[n].astype(t)).view(np.uint8).reshape(len(columns[n]), -1).T for n, t in fields]
    return b"".join(p.tobytes() for p in planes)


def unpacked(payload: bytes | pa.Buffer, fields: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    kinds = [np.dtype(t) for _, t in fields]
    data = np.frombuffer(payload, np.uint8)
    n, at, out = len(data) // sum(k.itemsize for k in kinds), 0, {}
    for (name, _), kind in zip(fields, kinds):
        plane = data[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T
        out[name] = np.ascontiguousarray(plane).view(kind).ravel()
        at += n * kind.itemsize
    return out


@dataclass
class Anchors:
    """Anchors of a block: row index, first and last window start (unit indices), fingerprint and context hash."""

    owner: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    fingerprint: np.ndarray
    context: np.ndarray


def range_hashes(sums: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((sums[stop] - sums[first]) * powers(len(sums))[1][first] + (stop - first).astype(np.uint64))


def unit_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of unit values (one number per byte or word) for :func:`range_hashes`."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def window_starts(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, unit index) of every window that lies within a row."""
    count = np.maximum(np.diff(bounds) - window + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    return owner, bounds[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def find_anchors(sums: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Anchors:
    owner, starts = window_starts(bounds, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    n = len(sums) - 1
    first = np.arange(n - gram + 1)
    grams = range_hashes(sums, first, first + gram)
    # smallest upper half of the hash, leftmost on ties: a function of the window's content alone
    least = sliding_min((grams >> np.uint64(32) << np.uint64(32)) | first.astype(np.uint64), window - gram + 1)
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    lo, hi, at, owner = starts[heads], starts[np.append(heads[1:] - 1, len(starts) - 1)], at[heads], owner[heads]
    place = ((at - lo) << 16 | (hi - lo)).astype(np.uint64)
    # smallest hashes crowd the lower end; hashed once more they spread evenly over the ranges
    fingerprint = mix(grams[at] + np.uint64(1))
    return Anchors(owner, lo, hi, fingerprint, (range_hashes(sums, lo, hi + window) ^ mix(place)) & _CONTEXT_BITS)


def merge_by_search(runs: list[np.ndarray]) -> np.ndarray:
    """Order in which the concatenated sorted runs are sorted: neighbours are merged pairwise by binary search."""
    starts = np.cumsum([0, *[len(r) for r in runs]])
    parts = [(r, np.arange(a, a + len(r))) for r, a in zip(runs, starts)]
    while len(parts) > 1:
        merged = []
        for k in range(0, len(parts) - 1, 2):
            (x, i), (y, j) = parts[k], parts[k + 1]
            place = np.searchsorted(x, y, side="right") + np.arange(len(y))
            keys, order = np.empty(len(x) + len(y), x.dtype), np.empty(len(x) + len(y), np.int64)
            rest = np.ones(len(keys), bool)
            rest[place] = False
            keys[place], order[place] = y, j
            keys[rest], order[rest] = x, i
            merged.append((keys, order))
        parts = merged + parts[len(parts) - len(parts) % 2 :]
    return parts[0][1] if parts else np.zeros(0, np.int64)


Resolver = Callable[[list[bytes], np.ndarray], list[np.ndarray]]


@dataclass
class Corpus:
    """How an operator reads its units.

    ``units(data, offsets)`` gives (value per unit, bounds of the rows in units); ``text(data, offsets, bounds)`` gives a
    function (first unit, stop unit) -> bytes of a context; ``resolve(contexts, group)`` gives, for contexts in the order
    of their positions, the window offsets within each context that repeat an earlier window of the same group;
    ``local(values, data, bounds, doc, row, anchors)``, if any, resolves a shard: flags of repeated starts.
    """

    window: int
    gram: int
    units: Callable
    text: Callable
    resolve: Resolver
    local: Callable | None = None


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    columns = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), text_bytes(text_column).alias("text")
    return row_numbers(docs)(*columns).select("doc", "row", "text")


def numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc, row, packed``: compressed texts, as they travel.  ``docs`` must be a stored table (rows are numbered by its files)."""
    chosen = _texts(docs, id_column, text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pa.array([press.compress(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), texts], names=["doc", "row", "packed"])

    return chosen.mapInArrow(run, "doc long, row long, packed binary")


def unpress(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text bytes and offsets of a column of compressed texts."""
    press = zstandard.ZstdDecompressor()
    return text_block(pa.array([press.decompress(t) for t in column.to_pylist()], pa.large_binary()))


def _shard_anchors(corpus: Corpus, data: np.ndarray, offsets: np.ndarray) -> tuple[Anchors, np.ndarray]:
    """Anchors of a shard, found block by block, and its row bounds in units."""
    parts, all_bounds, units = [], [np.zeros(1, np.int64)], 0
    for a, b in blocks(data, offsets):
        values, bounds = corpus.units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found = find_anchors(unit_sums(values), bounds, corpus.window, corpus.gram)
        parts.append((found.owner + a, found.lo + units, found.hi + units, found.fingerprint, found.context))
        all_bounds.append(bounds[1:] + units)
        units += int(bounds[-1])
    return Anchors(*[np.concatenate(c) for c in zip(*parts)]), np.concatenate(all_bounds)


def _shard_rows(corpus: Corpus, docs: pa.RecordBatch, ranges: int, turn: int) -> Iterator[tuple[int, bytes]]:
    """Sorted run of one shard, cut into the fingerprint ranges; locally resolved windows as spans behind them."""
    data, offsets = text_block(docs.column("text"))
    doc, row = docs.column("doc").to_numpy(), docs.column("row").to_numpy()
    a, bounds = _shard_anchors(corpus, data, offsets)
    if not len(a.lo):
        return
    if corpus.local:
        again = corpus.local(data, bounds, doc, row, a)
        at = np.flatnonzero(again)
        if len(at):
            owner = np.searchsorted(bounds, at, side="right") - 1
            cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
            heads = np.flatnonzero(cut)
            o = owner[heads]
            last = at[np.append(heads[1:] - 1, len(at) - 1)]
            spans = {"doc": doc[o], "row": row[o], "lo": at[heads] - bounds[o], "stop": last + corpus.window - bounds[o]}
            yield ranges + turn % ranges, packed(spans, _SPAN_FIELDS)
            total = np.concatenate([[0], np.cumsum(again)])
            left = total[a.hi + 1] - total[a.lo] < a.hi + 1 - a.lo
            a = Anchors(a.owner[left], a.lo[left], a.hi[left], a.fingerprint[left], a.context[left])
    order = np.argsort(a.fingerprint)
    o = a.owner[order]
    run = {
        "fingerprint": a.fingerprint[order], "context": a.context[order], "doc": doc[o], "row": row[o],
        "lo": a.lo[order] - bounds[o], "stop": a.hi[order] + corpus.window - bounds[o],
    }
    # borders of the ranges, found in the sorted run by binary search
    borders = np.array([-(-(k << 32) // ranges) for k in range(1, ranges)], np.uint64) << np.uint64(32)
    cuts = np.concatenate([[0], np.searchsorted(run["fingerprint"], borders), [len(order)]])
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), packed({n: v[cuts[k] : cuts[k + 1]] for n, v in run.items()}, _FIELDS)


def _runs(docs: DataFrame, corpus: Corpus, ranges: int) -> DataFrame:
    """``range, payload``: the runs of all shards; a shard is some ``SHARD_BYTES`` of documents of one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            data, offsets = text_block(batch.column("text"))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SHARD_BYTES, side="right")) - 1)
                rows = list(_shard_rows(corpus, batch.slice(at, stop - at), ranges, turn))
                at, turn = stop, turn + 1
                for k in range(0, len(rows), 256):
                    some = rows[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())], names=["range", "payload"])

    return docs.mapInArrow(run, "range int, payload binary")


_SETTLED = "kind tinyint, fingerprint long, doc long, row long, lo int, stop int"
SPAN, OPEN, HOT = 0, 1, 2


def _settle(payloads: list[pa.Buffer], hot: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Merge the runs of one range: spans of repeats, and contexts that stay open."""
    runs = [unpacked(p, _FIELDS) for p in payloads]
    order = merge_by_search([r["fingerprint"] for r in runs])
    all_ = {n: np.concatenate([r[n] for r in runs])[order] for n, _ in _FIELDS}
    f = all_["fingerprint"]
    same = f[1:] == f[:-1]
    shared = np.zeros(len(f), bool)
    shared[1:] |= same
    shared[:-1] |= same
    some = {n: v[shared] for n, v in all_.items()}
    if not len(some["lo"]):
        return
    turn = np.lexsort((some["lo"], some["row"], some["doc"], some["context"], some["fingerprint"]))
    some = {n: v[turn] for n, v in some.items()}
    new_f = np.concatenate([[True], some["fingerprint"][1:] != some["fingerprint"][:-1]])
    new_c = new_f | np.concatenate([[True], some["context"][1:] != some["context"][:-1]])
    yield SPAN, {n: v[~new_c] for n, v in some.items()}
    group = np.cumsum(new_f) - 1
    kinds = np.bincount(group, new_c)[group]
    yield OPEN, {n: v[new_c & (kinds > 1) & (kinds <= hot)] for n, v in some.items()}
    yield HOT, {n: v[new_c & (kinds > hot)] for n, v in some.items()}


def _settled(runs: DataFrame, ranges: int, hot: int) -> DataFrame:
    laid = runs.repartition(partitions_for(runs, ranges, 2), "range").sortWithinPartitions("range")

    def batch_of(kind: int, c: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(c["lo"])
        f = c["fingerprint"].view(np.int64) if "fingerprint" in c else np.zeros(n, np.int64)
        columns = [pa.array(np.full(n, kind, np.int8)), pa.array(f), pa.array(c["doc"]), pa.array(c["row"]), pa.array(c["lo"]), pa.array(c["stop"])]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "fingerprint", "doc", "row", "lo", "stop"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            payloads = batch.column("payload")
            for at, k in enumerate(batch.column("range").to_pylist()):
                payload = payloads[at].as_buffer()  # a view; the run is copied once, when it is merged
                if k >= ranges:
                    yield batch_of(SPAN, unpacked(payload, _SPAN_FIELDS))
                    continue
                if k != now and held:
                    for kind, c in _settle(held, hot):
                        yield batch_of(kind, c)
                    held = []
                now = k
                held.append(payload)
        if held:
            for kind, c in _settle(held, hot):
                yield batch_of(kind, c)

    return laid.mapInArrow(run, _SETTLED)


def _per_row(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("ranges"))


def _struct(lists: pa.ListArray, name: str) -> np.ndarray:
    return lists.flatten().field(name).to_numpy(zero_copy_only=False)


def _contexts(settled: DataFrame, texts: DataFrame, corpus: Corpus) -> DataFrame:
    """``kind, fingerprint, doc, row, lo, context, second``: texts of the open contexts, and the windows of the hot ones.

    A hot window has two hashes of its units, in ``fingerprint`` and ``second``, instead of a text.
    """
    open_ = settled.where(F.col("kind") != SPAN)
    met = texts.join(_per_row(open_, "kind", "fingerprint", "lo", "stop"), "row").select("doc", "row", "packed", "ranges")
    names = ["kind", "fingerprint", "doc", "row", "lo", "context", "second"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                data, offsets = unpress(batch.column("packed"))
                values, bounds = corpus.units(data, offsets)
                cut = corpus.text(data, offsets, bounds)
                lists = batch.column("ranges")
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                kind, fingerprint, lo, stop = (_struct(lists, c) for c in ("kind", "fingerprint", "lo", "stop"))
                doc, row = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
                hot = kind == HOT
                o = owner[~hot]
                pieces = [cut(int(x), int(y)) for x, y in zip(bounds[o] + lo[~hot], bounds[o] + stop[~hot])]
                columns = [kind[~hot], fingerprint[~hot], doc[o], row[o], lo[~hot]]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(pieces, pa.binary()), pa.array(np.zeros(len(pieces), np.int64))], names=names
                )
                if not hot.any():
                    continue
                n = stop[hot] - lo[hot] - corpus.window + 1
                at = (np.repeat(lo[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())).astype(np.int32)
                o = np.repeat(owner[hot], n)
                first = bounds[o] + at
                one = range_hashes(unit_sums(values), first, first + corpus.window).view(np.int64)
                two = range_hashes(unit_sums(mix(values)), first, first + corpus.window).view(np.int64)
                columns = [np.full(len(at), HOT, np.int8), one, doc[o], row[o], at]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(at), pa.binary()), pa.array(two)], names=names)

    return met.mapInArrow(run, "kind tinyint, fingerprint long, doc long, row long, lo int, context binary, second long")


def _resolved(contexts: DataFrame, corpus: Corpus) -> DataFrame:
    """``row, lo, stop``: repeated windows among the contexts of each fingerprint."""
    laid = contexts.select("fingerprint", "doc", "row", "lo", "context").repartition("fingerprint").sortWithinPartitions("fingerprint", "doc", "row", "lo")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def resolve(rows: pa.Table) -> pa.RecordBatch:
            f = rows.column("fingerprint").to_numpy()
            group = np.cumsum(np.concatenate([[0], f[1:] != f[:-1]]))
            found = corpus.resolve(rows.column("context").to_pylist(), group)
            n = np.array([len(x) for x in found])
            start = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64) + np.repeat(rows.column("lo").to_numpy(), n)
            row = np.repeat(rows.column("row").to_numpy(), n)
            if len(start):  # neighbouring starts of a row are one span
                new = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])])
                heads = np.flatnonzero(new)
                last = start[np.append(heads[1:] - 1, len(start) - 1)]
                row, start, stop = row[heads], start[heads], last + corpus.window
            else:
                stop = start
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["row", "lo", "stop"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("context").nbytes
            if size < GROUP_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            f = rows.column("fingerprint").to_numpy()
            whole = int(np.searchsorted(f, f[-1]))  # the last fingerprint may go on in the next batch
            yield from (resolve(part) for part in _portions(rows.slice(0, whole)))
            held = rows.slice(whole).to_batches()
            size = sum(b.column("context").nbytes for b in held)
        if held:
            yield from (resolve(part) for part in _portions(pa.Table.from_batches(held).combine_chunks()))

    return laid.mapInArrow(run, "row long, lo int, stop int")


def _portions(rows: pa.Table) -> Iterator[pa.Table]:
    """Whole fingerprints, about ``GROUP_BYTES`` of contexts at a time."""
    if not len(rows):
        return
    f = rows.column("fingerprint").to_numpy()
    size = np.cumsum(pa.compute.binary_length(rows.column("context")).to_numpy())
    heads = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    at = 0
    while at < len(rows):
        before = size[at - 1] if at else 0
        later = heads[(heads > at) & (size[heads - 1] - before >= GROUP_BYTES)]
        stop = int(later[0]) if len(later) else len(rows)
        yield rows.slice(at, stop - at)
        at = stop


def _hot_windows(windows: DataFrame, corpus: Corpus) -> DataFrame:
    """``row, lo, stop``: all but the first of equal windows, streamed in the order of hash and position."""
    order = ["fingerprint", "second", "doc", "row", "lo"]
    laid = windows.select(*order).repartition("fingerprint", "second").sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = batch.column("fingerprint").to_numpy(), batch.column("second").to_numpy()
            again = np.zeros(len(one), bool)
            again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            again[0] = last == (one[0], two[0])
            last = (one[-1], two[-1])
            lo = batch.column("lo").to_numpy()[again]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("row").to_numpy()[again]), pa.array(lo), pa.array((lo + corpus.window).astype(np.int32))], names=["row", "lo", "stop"]
            )

    return laid.mapInArrow(run, "row long, lo int, stop int")


def repeated_spans(docs: DataFrame, corpus: Corpus, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): ``doc, row, packed`` per document and ``row, ranges`` with the unit ranges [lo, stop) of windows
    that also start earlier, for the documents that have any."""
    docs = stored(docs)
    texts = numbered(docs, id_column, text_column)
    plain = _texts(docs, id_column, text_column)
    total = docs.select(text_bytes(text_column).alias("text")).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_anchor = (corpus.window - corpus.gram + 2) / 2  # units per anchor; a unit has a byte at least
    ranges = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / per_anchor / RANGE_ANCHORS))
    settled = keep(_settled(_runs(plain, corpus, ranges), ranges, hot), "settled")
    contexts = keep(_contexts(settled, texts, corpus), "contexts")
    spans = settled.where(F.col("kind") == SPAN).select("row", "lo", "stop")
    spans = spans.unionByName(_resolved(contexts.where(F.col("kind") == OPEN), corpus))
    spans = spans.unionByName(_hot_windows(contexts.where(F.col("kind") == HOT), corpus))
    return texts, _per_row(spans, "lo", "stop")


def covered(lists: pa.ListArray, bounds: np.ndarray) -> np.ndarray:
    """Flags of the units that the ranges of each row cover; a null list covers nothing."""
    step = np.zeros(int(bounds[-1]) + 1, np.int64)
    lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), lengths)
    np.add.at(step, bounds[owner] + _struct(lists, "lo"), 1)
    np.add.at(step, bounds[owner] + _struct(lists, "stop"), -1)
    return np.cumsum(step[:-1]) > 0
