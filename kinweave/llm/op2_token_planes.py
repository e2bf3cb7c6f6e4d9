"""Operator 2: token ids in a binary format of shuffled bit or byte planes.

Documents are laid out in ascending doc_id and encoded; the ids of a task's documents form one file, cut into blocks of
``BLOCK_IDS`` ids.  A block is transposed into byte or bit planes, each plane is compressed with zstandard, and planes
without any bit set are left out.  A file is a set of rows of one Parquet table, so any store Spark reaches can hold it:
``payload`` has the planes, all other columns are the chunk index (position, documents, plane numbers and sizes).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.registry import query
from kinweave.llm.store import new_folder, row_numbers, small_batches, stored, table, text_bytes
from kinweave.llm.words import over_batches, ragged, ragged_bytes, span_hashes

END_ID = 2
BLOCK_IDS = 1 << 16
FILE_BYTES = 16 << 20
CACHE_PIECES = 1 << 21
MOST_PIECES = 1 << 19  # looked up at a time; all of them and as many that share a hash fit an empty cache

# -- planes -----------------------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, scheme: str) -> list[tuple[int, bytes]]:
    """(plane number, compressed plane) of the planes of a block that have a bit set."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if scheme == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        planes = np.ascontiguousarray(raw.T)
    press = zstandard.ZstdCompressor(level=3)
    return [(k, press.compress(p.tobytes())) for k, p in enumerate(planes) if p.any()]


def from_planes(planes: Iterable[tuple[int, bytes]], n: int, scheme: str) -> np.ndarray:
    press = zstandard.ZstdDecompressor()
    if scheme == "bit":
        bits = np.zeros((32, n), np.uint8)
        for k, p in planes:
            bits[k] = np.unpackbits(np.frombuffer(press.decompress(p), np.uint8), count=n)
        return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u4").ravel()
    raw = np.zeros((4, n), np.uint8)
    for k, p in planes:
        raw[k] = np.frombuffer(press.decompress(p), np.uint8)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


# -- checksums --------------------------------------------------------------------------------------------------------

_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo the crc32 polynomial."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc32(one: int, two: int, bytes_of_two: int) -> int:
    """crc32 of two byte strings one after the other, from their own crc32."""
    shift, square, n = 1 << 31, 1 << 23, bytes_of_two  # x**0 and x**8
    while n:
        if n & 1:
            shift = _times(square, shift)
        square = _times(square, square)
        n >>= 1
    return _times(shift, one) ^ two


# -- encoding ---------------------------------------------------------------------------------------------------------


class HashIndex:
    """Open-addressing table from 64-bit hashes to numbers, looked up for whole arrays at a time."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it is unknown."""
        out = np.full(len(hashes), -1, np.int32)
        at, slot = np.arange(len(hashes)), hashes & self.mask
        while len(at):
            held = self.keys[slot]
            hit = held == hashes[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            at, slot = at[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Add distinct unknown hashes."""
        at, slot = np.arange(len(hashes)), hashes & self.mask
        while len(at):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[at[free]]  # of several in one slot the last stays
            won = free & (self.keys[slot] == hashes[at])
            self.values[slot[won]] = values[at[won]]
            at, slot = at[~won], (slot[~won] + np.uint64(1)) & self.mask


_SPACE, _OTHER_SPACE, _LETTER, _DIGIT, _MARK, _OPEN = range(6)
_KIND = np.full(256, _OPEN, np.uint8)  # apostrophes, controls and bytes beyond ASCII: left to the tokenizer
_KIND[32] = _SPACE
_KIND[[9, 10, 12, 13]] = _OTHER_SPACE
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = _MARK
#: Texts with rarer white space, which may join runs, or with a special token's mark are encoded whole.
_WHOLE = re.compile(rb"[\x0b\x1c-\x1f]|\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where byte-level pre-tokenization surely cuts.

    A run of white space is one piece but for its last byte, which leads the next piece if it is a space and else stands
    alone; letters, digits and marks of ASCII part wherever two kinds meet.
    """
    kind = _KIND[data]
    white = kind <= _OTHER_SPACE
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = _OTHER_SPACE
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    after[ends] = _OTHER_SPACE
    led = after > _OTHER_SPACE
    start = ~white & (before == _OTHER_SPACE)
    start |= white & (led | (before > _OTHER_SPACE))
    known = (kind >= _LETTER) & (kind <= _MARK)
    start |= known & (before >= _LETTER) & (before <= _MARK) & (before != kind)
    start[edges] = True
    return np.flatnonzero(start)


def _put(values: np.ndarray, ends: np.ndarray, n: int, sizes: list[int], new: np.ndarray) -> np.ndarray:
    """Append entries after the first ``n``; the buffer, which grows when it is full."""
    used = int(ends[n])
    if used + len(new) > len(values):
        values = np.concatenate([values, np.zeros(max(len(values), len(new)), values.dtype)])
    values[used : used + len(new)] = new
    ends[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(sizes)
    return values


class PieceEncoder:
    """Encodes texts with the tokenizers library, every distinct piece once per Python worker (up to a bound).

    A piece is known again by the hash of its bytes and then by the bytes themselves.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        kind = self.tokenizer.pre_tokenizer
        self.by_piece = isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        if self.by_piece:
            # letters of the byte alphabet, as the pre-tokenizer itself spells them
            plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            rest = [b for b in range(256) if b not in plain]
            self.spell = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self._empty()

    def _empty(self) -> None:
        self.index = HashIndex(22)
        self.n = 0
        self.ids = np.zeros(1 << 20, np.int32)
        self.ends = np.zeros(CACHE_PIECES + 1, np.int64)  # piece k has ids[ends[k] : ends[k + 1]]
        self.letters = np.zeros(1 << 23, np.uint8)
        self.letter_ends = np.zeros(CACHE_PIECES + 1, np.int64)  # and the bytes letters[letter_ends[k] : letter_ends[k + 1]]

    def _encode_new(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        open_ = []
        for k, piece in enumerate(pieces):
            text = piece.decode()
            word = text[1:] if text[0] == " " else text
            if word.isalpha() and max(word) < "ɐ":  # one pre-token: straight to the model
                out[k] = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.spell))]
            else:
                open_.append(k)
        for k, e in zip(open_, self.tokenizer.encode_batch_fast([pieces[k].decode() for k in open_], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _store(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of new pieces, whose ids and bytes are kept."""
        lists = self._encode_new(pieces)
        self.ids = _put(self.ids, self.ends, self.n, [len(x) for x in lists], np.fromiter((i for x in lists for i in x), np.int32))
        self.letters = _put(self.letters, self.letter_ends, self.n, [len(p) for p in pieces], np.frombuffer(b"".join(pieces), np.uint8))
        self.n += len(pieces)
        return np.arange(self.n - len(pieces), self.n, dtype=np.int32)

    def _others(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those of the piece found by their hash."""
        known, size = self.letter_ends[found], stops - starts
        same = self.letter_ends[found + 1] - known == size
        alike = np.flatnonzero(same)
        at, own = ragged_bytes(data, starts[alike], stops[alike])
        _, kept = ragged_bytes(self.letters, known[alike], known[alike] + size[alike])
        same[alike[np.searchsorted(at, np.flatnonzero(own != kept), side="right") - 1]] = False
        return np.flatnonzero(~same)

    def _numbers(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Number of every piece; unknown ones are encoded, and so is each that shares only its hash with a known one."""
        hashes = span_hashes(data, starts, stops)
        found = self.index.find(hashes)
        if self.n + 2 * int((found < 0).sum()) > CACHE_PIECES:
            self._empty()
            found[:] = -1
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            self.index.add(distinct, self._store([data[starts[k] : stops[k]].tobytes() for k in new[first]]))
            found = self.index.find(hashes)
        others = self._others(data, starts, stops, found)
        if len(others):
            pieces = [data[starts[k] : stops[k]].tobytes() for k in others]
            distinct = list(dict.fromkeys(pieces))
            if self.n + len(distinct) > CACHE_PIECES:  # rare enough to start again
                self._empty()
                return self._numbers(data, starts, stops)
            number = dict(zip(distinct, self._store(distinct).tolist()))
            found[others] = [number[p] for p in pieces]
        return found

    def _ids(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one piece after the other, and the number of each piece's ids."""
        size = self.ends[found + 1] - self.ends[found]
        return self.ids[np.repeat(self.ends[found] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per text) of the texts of a block."""
        n = len(offsets) - 1
        text = data.tobytes()
        special = [m.start() for m in _WHOLE.finditer(text)] if self.by_piece else []
        whole = np.zeros(n, bool) if self.by_piece else np.ones(n, bool)
        whole[np.searchsorted(offsets, special, side="right") - 1] = True
        starts = piece_starts(data, offsets) if len(data) else np.zeros(0, np.int64)
        stops = np.append(starts[1:], len(data))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        mine = ~whole[owner]
        starts, stops, owner = starts[mine], stops[mine], owner[mine]
        runs = [slice(k, k + MOST_PIECES) for k in range(0, len(starts), MOST_PIECES)]
        lows = [starts[r.start] for r in runs]
        parts = [self._ids(self._numbers(data[lo : stops[r][-1]], starts[r] - lo, stops[r] - lo)) for r, lo in zip(runs, lows)]
        ids = np.concatenate([np.zeros(0, np.int32), *[p for p, _ in parts]])
        size = np.concatenate([np.zeros(0, np.int64), *[p for _, p in parts]])
        counts = np.bincount(owner, size, n).astype(np.int64)
        if whole.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(whole):
                parts[k] = np.array(self.tokenizer.encode(text[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids, np.int32)
                counts[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, counts


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


# -- files ------------------------------------------------------------------------------------------------------------

_CHUNK = (
    "file int, chunk int, first long, n int, scheme string, docs array<long>, places array<int>, counts array<int>, "
    "planes array<int>, sizes array<int>, payload binary"
)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, scheme: str = "byte", block_ids: int = BLOCK_IDS,
    id_column: str = "doc_id", text_column: str = "text",
) -> None:
    """Encode ``docs`` in ascending id order (null ids first, rows with equal ids in input order) and write the files.

    Each document is followed by ``end_id``; null and empty texts have that id alone.
    """
    docs = stored(docs)
    chosen = row_numbers(docs)(F.col(id_column).cast("long").alias("doc"), text_bytes(text_column).alias("text")).select("doc", "row", "text")
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    laid = chosen.repartitionByRange(files, "doc", "row").sortWithinPartitions("doc", "row")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, file = encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[np.ndarray] = []  # ids that do not fill a block yet
        segments: list[tuple] = []  # (doc, place, ids in the block)
        filled, chunk, place = 0, 0, 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            planes = to_planes(ids, scheme)
            docs_, places, counts = zip(*segments)
            row = [
                [file], [chunk], [chunk * block_ids], [len(ids)], [scheme], [list(docs_)], [list(places)], [list(counts)],
                [[k for k, _ in planes]], [[len(p) for _, p in planes]], [b"".join(p for _, p in planes)],
            ]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.binary()]
            names = ["file", "chunk", "first", "n", "scheme", "docs", "places", "counts", "planes", "sizes", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

        for rows, data, offsets in over_batches(batches, "text"):
            ids, counts = tool.encode(data, offsets)
            at = 0
            for doc, count in zip(rows.column("doc").to_pylist(), counts.tolist()):
                own = np.append(ids[at : at + count], end_id)
                at, done = at + count, 0
                while done < len(own):
                    part = own[done : done + block_ids - filled]
                    held.append(part)
                    segments.append((doc, place, len(part)))
                    done, filled = done + len(part), filled + len(part)
                    if filled == block_ids:
                        yield block()
                        held, segments, filled, chunk = [], [], 0, chunk + 1
                place += 1
        if filled:
            yield block()

    with small_batches(docs.sparkSession):
        laid.mapInArrow(run, _CHUNK).write.option("compression", "uncompressed").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, computed from the ids in the files."""
    chunks = spark.read.schema(_CHUNK).parquet(folder)
    totals = chunks.groupBy("file").agg(F.sum("n").alias("ids"))  # one row per file
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("file", before.alias("before"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cuts = np.cumsum([0, *row["sizes"]])
                planes = [(k, row["payload"][a:b]) for k, a, b in zip(row["planes"], cuts[:-1], cuts[1:])]
                raw = from_planes(planes, row["n"], row["scheme"]).astype("<u4").tobytes()
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]] * n, pa.int32()), pa.array(row["places"], pa.int32()), pa.array(row["docs"], pa.int64()),
                        pa.array(starts + row["first"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["file", "place", "doc_id", "first", "n", "crc"],
                )

    parts = chunks.mapInArrow(run, "file int, place int, doc_id long, first long, n long, crc long")
    # a document that crosses block borders has one part per block
    whole = parts.groupBy("file", "place").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("first", "n", "crc"))).alias("parts"),
    )

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for some in batch.column("parts").to_pylist():
                crc = some[0]["crc"]
                for p in some[1:]:
                    crc = joined_crc32(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            kept = ["file", "doc_id", "first", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(crcs, pa.int64())], names=[*kept, "ids_crc32"])

    done = whole.mapInArrow(combine, "file int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return done.join(totals, "file").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


@query("op2_token_planes")
def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, str(public_tokenizers.path("byte_bpe_50k.json")))
    return read_token_files(spark, folder)
