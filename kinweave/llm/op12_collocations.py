"""Operator 12: phrase collocations per language, by best-first growth with score bounds.

A phrase of two or three words scores ``floor(SCALE * a * a / (l * r))`` at its lowest-scoring cut.  Counting all three-word
phrases would be the dearest shuffle, so they are grown from pairs.  For a pair ``u v`` every phrase ``u v w`` has
``a <= f(u v)`` and ``f(v w) >= a``, so its first cut gives at most ``SCALE * f(u v) / f(u)``: the pair's bound, which is
at least the pair's own score as well.

1. Words are counted, then neighbouring pairs; pairs seen often enough are the nodes, with bound and score.
2. The frontier of a language is the nodes with the highest bounds.  It is expanded by counting the three-word phrases
   that begin with a node, or end in one whose own score competes (a longer phrase may swallow the pair).
3. The score of the ``top``-th phrase that survives is a floor: nodes with lower bounds cannot reach it any more.  A
   language is settled, ties included, when all nodes whose bound reaches that score are expanded; else the frontier
   moves down to that score (or, as long as too few survive, to ``GROWTH`` times as many nodes) and growth goes on.

Texts are read in their own tasks, which count what they see before anything is shuffled.  Two bitmaps of hashes, of
bounded size, keep hopeless phrases out of the shuffle: pairs whose hash is too rare to be counted, and three-word phrases
of which a pair is rare or that touch no node of the frontier.  They only prune: whatever passes is counted by its words.
Bounds and scores are ranked through their histograms, so no task sorts a language.  Thresholds stay in tables; the driver
holds the bitmaps and learns how many languages are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.registry import query
from kinweave.llm.store import keep, table, text_bytes
from kinweave.llm.words import ARE_WORD, blocks, lowered, mix, ragged_bytes, text_block, word_hashes
from kinweave.session import spread

SCALE = 1_000_000
FIRST = 4  # the first frontier has this many nodes per wanted phrase
GROWTH = 8

BLOCK = 2 << 20  # bytes of text counted at once
SLOT_BITS = 44  # of the hashes that rare pairs are counted by
BITS_PER_ENTRY = 16  # of a bitmap
MOST_BITS = 1 << 28  # a bitmap has 32 MB at most; beyond that it prunes less

_BREAKS = np.zeros(256, bool)
_BREAKS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_ARE_WORD = ARE_WORD & ~_BREAKS

SQL = """
with p as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p
), u as (
  select lang, unnest(ws) as w1, unnest(ws[2:] || [null::varchar]) as w2, unnest(ws[3:] || [null::varchar, null::varchar]) as w3
  from w where len(ws) > 0
), s as (select * from u where w1 is not null), f1 as materialized (select lang, w1, count(*) as f from s group by all),
f2 as materialized (select lang, w1, w2, count(*) as f from s where w2 is not null group by all),
f3 as materialized (select lang, w1, w2, w3, count(*) as f from s where w3 is not null group by all having count(*) >= 10),
c as (
  select f2.lang, w1, w2, null as w3, f2.f as a, x.f as l, y.f as r, 1 as k
  from f2 join f1 x using (lang, w1) join f1 y on y.lang = f2.lang and y.w1 = f2.w2 where f2.f >= 10
  union all
  select f3.lang, f3.w1, f3.w2, f3.w3, f3.f, x.f, y.f, 1
  from f3 join f1 x using (lang, w1) join f2 y on y.lang = f3.lang and y.w1 = f3.w2 and y.w2 = f3.w3
  union all
  select f3.lang, f3.w1, f3.w2, f3.w3, f3.f, x.f, y.f, 2
  from f3 join f2 x using (lang, w1, w2) join f1 y on y.lang = f3.lang and y.w1 = f3.w3
), cut as (
  select *, (a::hugeint * a::hugeint * 1000000::hugeint // (l::hugeint * r::hugeint))::bigint as score from c
), low as (
  select * from cut qualify row_number() over (partition by lang, w1, w2, w3 order by score, k) = 1
), inside as (
  select lang, w1, w2, max(f) as f from (
    select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all
), kept as (
  select low.lang, concat_ws(' ', low.w1, low.w2, low.w3) as phrase, a, l, r, score
  from low left join inside i on i.lang = low.lang and i.w1 = low.w1 and i.w2 = low.w2
  where low.w3 is not null or i.f is null or 100 * i.f < 50 * low.a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
), total as (select lang, sum(f)::bigint as n from f1 group by all)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""


@dataclass
class Counted:
    """Words of a block of rows: bytes, spans, number and hash of each, the number of its language, and where phrases end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    number: np.ndarray
    distinct: int
    lang: np.ndarray
    langs: list[str]
    hashes: np.ndarray
    joined: np.ndarray  # whether a word and its successor stand in one piece

    def runs(self, length: int) -> np.ndarray:
        """Places at which ``length`` words of one piece begin."""
        at = np.ones(max(len(self.starts) - length + 1, 0), bool)
        for k in range(length - 1):
            at &= self.joined[k : k + len(at)]
        return np.flatnonzero(at)

    def slots(self) -> np.ndarray:
        """Hash of the pair that begins at each word, its language included."""
        marks = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in self.langs], np.uint64)
        out = np.zeros(len(self.hashes), np.uint64)
        out[:-1] = mix(mix(self.hashes[:-1] ^ marks[self.lang[:-1]]) + self.hashes[1:]) >> np.uint64(64 - SLOT_BITS)
        return out

    def grouped(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of every different phrase of ``length`` words among ``at``, and how often it occurs there."""
        key = self.lang[at] * self.distinct + self.number[at]
        for k in range(1, length):
            if k > 1:  # renumbered, so that the next word still fits
                key = np.unique(key, return_inverse=True)[1]
            key = key * self.distinct + self.number[at + k]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        return at[first], count

    def words(self, at: np.ndarray) -> pa.Array:
        offsets, letters = ragged_bytes(self.data, self.starts[at], self.ends[at])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(letters)).cast(pa.string())

    def languages(self, at: np.ndarray) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(self.lang[at], pa.int32()), pa.array(self.langs, pa.string())).cast(pa.string())


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[Counted]:
    """Blocks of rows (``lang, text``) with their words; a very long text is a block of its own."""
    for batch in batches:
        whole, offsets = text_block(batch.column("text"))
        named = batch.column("lang").dictionary_encode()
        for a, b in blocks(whole, offsets, BLOCK):
            data, edges = lowered(whole[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            hashes, starts, ends, bounds = word_hashes(data, edges, lower=False, are_word=_ARE_WORD)
            if not len(starts):
                continue
            row = np.repeat(np.arange(b - a), np.diff(bounds))
            breaks = np.cumsum(_BREAKS[data], dtype=np.int32)
            joined = (row[1:] == row[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1] - 1])
            at, letters = ragged_bytes(data, starts, ends)
            codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
            lang = named.indices.to_numpy()[a:b].astype(np.int64)[row]
            yield Counted(
                data, starts, ends, codes.indices.to_numpy().astype(np.int64), len(codes.dictionary), lang, named.dictionary.to_pylist(), hashes, joined
            )


def _has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    at = slots & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(slots: DataFrame) -> Broadcast:
    """Bits of the numbers in column ``slot``, of bounded size, on every executor; other numbers may share a bit."""
    slots = keep(slots, "phrase-slots")
    rows = slots.count()
    bits = 1 << min(max(16, (BITS_PER_ENTRY * max(rows, 1) - 1).bit_length()), MOST_BITS.bit_length() - 1)
    place = F.col("slot").bitwiseAND(F.lit(bits - 1)) + 1  # Spark's buckets of 32,768 bits begin at 1
    packed = slots.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in packed.collect():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return slots.sparkSession.sparkContext.broadcast(out)


def _words(texts: DataFrame) -> DataFrame:
    """``lang, word, f``: occurrences of every word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in counted(batches):
            at, f = c.grouped(c.runs(1), 1)
            yield pa.RecordBatch.from_arrays([c.languages(at), c.words(at), pa.array(f, pa.int64())], names=["lang", "word", "f"])

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _pair_slots(texts: DataFrame, least_count: int) -> DataFrame:
    """``slot`` of all pairs whose hash occurs often enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in counted(batches):
            slot, f = np.unique(c.slots()[c.runs(2)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(f, pa.int64())], names=["slot", "f"])

    return texts.mapInArrow(run, "slot long, f long").groupBy("slot").agg(F.sum("f").alias("f")).where(F.col("f") >= least_count).select("slot")


def _pairs(texts: DataFrame, often: Broadcast) -> DataFrame:
    """``lang, w1, w2, a, slot``: occurrences of the pairs whose hash is in a bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in counted(batches):
            slots, at = c.slots(), c.runs(2)
            at, f = c.grouped(at[_has(often.value, slots[at])], 2)
            columns = [c.languages(at), c.words(at), c.words(at + 1), pa.array(f, pa.int64()), pa.array(slots[at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "w1", "w2", "a", "slot"])

    found = texts.mapInArrow(run, "lang string, w1 string, w2 string, a long, slot long")
    return found.groupBy("lang", "w1", "w2").agg(F.sum("a").alias("a"), F.min("slot").alias("slot"))


def _triples(texts: DataFrame, often: Broadcast, starts: Broadcast, ends: Broadcast) -> DataFrame:
    """``lang, w1, w2, w3, a`` of phrases of two frequent pairs that begin or end in a node of the frontier."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in counted(batches):
            slots, at = c.slots(), c.runs(3)
            fits = _has(often.value, slots)
            at = at[fits[at] & fits[at + 1]]
            at = at[_has(starts.value, slots[at]) | _has(ends.value, slots[at + 1])]
            at, f = c.grouped(at, 3)
            columns = [c.languages(at), c.words(at), c.words(at + 1), c.words(at + 2), pa.array(f, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "w1", "w2", "w3", "a"])

    found = texts.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, a long")
    return found.groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a"))


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(15,0)")


def _score(a: str, left: str, right: str) -> Column:
    """Exact score of a cut; products have up to 37 digits."""
    return F.call_function("div", _wide(a) * _wide(a) * F.lit(SCALE), _wide(left) * _wide(right))


def _threshold(values: DataFrame, wanted: Column) -> DataFrame:
    """``lang, least, enough``: highest value that ``wanted`` rows of a language reach; 0 where rows are too few.

    ``values`` has ``lang, value``.  The window runs over at most ``SCALE + 1`` different values of a language.
    """
    counted = values.groupBy("lang", "value").agg(F.count(F.lit(1)).alias("rows"))
    above = F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("value")))
    reached = counted.withColumn("above", above).withColumn("fits", F.col("above") >= wanted)
    return reached.groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("fits"), F.col("value"))), F.lit(0)).alias("least"), F.max("fits").alias("enough")
    )


def _nodes(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, w1, w2, slot, a, l, r, bound, score`` of pairs that occur often enough."""
    found = pairs.join(words.select("lang", F.col("word").alias("w1"), F.col("f").alias("l")), ["lang", "w1"])
    found = found.join(words.select("lang", F.col("word").alias("w2"), F.col("f").alias("r")), ["lang", "w2"])
    bound = F.call_function("div", _wide("a") * F.lit(SCALE), _wide("l"))
    return found.select("lang", "w1", "w2", "slot", "a", "l", "r", bound.alias("bound"), _score("a", "l", "r").alias("score"))


def _grown(texts: DataFrame, often: Broadcast, nodes: DataFrame, steps: DataFrame, least_count: int) -> DataFrame:
    """``lang, w1, w2, w3, a``: phrases that extend the nodes between a language's old and new threshold.

    ``steps`` has ``lang, least, before``: nodes with ``least <= bound < before`` grow to the right, and those whose score
    lies in that range to the left.
    """
    met = nodes.join(steps, "lang")
    starts = met.where((F.col("bound") >= F.col("least")) & (F.col("bound") < F.col("before"))).select("slot")
    ends = met.where((F.col("score") >= F.col("least")) & (F.col("score") < F.col("before"))).select("slot")
    return _triples(texts, often, _bitmap(starts), _bitmap(ends)).where(F.col("a") >= least_count)


def _scored(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of three-word phrases at their lowest-scoring cut."""
    first = nodes.select("lang", "w1", "w2", F.col("a").alias("front"), F.col("l").alias("head"))
    last = nodes.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("back"), F.col("r").alias("tail"))
    both = triples.join(first, ["lang", "w1", "w2"]).join(last, ["lang", "w2", "w3"])
    one, two = _score("a", "head", "back"), _score("a", "front", "tail")
    cut = both.withColumn("one", one).withColumn("two", two)
    pick = lambda x, y: F.when(F.col("one") <= F.col("two"), F.col(x)).otherwise(F.col(y))
    return cut.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("head", "front").alias("l"), pick("back", "tail").alias("r"),
        F.least("one", "two").alias("score"),
    )


def _survivors(nodes: DataFrame, triples: DataFrame, state: DataFrame, share: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of all phrases whose fate the expanded nodes decide.

    A pair is swallowed by a longer phrase that occurs in at least ``share`` percent of its places.
    """
    inside = triples.select("lang", "w1", "w2", F.col("a").alias("longer")).unionByName(
        triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("longer"))
    )
    inside = inside.groupBy("lang", "w1", "w2").agg(F.max("longer").alias("longer"))
    known = nodes.join(state.select("lang", "least"), "lang").where(F.col("score") >= F.col("least"))
    stay = known.join(inside, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    pairs = stay.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
    return pairs.unionByName(_scored(triples, nodes))


def collocations(
    docs: DataFrame, top: int = 2_000, least_count: int = 10, share: int = 50, text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at blanks and tabs into words; a null
    text has no words, a null language is ``und``.  ``n`` counts all words of a language, ``a`` the places of the phrase
    within pieces, ``l`` and ``r`` those of its parts at the lowest-scoring cut (of equal scores the first cut).  Phrases
    have two or three words and ``least_count`` places or more; a pair inside a three-word phrase with at least ``share``
    percent of its places is dropped.  Order: score and ``a`` descending, then the phrase by bytes.  Repeated rows count as
    often as they occur; an empty table, and a language without such phrases, gives no rows.  Other columns are not read.
    """
    named = F.coalesce(F.col(lang_column), F.lit("und")).alias("lang")
    texts = spread(docs.select(named, text_bytes(text_column).alias("text")))
    words = keep(_words(texts), "phrase-words")
    often = _bitmap(_pair_slots(texts, least_count))
    pairs = _pairs(texts, often).where(F.col("a") >= least_count)
    nodes = keep(_nodes(pairs, words.where(F.col("f") >= least_count)), "phrase-nodes")
    bounds = nodes.select("lang", F.col("bound").alias("value"))

    wanted = FIRST * top
    first = _threshold(bounds, F.lit(wanted))
    state = keep(first.select("lang", "least", F.lit(SCALE + 1).cast("long").alias("before"), F.lit(False).alias("done")), "phrase-state")
    triples = None
    while True:
        fresh = _grown(texts, often, nodes, state.where("not done").select("lang", "least", "before"), least_count)
        triples = keep(fresh if triples is None else triples.unionByName(fresh).distinct(), "phrase-triples")
        found = keep(_survivors(nodes, triples, state, share), "phrase-found")
        reached = _threshold(found.select("lang", F.col("score").alias("value")), F.lit(top))
        now = state.join(reached.select("lang", F.col("least").alias("floor"), "enough"), "lang", "left")
        enough = F.coalesce("enough", F.lit(False))
        now = now.withColumn("settled", F.col("done") | (F.col("least") == 0) | (enough & (F.col("floor") >= F.col("least"))))
        now = keep(now.withColumn("enough", enough), "phrase-step")
        if now.where("not settled").isEmpty():
            break
        wanted *= GROWTH
        deeper = _threshold(bounds, F.lit(wanted)).select("lang", F.col("least").alias("deeper"))
        # with enough survivors the floor is final: all that can still matter reaches it
        following = F.when(F.col("settled"), F.col("least")).when(F.col("enough"), F.col("floor")).otherwise(F.col("deeper"))
        state = keep(
            now.join(deeper, "lang").select("lang", following.alias("least"), F.col("least").alias("before"), F.col("settled").alias("done")),
            "phrase-state",
        )

    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op12_collocations", SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
