"""Exact dedup, sharding, packing and chat assembly: brute force, laws, round trips and odd inputs."""

import hashlib
import random
import zlib

from hypothesis import given
from hypothesis import strategies as st

from kinweave.llm.op3_packing import best_fit, pack
from kinweave.llm.op4_chat import CONTROL, assemble, digests, escape, unescape
from kinweave.llm.op7_exact_dedup import CuckooIndex, drop_copies, exact_dedup
from kinweave.llm.op9_sharding import external_shuffle, fisher_yates
from kinweave.llm.store import new_folder

ODD = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (7, "äB"), (7, "äB"), (None, "same TEXT"), (8, "long " * 50_000)]


def test_exact_dedup_keeps_the_largest_id(stored):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(stored(ODD)).collect()), key=str)
    groups = {"same text": [1, 2, None], "": [3, 4], "Äb": [5], "äb": [6, 7, 7], "long": [8]}
    for ids in groups.values():
        rows = [g for g in got if g[0] in ids]
        keep = max(i for i in ids if i is not None)
        assert len(rows) == len(ids) and {r[1] for r in rows} == {keep} and {r[2] for r in rows} == {len(ids)}
        assert sum(r[3] for r in rows) == 1
    digest = {r.doc_id: r.text_sha256 for r in exact_dedup(stored(ODD)).collect()}
    assert digest[1] == hashlib.sha256(b"same text").hexdigest() and digest[3] == hashlib.sha256(b"").hexdigest()


def test_drop_copies_keeps_columns_and_one_row_per_text(stored):
    docs = stored(ODD)
    out = drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 7, 8]


def test_empty_table(stored):
    none = stored(ODD).where("doc_id < 0")
    assert exact_dedup(none).count() == 0 and drop_copies(none).count() == 0


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 400)), max_size=600))
def test_cuckoo_index_is_a_map(steps):
    index, want = CuckooIndex(buckets=1), {}
    for add, k in steps:
        digest = hashlib.sha256(str(k).encode()).digest()
        if add and digest not in want:
            index.insert(digest, k)
            want[digest] = k
        elif not add and digest in want:
            assert index.delete(digest) == want.pop(digest)
        assert index.get(digest) == want.get(digest)
    assert dict(index.items()) == want and len(index) == len(want)
    assert all(index.get(d) == v for d, v in want.items())


def test_cuckoo_index_grows_past_its_first_size():
    index = CuckooIndex(buckets=2)
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(5_000)]
    for k, d in enumerate(digests):
        index.insert(d, k)
    assert [index.get(d) for d in digests] == list(range(5_000))


def test_sharding_laws(spark, stored):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(0, 300)) for k in range(400)] + [(9, None), (9, "x"), (None, "y")]
    docs = stored(rows)
    out = external_shuffle(docs, new_folder(spark, "t"), shards=5, bucket_bytes=4_000)
    got = out.collect()
    assert sorted((r.record.doc_id is None, r.record.doc_id or 0, r.record.text or "") for r in got) == sorted((d is None, d or 0, t or "") for d, t in rows)
    shard = {}
    for r in got:
        text = (r.record.text or "").encode()
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
        assert shard.setdefault(r.record.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 5)
    assert any(r.grown_shard == 5 for r in got)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    ids = [r.record.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.record.doc_id is not None]
    assert ids != sorted(ids)
    more = {r.record.doc_id: r.shard for r in external_shuffle(docs, new_folder(spark, "t"), shards=6).collect()}
    assert all(more[r.record.doc_id] == r.grown_shard for r in got)
    assert external_shuffle(docs.where("doc_id < 0"), new_folder(spark, "t")).count() == 0


def test_fisher_yates_is_a_seeded_permutation():
    assert sorted(fisher_yates(100, 1, 2)) == list(range(100))
    assert list(fisher_yates(100, 1, 2)) == list(fisher_yates(100, 1, 2)) != list(fisher_yates(100, 1, 3))


pieces = st.lists(st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(0, 6)), max_size=60)


@given(pieces)
def test_best_fit_takes_the_tightest_compatible_bin(items):
    items.sort(reverse=True)
    bins, offsets = best_fit(*([x[k] for x in items] for k in range(3)), capacity=20) if items else ([], [])
    state = []  # the same rule by a scan over all bins: [residual, sources, clusters, number]
    for (length, source, cluster), b, at in zip(items, bins, offsets):
        fit = [x for x in state if x[0] >= length and x[0] > 0 and source not in x[1] and cluster not in x[2]]
        best = min(fit, key=lambda x: (x[0], x[3]), default=None)
        if best is None:
            best = [20, set(), set(), len(state)]
            state.append(best)
        assert (b, at) == (best[3], 20 - best[0])
        best[0] -= length
        best[1].add(source)
        best[2].add(cluster)


def test_packing_places_every_piece_once(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 5, 90, 250, 1000, None]), rng.choice("abc"), rng.choice(["p", "q", None, str(k)])) for k in range(300)] + [(None, 3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, n long, source string, cluster string")
    got = pack(docs, "n", "source", "cluster", ["doc_id"], capacity=100, group_rows=64).collect()
    known = {d: (n or 0, s, c) for d, n, s, c in rows}
    held = {}
    for r in got:
        held.setdefault((r.bin_group, r.bin), []).append(r)
    for d, (n, _, _) in known.items():
        mine = sorted((r.piece_start, r.piece_length) for r in got if r.doc_id == d)
        assert sum(x for _, x in mine) == n and [a for a, _ in mine] == list(range(0, max(n, 1), 100))
    for some in held.values():
        assert sum(r.piece_length for r in some) <= 100
        assert len({known[r.doc_id][1] for r in some}) == len(some) == len({known[r.doc_id][2] for r in some})
        at = 0
        for r in sorted(some, key=lambda r: (r.bin_offset, r.piece_length)):
            assert r.bin_offset == at
            at += r.piece_length
    assert pack(docs.where("n < 0"), "n", "source", "cluster", ["doc_id"]).count() == 0


@given(st.lists(st.sampled_from([*CONTROL, "\\", "a", "<", "[", " ", "é"]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert unescape(escape(text)) == text
    for k, c in enumerate(escape(text)):
        for s in CONTROL:
            if escape(text).startswith(s, k):
                assert k and escape(text)[k - 1] == "\\"


def test_chat_round_trip_and_mask(spark):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\</s> déjà <|endoftext|>"), (1, 2, "user", None), (1, 3, "assistant", ""),
        (2, 0, "tool<s>", "x"), (3, 0, None, None), (None, 0, "user", "n"), (4, 1, "assistant", "b"), (4, 0, "assistant", "a"), (4, 1, "assistant", "b"),
        (5, 0, "assistant", "word " * 30_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = assemble(turns, path)
    got = {r.conv_id: r for r in digests(formatted, path).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for r in formatted.collect():
        assert len(r.ids) == len(r.loss_mask)
    starts = sorted((r.seq, r.start, len(r.ids)) for r in formatted.where("conv_id = 1").collect())
    assert [s for _, s, _ in starts] == [sum(n for _, _, n in starts[:k]) for k in range(len(starts))]
    assert digests(assemble(turns.where("conv_id < 0"), path), path).count() == 0
