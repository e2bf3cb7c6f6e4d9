"""Repeats, near copies, token files, quality and decontamination against brute force, on small hostile tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kinweave.llm.components import components
from kinweave.llm.op1_suffix_dedup import remove_repeats
from kinweave.llm.op2_token_planes import PieceEncoder, from_planes, joined_crc32, read_token_files, to_planes, write_token_files
from kinweave.llm.op5_quality import FEATURES, document_statistics, fit_trees, held_out, keep_good, quality, statistics
from kinweave.llm.op6_phrases import remove_phrases
from kinweave.llm.op7_exact_dedup import drop_copies
from kinweave.llm.op8_jaccard import CountTree, drop_near_copies, jaccard_components, least_overlap
from kinweave.llm.op10_decontamination import common_subsequence, drop_leaks, latent_basis, leaks
from kinweave.llm.passages import merge_by_search
from kinweave.llm.store import new_folder, table
from kinweave.llm.suffixes import common_prefixes, repeated_windows, suffix_array
from kinweave.llm.words import ARE_PLAIN, text_block, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def corpus(seed=5, n=120):
    """Documents with shared passages, copies, near copies, hot repeats, nulls, empty and odd texts."""
    rng = random.Random(seed)
    words = ["the", "of", "and"] * 3 + ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.choice([15, 25, 60])) for _ in range(4)]
    rows = []
    for k in range(n):
        parts = [text(rng.randint(0, 50))]
        if k % 3 == 0:
            parts += [rng.choice(shared), text(rng.randint(0, 30))]
        if k % 10 == 0:
            parts += [shared[0], shared[0]]
        rows.append((k, rng.choice([" ", "\n", "  \t"]).join(parts)))
    for k in range(n, n + 25):
        w = rows[rng.randrange(n)][1].split()
        if w and k % 2:
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "é" * 150), (904, "é" * 149 + "x"), (905, "ab " * 200), (906, "ab " * 200)]
    rows += [(907, rows[3][1]), (907, rows[3][1]), (None, rows[6][1]), (908, " ".join(["nb"] * 40)), (909, "one two")]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    return sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0]))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_bytes(stored, hot):
    rows = corpus()
    seen, want = set(), Counter()
    for _, (doc, text) in in_order(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
            seen.add(b[k : k + 50])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want[doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    docs = stored(rows)
    got = remove_repeats(docs, window=50, gram=16, hot=hot)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    if hot > 1:
        assert remove_repeats(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_phrases(stored, hot):
    rows = corpus(6)
    seen, want = set(), Counter()
    for _, (doc, text) in in_order(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    docs = stored(rows)
    got = remove_phrases(docs, hot=hot)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    if hot > 1:
        assert remove_phrases(docs.where("doc_id < 0")).count() == 0


@given(st.text("a\0b", max_size=80).map(str.encode), st.integers(1, 3))
def test_suffix_array_and_prefixes(text, times):
    data = np.frombuffer(text * times, np.uint8)
    order = suffix_array(data, 512)
    assert sorted(order) == list(range(len(data)))
    full = text * times
    assert [full[k:] for k in order] == sorted(full[k:] for k in range(len(full)))
    shared = common_prefixes(data, order, 512)
    for k in range(1, len(order)):
        a, b = full[order[k - 1] :], full[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == n


@given(st.lists(st.integers(0, 2), max_size=120), st.integers(3, 9))
def test_repeated_windows_by_brute_force(values, window):
    text = bytes(values)
    starts = np.zeros(len(text), bool)
    starts[: max(len(text) - window + 1, 0)] = True
    seen, want = set(), []
    for k in range(len(text) - window + 1):
        want.append(text[k : k + window] in seen)
        seen.add(text[k : k + window])
    assert repeated_windows(np.frombuffer(text, np.uint8), starts, window)[: len(want)].tolist() == want


@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=7))
def test_merge_by_search_sorts(runs):
    runs = [np.sort(np.array(r, np.int64)) for r in runs]
    flat = np.concatenate([*runs, np.zeros(0, np.int64)])
    assert flat[merge_by_search(runs)].tolist() == sorted(flat.tolist())


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(stored, n, percent):
    rows = corpus(7)
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[root(k)].append(rows[k][0])
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    want = Counter((rows[k][0], len(sets[k]), least[root(k)]) for k in range(len(rows)))
    docs = stored(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, n, percent).collect()) == want
    kept = drop_near_copies(docs, n, percent)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least[r] if sets[r] else rows[r][0] for r in members)
    assert jaccard_components(docs.where("doc_id < 0"), n, percent).count() == 0


@given(st.lists(st.lists(st.integers(0, 9), min_size=16, max_size=16), min_size=1, max_size=60), st.sampled_from([50, 80, 90]))
def test_count_tree_finds_all_that_the_bound_allows(points, percent):
    points = np.array(points)
    tree = CountTree(points)
    for p in points[:5]:
        sizes = points.sum(axis=1)
        bound = np.minimum(points, p).sum(axis=1)
        want = np.flatnonzero((bound >= least_overlap(int(p.sum()), sizes, percent)) & (100 * sizes >= percent * p.sum()) & (100 * p.sum() >= percent * sizes))
        assert set(want) <= set(tree.search(p, percent).tolist())


def test_components_of_chains_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200, 202: 200, 299: 299, 300: 299}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("scheme", ["byte", "bit"])
def test_planes_round_trip(scheme):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        for top in (1, 2, 50_257, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            assert from_planes(to_planes(ids, scheme), n, scheme).tolist() == ids.tolist()


@given(st.binary(max_size=60), st.binary(max_size=60))
def test_joined_crc(a, b):
    assert joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("scheme", ["byte", "bit"])
def test_token_files(spark, stored, scheme):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus(8, 40) + [(950, "it's   <|endoftext|> 12ab!?'ll\x0b\x1c  日本 \r\n\r\n x"), (951, "word " * 3_000)]
    docs, folder = stored(rows), new_folder(spark, "tokens")
    write_token_files(docs, folder, path, scheme=scheme, block_ids=256)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, folder).collect()))
    encode = Tokenizer.from_file(path).encode
    known = sorted((d is not None, d or 0, t or "") for d, t in rows)
    at = 0
    for g, (some, doc, text) in zip(got, known, strict=True):
        ids = np.array([*encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert g == (some, doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = new_folder(spark, "tokens")
    write_token_files(docs.where("doc_id < 0"), empty, path)
    assert read_token_files(spark, empty).count() == 0


def test_piece_encoder_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    parts = "a|B|'s|'t|'| |  |\n|\t|\r|1|23|,|!!|é|ß| | |“|😀|\x0b|\x1c|\x85|日本|<|endoftext|>|'ll|́|٣|ª|²|<|endoftext|>".split("|")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + ["<|endoftext|>", "a<|endoftext|> b"]
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    data, offsets = text_block(pa.array(texts))
    ids, counts = PieceEncoder(path).encode(data, offsets)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def alike(letters: int) -> tuple[str, str]:
    """Two words that a polynomial modulo a power of two cannot tell apart, whatever its base."""
    bits = [bin(k).count("1") % 2 for k in range(letters)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_under_polynomials():
    words = [w for n in (16, 64, 256, 1_024, 2_048, 4_096) for w in alike(n)]
    hashes = word_hashes(*text_block(pa.array(words)), lower=True)[0]
    assert len(set(hashes.tolist())) == len(words)
    long = "x" * 24 + " " + "x" * 25 + " "  # either side of the border, at any place and in any block
    assert len(set(word_hashes(*text_block(pa.array([long * 3, long])), lower=False)[0].tolist())) == 2


def test_documents_of_colliding_words_stay_apart(stored):
    a, b = alike(1_024)
    docs = stored([(1, f"{a} x y z"), (2, f"{b} x y z"), (3, f"{a} " * 25), (4, f"{b} " * 25), (5, f"{a} x y z")])
    assert [r.component_id for r in jaccard_components(docs, 3, 90).orderBy("doc_id").collect()] == [1, 2, 3, 4, 1]
    assert [r.n_removed for r in remove_phrases(docs).orderBy("doc_id").collect()] == [0, 0, 24, 24, 0]


@pytest.mark.parametrize("bits", [64, 8, 0])
@pytest.mark.parametrize("most", [1 << 19, 50])
def test_pieces_are_compared_by_their_bytes(monkeypatch, bits, most):
    """With hashes of a few bits most pieces meet another's hash; the cache is emptied again and again."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from kinweave.llm import op2_token_planes as op2

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcé1!") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["", *alike(1_024), *alike(2_048), " ".join(alike(1_024) * 2)]
    whole = op2.span_hashes
    if bits < 64:
        monkeypatch.setattr(op2, "span_hashes", lambda *x: whole(*x) % np.uint64(1 << bits) + np.uint64(1))
    monkeypatch.setattr(op2, "MOST_PIECES", most)
    monkeypatch.setattr(op2, "CACHE_PIECES", 4_000 if most > 50 else 200)
    tool = op2.PieceEncoder(path)
    for _ in range(2):
        ids, counts = tool.encode(*text_block(pa.array(texts)))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(truth[d], got[d].predicted) for d in truth if got[d].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.97 * len(held)
    good = {r.doc_id for r in keep_good(docs, labels).collect()}
    assert good == {d for d, r in got.items() if r.predicted}


def test_quality_of_odd_inputs(spark, stored):
    docs = stored(corpus(9, 30))
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality(docs, none).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1
    assert keep_good(docs, none).columns == docs.columns and keep_good(docs, none).count() == docs.count()
    assert quality(docs.where("doc_id < 0"), none).count() == 0
    assert spark.range(1).select(held_out("id").alias("h")).first().h == (zlib.crc32(b"0") % 5 == 0)


def test_statistics_do_not_depend_on_the_block():
    texts = [t or "" for _, t in corpus(3, 40)]
    whole = statistics(*text_block(pa.array(texts)))
    assert whole.shape == (len(texts), len(FEATURES))
    for k, t in enumerate(texts):
        assert np.allclose(statistics(*text_block(pa.array([t])))[0], whole[k])


def test_trees_learn_and_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    model = fit_trees(x[:2000], y[:2000], trees=20)
    score = model.score(x)
    assert ((score[2000:] > 0.5) == y[2000:]).mean() > 0.97
    for i in range(20):
        total = model.start
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[i, f[node]] > c[node] else 1)
            total += leaf[node - len(f)]
        assert np.isclose(score[i], 1 / (1 + np.exp(-total)))


@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert common_subsequence(a, b) == best[-1][-1]


def test_leaks_are_found_and_clean_documents_left(spark, stored):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioustrnlmk") for _ in range(rng.randint(3, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    items = [(k, ". ".join([text(n // 2), text(n - n // 2)]) + ".") for k, n in enumerate([16, 20, 30, 40, 50, 55, 150])]
    rows = [(k, text(rng.randint(0, 300))) for k in range(60)]
    planted = set()
    for k, (item, t) in enumerate(items):
        rows.append((100 + k, f"{text(rng.randint(0, 200))} {t} {text(rng.randint(0, 90))}"))
        rows.append((200 + k, f"{text(40)}\n{t.upper().replace('.', ' -')}"))
        w = t.split()
        w[1] = "other"  # a word changed, the answer kept
        rows.append((300 + k, " ".join(w)))
        planted |= {(100 + k, item), (200 + k, item), (300 + k, item)}
    rows += [(400, None), (401, ""), (None, "x " + items[2][1])]
    docs = stored(rows)
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (3, items[3][1])], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in leaks(docs, bench).collect())
    assert set(got) == planted | {(None, 2)} and set(got.values()) == {1}
    left = drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([*range(60), 400, 401])
    assert leaks(docs.where("doc_id < 0"), bench).count() == 0
    assert leaks(docs, bench.where("item_id < 0")).count() == 0


def test_candidate_recall_against_brute_force(spark):
    """Windows that hold most of a passage, by exact comparison, are candidates of the latent search."""
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in (r.text or "")}
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert len(want) > 10 and len(want & got) >= 0.9 * len(want)
    assert got <= want  # the table holds verbatim passages only


def test_every_verbatim_item_of_200_is_found(spark):
    docs, bench = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for i, t in items.items() if t in (r.text or "")}
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert len(items) == 200 and len(want) > 200 and want <= got


def planted_items(n, seed):
    """Items of ordinary words, and documents that hold some of them whole and some with words changed before the answer."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustrnlmk") for _ in range(rng.randint(3, 9))) for _ in range(3_000)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(k, f"{text(30)}. {text(10)}.") for k in range(n)]
    rows, planted = [(k, text(200)) for k in range(50)], set()
    for k, (item, t) in enumerate(rng.sample(items, 120)):
        w = t.split()
        if k % 2:
            for at in rng.sample(range(29), 6):
                w[at] = "other"
        rows.append((1_000 + k, f"{text(rng.randint(0, 90))} {' '.join(w)} {text(rng.randint(0, 90))}"))
        planted.add((1_000 + k, item))
    return items, rows, planted


@pytest.mark.parametrize("n", [300, 4_500])
def test_recall_does_not_fall_with_the_size_of_the_benchmark(spark, stored, n):
    items, rows, planted = planted_items(n, 17)
    got = {(r.doc_id, r.item_id) for r in leaks(stored(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == planted


@pytest.mark.parametrize("frequent", [False, True])
def test_items_of_one_to_fifteen_words_are_found(spark, stored, frequent):
    rng = random.Random(23)
    vocabulary = ["".join(rng.choice("aeioustrnlmk") for _ in range(rng.randint(4, 9))) for _ in range(4_000)]
    pick = lambda: vocabulary[int(len(vocabulary) * rng.random() ** 3)]
    items, rows = [], []
    for n in range(1, 16):
        for k in range(8):
            words = [pick() if frequent and n > 1 else rng.choice(vocabulary) for _ in range(n)]
            items.append((100 * n + k, words))
            rows.append((100 * n + k, [pick() for _ in range(rng.randint(0, 60))] + words + [pick() for _ in range(rng.randint(0, 60))]))
    rows += [(10_000 + k, [pick() for _ in range(rng.randint(0, 120))]) for k in range(100)]
    holds = lambda all_, part: any(all_[i : i + len(part)] == part for i in range(len(all_) - len(part) + 1))
    want = {(d, i) for d, w in rows for i, part in items if holds(w, part)}
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(stored([(d, " ".join(w)) for d, w in rows]), bench).collect()}
    size = {i: len(p) for i, p in items}
    assert {x for x in got if size[x[1]] < 8} <= want  # short items leak word for word only
    for n in range(1, 16):
        mine = {x for x in want if size[x[1]] == n}
        assert len(mine) >= 8 and len(mine & got) >= 0.9 * len(mine), n


def test_rows_are_dropped_one_by_one(spark, stored):
    """A clean row stays although a leak has its doc_id, or no id either."""
    rng = random.Random(29)
    text = lambda k: " ".join("".join(rng.choice("aeioustrnlmk") for _ in range(6)) for _ in range(k))
    item = text(30)
    rows = [(1, f"{text(20)} {item}"), (1, text(40)), (None, item), (None, text(30)), (2, None), (2, "")]
    left = drop_leaks(stored(rows), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted((d or 0, t or "") for d, t in (rows[1], rows[3], rows[4], rows[5]))


def test_a_latent_space_keeps_every_passage_whole():
    rng = np.random.default_rng(3)
    rows = [(f := np.unique(rng.integers(0, 1 << 16, 60)), rng.uniform(0.1, 9, len(f))) for _ in range(150)]
    rows += [rows[0], (rows[1][0], 2 * rows[1][1]), (rows[2][0][:1], np.ones(1) * 0.01)]
    features, basis = latent_basis(rows)
    for f, w in rows:
        assert np.linalg.norm(w @ basis[np.searchsorted(features, f)]) == pytest.approx(np.linalg.norm(w), rel=1e-6)


def test_rows_keep_their_numbers_when_files_are_split_anew(spark, stored):
    """A lost core changes Spark's file splits between two jobs: what is dropped must not change with them."""
    rows = corpus()
    docs, texts = stored(rows), [t or "" for _, t in rows]
    copies, near, repeats = drop_copies(docs), drop_near_copies(docs, 5, 80), remove_repeats(docs, 30, 8)
    want = [sorted(map(str, f.collect())) for f in (copies, near, repeats)]
    copies, near, repeats = drop_copies(docs), drop_near_copies(docs, 5, 80), remove_repeats(docs, 30, 8)
    conf = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    parts = docs.rdd.getNumPartitions()
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert docs.where("true").rdd.getNumPartitions() != parts
        got = [sorted(map(str, f.collect())) for f in (copies, near, repeats)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want
    assert len({t.lower() for t in texts}) == len(want[0])


def test_tables_that_are_not_stored_are_stored_first(spark):
    rows = [(k, t) for k, t in corpus() if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert drop_copies(docs.unionByName(docs)).count() == len({t.lower() for _, t in rows})
