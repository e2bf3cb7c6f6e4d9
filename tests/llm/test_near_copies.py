"""MinHash components, links inside blocks and collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_ops import corpus, shingle_set

from kinweave.llm import op8_jaccard
from kinweave.llm.near_copies import links_between, overlaps
from kinweave.llm.op12_collocations import collocations
from kinweave.llm.op13_minhash import band_keys, donor_order, minhash_components, signatures
from kinweave.llm.store import keep
from kinweave.llm.words import shingles, word_hashes


def labels(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def plain_components(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]

    def linked(i, j):
        common = len(sets[i] & sets[j])
        return common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common)

    label = labels(len(rows), linked)
    members = defaultdict(list)
    for k, x in enumerate(label):
        members[x].append(rows[k][0])
    least = {x: min((d for d in m if d is not None), default=None) for x, m in members.items()}
    return Counter((rows[k][0], len(sets[k]), least[label[k]]) for k in range(len(rows)))


def crowd(rng, copies, changed, words=120):
    """Near copies of one text: each has some words of its own."""
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for k in range(copies):
        mine = list(base)
        for at in rng.sample(range(words), changed):
            mine[at] = f"own{rng.randrange(30)}"
        out.append(" ".join(mine))
    return out


def test_minhash_components(stored):
    rng = random.Random(2)
    rows = corpus(11) + [(2000 + k, t) for k, t in enumerate(crowd(rng, 40, 3) + crowd(rng, 40, 2) + crowd(rng, 30, 1, 30))]
    rows += [(3000, "Word"), (3001, "word"), (3002, "one TWO"), (3003, "long " * 60_000), (None, None)]
    rng.shuffle(rows)
    got = minhash_components(stored(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, 3, 85)
    groups = defaultdict(list)
    for r in got:
        groups[r.component].append(r)
    for component, members in groups.items():
        assert component is None or sum(r.kept for r in members) == 1
    assert all(r.kept for r in groups[None]) and all(r.doc_id == r.component_id for r in got if r.kept)
    assert minhash_components(stored(rows).where("doc_id < 0")).count() == 0


def test_pairs_at_the_threshold_share_a_band():
    rng, order, missed = np.random.default_rng(4), donor_order(160), 0
    for size in (7, 40, 400):
        for _ in range(200):
            pool = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            apart = size - int(np.ceil(0.85 * size))
            one, two = pool[apart // 2 :], np.concatenate([pool[: size - apart + apart // 2]])
            keys = band_keys(signatures(np.concatenate([one, two]), np.array([len(one), len(two)]), order), 32)
            missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_densified_bins_estimate_similarity():
    rng, order = np.random.default_rng(5), donor_order(160)
    for size, share in ((12, 0.5), (60, 0.8), (2_000, 0.3)):
        equal = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            common = int(size * share)
            half = (size - common) // 2
            one, two = pool[: common + half], np.concatenate([pool[:common], pool[common + half :]])
            lines = signatures(np.concatenate([one, two]), np.array([len(one), len(two)]), order)
            equal.append((lines[0] == lines[1]).mean())
        assert abs(np.mean(equal) - common / size) < 0.06


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 12), min_size=1), min_size=2, max_size=12), st.booleans(), st.randoms(use_true_random=False))
def test_links_between_join_what_links(sets, halves, rng):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    apart = ~np.eye(len(sets), dtype=bool)
    assert (overlaps(arrays) == [[len(a & b) for b in sets] for a in sets])[apart].all()
    component = np.array([rng.randrange(len(sets)) for _ in sets])
    side = np.array([rng.randrange(2) for _ in sets]) if halves else None
    linked = lambda i, j: (not halves or side[i] != side[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    found = links_between(arrays, component, side, 80)
    assert all(linked(i, j) for i, j in found) and len(found) < len(sets)
    same = lambda i, j: component[i] == component[j]
    assert labels(len(sets), lambda i, j: same(i, j) or (i, j) in found or (j, i) in found) == labels(len(sets), lambda i, j: same(i, j) or linked(i, j))


def test_a_crowd_below_the_threshold_emits_no_rows():
    rng = random.Random(9)
    sets = []
    for t in crowd(rng, 1_500, 9):
        data = np.frombuffer(t.encode(), np.uint8)
        words, _, _, bounds = word_hashes(data, np.array([0, len(data)]), lower=True)
        sets.append(next(shingles(words, bounds, 5)))
    common = overlaps(sets)
    size = np.array([len(s) for s in sets])
    union = size[:, None] + size - common
    links = int((np.triu(100 * common >= 80 * union, 1)).sum())
    assert len(links_between(sets, np.arange(len(sets)), None, 80)) <= min(links, len(sets) - 1)


def test_jaccard_texts_travel_only_with_possible_partners(stored, monkeypatch):
    """Long unrelated texts that share a passage look alike in coarse vectors; their blocks must not hold their texts."""
    rng, carried = random.Random(12), []
    passages = [" ".join(f"p{g}-{k}" for k in range(150)) for g in range(6)]  # each in too few texts to count as frequent
    rows = [(k, passages[k % 6] + "".join(f" w{rng.randrange(10**9)}" for _ in range(550 + k))) for k in range(42)]
    rows += [(100 + k, t) for k, t in enumerate(crowd(rng, 30, 3))]
    work = op8_jaccard.block_links

    def seen(members, texts, n, percent):
        carried.extend(r.node for r in members.select("node").distinct().collect())
        assert texts.count() == len(carried)
        return work(members, texts, n, percent)

    monkeypatch.setattr(op8_jaccard, "block_links", seen)
    docs = stored(rows)
    got = op8_jaccard.jaccard_components(docs, 5, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, 5, 80)
    long = {r.row for r in got if r.n_shingles > 500}
    assert len(long) == 42 and not long & set(carried)


def test_vectors_are_counted_beyond_the_width_they_are_stored_in():
    s = np.arange(0, 16 * 1_000, 16, dtype=np.uint64)  # all in one group of 16
    narrow, wide = (op8_jaccard._vector(op8_jaccard._stored(op8_jaccard.counted(x, op8_jaccard.COARSE))) for x in (s[:250], s))
    assert narrow.dtype == np.uint8 and op8_jaccard.folded(np.concatenate([narrow] * 4), 16).sum() == 1_000
    assert op8_jaccard.reachable(wide, wide, 90) and not op8_jaccard.reachable(narrow, wide, 90)


def plain_collocations(rows, top, least_count, share):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least_count}
        gone = {q for p, b in cand.items() if len(p) == 3 for q in (p[:2], p[1:]) if q in cand and 100 * b >= share * cand[q]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        scored.sort()
        out += [(lang, k + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for k, x in enumerate(scored[:top])]
    return sorted(out)


def test_collocations(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(12)] + ["É", "x\xa0y", "zz"]
    rows = []
    for k in range(150):
        parts = [rng.choice(words) if rng.random() < 0.6 else rng.choice(["new york city", "New York", "ab cd", "q r s t"]) for _ in range(rng.randint(0, 25))]
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), "".join(p + rng.choice([" ", " ", "\t", ". ", "\n", ", "]) for p in parts)))
    rows += [("en", None), (None, ""), ("fr", " . , "), ("it", "once only"), *[("en", "same row here")] * 30, ("xx", "long text " * 30_000)]
    docs = keep(spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "lang string, text string, rank int, w1 string").coalesce(3), "t")
    for top, least_count in ((2_000, 10), (5, 2), (1, 3)):
        got = sorted(tuple(r) for r in collocations(docs, top, least_count).collect())
        assert got == plain_collocations(rows, top, least_count, 50)
    assert collocations(docs.where("rank > 1")).count() == 0
