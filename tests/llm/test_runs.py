"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm.op11_periodic_runs import periodic_runs, runs
from kinweave.llm.store import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """All maximal stretches by trying every period and place."""
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q):
                stretch = words[i : i + length]
                if not any(all(stretch[x] == stretch[x + p] for x in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found)


def plain(doc_id, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def answers(docs, plant):
    rows = periodic_runs(docs, plant=plant).collect()
    for r in rows:
        assert hashlib.sha256(r.collapsed).hexdigest() == r.collapsed_sha256 and len(r.runs) == r.n_runs
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9)), max_size=6))
def test_runs_of_small_alphabets(parts):
    rows = [[x for part, k in parts[:cut] for x in part * k] for cut in (len(parts), len(parts) // 2, 0)]
    bounds = np.cumsum([0, *map(len, rows)])
    start, length, period = runs(np.array([x for r in rows for x in r], np.int64), bounds)
    want = [(s + b, m, q) for b, r in zip(bounds.tolist(), rows) for s, m, q in plain_runs(r)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def hostile():
    rng = random.Random(3)
    unit = lambda k: [rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(k)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 24), (5, "x " * 23), (None, "a b " * 30), (6, "a b " * 12), (6, "a b " * 12)]
    for k in range(7, 60):
        u, v = unit(rng.randint(1, 45)), unit(rng.randint(1, 20))
        words = unit(rng.randint(0, 20)) + u * rng.randint(1, 6) + u[: rng.randint(0, len(u))] + v * rng.randint(1, 12) + unit(5)
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(words)))
    # fibonacci words: many runs of many periods over each other
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    rows.append((90, " ".join(b)))
    rows.append((91, "é " * 40 + "  " * 30))
    return rows


def test_hostile_rows(stored):
    rows = hostile()
    for plant in (False, True):
        assert answers(stored(rows), plant) == sorted((plain(d, t, plant) for d, t in rows), key=str)


def test_long_text_and_empty_table(stored):
    long = [(10, "same " * 200_000), (11, " ".join(f"w{i % 50_000}" for i in range(200_000)))]
    got = {r.doc_id: r for r in periodic_runs(stored(long)).collect()}
    assert (got[10].n_runs, got[10].length, got[10].period, bytes(got[10].collapsed)) == (1, 200_000, 1, b"same")
    assert (got[11].n_runs, got[11].length, got[11].period) == (1, 200_000, 50_000)
    assert periodic_runs(stored(long).where("doc_id < 0")).count() == 0


def test_planted_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("n_chars < 6000")
    want = sorted((plain(r.doc_id, r.text, True) for r in docs.collect()), key=str)
    assert answers(docs, True) == want and any(r[1] for r in want)
