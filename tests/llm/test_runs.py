import hashlib
import random
import zlib

import numpy as np
import pytest

from barloom.llm import runs
from barloom.llm.queries import QUERIES


def brute_runs(words):
    """(start, length, period) of all runs, by comparing the words with themselves at every distance."""
    best, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((i, length, q) for (i, length), q in best.items())


def brute_row(doc_id, words):
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *sha)


def spaced(text):
    return (text or "").encode().split()


def same(texts):
    for words, got in zip(texts, runs.runs_of_texts(texts), strict=True):
        assert [tuple(r) for r in got.tolist()] == brute_runs(words), words[:60]


def test_random_texts_of_few_words():
    rng = random.Random(1)
    same([[bytes([rng.randrange(k)]) for _ in range(rng.randrange(400))] for k in (1, 2, 2, 2, 3, 3, 4, 9) for _ in range(12)])


def test_repeated_blocks_of_every_period():
    rng = random.Random(2)
    texts = []
    for q in [*range(1, 120, 3), 200, 333, 512]:
        block = [rng.randrange(4) for _ in range(q)]
        ends = [[rng.randrange(4) for _ in range(rng.randrange(90))] for _ in "ab"]
        times = rng.choice([2, 2, 3, 5])
        words = ends[0] + block * times + block[: rng.randrange(q)] + ends[1]
        texts.append([b"%d" % w for w in words])
    same(texts)


def test_blocks_that_are_periodic_themselves():
    """Touching runs of one small period: squares whose halves are periodic, at every scale."""
    rng = random.Random(3)
    texts = []
    for p in (1, 2, 3, 5, 7, 16, 17):
        for a, b in ((60, 75), (200, 140), (330, 331), (97, 500)):
            root = list(range(p))
            shift = rng.randrange(p)
            left, right = (root * 600)[:a], (root * 600)[shift : shift + b]
            for words in (left + right, [99] + left + right + [98], left + right + left + right, (left + [77]) * 2 + right, left + left[:-1] + left):
                texts.append([b"%d" % w for w in words])
    same(texts)


def test_words_of_fibonacci_and_thue_morse():
    fib, other = b"a", b"ab"
    for _ in range(13):
        fib, other = other, other + fib
    morse = [bin(i).count("1") % 2 for i in range(700)]
    same([[bytes([c]) for c in fib], [b"%d" % m for m in morse], [b"x"] * 500, [b"x"] * 11, [b"x"] * 12, []])


def test_synchronising_sets_depend_on_context_alone_and_leave_no_gaps():
    rng = random.Random(4)
    words = [rng.randrange(3) for _ in range(500)] + [0, 1, 2] * 60 + [rng.randrange(3) for _ in range(200)]
    words += words[100:400]
    ids = np.array([*words, -1], np.int32)
    lengths = np.array([len(words)])
    hashes, found = runs._Hashes(ids, lengths), runs._small(ids)
    for t in (16, 32):
        at = set(runs.synchronising(hashes, t, hashes.prefix(6 * t - 2), found).tolist())
        told = {}
        for i in range(len(words) - 2 * t + 1):
            assert told.setdefault(tuple(words[i : i + 2 * t]), i in at) == (i in at)

        def period(s):
            return next(p for p in range(1, len(s) + 1) if s[p:] == s[:-p] or p == len(s))

        for i in range(len(words) - 3 * t + 2):
            assert bool(at & set(range(i, i + t))) != (3 * period(words[i : i + 3 * t - 1]) <= t)


def test_odd_rows(odd, odd_rows, empty):
    want = sorted((brute_row(i, [w.decode() for w in spaced(t)]) for i, t, *_ in odd_rows if len(t or "") < 50_000), key=str)
    got = sorted((tuple(r) for r in runs.find(odd).where("doc_id IS NULL OR doc_id <> 4").collect()), key=str)
    assert got == want
    assert runs.find(odd).count() == len(odd_rows) and runs.find(empty).count() == 0
    full = {r.doc_id: r for r in runs.find(odd, with_texts=True).collect()}
    assert full[11].collapsed == "Thon" and [tuple(r) for r in full[11].runs] == [(0, 300, 1)]


def with_tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, d).collect()}
    assert len(got) == len(rows)
    checked = [r for r in rows if len(r.text) < 12_000]
    assert len(checked) > 150 and sum(got[r.doc_id][1] > 0 for r in checked) > 10
    for r in checked:
        assert got[r.doc_id] == brute_row(r.doc_id, with_tail(r.doc_id, [w.decode() for w in spaced(r.text)]))
