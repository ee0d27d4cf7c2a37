import hashlib
import random

import numpy as np
import pytest

from barloom.llm import suffix_dedup as S

from .conftest import prose


def brute(rows):
    """Every 100-byte string by its earliest place; rows of one id count by the order the operator states."""
    keyed = sorted({((i is not None, i or 0), t or "") for i, t, *_ in rows}, key=lambda r: r[0])
    first, result = {}, {}
    for key, text in keyed:
        data = text.encode()
        off = np.zeros(len(data), bool)
        for at in range(len(data) - S.WIDTH + 1):
            if first.setdefault(data[at : at + S.WIDTH], (key, at)) != (key, at):
                off[at : at + S.WIDTH] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~off])
        result[key, text] = (len(data), int(off.sum()), int((np.diff(off.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return sorted(((i, *result[(i is not None, i or 0), t or ""]) for i, t, *_ in rows), key=str)


def got(df, **options):
    return sorted((tuple(r)[:5] for r in S.without_repeats(df, **options).collect()), key=str)


def test_odd_rows(spark, odd, odd_rows):
    # Two texts of one id come in an order of their own: leave the second id out here, and look at it below.
    rows = [r for r in odd_rows if r[0] not in (6, None)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(df) == brute(rows + rows[:3])
    whole = S.without_repeats(odd).collect()
    assert len(whole) == len(odd_rows)
    assert len({(r.n_removed, r.kept_sha256) for r in whole if r.doc_id == 6}) == 2
    for r in whole:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got(docs, with_bytes=False) == want
    assert sum(r[2] for r in want) > 0


@pytest.fixture
def shared(spark):
    """One passage in many documents, each with other neighbours, and low-complexity text."""
    rng = random.Random(8)
    passage, line = prose(rng, 50), prose(rng, 18)
    rows = [(k, prose(rng, rng.randint(0, 30)) + " " + rng.choice([passage, line, passage[: rng.randint(90, 130)]]) + " " + prose(rng, rng.randint(0, 30))) for k in range(150)]
    rows += [(1000 + k, "ab" * rng.randint(40, 200)) for k in range(5)] + [(2000, "\0" * 300), (2001, "é" * 150), (2002, None), (None, passage)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_edges_of_a_shared_passage(shared):
    rows, df = shared
    assert got(df) == brute(rows)


def test_hot_anchors_window_by_window(shared, monkeypatch):
    rows, df = shared
    monkeypatch.setattr(S, "HOT", 3)
    assert got(df) == brute(rows)


def test_small_flushes_blocks_and_chunks(shared, monkeypatch):
    rows, _ = shared
    texts = [t.encode() for _, t in rows if t]
    whole = [S.segments(t) for t in texts]
    for t, (_, first, n, _) in zip(texts, whole, strict=True):
        windows = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n, strict=True)] or [[]])
        assert windows.tolist() == list(range(max(0, len(t) - S.WIDTH + 1)))
    monkeypatch.setattr(S, "CHUNK", 37)
    for t in texts[:20]:
        _, first, n, _ = S.segments(t)
        windows = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n, strict=True)] or [[]])
        assert windows.tolist() == list(range(max(0, len(t) - S.WIDTH + 1)))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    window = prose(rng, 60).encode()[: S.WIDTH]
    anchors = set()
    for _ in range(50):
        before = prose(rng, rng.randint(0, 40)).encode()
        anchor, first, n, _ = S.segments(before + window + prose(rng, 30).encode())
        at = np.searchsorted(first, len(before), "right") - 1
        anchors.add(int(anchor[at]))
    assert len(anchors) == 1


def test_suffix_array_and_prefixes():
    rng = random.Random(4)
    for _ in range(60):
        parts = [bytes(rng.choice(rng.choice([b"a", b"ab", b"abc\0\xff"])) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        order, text = S.suffix_array(parts)
        marks = np.flatnonzero(text == 0)
        ends = marks[np.searchsorted(marks, np.arange(len(text)))]
        key = lambda i: ([int(c) for c in text[i : ends[i]]], i)
        assert order.tolist() == sorted(range(len(text)), key=key)
        lcp = S.common_prefixes(order, text, 10)
        for k in range(1, len(order)):
            a, b = key(order[k - 1])[0], key(order[k])[0]
            same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(same, 10)


def test_empty_table(empty):
    assert S.without_repeats(empty).count() == 0
