import random

import numpy as np

from barloom.llm import bpe, packing


def naive(sizes, size):
    left, rows = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        open_ = [room for room in left if room >= sizes[k]]
        if open_:
            row = max(r for r in range(len(left)) if left[r] == min(open_))
        else:
            row = len(left)
            left.append(size)
            rows.append([])
        left[row] -= sizes[k]
        rows[row].append(k)
    return rows


def test_best_fit():
    rng = random.Random(1)
    for size in (1, 2, 7, 8, 64, 100):
        sizes = [rng.randint(1, size) for _ in range(300)]
        got = packing.best_fit(sizes, size)
        assert sorted(k for row in got for k in row) == list(range(300))
        assert all(sum(sizes[k] for k in row) <= size for row in got)
        # Ties between rows of equal room may fall either way: the filling is the same.
        assert sorted(sum(sizes[k] for k in row) for row in got) == sorted(sum(sizes[k] for k in row) for row in naive(sizes, size))
    assert packing.best_fit([], 5) == []


def unpacked(rows, size):
    docs = {}
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == size
        cuts = list(r.cu_seqlens)
        assert cuts[0] == 0 and cuts == sorted(set(cuts)) and len(cuts) == len(r.doc_ids) + 1 == len(r.doc_offsets) + 1
        for i, at, a, b in zip(r.doc_ids, r.doc_offsets, cuts, cuts[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            docs.setdefault(i, []).append((at, tuple(ids[a:b].tolist())))
        assert (ids[cuts[-1] :] == packing.PAD).all() and (positions[cuts[-1] :] == 0).all()
    return docs


def test_documents_come_back_whole(odd, odd_rows, sample, sample_rows, empty):
    c = bpe.codec(bpe.vocabulary())
    for df, rows, size, window in ((sample, sample_rows, 64, 1000), (sample, sample_rows, 2048, packing.WINDOW), (odd, odd_rows, 32, 500)):
        got = unpacked(packing.pack(df, size=size, window=window).collect(), size)
        want = {}
        for i, text, *_ in rows:
            ids = c.encode(text or "")
            for at in range(0, len(ids), size):
                want.setdefault(i, []).append((at, tuple(ids[at : at + size])))
        assert {i: sorted(p) for i, p in got.items()} == {i: sorted(p) for i, p in want.items()}
    assert packing.pack(empty).count() == 0


def test_little_room_is_lost(sample, sample_rows):
    c = bpe.codec(bpe.vocabulary())
    tokens = sum(len(c.encode(t)) for _, t, *_ in sample_rows)
    rows = packing.pack(sample.coalesce(1), size=512).count()
    assert rows <= 1.02 * tokens / 512 + 1
