import hashlib
import random

import numpy as np
import pytest

from barloom.llm import syncmers
from barloom.llm.queries import QUERIES
from barloom.llm.syncmers import K, S

from .conftest import prose


def one(text):
    return syncmers.anchors([syncmers.code_points(text)])[0]


def fingerprint(text):
    return syncmers.written_out(*one(text))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_anchors_are_closed_syncmers_and_leave_no_gaps():
    """The least of the inner substrings, by their own hashes, stands at an edge."""
    rng = random.Random(1)
    for text in (prose(rng, 200), "ab" * 300, "x" * 200, prose(rng, 60, "ab") + "日本語🙂" * 30):
        places, _ = one(text)
        points = syncmers.code_points(text)
        inner = {}

        def h(part, inner=inner, points=points):
            if part not in inner:
                at = text.index(part)
                inner[part] = int(syncmers._mixed(syncmers._substrings(syncmers._mixed(points[at : at + S].astype(np.uint64) * syncmers._A + syncmers._A), (S,))[0])[0])
            return inner[part]

        want = []
        for i in range(len(text) - K + 1):
            parts = [h(text[i + j : i + j + S]) for j in range(K - S + 1)]
            if min(parts) in (parts[0], parts[-1]):
                want.append(i)
        assert places.tolist() == want
        gaps = np.diff(places, prepend=-1, append=len(text) - K + 1)
        assert gaps.max() <= K - S + 1


def test_anchors_need_no_context():
    rng = random.Random(2)
    passage = prose(rng, 100)
    alone = dict(zip(*(x.tolist() for x in one(passage)), strict=True))
    before = prose(rng, 33)
    within = {p - len(before): h for p, h in zip(*(x.tolist() for x in one(before + passage + prose(rng, 20))), strict=True)}
    assert all(within[p] == h for p, h in alone.items())
    assert {p for p in within if 0 <= p <= len(passage) - K} == set(alone)


def test_together_as_alone():
    rng = random.Random(3)
    texts = ["", "a", "x" * (K - 1), "x" * K, "", prose(rng, 50), "", prose(rng, 3), "", "y" * 200, ""]
    for text, (places, hashes) in zip(texts, syncmers.anchors([syncmers.code_points(t) for t in texts]), strict=True):
        assert syncmers.written_out(places, hashes) == fingerprint(text)
        back = syncmers.read_back(fingerprint(text))
        assert back[0].tolist() == places.tolist() and back[1].tolist() == hashes.tolist()
    assert [len(fingerprint(t)) // 10 for t in texts[:5]] == [0, 1, 1, 1, 0]


def test_edits_as_whole_texts():
    rng = random.Random(4)
    texts = ["", "a", "ab", "x" * 47, "x" * 48, "y" * 95, "z" * 96, "z" * 97, *(prose(rng, rng.randrange(1, 60)) for _ in range(30))]
    made = [syncmers._Text(0, 0, t, syncmers.code_points(t), *one(t)) for t in texts]
    pairs = [(a, z) for a in made for z in made]
    for (a, z), found in zip(pairs, syncmers.edited_anchors(pairs), strict=True):
        half = len(a.text) // 2
        assert syncmers.written_out(*found) == fingerprint(a.text[: len(a.text) - half] + z.text[:half])


def test_likeness():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(10_000) for _ in range(rng.randrange(40))] for _ in "ab")
        b = [x for x in a if rng.random() < 0.7] + b[: rng.randrange(5)]
        got = syncmers.likeness(np.array(a, np.uint32), np.array(b, np.uint32))
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert got == (1.0 if a == b else 2 * longest_common(a, b) / (len(a) + len(b)))
        assert 0 <= got <= 1 and syncmers.likeness(np.array(a, np.uint32), np.array(a, np.uint32)) == 1
    assert syncmers.likeness(np.zeros(0), np.ones(3)) == 0
    text = prose(rng, 400)
    near = text[:1000] + "#" + text[1001:]
    assert 0.9 < syncmers.likeness(one(text)[1], one(near)[1]) < 1
    assert syncmers.likeness(one(text)[1], one(text[1000:] + text[:1000])[1]) < 0.75  # the order counts
    assert syncmers.likeness(one(text)[1], one(prose(rng, 400))[1]) < 0.05


def brute(rows):
    """Rows of the query by their order: a null doc_id first, then doc_id."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, z = (one(t)[1] for t in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(text), fingerprint(edited), syncmers.likeness(a, e), syncmers.likeness(a, z)))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_fingerprints"](spark, d).collect()}
    assert [got[i] for i, _ in rows] == brute(rows) and len(got) == len(rows)
    edits = [r[5] for r in got.values() if r[1] > 1000]
    assert 0.4 < sum(edits) / len(edits) < 0.8


def test_odd_rows(odd, odd_rows, empty, spark):
    got = syncmers.compare(odd).collect()
    assert len(got) == len(odd_rows) and got[0].asDict().keys() == dict(syncmers.COLUMNS).keys()
    # Rows of one doc_id have no order of their own; those of a doc_id that stands once, before another such, are as in brute force.
    ids = [r[0] for r in odd_rows]
    once = [r[:2] for r in odd_rows if ids.count(r[0]) == 1 and r[0] is not None]
    order = sorted(set(ids) - {None})
    want = {}
    for i, text in once:
        after = order[(order.index(i) + 1) % len(order)]
        if ids.count(after) == 1 and i != max(order):
            want[i] = brute([(i, text), next(r for r in once if r[0] == after)])[0]
    found = {r.doc_id: tuple(r) for r in got}
    assert len(want) >= 10 and all(found[i] == row for i, row in want.items())
    assert syncmers.compare(empty).count() == 0 and syncmers.fingerprints(empty).count() == 0
    alone = spark.createDataFrame([(5, "b" * 100 + "c" * 101)], "doc_id long, text string")
    assert [tuple(r) for r in syncmers.compare(alone).collect()] == brute([(5, "b" * 100 + "c" * 101)])
    same = spark.createDataFrame([(5, "same text " * 30)] * 40, "doc_id long, text string").repartition(7)
    rows = syncmers.compare(same).collect()
    assert len(rows) == 40 and {r.near_next for r in rows} == {1.0}
