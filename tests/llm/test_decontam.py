import random

import numpy as np
import pytest

from barloom.llm import decontam

from .conftest import prose, with_extra

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def best(pattern, text):
    """Least edits that make the pattern a part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def altered(rng, text, n):
    for _ in range(n):
        at = rng.randrange(1, len(text) - 1)
        text = text[:at] + rng.choice([rng.choice(LETTERS), "", text[at] + rng.choice(LETTERS)]) + text[at + 1 :]
    return text


def plain(text):
    return " ".join((text or "").lower().split())


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    items = [(k, prose(rng, rng.randint(12, 60), LETTERS)) for k in range(8)] + [(8, "short item"), (9, None), (10, ""), (11, "ab " * 60)]
    docs = []
    for k in range(60):
        _, item = items[rng.randrange(8)]
        e = int(decontam.EDIT_RATE * len(plain(item)))
        body = altered(rng, item, rng.choice([0, 1, e // 2, e, e + 6, 3 * e]))
        docs.append((k, prose(rng, rng.choice([0, 1, 30, 80]), LETTERS) + " " + body.upper() + "\n" + prose(rng, rng.choice([0, 40]), LETTERS)))
    docs += [(100, None), (101, ""), (102, items[0][1][:-40]), (None, items[1][1]), (103, items[2][1]), (103, items[2][1]), (104, "ab " * 5000), (105, prose(rng, 40_000, LETTERS) + " " + items[3][1])]
    return docs, items


def test_finds_what_whole_alignment_finds(spark, planted):
    docs, items = planted
    rows = decontam.leaks(with_extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), with_extra(spark.createDataFrame(items, "item_id long, text string"))).collect()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.item_id), []).append((r.edits, r.start, r.end))
    for i, text in docs[:-2]:
        for k, item in items:
            m = len(plain(item))
            e = min(int(decontam.EDIT_RATE * m), (m - decontam.Q) // decontam.Q)
            edits = best(plain(item), plain(text)) if m >= decontam.MIN_CHARS else m + 1
            if 0 < m < decontam.MIN_CHARS:
                assert ((i, k) in got) == (f" {plain(item)} " in f" {plain(text)} ")
            elif m >= decontam.MIN_CHARS and edits <= e:
                for found, start, end in got[i, k]:
                    assert found == edits
                    assert best(plain(item), plain(text)[start:end]) == edits
            else:
                assert (i, k) not in got
    assert len(got[103, 2]) == 2
    assert got[None, 1][0][0] == 0
    assert got[104, 11][0][0] == 0
    assert got[105, 3][0][0] == 0 and (got[105, 3][0][2] - got[105, 3][0][1]) == len(plain(items[3][1]))


def test_blocks_of_items_give_the_same(spark, planted):
    docs, items = planted
    d, b = spark.createDataFrame(docs[:40], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.leaks(d, b).collect()))
    assert whole == sorted(map(tuple, decontam.leaks(d, b, block_chars=500).collect()))
    bad = {r[0] for r in whole}
    for options in ({}, {"block_chars": 500}):
        assert sorted(r.doc_id for r in decontam.without_leaks(d, b, **options).collect()) == sorted(i for i, _ in docs[:40] if i not in bad)


def test_documents_of_the_sample(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    texts, known = docs.collect(), items.collect()
    want = {(d.doc_id, b.item_id) for d in texts for b in known if plain(b.text) in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).where("edits = 0").collect()}
    assert got == want and want
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns
    leaking = {r.doc_id for r in decontam.leaks(docs, items).collect()}
    assert {r.doc_id for r in kept.collect()} == {d.doc_id for d in texts} - leaking


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, odd_rows[6][1])], "item_id long, text string")
    assert decontam.leaks(odd, none).count() == 0
    assert decontam.without_leaks(odd, none).count() == len(odd_rows)
    assert decontam.leaks(empty, some).count() == 0
    assert decontam.without_leaks(empty, some).count() == 0
    assert {r.doc_id for r in decontam.leaks(odd, some).collect()} == {i for i, t, *_ in odd_rows if plain(odd_rows[6][1]) in plain(t)}


def test_hits_come_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(decontam, "HITS", 100)
    index = decontam.Index.of([(1, "ab " * 60)])
    text = decontam.codes("ab " * 400)
    parts = list(index.hits(text))
    assert len(parts) > 10
    grams = decontam.grams(text)
    assert sum(len(p[0]) for p in parts) == sum(int((decontam.grams(index.chars[0]) == g).sum()) for g in grams)


def test_short_items_and_items_without_an_id(spark):
    rng = random.Random(17)
    long = prose(rng, 30, LETTERS)
    items = [(1, "What is the capital of Peru?"), (2, "pi=3."), (None, "abcde"), (None, long), (3, "?"), (4, "What is the  capital of PERU?")]
    docs = [(0, "x what is\nthe capital of peru?\" y"), (1, "somewhat is the capital of peru?"), (2, "abcdef xabcde"), (3, "(abcde)"), (4, "2pi=3.1"), (5, "tau=2pi=3.1 pi=3.1"),
            (6, prose(rng, 9) + " " + long), (7, None), (8, "clean"), (9, "well?")]
    d, b = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id")))
    got = sorted(((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in decontam.leaks(d, b).collect()), key=str)
    start = len(plain(docs[6][1])) - len(plain(long))
    want = [(0, 1, 0, 2, 30), (0, 4, 0, 2, 30), (0, 3, 0, 29, 30), (1, 3, 0, 31, 32), (3, None, 0, 1, 6), (5, 2, 0, 12, 17), (6, None, 0, start, start + len(plain(long))), (9, 3, 0, 4, 5)]
    assert got == sorted(want, key=str)
    for options in ({}, {"block_chars": 20}):
        assert sorted(r.doc_id for r in decontam.without_leaks(d, b, **options).collect()) == [2, 4, 7, 8]
