import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import langid

PATH = public_tokenizers.path(langid.VOCABULARY)


def sum_of_segmentations(text, p):
    """By listing every way to cut the text."""
    if not text:
        return 1.0
    return sum(p[text[:n]] * sum_of_segmentations(text[n:], p) for n in range(1, len(text) + 1) if text[:n] in p)


@pytest.fixture(scope="module")
def pieces():
    automaton, sizes = langid._pieces(PATH)
    return {s: automaton.get(s) for s in automaton}, len(sizes)


def test_forward_sums_all_segmentations(pieces):
    ids, size = pieces
    rng = np.random.default_rng(1)
    model = rng.random((2, size)) / size * 50
    words = [" the", " a", " thonnd", " ofthe", "é".encode().decode("latin-1")]
    got = langid.Lattice(PATH, words).log_probability(model)
    for row, word in zip(got, words, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(sum_of_segmentations(word, {s: model[k, i] for s, i in ids.items() if len(s) <= 8})))


def test_expected_counts(pieces):
    ids, size = pieces
    model = np.random.default_rng(2).random(size)
    lattice = langid.Lattice(PATH, [" then", " on"])
    piece, n = lattice.expected(model, np.array([3.0, 1.0]))
    got = np.bincount(piece, n, size)
    want = np.zeros(size)

    def walk(text, done, weight, total):
        if not text:
            for i in done:
                want[i] += weight * math.prod(model[j] for j in done) / total
            return
        for k in range(1, len(text) + 1):
            if text[:k] in ids:
                walk(text[k:], [*done, ids[text[:k]]], weight, total)

    for text, weight in ((" then", 3.0), (" on", 1.0)):
        walk(text, [], weight, sum_of_segmentations(text, {s: model[i] for s, i in ids.items() if len(s) < 8}))
    assert got == pytest.approx(want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    mine = [r for r in rows if r.held_out and re.search(r"[^\W\d_]", r.text)]
    assert sum(r.lang == r.lang_pred for r in mine) >= 0.97 * len(mine)


def test_rare_languages_are_kept():
    for rows in (10, 200, 20_000):
        for counts in ({"a": 1}, {"a": 10_000_000, "b": 500, "c": 1}, {"a": 50, "b": 60}, {str(k): 10**k for k in range(8)}):
            taken = {lang: n * langid.shares(counts, rows)[lang] for lang, n in counts.items()}
            assert all(taken[lang] >= min(n, rows / (2 * len(counts))) - 1e-6 for lang, n in counts.items())
            assert sum(taken.values()) <= 1.5 * rows + 1e-6
            assert sum(counts.values()) > rows or taken == pytest.approx(counts)


def test_a_rare_language_is_learned(spark):
    often = spark.range(30_000).selectExpr("concat('the of and ', id % 90) AS text", "'en' AS lang")
    rare = spark.range(20).selectExpr("'zyxq vuzz qixx' AS text", "'zz' AS lang")
    langs, model = langid.fit(often.unionByName(rare), PATH, rows=100)
    assert langs == ["en", "zz"]
    docs = spark.createDataFrame([(1, "qixx zyxq"), (2, "and the of")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, langs, model, PATH).collect()} == {1: "zz", 2: "en"}


def test_only_the_text_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    # Labels of held-out rows, ids beyond their remainder and sources say nothing.
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs).collect()}
    b = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(other).collect()}
    assert a == b


def test_odd_rows(odd, odd_rows):
    got = langid.identify(odd).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by[1] == by[2] == by[3] == ["und"]
    assert set(by[6]) <= {"en", "fr", "de", "es"}


def test_nothing_to_learn_from(spark, empty):
    assert langid.identify(empty).count() == 0
    one = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(one).collect()] == [("und", 0.0)]


def test_long_words_are_scored_whole():
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefgh") for _ in range(1000))
    assert "".join(langid.windows(word)) == " " + word


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "\u00b2 \u00bd 12 _", None), (3, "three\u00b2", None), (4, "three", None)],
                                 "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, ["en", "fr"], np.random.default_rng(3).random((2, 50256)), PATH).collect()}
    assert got[2] == ("und", 0.0)
    assert got[3] == got[4] and got[4][0] in ("en", "fr")
