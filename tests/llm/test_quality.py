import time
import re
from collections import Counter

from barloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    dup = len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    caps = sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words)
    bad = 10 * symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 15 * n or 2 * caps > n
    return n, chars, symbols, dup, len(covered), failed, not (failed or bad)


def rows(df):
    return sorted((tuple(r) for r in df.drop("rejected_by").collect()), key=str)


def test_odd_rows(odd, odd_rows):
    assert rows(quality.assess(odd)) == sorted(((i, *brute(t)) for i, t, *_ in odd_rows), key=str)


def test_documents(sample, sample_rows):
    assert rows(quality.assess(sample)) == sorted(((i, *brute(t)) for i, t, *_ in sample_rows), key=str)


def test_order_does_not_change_what_is_kept(odd, odd_rows):
    want = sorted(((i, t) for i, t, *_ in odd_rows if brute(t)[-1]), key=str)
    for order in (list(quality.RULES), list(quality.RULES)[::-1], None):
        kept = quality.keep(odd, order)
        assert kept.columns == odd.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want


def test_order_is_by_rejection_per_cost(sample, monkeypatch):
    """Rules of known cost and rejection: cheap ones that reject much come first, costly ones that reject little last."""
    def rule(seconds, one_in):
        def fails(d):
            time.sleep(seconds)
            return one_in and len(d.text) % one_in == 0
        return fails

    rules = {"never": rule(0.0001, 0), "dear_often": rule(0.02, 1), "cheap_often": rule(0.0002, 1), "cheap_seldom": rule(0.0002, 10), "dear_seldom": rule(0.02, 10)}
    monkeypatch.setattr(quality, "RULES", rules)
    order = quality.rule_order(sample.limit(60))
    assert order == ["cheap_often", "cheap_seldom", "dear_often", "dear_seldom", "never"]


def test_cascade_stops_at_the_first_rejection(monkeypatch):
    asked = []
    monkeypatch.setattr(quality, "RULES", {n: (lambda d, n=n: asked.append(n) or n == "b") for n in "abc"})
    assert not quality.passes("text", ["a", "b", "c"])
    assert asked == ["a", "b"]


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {(r.quality, r.kept): r.n for r in quality.assess(docs).where("n_words >= 50").join(labels, "doc_id").groupBy("quality", "kept").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert found.get((1, False), 0) == 0
    assert found.get((0, True), 0) == 0


def test_empty_table(empty):
    assert quality.assess(empty).count() == 0
    assert quality.keep(empty).count() == 0
