import random
import re

from barloom.llm import licenses

from .conftest import prose

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


def brute_templates(text, templates):
    """Labels and spans by listing all hits, bands and spans."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    k, matches = licenses.K, []
    for template, label in templates.items():
        t = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.lower())
        grams = len(t) - k + 1
        far = int(len(t) * licenses.STRETCH) + 1 - k
        hits = sorted((i - j, i, j) for i in range(len(words) - k + 1) for j in range(grams) if words[i : i + k] == t[j : j + k])
        bands = []
        for h in hits:
            if not bands or h[0] - bands[-1][-1][0] > licenses.NEAR:
                bands.append([])
            bands[-1].append(h)
        for band in bands:
            row = sorted((i, j) for _, i, j in band)
            back = [n > 0 and row[n][1] < row[n - 1][1] for n in range(len(row))]
            best = None
            for end in {i for i, _ in row}:
                here = [n for n, (i, _) in enumerate(row) if end - far <= i <= end]
                if sum(back[n] for n in here) <= len(here) * licenses.BACK:
                    start = min(row[n][0] for n in here)
                    best = max(filter(None, [best, (len({row[n][1] for n in here}) / grams, start - end, -start, end)]))
            if best and best[0] >= licenses.COVER:
                matches.append((-best[2], best[3] + k - 1, label, best[0], grams))
    kept = [m for m in matches if not any(
        o[2] != m[2] and o[0] <= m[1] and o[1] >= m[0] and (o[3], o[4]) > (m[3], m[4]) for o in matches)]
    return {m[2] for m in kept}, ",".join(f"{m[2]}:{m[0]}:{m[1]}" for m in sorted(kept))


BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_odd_rows_once_each(odd, odd_rows):
    want = sorted({(i, t): (i, *brute(t)) for i, t, *_ in odd_rows}.values(), key=str)
    assert sorted((tuple(r) for r in licenses.scan(odd).select(*BASE).collect()), key=str) == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    rows = licenses.scan(docs).collect()
    assert sorted(tuple(r[c] for c in BASE) for r in rows) == want
    assert any(r.n_base for r in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(("gpl-3" in r.labels) == ("GNU General Public License" in text[r.doc_id]) for r in rows)


def test_places_edges_and_altered_templates(spark):
    rng = random.Random(3)
    gpl = next(t for t, label in licenses.TEMPLATES.items() if label == "gpl-3" and "free software" in t)
    altered = gpl.replace("redistribute it", "hand it on").replace("any later version", "any newer version").replace("published by", "published in print by")
    texts = [
        "Under THE MIT-license", "released under the mit license under the mit license", "CC BY/NC cc by nc cc by  nc.", "apache license version 20",
        "the apache license, VERSION 2", prose(rng, 200) + " " + altered + " " + prose(rng, 100), "éunder the mit license", "under the mit licenseé", "under the mıt license",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(licenses.scan(df).collect())
    assert [tuple(r[c] for c in BASE) for r in rows] == [(i, *brute(t)) for i, t in enumerate(texts)]
    assert rows[5].labels == "gpl-3" and rows[5].base_labels == "" and licenses.COVER <= rows[5].score < 1
    label, first, last = rows[5].spans.split(":")
    assert abs(int(first) - 200) <= 1 and abs(int(last) - 200 - len(gpl.split())) <= 3
    assert "python" not in licenses.scan(df)._jdf.queryExecution().toString().lower()


def test_templates_like_brute_force(spark):
    rng = random.Random(8)
    all_of = list(licenses.TEMPLATES)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(all_of).split()
            kind = rng.randrange(5)
            if kind == 1:  # words put in, left out and changed
                t = [w for x in t for w in ([], [x], [x, "filler"], ["other"])[rng.choice([1] * 20 + [0, 2, 3])]]
            elif kind == 2:  # a part of it
                a = rng.randrange(len(t))
                t = t[a : a + rng.randrange(len(t)) + 1]
            elif kind == 3:  # two halves in wrong order
                a = len(t) // 2
                t = t[a:] + t[:a]
            elif kind == 4:  # scattered
                t = [w for i in range(0, len(t), 3) for w in [*t[i : i + 3], "filler"]]
            parts += [" ".join(t), prose(rng, rng.choice([0, 3, 30]))]
        texts.append(" ".join(parts))
    texts += [prose(rng, 5000) + " " + all_of[1] + " " + prose(rng, 5000), "free software foundation " * 300, " ".join(all_of), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        labels, spans = brute_templates(texts[r.doc_id], licenses.TEMPLATES)
        assert (r.labels, r.spans) == (",".join(sorted(labels | set(filter(None, r.base_labels.split(","))))), spans), r.doc_id


def test_each_notice_has_one_label_and_scattered_words_none(spark):
    rng = random.Random(4)
    all_of = list(licenses.TEMPLATES.items())
    texts = [prose(rng, 20) + " " + t + " " + prose(rng, 20) for t, _ in all_of]
    texts += [t.replace("library", "program").replace("is free software;", "is free software:") for t, _ in all_of]
    words = max((t for t, label in all_of if label == "gpl-3"), key=len).split()
    texts.append(" ".join(w for i in range(len(words) - 2) for w in [*words[i : i + 3], "filler"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (_, label) in enumerate(all_of):
        assert got[i].labels == label and got[i].score == 1.0
        assert got[i + len(all_of)].labels == label
    assert (got[len(texts) - 1].labels, got[len(texts) - 1].score, got[len(texts) - 1].spans) == ("", 0.0, "")


def test_own_templates(spark):
    mine = {"all rights to this text are kept by the house of mirrors": "mirrors"}
    df = spark.createDataFrame([(1, "Here all rights to this text are kept by the house of mirrors."), (2, "cc by nc")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df, templates=mine).collect()} == {1: "mirrors", 2: "cc-by-nc"}
    assert {r.doc_id: r.labels for r in licenses.scan(df, templates={}).collect()} == {1: "", 2: "cc-by-nc"}


def test_empty_table(empty):
    assert licenses.scan(empty).count() == 0
