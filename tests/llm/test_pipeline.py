import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from barloom.llm import bpe  # noqa: E402
from barloom.llm.queries import QUERIES  # noqa: E402

from . import test_decontam, test_jaccard, test_pii, test_quality  # noqa: E402


def brute(rows, items):
    rows = {r[0]: r[1] for r in rows if test_quality.brute(r[1])[-1]}
    first = sorted(set(test_jaccard.roots_by_shared_shingles(rows.items()).values()))
    plain = test_decontam.plain
    return [(i, rows[i]) for i in first if not any(plain(t) in plain(rows[i]) for t in items)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stages(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = brute([tuple(r) for r in docs.collect()], items)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "benchmark_leaks", "personal_data", "encoding"]
    for name in list(stages)[:3]:
        docs = corpus_pipeline.written(stages[name](spark, docs, d))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == want
    clean = corpus_pipeline.written(stages["personal_data"](spark, docs, d))
    got = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and set(got) == {i for i, _ in want}
    for i, text in want:
        assert not test_pii.brute(got[i].text) and got[i].n_chars == len(got[i].text)
        assert test_pii.brute(text) or got[i].text == text or "[SECRET]" in got[i].text
    c = bpe.codec(bpe.vocabulary())
    encoded = {r.doc_id: list(r.ids) for r in stages["encoding"](spark, clean, d).collect()}
    assert encoded == {i: c.encode(r.text) for i, r in got.items()}
    result = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, d).collect()}
    assert result == encoded


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def test_odd_rows_pass_through(spark, odd, odd_rows):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == docs.count() > 0
