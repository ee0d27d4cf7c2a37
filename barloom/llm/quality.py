"""Quality rules as a short-circuit cascade: the rule that rejects most per second of work goes first.

Each rule looks at one document and rejects it or not. A document goes once any rule rejects it, so the
order changes what the rules cost together, never what is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batch, small_batches, texts

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Bound of the sample on which costs and rejections are estimated.
SAMPLE_ROWS = 2000


class Document:
    """A text's features, each worked out when first asked for. A null text has no words."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes split at the six ASCII spaces only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in self.words), np.int64, n)
        # Numbers of the distinct pairs, then of pairs with a third word: no product leaves 64 bits.
        pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
        _, window, count = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
        again = count[window] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())


RULES: dict[str, Callable[[Document], bool]] = {
    "few_words": lambda d: d.n_words < 50,
    "repeated_words": lambda d: 100 * d.n_repeat_words > 50 * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "repeated_lines": lambda d: 2 * d.n_dup_lines > len(d.lines),
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words,
    "shouting": lambda d: 2 * sum(map(bytes.isupper, d.words)) > d.n_words,
}
BASE = ("few_words", "repeated_words")


def rule_order(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7) -> list[str]:
    """All rules, those that reject most per second first, as measured on about `rows` sampled documents.

    Each rule is timed on a fresh document, so it pays for the features it needs. The measuring runs in
    tasks; one row per rule and task comes back. Without documents the order is that of RULES.
    """
    names = list(RULES)
    schema = pa.schema([("rule", pa.string()), ("seconds", pa.float64()), ("rejected", pa.int64())])
    total = docs.count()
    if not total:
        return names

    def measure(batches):
        seconds, rejected = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
        for b in batches:
            for text in b.column(0).to_pylist():
                for name in names:
                    began = time.perf_counter()
                    rejected[name] += bool(RULES[name](Document(text)))
                    seconds[name] += time.perf_counter() - began
        yield batch(schema, names, list(seconds.values()), list(rejected.values()))

    sample = small_batches(docs.select(F.col(text_col).cast("string").alias("text"))).sample(min(1.0, rows / total), seed)
    found = sample.mapInArrow(measure, "rule string, seconds double, rejected long").groupBy("rule").sum("seconds", "rejected").collect()
    rate = {name: rejected / max(seconds, 1e-9) for name, seconds, rejected in found}
    return sorted(names, key=lambda name: (-rate.get(name, 0.0), name))


def passes(text: str | None, order: list[str]) -> bool:
    d = Document(text)
    return not any(RULES[name](d) for name in order)


def keep(docs: DataFrame, order: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns; no shuffle. A null or empty text goes."""
    order = order or rule_order(docs, text_col)

    def run(batches):
        for b in batches:
            found = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([passes(t, order) for t in b.column(found).to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def assess(docs: DataFrame, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base figures and verdict of each row of `docs`; no shuffle.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by (a
    rule that rejects it, the first by the order given; null if kept). A null text has no words; a null
    doc_id stays null; repeated rows give repeated rows.
    """
    order = order or rule_order(docs, text_col)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                d = Document(text)
                by = next((name for name in order if RULES[name](d)), None)
                rows.append((*(getattr(d, c) for c in counts), any(RULES[r](d) for r in BASE), by is None, by))
            yield batch(schema, b.column(0), *([r[k] for r in rows] for k in range(len(schema) - 1)))

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, " + "".join(f"{c} long, " for c in counts) + "base_failed boolean, kept boolean, rejected_by string")
