"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is
the sum, over all ways to cut it into pieces, of the product of theirs; the forward algorithm adds these
up from left to right. A text scores the sum of the logarithms over its words.

Words are runs of letters in lower case with a space before, as UTF-8 bytes mapped to Latin-1, so every
word can be cut. A word of over WINDOW bytes is scored window by window, all of it.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batch, small_batches, stored, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WINDOW = 48
# Bound of the rows a classifier is fitted on, but for half as many again that rare languages may add.
TRAIN_ROWS = 20_000
# Strength of the pieces' overall shares in each language's probabilities.
PRIOR = 2000.0
MEMO = 200_000
WORDS_AT_ONCE = 20_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
ONLY_LETTERS = regex.compile(r"\p{L}+")
GAP = "\u0100"


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[ahocorasick.Automaton, np.ndarray]:
    """An automaton of all pieces, and the length of each."""
    automaton, pieces = ahocorasick.Automaton(), {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                pieces[int(rank)] = base64.b64decode(token).decode("latin-1")
    sizes = np.zeros(max(pieces) + 1, np.int64)
    for piece, text in pieces.items():
        automaton.add_word(text, piece)
        sizes[piece] = len(text)
    automaton.make_automaton()
    return automaton, sizes


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def windows(word: str) -> list[str]:
    """What of a word is scored: none of a number such as ½, which is taken for a word at first."""
    letters = [word] if word.isalpha() else ONLY_LETTERS.findall(word)
    cut = [(" " + part).encode().decode("latin-1") for part in letters]
    return [part[i : i + WINDOW] for part in cut for i in range(0, len(part), WINDOW)]


class Places(dict):
    """A number for each word, in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        return self.setdefault(word, len(self))


class Lattice:
    """All pieces at all places of many short strings, by the place where they end, then by string.

    The strings are searched as one, with a character between them that no piece holds. Each byte is a
    piece, so one ends at every place of every string.
    """

    def __init__(self, path: str, strings: list[str]):
        automaton, sizes = _pieces(path)
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.rows, self.width = len(strings), int(self.length.max(initial=0))
        began = np.cumsum(self.length + 1) - self.length - 1
        found = np.fromiter(chain.from_iterable(automaton.iter(GAP.join(strings))), np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(self.rows), self.length + 1)[found[:, 0]]
        end = found[:, 0] + 1 - began[row]
        order = np.argsort(end, kind="stable")
        self.row, self.end, self.piece = row[order], end[order], found[order, 1]
        self.start = self.end - sizes[self.piece]
        self.cuts = np.searchsorted(self.end, np.arange(self.width + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Probability of each beginning of each string, by the probability of each piece found; a column for each of p."""
        alpha = np.zeros((self.width + 1, self.rows, p.shape[1]))
        alpha[0] = 1.0
        for j in range(1, self.width + 1):
            k = slice(self.cuts[j], self.cuts[j + 1])
            row = self.row[k]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            alpha[j, row[first]] = np.add.reduceat(alpha[self.start[k], row] * p[k], first, axis=0)
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.width + 1, self.rows))
        beta[self.length, np.arange(self.rows)] = 1.0
        for j in range(self.width, 0, -1):
            k = slice(self.cuts[j], self.cuts[j + 1])
            np.add.at(beta, (self.start[k], self.row[k]), beta[j, self.row[k]] * p[k])
        return beta

    def log_probability(self, model: np.ndarray) -> np.ndarray:
        """One row per string, one column per language."""
        totals = self.forward(model.T[self.piece])[self.length, np.arange(self.rows)]
        return np.log(np.maximum(totals, 1e-300))

    def expected(self, model: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces found, and how often each is expected in a segmentation, times the string's weight."""
        p = model[self.piece]
        alpha, beta = self.forward(p[:, None])[:, :, 0], self.backward(p)
        total = np.maximum(alpha[self.length, np.arange(self.rows)], 1e-300)
        return self.piece, alpha[self.start, self.row] * p * beta[self.end, self.row] / total[self.row] * weight[self.row]


def word_counts(labelled: DataFrame) -> DataFrame:
    """lang, word, n of rows of lang and text; counted in tasks before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        count: Counter[tuple[str, str]] = Counter()

        def out():
            made = batch(schema, [k[0] for k in count], [k[1] for k in count], list(count.values()))
            count.clear()
            return made

        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for word, n in Counter(words(text)).items():
                    count[lang, word] += n
                if len(count) > MEMO:
                    yield out()
        yield out()

    return small_batches(labelled.select("lang", "text")).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def shares(counts: dict[str, int], rows: int) -> dict[str, float]:
    """The share of each language's rows to fit on: its part of `rows`, but as many as half of an equal part where it has them.

    In all at most one and a half times `rows`, and no language is lost for being rare.
    """
    total = sum(counts.values())
    return {lang: min(1.0, max(rows / total, rows / (2 * len(counts) * n))) for lang, n in counts.items()}


def fit(labelled: DataFrame, path: str, rows: int = TRAIN_ROWS, rounds: int = 2, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each piece in each, by `rounds` of expectation-maximisation.

    Fitted on about `rows` of the rows of `labelled` (lang, text), sampled by `shares` of each language; null labels are
    left out. What comes to the driver, and is sent to tasks, is one number per language and piece of the vocabulary:
    bounded by the number of languages.
    """
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    size = len(_pieces(path)[1])
    if not counts:
        return [], np.zeros((0, size))
    counted = stored(word_counts(known.sampleBy("lang", shares(counts, rows), seed)))
    langs: list[str] = sorted(r[0] for r in counted.select("lang").distinct().collect())
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int64()), ("n", pa.float64())])
    model = np.full((len(langs), size), 1.0 / size)
    for _ in range(rounds):
        shipped = counted.sparkSession.sparkContext.broadcast((langs, model))

        def run(batches, shipped=shipped):
            langs, model = shipped.value
            sums = np.zeros_like(model)
            for b in batches:
                lang, word, n = (c.to_pylist() for c in b.columns)
                for k, name in enumerate(langs):
                    mine = [(w, c) for a, w, c in zip(lang, word, n, strict=True) if a == name]
                    strings = [(s, c) for w, c in mine for s in windows(w)]
                    if strings:
                        lattice = Lattice(path, [s for s, _ in strings])
                        sums[k] += np.bincount(*lattice.expected(model[k], np.array([c for _, c in strings], float)), size)
            for k, name in enumerate(langs):
                at = np.flatnonzero(sums[k])
                yield batch(schema, [name] * len(at), at, sums[k, at])

        found = counted.mapInArrow(run, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        counts = np.zeros((len(langs), size))
        for name, piece, n in found.toLocalIterator():
            counts[langs.index(name), piece] = n
        share = (counts.sum(0) + 0.1) / (counts.sum() + 0.1 * size)
        model = (counts + PRIOR * share) / (counts.sum(1, keepdims=True) + PRIOR)
    return langs, model


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (probability among the languages, all equally likely before) of each row; no shuffle.

    `und` with score 0 for a null text, one without letters, and where nothing was learned. Ties go to
    the first language by name. Only the text is looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        places, known = Places(), np.zeros((0, len(langs) + 1))  # the last column counts windows
        for b in batches:
            if len(places) > MEMO:
                places, known = Places(), known[:0]
            found = [words(t) if langs else [] for t in b.column(1).to_pylist()]
            found = [np.fromiter(map(places.__getitem__, w), np.int64, len(w)) for w in found]
            values = [known]
            for i in range(0, len(places.new), WORDS_AT_ONCE):
                cut = [windows(w) for w in places.new[i : i + WORDS_AT_ONCE]]
                value = Lattice(path, [s for c in cut for s in c]).log_probability(shipped.value)
                n = np.array([len(c) for c in cut])
                first = np.cumsum(n) - n
                sums = np.zeros((len(cut), len(langs) + 1))
                sums[:, -1] = n
                sums[n > 0, :-1] = np.add.reduceat(value, first[n > 0], axis=0)
                values.append(sums)
            places.new.clear()
            known = np.concatenate(values)
            pred, score = [], []
            for at in found:
                *total, n = known[at].sum(0)
                if not n:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                total = np.array(total)
                k = int(total.argmax())
                pred.append(langs[k])
                score.append(1.0 / math.fsum(np.exp(np.maximum(total - total[k], -700.0))))
            yield batch(schema, b.column(0), pred, score)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: the remainder of crc32 of the id as text by 5 is 0. A null id is kept too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, path: str | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the labelled rows of `docs` (doc_id, text, lang) that are not held out, and predict all rows.

    doc_id, held_out, lang_pred, score; one row per row of `docs`.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    langs, model = fit(docs.where(~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), path, rows)
    return predict(docs, langs, model, path).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
