"""Periodic runs of words, found by string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q (words q apart are equal), at least twice as long as q
and at least LEAST words, that cannot be extended. All runs of a text are found:

- Periods below 3 * FIRST - 1 by comparing the words with themselves, shifted.
- For the periods from 3t - 1 to 6t - 2 of a scale t, a synchronising set holds the places whose next t + 1
  substrings of t words have their least hash at an edge; substrings of period t / 3 or less do not count. Whether a place is in the
  set depends on the 2t words that follow it alone, so a run repeats its members a period apart, and members of equal context
  propose their distance as a period. Any t places that follow one another hold a member, unless 3t - 1 words there have
  a period of t / 3 or less.
- What that leaves out are runs whose every period lies within one shorter run: two runs of the same small period that
  touch. Such pairs are known from the scales before and propose the periods that bring them to cover.

Each proposal is extended by comparing hashes of 2^k words; the hashes are of 64 bits and compared within a batch only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import batch, pieces, plain_texts

LEAST = 12
FIRST = 16  # the first scale
WORDS = 200_000  # words searched together; a longer text is searched alone

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(2**64 - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


class _Hashes:
    """Hashes of all substrings of 2^k words of texts that stand one after another, the longest first."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.reach = np.concatenate([[0], np.cumsum(lengths + 1)])  # with a separator after each text
        self.lengths = lengths
        self.levels = [_mixed(words.astype(np.uint64) * _A + _A)]
        while lengths[0] >= 2 << (len(self.levels) - 1):
            k = len(self.levels)
            width, last = 1 << (k - 1), self.levels[-1][: self.prefix(1 << k) - (1 << k) + 1 + (1 << (k - 1))]
            self.levels.append(_mixed(last[:-width] * _A + last[width:]))

    def prefix(self, n: int) -> int:
        """Where the texts of at least `n` words end."""
        return int(self.reach[np.searchsorted(-self.lengths, -n, side="right")])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; j is above i."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            h = self.levels[k]
            fits = j + n < len(h)
            a, b = np.where(fits, i + n, 0), np.where(fits, j + n, 0)
            n += (fits & (h[a] == h[b])).astype(np.int64) << k
        return n

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            h, width = self.levels[k], 1 << k
            a, b = i - n - width, j - n - width
            fits = (a >= 0) & (b < len(h))
            a, b = np.where(fits, a, 0), np.where(fits, b, 0)
            n += (fits & (h[a] == h[b])).astype(np.int64) << k
        return n


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Of runs that cover the same words the one of smallest period: the others are multiples of it."""
    runs = runs[np.argsort(runs[:, 2], kind="stable")]
    return runs[np.unique(runs[:, 0] << 32 | runs[:, 1], return_index=True)[1]]


def _small(words: np.ndarray) -> np.ndarray:
    found = []
    for q in range(1, min(3 * FIRST - 1, len(words))):
        need = max(LEAST, 2 * q) - q
        at = np.flatnonzero(words[q:] == words[:-q])
        if len(at) < need:
            continue
        starts = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
        sizes = np.diff(np.append(starts, len(at)))
        long = sizes >= need
        if long.any():
            found.append(np.stack([at[starts[long]], sizes[long] + q, np.full(long.sum(), q)], axis=1))
    return _distinct(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def synchronising(hashes: _Hashes, t: int, end: int, runs: np.ndarray) -> np.ndarray:
    """The places before `end` of the synchronising set of scale `t` (a power of two); `runs` holds all of period t / 3 or less."""
    ids = hashes.levels[t.bit_length() - 1][: end - t + 1].copy()
    poor = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] >= t) & (runs[:, 0] < len(ids))]
    if len(poor):
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, poor[:, 0], 1)
        np.add.at(edge, np.minimum(poor[:, 0] + poor[:, 1] - t + 1, len(ids)), -1)
        ids[np.cumsum(edge[:-1]) > 0] = _TOP
    least, width = ids, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], ids[t:])
    first, last = ids[: len(least)], ids[t:]
    return np.flatnonzero((least < _TOP) & ((least == first) | (least == last)))


def _by_context(hashes: _Hashes, t: int, end: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and proposed periods of the scale: members of equal context, that far from one another.

    Members of one context stand more than t / 3 apart, so each has a bounded number of others within 6t - 2.
    """
    at = synchronising(hashes, t, end, runs)
    context = hashes.levels[t.bit_length()][at]
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    left, step = np.arange(len(at)), 1
    places, periods = [], []
    while True:
        left = left[left + step < len(at)]
        apart = at[left + step] - at[left]
        near = (context[left + step] == context[left]) & (apart <= 6 * t - 2)
        left, apart = left[near], apart[near]
        if not len(left):
            break
        far = apart >= 3 * t - 1
        places.append(at[left[far]])
        periods.append(apart[far])
        step += 1
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.zeros(0, np.int64),) * 2


def _by_touching(hashes: _Hashes, t: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and proposed periods of the scale from touching runs of one small period with the same words."""
    long = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] >= 3 * t - 1)]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    meet = (long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 0] + long[:-1, 1])
    for k in np.flatnonzero(meet):
        (b1, n1, p), (b2, n2, _) = long[k].tolist(), long[k + 1].tolist()
        e1, e2 = b1 + n1, b2 + n2
        top = p.bit_length() - 1
        h, y = hashes.levels[top], b2 + np.arange(p)
        same = np.flatnonzero((h[y] == h[e1 - p]) & (h[y + p - (1 << top)] == h[e1 - (1 << top)]))
        if len(same):
            shift = int(y[same[0]]) - (e1 - p)
            low = 3 * t - 1
            q = np.arange(low + (shift - low) % p, min(6 * t - 2, n1, n2) + 1, p)
            start = np.maximum(b1, b2 - q)
            keep = np.minimum(e1, e2 - q) - start >= q
            places.append(start[keep])
            periods.append(q[keep])
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows start, length, smallest period of all runs of texts that stand one after another.

    `words` are word numbers, with a number of its own after each text; `lengths` (falling) are the texts' words.
    """
    runs = _small(words)
    if not len(lengths) or lengths[0] < 2 * (3 * FIRST - 1):
        return runs
    hashes = _Hashes(words, lengths)
    t = FIRST
    while lengths[0] >= 6 * t - 2:
        pairs = zip(_by_context(hashes, t, hashes.prefix(6 * t - 2), runs), _by_touching(hashes, t, runs), strict=True)
        at, q = (np.concatenate(x) for x in pairs)
        if len(at):
            order = np.lexsort((at, q))
            at, q = at[order], q[order]
            # All proposals agree on 2t words at least, so near ones of one period belong to the same run.
            new = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(at) > 2 * t)])
            at, q = at[new], q[new]
            back = hashes.behind(at, at + q)
            n = back + hashes.ahead(at, at + q) + q
            found = np.stack([at - back, n, q], axis=1)[n >= np.maximum(LEAST, 2 * q)]
            runs = _distinct(np.concatenate([runs, found]))
        t *= 2
    return runs


def _groups(sizes: Iterable[int]) -> Iterable[list[int]]:
    """Numbers of texts, about WORDS words at a time."""
    group, total = [], 0
    for k, n in enumerate(sizes):
        if group and total + n > WORDS:
            yield group
            group, total = [], 0
        group.append(k)
        total += n
    if group:
        yield group


def runs_of_texts(split: list[list[bytes]]) -> list[np.ndarray]:
    """Rows start, length, period (by start, then period) of all runs of each text, given as its words."""
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(split)
    for group in _groups(map(len, split)):
        group.sort(key=lambda k: -len(split[k]))
        lengths = np.array([len(split[k]) for k in group], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        number: dict[bytes, int] = {}
        ids = np.empty(starts[-1], np.int32)
        for k, a, n in zip(group, starts.tolist(), lengths.tolist(), strict=False):
            ids[a : a + n] = [number.setdefault(w, len(number)) for w in split[k]]
        ids[starts[1:] - 1] = -1 - np.arange(len(group))
        runs = find_runs(ids, lengths)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        text = np.searchsorted(starts, runs[:, 0], side="right") - 1
        runs[:, 0] -= starts[text]
        cuts = np.searchsorted(text, np.arange(len(group) + 1))
        for i in np.unique(text):
            out[group[i]] = runs[cuts[i] : cuts[i + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, with_texts: bool = False,
) -> DataFrame:
    """The runs of each row of `docs`; no shuffle. Words are parted by ASCII white space.

    doc_id, n_runs; start (a word number from 0), length, period and exponent_milli (1000 * length / period, rounded down) of the
    longest run (then that of smallest start, then period; without runs four nulls); runs_sha256 (of `start,length,period` and
    a line feed of every run) and collapsed_sha256 (of the words that no run holds after its first period, joined by spaces). With
    `with_texts` also runs (the structs) and collapsed (the text). `edit` may change the words of a row first.

    A null or empty text has no words and no runs. A null doc_id stays null; repeated rows give repeated rows; no other column is read.
    """
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = [(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in COLUMNS.split(", "))]
    extra = [("runs", pa.list_(triple)), ("collapsed", pa.string())] if with_texts else []
    schema = pa.schema(fields + extra)

    def run(batches):
        for b in pieces(batches):
            ids = b.column(0).to_pylist()
            split = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            if edit:
                split = list(map(edit, ids, split))
            rows = []
            for i, words, runs in zip(ids, split, runs_of_texts(split), strict=True):
                best = (None,) * 4
                if len(runs):
                    start, length, period = runs[np.argmax(runs[:, 1])].tolist()
                    best = (start, length, period, 1000 * length // period)
                lines = "".join("%d,%d,%d\n" % (*r,) for r in runs.tolist()).encode()
                left = b" ".join(collapsed(words, runs))
                row = (i, len(runs), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(left).hexdigest())
                if with_texts:
                    row += ([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], left.decode())
                rows.append(row)
            yield batch(schema, *map(list, zip(*rows, strict=True)))

    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_texts else ""
    return plain_texts(docs, id_col, text_col).mapInArrow(run, COLUMNS + more)
