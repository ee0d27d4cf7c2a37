"""Benchmark decontamination by the q-gram lemma.

A text of m characters that is altered by at most e edits still shares m - q + 1 - q * e of its q-grams
with the original, all on diagonals at most e apart. So shared q-grams are counted in bands of diagonals
that overlap by half; bands below that bound hold no match. The rest is verified by an alignment that is
confined to the band. Items too short for that are looked for as they are, at word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batch, small_batches, texts

Q = 8
# Share of an item's characters that may be edited.
EDIT_RATE = 0.1
# Shorter items say too little to tell an altered copy from chance; only exact copies of them are searched for.
MIN_CHARS = 32
# Characters of the items that are indexed at a time: the bound of what is shipped to tasks.
BLOCK_CHARS = 2_000_000
SLAB = 1 << 19
# Shared q-grams that are counted at a time.
HITS = 1 << 21
_STEP = 0x9E3779B97F4A7C15
_GAP = np.uint32(0xFFFFFFFF)  # no character
_BITS = 20


def codes(text: str | None) -> np.ndarray:
    """Lower-case characters with each run of white space as one space."""
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le"), np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit number for the Q characters from each place on."""
    h, width = chars.astype(np.uint64), 1
    while width < Q:  # Q is a power of two
        h = h[:-width] * np.uint64(pow(_STEP, width, 1 << 64)) + h[width:] if len(h) > width else h[:0]
        width *= 2
    return h ^ (h >> np.uint64(29))


@dataclass
class Index:
    """The q-grams of a block of items, and what is asked of each item."""

    ids: list[int | None]  # of the items searched by q-grams, then of the short ones
    chars: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    slots: np.ndarray
    short: ahocorasick.Automaton | None

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], rate: float = EDIT_RATE, min_chars: int = MIN_CHARS) -> Index:
        given = [(i, codes(t)) for i, t in items]
        known = [(i, c) for i, c in given if len(c) >= max(min_chars, Q)]
        brief = [(i, c.tobytes().decode("utf-32-le")) for i, c in given if 0 < len(c) < max(min_chars, Q)]
        chars = [c for _, c in known]
        m = np.array([len(c) for c in chars], np.int64)
        edits = np.minimum((rate * m).astype(np.int64), (m - Q) // Q)  # the bound stays positive
        found = [grams(c) for c in chars]
        gram = np.concatenate([*found, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(chars)), [len(g) for g in found])
        place = np.concatenate([*(np.arange(len(g)) for g in found), np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        gram, first = np.unique(gram[order], return_index=True)
        slots = np.zeros(1 << _BITS, bool)
        slots[_slot(gram)] = True
        same: dict[str, list[int]] = {}
        for k, (_, t) in enumerate(brief, len(known)):
            same.setdefault(t, []).append(k)
        short = ahocorasick.Automaton() if same else None
        for t, numbers in same.items():
            short.add_word(t, (t, numbers))
        if short:
            short.make_automaton()
        return cls([i for i, _ in known + brief], chars, edits, m - Q + 1 - Q * edits, gram,
                   np.append(first, len(order)), item[order], place[order], slots, short)

    def hits(self, chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of shared q-grams in a text, their items and places in these, about HITS at a time."""
        for at in range(0, len(chars), SLAB):
            h = grams(chars[at : at + SLAB + Q - 1])
            place = np.flatnonzero(self.slots[_slot(h)])
            k = np.searchsorted(self.gram, h[place])
            k[k == len(self.gram)] = 0
            same = self.gram[k] == h[place]
            place, k = place[same] + at, k[same]
            n = self.first[k + 1] - self.first[k]
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1 if len(n) else ()
            for p, f, c in zip(np.split(place, cuts), np.split(self.first[k], cuts), np.split(n, cuts), strict=True):
                each = np.repeat(f - (np.cumsum(c) - c), c) + np.arange(c.sum())
                yield np.repeat(p, c), self.item[each], self.place[each]


def exact(index: Index, chars: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, start, end, 0 edits) of the first place of each short item where no letter or digit of the text adjoins one of the item."""
    text = chars.tobytes().decode("utf-32-le")
    first: dict[int, tuple[int, int]] = {}
    for last, (t, numbers) in index.short.iter(text) if text else ():
        a, b = last + 1 - len(t), last + 1
        if numbers[0] in first or (a and t[0].isalnum() and text[a - 1].isalnum()) or (b < len(text) and t[-1].isalnum() and text[b].isalnum()):
            continue
        first.update(dict.fromkeys(numbers, (a, b)))
    return [(k, a, b, 0) for k, (a, b) in sorted(first.items())]


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(_STEP)) >> np.uint64(64 - _BITS)


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int] | None:
    """Least edits that turn the pattern into a part of the text on the diagonals low ... low + width, and where
    that part ends (the first such end); None above `most`."""
    m = len(pattern)
    window = np.full(m + width + 1, _GAP, np.uint32)
    a, b = max(low, 0), min(low + m + width + 1, len(text))
    if b > a:
        window[a - low : b - low] = text[a:b]
    step = np.arange(width + 1)
    row = np.zeros(width + 1, np.int64)
    row[: max(0, min(-low, width + 1))] = m + 1  # no part begins before the text
    for i in range(m):
        new = row + (window[i : i + width + 1] != pattern[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
        if row.min() > most:
            return None
    row[step + low + m > len(text)] = m + 1
    k = int(row.argmin())
    return (int(row[k]), low + m + k) if row[k] <= most else None


def matches(index: Index, chars: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits), the first best place of each item in each document.

    `chars` are the documents one after another with a gap behind each; `starts` are their places, with the
    end of the last.
    """
    keys = []
    for place, item, inside in index.hits(chars):
        if not len(place):
            continue
        doc = np.searchsorted(starts, place, "right") - 1
        diagonal = place - starts[doc] - inside
        width = index.edits[item] + 1
        band = diagonal // width  # bands band and band - 1 hold it; each is two widths wide
        pair = doc * len(index.chars) + item
        key = (pair << 32) + band + (1 << 31)
        keys.append(np.unique(np.concatenate([key, key - 1]), return_counts=True))
    if not keys:
        return []
    key, at = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
    count = np.bincount(at, np.concatenate([n for _, n in keys]))
    pair, band = key >> 32, (key & 0xFFFFFFFF) - (1 << 31)
    enough = count >= index.needed[pair % len(index.chars)]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for p, b in zip(pair[enough].tolist(), band[enough].tolist(), strict=True):
        doc, item = divmod(p, len(index.chars))
        pattern, e = index.chars[item], int(index.edits[item])
        text = chars[starts[doc] : starts[doc + 1] - 1]
        low, width = b * (e + 1) - e, 2 * (e + 1) + 2 * e
        found = aligned(pattern, text, low, width, e)
        if found and ((doc, item) not in best or (found[0], found[1]) < (best[doc, item][0], best[doc, item][2])):
            edits, end = found
            # The same backwards from the end gives the start.
            back = aligned(pattern[::-1], text[:end][::-1], -e, 2 * e, e)
            best[doc, item] = (edits, end - (back[1] if back else len(pattern)), end)
    return [(doc, item, start, end, edits) for (doc, item), (edits, start, end) in sorted(best.items())]


def _found(index: Index, column: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    parts = [codes(t) for t in column]
    found = [(doc, *f) for doc, p in enumerate(parts) for f in exact(index, p)] if index.short else []
    if not index.chars:
        return found
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    gap = np.array([_GAP], np.uint32)
    chars = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap[:0]
    return found + matches(index, chars, starts)


def indexes(items: DataFrame, rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
            id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of all items, in blocks of about `block_chars` characters.

    Only one block at a time is on the driver and in tasks, however large the benchmark is; each block is
    one pass over the documents. A single item longer than a block makes a block of its own.
    """
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        found = Index.of(sorted(((r.i, r.t) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), rate, min_chars)
        if len(found.ids):
            yield found


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, start, end, edits: each benchmark item in each document, at its first best place.

    Places count in the lower-case text with single spaces. Documents are read in place, without a shuffle.
    Null and empty texts match nothing; of items below `min_chars` only exact copies at word boundaries are found; repeated rows and items
    give repeated matches; a null doc_id or item_id stays null.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "start", "end", "edits")])
    out = None
    for index in indexes(items, **options):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shipped=shipped):
            for b in batches:
                found = _found(shipped.value, b.column(1).to_pylist())
                ids = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield batch(schema, ids, [shipped.value.ids[f[1]] for f in found], *([f[k] for f in found] for k in (2, 3, 4)))

        part = texts(docs, id_col, text_col).mapInArrow(run, ", ".join(f"`{c}` long" for c in schema.names))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], ", ".join(f"`{c}` long" for c in schema.names))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns; no shuffle.

    Short items count too, and items without an id; a caller who means to keep what is said by chance leaves short items out of `items`.
    """
    for index in indexes(items, **options):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shipped=shipped):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in _found(shipped.value, b.column(b.schema.get_field_index(text_col)).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs
