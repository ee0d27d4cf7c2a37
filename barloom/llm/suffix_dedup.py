"""Repeated byte strings across a corpus, by suffix arrays of what may repeat.

A window is WIDTH bytes. Each window has an anchor: of the grams of GRAM bytes in it, the one with the
smallest hash, the leftmost of equals. Equal windows have equal anchors, so windows are dealt out by
anchor, as segments of neighbouring windows that share one. Equal segments are settled by their hashes,
before and after the shuffle: the earliest stays. Only anchors with several different segments remain,
such as at the edges of a repeated passage. Their segments, but for those whose neighbourhood of the anchor
is nobody else's, are sorted as suffixes in two stages: suffixes smaller
than their successors directly, the others induced by a scan over buckets; neighbours with a common
prefix of WIDTH bytes are equal windows, and all but the earliest repeat.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batch, texts, written

WIDTH = 100
GRAM = 24
_GRAMS = WIDTH - GRAM + 1  # grams in a window
# Windows of one document looked at together, and segments compared in a task before the shuffle.
CHUNK = 1 << 19
FLUSH = 1 << 20
# An anchor with more different segments than this is settled window by window, which is dealt out further.
HOT = 10_000
# Bytes sorted as one suffix array.
BLOCK = 1 << 20
_B, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 20) - 1)
_HALF = (WIDTH - GRAM) // 2
_KEYS = "anchor long, seg long, id long, part int, start long, n int, at int"
_SCHEMA = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])
_GONE = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int32())])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    def join(a: np.ndarray, b: np.ndarray, width: int, of_b: int) -> np.ndarray:
        n = len(data) - width - of_b + 1
        return a[:n] * np.uint64(pow(_B, of_b, 1 << 64)) + b[width : width + n]

    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = join(h1, h1, 1, 1)
    h4 = join(h2, h2, 2, 2)
    h8 = join(h4, h4, 4, 4)
    return _mixed(join(join(h8, h8, 8, 8), h8, 16, 8))


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and the anchor's place from there of each segment of a document."""
    found = []
    array = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - WIDTH + 1, CHUNK):
        h = gram_hashes(array[at : at + CHUNK + WIDTH - 1])
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= _GRAMS:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(h) - _GRAMS + 1], least[_GRAMS - span :])
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((h[place[first]], first + at, np.diff(np.append(first, len(place))), place[first] - first))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _settled(anchor, seg, doc, part, start, n, at):
    """Rows with all but the earliest of equal segments marked: n below 0, and dealt out by place instead of anchor."""
    order = np.lexsort((start, part, doc, seg, anchor))
    anchor, seg, doc, part, start, n, at = (x[order] for x in (anchor, seg, doc, part, start, n, at))
    again = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (seg[1:] == seg[:-1])])
    elsewhere = _mixed(doc.view(np.uint64) * np.uint64(_B) + start.view(np.uint64)).view(np.int64)
    return batch(_SCHEMA, np.where(again, elsewhere, anchor), np.where(again, 0, seg), doc, part, start, np.where(again, -n, n).astype(np.int32), at.astype(np.int32))


class _Buffer:
    """Rows of segments, settled every FLUSH rows."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, anchor, seg, doc, part, start, n, at):
        size = len(start)
        self.parts.append((anchor, seg, np.full(size, doc, np.int64), np.full(size, part, np.int32), start, n, at))
        self.rows += size

    def out(self, least: int = 0):
        if self.parts and self.rows >= least:
            yield _settled(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts, self.rows = [], 0


def _anchored(rows: DataFrame) -> DataFrame:
    def run(batches):
        held = _Buffer()
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for doc, part, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = (text or "").encode()
                anchor, start, n, at = segments(data)
                seg = [digest(data[a:e]) for a, e in zip(start.tolist(), (start + n + WIDTH - 1).tolist(), strict=True)]
                held.add(anchor.view(np.int64), np.array(seg, np.uint64).view(np.int64), doc, part, start, n, at)
                yield from held.out(FLUSH)
        yield from held.out()

    return rows.mapInArrow(run, _KEYS)


def _sifted(rows: DataFrame) -> DataFrame:
    """Rows as before, with n below 0 where an equal segment is earlier, and else only those whose anchor has several segments."""
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "seg", "id", "part", "start")

    def run(batches):
        held, multiple = None, False
        for b in batches:
            table = [c.to_numpy() for c in b.columns]
            done = table[5] < 0
            if done.any():
                yield batch(_SCHEMA, *(c[done] for c in table))
            table = [c[~done] for c in table]
            if held is not None:
                table = [np.concatenate([h, c]) for h, c in zip(held, table, strict=True)]
            if not len(table[0]):
                continue
            anchor, seg = table[0], table[1]
            first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])])
            yield batch(_SCHEMA, *(c[~first] for c in table[:5]), -table[5][~first], table[6][~first])
            kept = [c[first] for c in table]
            same = kept[0][1:] == kept[0][:-1]
            several = np.concatenate([[multiple], same]) | np.concatenate([same, [False]])
            several_but_last = several[:-1]
            yield batch(_SCHEMA, *(c[:-1][several_but_last] for c in kept))
            held, multiple = [c[-1:] for c in kept], bool(several[-1])
        if held is not None and multiple:
            yield batch(_SCHEMA, *held)

    return dealt.mapInArrow(run, _KEYS)


def suffix_array(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of some strings in order, and the strings joined with an end mark after each (characters are 1 more than bytes, marks 0).

    A mark is smaller than any character; marks count by place.
    """
    text = np.concatenate([np.concatenate([np.frombuffer(p, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]) for p in parts])
    n = len(text)
    # Smaller than the successor: the first character that differs from its successor decides.
    step = np.diff(text, append=np.int16(0))
    decides = np.where(step != 0, np.arange(n), n - 1)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    small = step[decides] > 0
    marks = np.flatnonzero(text == 0)
    small[marks] = False
    joined = b"\0".join(parts) + b"\0"
    ends = marks[np.searchsorted(marks, np.arange(n))]
    direct = np.flatnonzero(small)
    last = ends[direct].tolist()
    keys = [joined[a:b] for a, b in zip(direct.tolist(), last, strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]  # stable: equals by place
    del keys
    # Buckets by first character: the induced suffixes in front, the directly sorted ones behind.
    sizes = np.bincount(text, minlength=257)
    ends_of = np.cumsum(sizes)
    order = np.full(n, -1, np.int64)
    order[: len(marks)] = marks
    chars = text[direct]
    count = np.bincount(chars, minlength=257)
    order[ends_of[chars] - count[chars] + np.arange(len(direct)) - (np.cumsum(count) - count)[chars]] = direct
    sa, heads = order.tolist(), (ends_of - sizes).tolist()
    letters = text.tolist()
    large = (~small & (text != 0)).tolist()
    for j in range(n):
        i = sa[j] - 1
        if i >= 0 and large[i]:
            c = letters[i]
            sa[heads[c]] = i
            heads[c] += 1
    return np.array(sa, np.int64), text


def common_prefixes(order: np.ndarray, text: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it, up to `limit`; marks are never equal."""
    padded = np.concatenate([text, np.full(limit + 1, -1, np.int16)])
    lcp = np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    for k in range(limit):
        a = padded[order[going] + k]
        going = going[(a == padded[order[going - 1] + k]) & (a > 0)]
        if not len(going):
            break
        lcp[going] += 1
    return lcp


def repeats(parts: list[bytes], rank: np.ndarray, width: int) -> list[np.ndarray]:
    """For each string the places of windows that also stand earlier; `rank` orders the strings, equal places by place."""
    if not parts:
        return []
    order, text = suffix_array(parts)
    lcp = common_prefixes(order, text, width)
    run = np.cumsum(lcp < width)
    lengths = np.array([len(p) + 1 for p in parts])
    owner = np.repeat(np.arange(len(parts)), lengths)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = (rank[owner].astype(np.int64) << 32) + inside
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    earliest = np.repeat(np.minimum.reduceat(key[order], starts), np.diff(np.append(starts, len(order))))
    again = np.zeros(len(text), bool)
    again[order] = key[order] != earliest
    return [inside[s][again[s]] for s in (slice(e - n, e) for e, n in zip(np.cumsum(lengths), lengths, strict=True))]


def _cut(listed: DataFrame, rows: DataFrame, each, schema: str) -> DataFrame:
    """`each` of every text with its list of segments (anchor, start, n, at)."""
    per_doc = listed.groupBy("id", "part").agg(F.collect_list(F.struct("anchor", "start", "n", "at")).alias("found"))

    def run(batches):
        for b in batches:
            yield from each(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))

    # All columns, so that the final join reads the same shuffle of the texts.
    return rows.join(per_doc, ["id", "part"]).select("id", "part", "text", "found", "unnamed").mapInArrow(run, schema)


def _may_repeat(rows: list[tuple]) -> list[tuple]:
    """Segments that share the anchor and _HALF bytes before or behind it with another; a window holds one of these whole."""
    sides = [[(r[0], r[5][r[4] - _HALF : r[4]]) if r[4] >= _HALF else None for r in rows],
             [(r[0], r[5][r[4] + GRAM : r[4] + GRAM + _HALF]) if r[4] + GRAM + _HALF <= len(r[5]) else None for r in rows]]
    counts = [Counter(s) for s in sides]
    return [r for r, before, behind in zip(rows, *sides, strict=True) if before and counts[0][before] > 1 or behind and counts[1][behind] > 1]


def _by_suffixes(listed: DataFrame, rows: DataFrame) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("at", pa.int32()), ("piece", pa.binary())])

    def cut(docs):
        out = []
        for doc, part, text, found in docs:
            data = text.encode()
            out += [(f["anchor"], doc, part, f["start"], f["at"], data[f["start"] : f["start"] + f["n"] + WIDTH - 1]) for f in found]
        yield batch(schema, *([r[k] for r in out] for k in range(6)))

    pieces = _cut(listed, rows, cut, "anchor long, id long, part int, start long, at int, piece binary")
    # Each anchor has at most HOT segments, each below twice WIDTH bytes: no group outgrows a block by much.
    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor", "id", "part", "start")

    def run(batches):
        held, size = [], 0

        def out(rows):
            rows = _may_repeat(rows)
            place = np.array([(r[1], r[2], r[3]) for r in rows], np.int64).reshape(-1, 3)
            rank = np.empty(len(rows), np.int64)
            rank[np.lexsort(place.T[::-1])] = np.arange(len(rows))
            ids = []
            for r, again in zip(rows, repeats([r[5] for r in rows], rank, WIDTH), strict=True):
                cuts = np.flatnonzero(np.diff(again) != 1) + 1
                ids += [(r[1], r[2], r[3] + int(g[0]), len(g)) for g in np.split(again, cuts) if len(g)]
            return batch(_GONE, *([r[k] for r in ids] for k in range(4)))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > BLOCK and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield out(held)

    return dealt.mapInArrow(run, "id long, part int, start long, n int")


def _by_windows(listed: DataFrame, rows: DataFrame) -> DataFrame:
    """The same window by window: each is a segment of its own, and equal ones are settled in tasks before the shuffle."""

    def cut(docs):
        held = _Buffer()
        for doc, part, text, found in docs:
            data = text.encode()
            for f in found:
                start = np.arange(f["start"], f["start"] + f["n"])
                whole = [xxhash.xxh3_128_intdigest(data[a : a + WIDTH]) for a in start.tolist()]
                high, low = (np.array(x, np.uint64).view(np.int64) for x in ([w >> 64 for w in whole], [w & (1 << 64) - 1 for w in whole]))
                held.add(high, low, doc, part, start, np.ones(len(start), np.int64), np.zeros(len(start), np.int64))
            yield from held.out(FLUSH)
        yield from held.out()

    return _sifted(_cut(listed, rows, cut, _KEYS)).where("n < 0").select("id", "part", "start", (-F.col("n")).alias("n"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """id, part, unnamed, text: one row per row of `docs`, and one per document.

    A null id comes before all others. part tells documents of one id apart, by a hash of the text; it is 0 where ids are unique.
    """
    rows = texts(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce("text", F.lit("")).alias("text"))
    many = written(rows.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("many")))
    if many.isEmpty():
        rows = rows.select("id", F.lit(0).alias("part"), "unnamed", "text")
        return rows, rows
    part = F.when(F.col("many"), F.hash("text")).otherwise(0)
    rows = rows.join(many, "id", "left").select("id", part.alias("part"), "unnamed", "text")
    return rows, rows.dropDuplicates(["id", "part"])


def repeated(rows: DataFrame) -> DataFrame:
    """id, part, start, n: windows start ... start + n - 1 of a document also stand earlier. `rows` as by `keyed`."""
    sifted = written(_sifted(_anchored(rows.select("id", "part", "text"))))
    gone = sifted.where("n < 0").select("id", "part", "start", (-F.col("n")).cast("int").alias("n"))
    open_ = sifted.where("n > 0")
    hot = written(open_.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"))
    gone = gone.unionByName(_by_suffixes(open_.join(hot, "anchor", "left_anti"), rows))
    if not hot.isEmpty():
        gone = gone.unionByName(_by_windows(open_.join(hot, "anchor", "left_semi"), rows))
    return gone


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary: the bytes left, if asked for) of each row of `docs`.

    Documents count by doc_id, a null one first; of rows with one doc_id, by a hash of the text, and rows that
    repeat both are one document, all with its result. A null text is an empty one. Texts below WIDTH bytes stay.
    """
    rows, documents = keyed(docs, id_col, text_col)
    per_doc = repeated(documents).groupBy("id", "part").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                        *[("kept", pa.binary())] * with_bytes])

    def run(batches):
        for b in batches:
            out = []
            for doc, unnamed, text, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode()
                change = np.zeros(len(data) + 1, np.int64)
                for g in gone or ():
                    change[g["start"]] += 1
                    change[g["start"] + g["n"] + WIDTH - 1] -= 1
                off = np.cumsum(change)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~off].tobytes() if gone else data
                spans = int(np.count_nonzero(np.diff(off.astype(np.int8), prepend=0) == 1))
                out.append((None if unnamed else doc, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield batch(schema, *([r[k] for r in out] for k in range(len(schema))))

    joined = rows.join(per_doc, ["id", "part"], "left").select("id", "unnamed", "text", "gone")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
