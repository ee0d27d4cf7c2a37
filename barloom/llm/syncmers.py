"""Document fingerprints of closed syncmers, compared by the order in which their anchors stand.

A substring of K characters is an anchor if the least hash among its substrings of S characters stands at its
start or its end. That depends on the K characters alone, so a passage has the same anchors in any text, and any
K - S + 1 substrings of K characters that follow one another hold one. A fingerprint lists the anchors of a whole text: their hashes
and how far each stands behind the one before. Two fingerprints are as alike as the share of their anchors that can be
matched in one order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batch, pieces, plain_texts

K, S = 48, 12
DIGITS = 10  # hex digits of an anchor: 8 of its hash, 2 of its distance from the one before

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def _substrings(h: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all substrings of each of the sizes, made of the substrings of powers of two; `h` has those of one character."""
    power, width, made = int(_A), 1, {}
    parts: dict[int, tuple[np.ndarray, np.uint64]] = {1: (h, _A)}
    while 2 * width <= max(sizes):
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % 2**64, 2 * width
        parts[width] = h, np.uint64(power)
    for size in sizes:
        whole, length = None, 0
        for w in sorted(parts, reverse=True):
            if size & w:
                part, factor = parts[w]
                whole = part if whole is None else whole[: len(part) - length] * factor + part[length:]
                length += w
        made[size] = whole
    return [made[s] for s in sizes]


def anchors(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the anchors of each text, given as its code points.

    A text shorter than K has one anchor at 0, the hash of all of it; an empty one has none.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    points = np.concatenate([*texts, np.zeros(K, np.uint32)]).astype(np.uint64)
    inner, outer = _substrings(_mixed(points * _A + _A), (S, K))
    inner = _mixed(inner)
    least, width, span = inner, 1, K - S + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    closed = (least == inner[: len(least)]) | (least == inner[span - 1 :])
    at = np.flatnonzero(closed)
    text = np.searchsorted(starts, at, side="right") - 1  # of empty texts at the same place the last, which holds it if any does
    inside = at + K <= starts[text] + sizes[text] if len(texts) else np.zeros(0, bool)
    at, text = at[inside], text[inside]
    hashes = (_mixed(outer[at]) >> np.uint64(32)).astype(np.uint32)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for k, points_of in enumerate(texts):
        if 0 < len(points_of) < K:
            whole = hashlib.blake2b(points_of.tobytes(), digest_size=4).digest()
            out.append((np.zeros(1, np.int64), np.frombuffer(whole, np.uint32)))
        else:
            part = slice(cuts[k], cuts[k + 1])
            out.append((at[part] - starts[k], hashes[part]))
    return out


def written_out(places: np.ndarray, hashes: np.ndarray) -> str:
    """The fingerprint: DIGITS hex digits an anchor."""
    rows = np.empty((len(places), 5), np.uint8)
    rows[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4] = np.diff(places, prepend=0)
    return rows.tobytes().hex()


def read_back(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, DIGITS // 2)
    return np.cumsum(rows[:, 4], dtype=np.int64), np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the anchors matched over all anchors, of two rows of hashes in the order of their places.

    The nth anchor of a hash matches the nth of the same hash, and matches keep the order on both sides: the longest rising
    row of them counts. Equal rows give 1, also two empty ones.
    """
    if np.array_equal(a, b):
        return 1.0
    rest: dict[int, list[int]] = {}
    for place, h in enumerate(b.tolist()):
        rest.setdefault(h, []).append(place)
    rest = {h: iter(places) for h, places in rest.items()}
    tails: list[int] = []
    for h in a.tolist():
        place = next(rest[h], None) if h in rest else None
        if place is None:
            continue
        if not tails or place > tails[-1]:
            tails.append(place)
        else:
            tails[bisect_left(tails, place)] = place
    return 2 * len(tails) / (len(a) + len(b))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of each row of `docs`; no shuffle.

    A null or empty text has no characters and an empty fingerprint. A null doc_id stays null; repeated rows give repeated rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in pieces(batches):
            found = list(map(code_points, b.column(1).to_pylist()))
            yield batch(schema, b.column(0), list(map(len, found)), [written_out(*x) for x in anchors(found)])

    return plain_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, extra, doc_id, text: all rows in ranges of ascending doc_id, sorted; each part ends with a copy (extra = 1) of the row that follows.

    After the last row comes the first. A null doc_id comes first; rows of one doc_id stand by a hash of their text, so
    many of them are still cut into several parts unless their texts are equal too. The first row's doc_id and hash of
    every part reach the driver, never a text. Whole texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = plain_texts(docs, id_col, text_col).select(
        F.col("doc_id").isNotNull().alias("given"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("h"), "text")
    # More parts than tasks, so that tasks get even shares of them.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select("given", "i", "h").repartitionByRange(parts, "given", "i", "h")
    found = ranges.groupBy(F.spark_partition_id()).agg(F.min(F.struct("given", "i", "h")).alias("p")).collect()
    firsts = sorted((r.p.given, r.p.i, r.p.h) for r in found)
    before = {p: (k - 1) % len(firsts) for k, p in enumerate(firsts)}
    schema = pa.schema([("part", pa.int32()), ("extra", pa.int32()), ("given", pa.bool_()), ("i", pa.int64()), ("h", pa.int64()), ("text", pa.string())])

    def deal(batches):
        copied = set()
        for b in pieces(batches, 3):
            keys = list(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True))
            part = [bisect_right(firsts, k) - 1 for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([0] * len(part), pa.int32()), *b.columns], schema=schema)
            # Rows equal in doc_id and text: one copy of a task is enough, and the first that arrives is taken.
            again = [n for n, k in enumerate(keys) if k in before and not (k in copied or copied.add(k))]
            if again:
                some = b.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([pa.array([before[keys[n]] for n in again], pa.int32()), pa.array([1] * len(again), pa.int32()), *some.columns], schema=schema)

    dealt = rows.mapInArrow(deal, "part int, extra int, given boolean, i long, h long, text string")
    return dealt.repartition("part").sortWithinPartitions("part", "extra", "given", "i", "h").select(
        "part", "extra", F.when(F.col("given"), F.col("i")).alias("doc_id"), "text")


class _Text(NamedTuple):
    extra: int
    doc_id: int | None
    text: str
    points: np.ndarray
    places: np.ndarray
    hashes: np.ndarray


def edited_anchors(pairs: list[tuple[_Text, _Text]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Anchors of each first text with its last half replaced from the second.

    Anchors need no context, so those of both texts that lie within their parts are kept, and only the seam is searched.
    """
    seams, keep = [], []
    for one, other in pairs:
        half = len(one.points) // 2
        left, right = len(one.points) - half, min(half, len(other.points))
        from_, to = (0, left + right) if left + right < K else (max(0, left - K + 1), left + min(right, K - 1))
        seams.append(np.concatenate([one.points[from_:left], other.points[: to - left]]))
        keep.append((from_, left, right))
    out = []
    for (one, other), seam, (places, hashes), (from_, left, right) in zip(pairs, seams, anchors(seams), keep, strict=True):
        if len(seam) < K and left + right >= K:
            places, hashes = places[:0], hashes[:0]
        a, z = one.places <= left - K, other.places <= right - K
        out.append((np.concatenate([one.places[a], places + from_, other.places[z] + left]), np.concatenate([one.hashes[a], hashes, other.hashes[z]])))
    return out


COLUMNS = (("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"),
           ("near_edited", "double"), ("near_next", "double"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each row's text and of an edit of it: its last half (rounded down) replaced by as much of the start of the next row's text.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness of its fingerprint to that of the edit
    and of the next text). The order is that of `beside_next`; the only row of a table is its own next. A null text is empty; two
    empty fingerprints are alike (1), an empty and another are not (0). A null doc_id stays null; repeated rows give repeated rows.
    """
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in COLUMNS])

    def run(batches):
        held: list[_Text] = []  # the last row, whose next is in the next piece
        for b in pieces(batches, 3):
            columns = (c.to_pylist() for c in b.columns[1:])
            given = [(extra, i, text or "", code_points(text)) for extra, i, text in zip(*columns, strict=True)]
            rows = held + [_Text(*g, *found) for g, found in zip(given, anchors([g[3] for g in given]), strict=True)]
            held = [] if rows[-1].extra else rows[-1:]
            pairs = [(a, z) for a, z in zip(rows, rows[1:], strict=False) if not a.extra]
            if not pairs:
                continue
            out = []
            for (a, z), (places, hashes) in zip(pairs, edited_anchors(pairs), strict=True):
                half = len(a.text) // 2
                edited = a.text[: len(a.text) - half] + z.text[:half]
                out.append((a.doc_id, len(a.text), hashlib.sha256(edited.encode()).hexdigest(), written_out(a.places, a.hashes),
                            written_out(places, hashes), likeness(a.hashes, hashes), likeness(a.hashes, z.hashes)))
            yield batch(schema, *map(list, zip(*out, strict=True)))

    return beside_next(docs, id_col, text_col).mapInArrow(run, ", ".join(map(" ".join, COLUMNS)))
