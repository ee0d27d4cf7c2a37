"""Token ids packed into rows of fixed length by best-fit decreasing, written as binary matrices.

Documents are encoded, those longer than a row are cut into full rows and a rest, and the pieces are
put, longest first, each into the open row with the least room that still holds it. That row is found by
descending a segment tree over amounts of room. Packing goes by windows of a partition's tokens: memory
is bounded, nothing is shuffled, and a lost task packs the same documents the same way again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.bpe import encoder, vocabulary
from barloom.llm.common import batch, texts

ROW = 2048
# Tokens packed together.
WINDOW = 4_000_000
PAD = 50256  # free in the vocabulary


class Room:
    """Open rows by the room left in them: a segment tree over 0 ... size that tells where rows are."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room from `need` on, and that room; it is open no longer."""
        node = need + self.leaves
        if not self.count[node]:
            # Up to the first subtree on the right that has rows, then down its left side.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], size: int) -> list[list[int]]:
    """Rows of piece numbers, by best-fit decreasing; no size is above `size`. Equal pieces go in order."""
    rows: list[list[int]] = []
    room = Room(size)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = room.take(sizes[k])
        if found:
            row, left = found
        else:
            row, left = len(rows), size
            rows.append([])
        rows[row].append(k)
        if left > sizes[k]:
            room.put(left - sizes[k], row)
    return rows


def pack_window(docs: list[tuple[int | None, np.ndarray]], size: int, pad: int, kind: np.dtype):
    """Columns of the packed rows of some encoded documents; documents without tokens take no room."""
    pieces = [(i, at, ids[at : at + size]) for i, ids in docs for at in range(0, len(ids), size)]
    for row in best_fit([len(p[2]) for p in pieces], size):
        chosen = [pieces[k] for k in row]
        ends = np.cumsum([len(p[2]) for p in chosen])
        ids = np.full(size, pad, kind)
        ids[: ends[-1]] = np.concatenate([p[2] for p in chosen])
        positions = np.zeros(size, kind)
        starts = np.concatenate([[0], ends[:-1]])
        positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(starts, np.diff(np.append(starts, ends[-1])))
        yield ids.tobytes(), positions.tobytes(), [0, *ends.tolist()], [p[0] for p in chosen], [p[1] for p in chosen]


SCHEMA = pa.schema([
    ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))])


def pack(docs: DataFrame, path: str | None = None, size: int = ROW, window: int = WINDOW, pad: int = PAD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of all documents.

    input_ids: `size` token ids, little-endian, in 2 bytes each (4 if the vocabulary or `size` needs it),
    padded with `pad`. position_ids: likewise, beginning at 0 with each piece, 0 in the padding. cu_seqlens: where the
    pieces begin and the last ends. doc_ids, doc_offsets: the document of each piece and its first token there; put
    together by these, the pieces are the documents' tokens. A null or empty text has no tokens and no
    piece; a null doc_id stays null; repeated rows are packed as often.
    """
    path = path or vocabulary()

    def run(batches):
        c = encoder(path)
        kind = np.dtype("<u2" if max(c.max_token_value, pad, size) < 1 << 16 else "<u4")
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def out():
            rows = list(pack_window(held, size, pad, kind))
            held.clear()
            for i in range(0, len(rows), 1024):
                yield batch(SCHEMA, *([r[k] for r in rows[i : i + 1024]] for k in range(5)))

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = c.encode_to_numpy(text or "", disallowed_special=()).astype(kind)
                held.append((i, ids))
                tokens += len(ids)
                if tokens >= window:
                    yield from out()
                    tokens = 0
        yield from out()

    return texts(docs, id_col, text_col).mapInArrow(
        run, "input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_offsets array<long>")
