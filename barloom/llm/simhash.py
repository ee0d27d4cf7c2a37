"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in few bits agree on whole blocks of bits, so candidates are those that share
some blocks. Inside such a bucket the fingerprints stand as bit planes: one word of a plane holds one bit
of 64 fingerprints. Their differing bits are counted for all 64 at once by carry-save addition, with
counters that start so that they overflow just beyond the radius; a block stops once all have overflowed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batch, stored, texts, unused, written
from barloom.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
# A fingerprint is cut into RADIUS + SHARED blocks; two within the radius agree on SHARED of them at least.
SHARED = 3
# Shingles that are hashed and summed at a time.
SLAB = 50_000
# Buckets from this size on are compared plane by plane; smaller ones are pooled pair by pair.
LARGE = 64
QUERIES = 32
PAIRS = 1 << 17
# A bucket of more fingerprints than about this is dealt out in chunks of about as many, each pair of chunks apart.
BLOCK = 4096
# Fingerprints of a chunk that are counted to tell how large a bucket is.
COUNTED = 64


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is in over half of the shingle hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII spaces only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[SHINGLE - 1 :].tolist() or [len(line)]
    first = starts[: len(last)].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(last), SLAB):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first[i : i + SLAB], last[i : i + SLAB], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (long: the 64 bits) of each row of `docs`."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield batch(schema, b.column(0), b.column(2), fp.view(np.int64))

    rows = texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def masks(radius: int = RADIUS, shared: int = SHARED) -> list[int]:
    """For each choice of `shared` of radius + shared blocks, the bits of these blocks, as a signed long."""
    n = radius + shared
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [int(np.uint64(sum(chosen)).astype(np.int64)) for chosen in combinations(blocks, shared)]


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: 64 rows of words, bit i of a row is that bit of value i; padded with zeros."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def far(differences, shape, radius: int) -> np.ndarray:
    """Words whose bits tell which sums over the given planes of differing bits exceed the radius."""
    full = np.uint64(2**64 - 1)
    size = radius.bit_length()
    preset = (1 << size) - (radius + 1)
    counter = [np.full(shape, full if preset >> k & 1 else 0, np.uint64) for k in range(size)]
    over = np.zeros(shape, np.uint64)
    for k, carry in enumerate(differences):
        for j in range(size):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        over |= carry
        if k % 8 == 7 and (over == full).all():
            break
    return over


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs a[i], b[i] are within the radius."""
    out = [unpacked(~far(planes(x), -(-len(x) // 64), radius), len(x)) for x in np.array_split(a ^ b, max(1, -(-len(a) // PAIRS)))]
    return np.concatenate(out)


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the labels of the pairs a[i], b[i] in place; which of the pairs joined two that were apart."""
    parent, joins = {}, np.zeros(len(a), bool)

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for i, (x, y) in enumerate(zip(labels[a].tolist(), labels[b].tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[y], joins[i] = x, True
    if parent:
        to = np.arange(len(labels))
        to[list(parent)] = [root(x) for x in parent]
        labels[:] = to[labels]
    return joins


def links_of_large(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within the radius connect, fewer than there are values.

    Each value is a query once, and a target until then, so no pair is missed; only pairs that are
    not connected yet are looked at.
    """
    n, bits = len(values), planes(values)
    full = np.uint64(2**64 - 1)
    waiting, fresh = [], 0
    open_, done, labels = np.ones(n, bool), np.zeros(n, bool), np.arange(n)
    left, right = [], []
    while True:
        queries, waiting = waiting[:QUERIES], waiting[QUERIES:]
        while len(queries) < QUERIES and fresh < n:
            if open_[fresh]:
                queries.append(fresh)
                open_[fresh] = False
            fresh += 1
        if not queries or (labels[~done] == labels[queries[0]]).all():
            break
        q = np.array(queries)
        own = np.where((values[q][None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), full, np.uint64(0))
        over = far((own[k][:, None] ^ bits[k][None, :] for k in range(64)), (len(q), bits.shape[1]), radius)
        near = unpacked(~over, n) & ~done & (labels[q][:, None] != labels)
        done[q] = True
        which, at = np.nonzero(near)
        if len(at):
            first = near.argmax(0)[at]
            nodes, once = np.unique(at, return_index=True)
            met = np.unique(which * len(q) + first)  # queries that meet in a value are linked as well
            a = np.concatenate([q[first[once]], q[met // len(q)]])
            b = np.concatenate([nodes, q[met % len(q)]])
            joins = joined(labels, a, b)
            left.append(a[joins])
            right.append(b[joins])
            new = nodes[open_[nodes]]
            open_[new] = False
            waiting.extend(new.tolist())
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return values[a], values[b]


def links_of_buckets(bucket: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each bucket; equal buckets stand together."""
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(starts, len(bucket)))
    left, right = [], []
    for at, n in zip(starts[sizes >= LARGE], sizes[sizes >= LARGE], strict=True):
        a, b = links_of_large(values[at : at + n], radius)
        left.append(a)
        right.append(b)
    small = (sizes > 1) & (sizes < LARGE)
    starts, sizes = starts[small], sizes[small]
    rows = np.repeat(starts + sizes, sizes)  # for each row of a small bucket, where the bucket ends
    at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    step = 1
    while len(at):
        inside = at + step < rows
        at, rows = at[inside], rows[inside]
        if len(at):
            a, b = values[at], values[at + step]
            hit = near_pairs(a, b, radius)
            left.append(a[hit])
            right.append(b[hit])
        step += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))


def chunks_of_large(distinct: DataFrame, keys, block: int) -> DataFrame:
    """bucket, chunks: into how many chunks each bucket of more than about `block` values of fp is cut, two or more.

    Sizes are told from the values whose hash falls into one of block / COUNTED shares. They decide where pairs
    are compared, never whether.
    """
    share = max(1, block // COUNTED)
    some = distinct.where(F.pmod(F.xxhash64(F.lit("share"), "fp"), F.lit(share)) == 0)
    sizes = some.select(F.explode(keys).alias("bucket")).groupBy("bucket").agg((F.count("*") * share).alias("size"))
    return sizes.where(F.col("size") > block).select("bucket", F.ceil(F.col("size") / block).alias("chunks"))


def dealt_out(distinct: DataFrame, radius: int, shared: int, block: int | None) -> DataFrame:
    """bucket, fp: every two values of fp that agree on all bits of `shared` blocks share a bucket.

    A large bucket becomes one bucket for each pair of its chunks, so no task holds or compares it whole; with no
    `block` buckets stay whole.
    """
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius, shared))))
    if block is None:
        return distinct.select(F.explode(keys).alias("bucket"), "fp")
    large = written(chunks_of_large(distinct, keys, block))  # a table, so that Spark knows whether it is small enough to broadcast
    all_ = distinct.select(F.explode(keys).alias("bucket"), "fp").join(large, "bucket", "left")
    own = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: c != own)
    pairs = F.transform(others, lambda c: F.xxhash64("bucket", F.least(c, own), F.greatest(c, own)))
    return all_.select(F.explode(F.when(F.col("chunks").isNull(), F.array("bucket")).otherwise(pairs)).alias("bucket"), "fp")


def links(distinct: DataFrame, radius: int = RADIUS, shared: int = SHARED, block: int | None = BLOCK) -> DataFrame:
    """u, v: links between the distinct values of fp that connect all that are within the radius.

    A bucket holds distinct fingerprints that agree on all bits of `shared` blocks, never copies; `block` bounds it to
    about twice as many.
    """
    dealt = dealt_out(distinct, radius, shared, block).repartition("bucket").sortWithinPartitions("bucket", "fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        bucket, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            bucket = np.concatenate([bucket, b.column(0).to_numpy()])
            values = np.concatenate([values, b.column(1).to_numpy().view(np.uint64)])
            if not len(bucket):
                continue
            cut = np.searchsorted(bucket, bucket[-1])  # the last bucket may go on in the next batch
            if cut:
                u, v = links_of_buckets(bucket[:cut], values[:cut], radius)
                yield batch(schema, u.view(np.int64), v.view(np.int64))
                bucket, values = bucket[cut:], values[cut:]
        if len(bucket):
            u, v = links_of_buckets(bucket, values, radius)
            yield batch(schema, u.view(np.int64), v.view(np.int64))

    return dealt.mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and fp, root of each distinct one; fingerprints of one component share a root."""
    fps = stored(fingerprints(docs, id_col, text_col))
    distinct = stored(fps.select("fp").distinct())
    found = components(links(distinct, radius))
    member = distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return fps, member


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row of `docs`.

    Copies share a fingerprint and are compared once. A null or empty text has fingerprint zero and is
    linked like any other. A null doc_id keeps a row, and names a component only if that has no other.
    Repeated rows give repeated rows.
    """
    fps, member = groups(docs, radius, id_col, text_col)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(member, "fp")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one of smallest doc_id, with all columns of `docs`.

    Rows without a doc_id come last. Of rows that repeat the same id and text one stays.
    """
    return first_of_each(docs, *groups(docs, radius, id_col, text_col), id_col, text_col)


def first_of_each(docs: DataFrame, fps: DataFrame, member: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of smallest doc_id of each root; `fps` (doc_id, text_hash, fp) are the rows, `member` (fp, root) their groups."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    # Rows per fingerprint first, so that many copies are combined before they meet.
    rows = fps.groupBy("fp", "doc_id", "text_hash").count().groupBy("fp").agg(F.min(place).alias("p"), F.min_by("count", place).alias("n"))
    first = rows.join(member, "fp").groupBy("root").agg(F.min("p").alias("p"), F.min_by("n", "p").alias("n"))
    own_id, own_hash, own_n = (unused(docs, c) for c in ("kept_id", "kept_hash", "kept_n"))
    first = stored(first.select(F.col("p.doc_id").alias(own_id), F.col("p.text_hash").alias(own_hash), F.col("n").alias(own_n)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & F.xxhash64(F.col(text_col).cast("string")).eqNullSafe(F.col(own_hash))
    once = docs.join(first.where(F.col(own_n) == 1), same, "left_semi")
    again = docs.join(first.where(F.col(own_n) > 1), same, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(again)
