import random
from itertools import combinations

import numpy as np
import xxhash

from barloom.llm import simhash
from barloom.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, radius):
    """Smallest member of the component of each value."""
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= radius:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in parent}


def brute(rows, radius=4):
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    roots = brute_roots({f for _, f in fps}, radius)
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(roots[f])) for i, f in fps), key=str)


def test_odd_rows(odd, odd_rows):
    assert sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=str) == brute(odd_rows)


def test_documents(sample, sample_rows):
    assert sorted((tuple(r) for r in simhash.near_duplicates(sample).collect()), key=str) == brute(sample_rows)


def test_one_of_each(odd, odd_rows):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    roots = brute_roots({brute_fingerprint(t) for _, t, *_ in odd_rows}, 4)
    best = {}
    for i, t, *_ in odd_rows:
        root = roots[brute_fingerprint(t)]
        best[root] = min(best.get(root, (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, _ in rows) == sorted(best.values())
    assert len({roots[brute_fingerprint(t)] for _, t in rows}) == len(rows) == len(best)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0


def clustered(rng, n, width=64):
    """Values around some centres, near and far."""
    centres = [rng.getrandbits(width) for _ in range(5)]
    return sorted({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(n)})


def test_planes_and_counters():
    rng = random.Random(1)
    for radius in (0, 1, 3, 4, 7):
        a = np.array(clustered(rng, 300), np.uint64)
        b = np.array([int(x) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))) for x in a], np.uint64)
        near = simhash.near_pairs(a, b, radius)
        assert near.tolist() == [(int(x) ^ int(y)).bit_count() <= radius for x, y in zip(a, b, strict=True)]


def test_large_and_small_buckets_connect_the_same():
    rng = random.Random(2)
    for n in (2, 3, 63, 64, 65, 700):
        values = np.array(clustered(rng, n), np.uint64)
        bucket = np.array([i % 3 for i in range(len(values))])
        order = np.argsort(bucket, kind="stable")
        for a, b in (simhash.links_of_large(values, 4), simhash.links_of_buckets(np.zeros(len(values), np.int64), values, 4)):
            assert all((int(x) ^ int(y)).bit_count() <= 8 for x, y in zip(a, b, strict=True))
            linked = joined({int(v) for v in values}, zip(a.tolist(), b.tolist(), strict=True))
            assert linked == brute_roots({int(v) for v in values}, 4)
            assert len(a) <= 8 * n + simhash.QUERIES**2
        a, b = simhash.links_of_buckets(bucket[order], values[order], 4)
        expected = {}
        for k in range(3):
            expected |= brute_roots({int(v) for v in values[bucket == k]}, 4)
        assert joined({int(v) for v in values}, zip(a.tolist(), b.tolist(), strict=True)) == expected


def test_single_bridges_between_large_clusters():
    """Both ends of the only link wait for their turn as queries, in different batches."""
    rng = random.Random(6)
    for n in (40, 150):
        a, bits = rng.getrandbits(64), rng.sample(range(64), 64)
        b = a ^ sum(1 << k for k in bits[:12])
        x, y = a ^ sum(1 << k for k in bits[:4]), a ^ sum(1 << k for k in bits[:8])
        around = [sum(1 << k for k in rng.sample(bits[12:], 2)) for _ in range(2 * n)]
        one, other = ({c ^ f for f in part} for c, part in ((a, around[:n]), (b, around[n:])))
        values = [a, b, *one, x, *other, y]
        assert len(set(brute_roots(values, 4).values())) == 1 and len(set(brute_roots(set(values) - {x}, 4).values())) == 2
        u, v = simhash.links_of_large(np.array(values, np.uint64), 4)
        assert joined(values, zip(u.tolist(), v.tolist(), strict=True)) == brute_roots(values, 4)
        assert len(u) < len(values)


def test_large_buckets_in_blocks(spark):
    """Buckets far larger than a block, of near and far values, are cut without losing a link; no bucket stays large."""
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(40, 64), rng.randint(0, 8))) for _ in range(1500)}
    signed = {int(np.uint64(v).astype(np.int64)): v for v in values}
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(4)
    for block in (64, 400):
        sizes = [r["count"] for r in simhash.dealt_out(distinct, 4, 3, block).groupBy("bucket").count().collect()]
        assert max(sizes) <= 3 * block
        found = [(signed[r.u], signed[r.v]) for r in simhash.links(distinct, block=block).collect()]
        assert all((a ^ b).bit_count() <= 8 for a, b in found)
        assert joined(signed.values(), found) == brute_roots(signed.values(), 4)
    assert max(r["count"] for r in simhash.dealt_out(distinct, 4, 3, None).groupBy("bucket").count().collect()) > 350


def joined(nodes, links):
    root = {n: n for n in nodes}
    links = list(links)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    mixed = [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    links = chain + star + mixed + [(5, 5), (1, 2), (2, 1), (None, 4)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == joined({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_every_near_pair_shares_a_bucket():
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    rng = random.Random(4)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)
