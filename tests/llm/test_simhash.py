import random
import re

import numpy as np
import xxhash

from tidegauge.llm import simhash


def fingerprint(text, n=4, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), seed) for i in range(max(1, len(words) - n + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, limit):
    """Smallest id reachable from every (id, print), by all pairs; equal ids are one document, None is none."""
    parent = {d: d for d, _ in prints if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    known = [(d, p) for d, p in prints if d is not None]
    values = np.array([p for _, p in known], np.uint64)
    for k, (d, p) in enumerate(known):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ np.uint64(p)) <= limit):
            a, b = root(d), root(known[j][0])
            parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in parent}


def brute(rows, n=4, limit=4):
    prints = [(d, fingerprint(t, n)) for d, t in rows]
    found = classes(prints, limit)
    return sorted(((d, f"{p:016x}", found.get(d)) for d, p in prints), key=str)


def rows_of(df, *args):
    return sorted((tuple(r) for r in simhash.near_duplicates(df, *args).collect()), key=str)


def clouds(rng, n):
    """Random fingerprints and chains of neighbours a few bits apart."""
    out = []
    while len(out) < n:
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            out.append(p)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                p ^= 1 << b
    return list(enumerate(dict.fromkeys(out)))


def linked(spark, prints, limit=4):
    df = spark.createDataFrame([(d, int(np.uint64(p).astype(np.int64))) for d, p in prints], "id bigint, print bigint")
    got = {r.node: r.component for r in simhash.components(simhash.links(df.repartition(5), limit)).collect()}
    return {d: got.get(d, d) for d, _ in prints}


def test_against_all_pairs(spark, copies):
    df = spark.createDataFrame(copies, "doc_id bigint, text string").repartition(6)
    for n, limit in ((4, 4), (2, 12)):
        assert rows_of(df, n, limit) == brute(copies, n, limit)


def test_awkward_rows(awkward, nothing):
    assert rows_of(awkward) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert rows_of(nothing) == []


def test_routing_loses_no_pair(spark, monkeypatch):
    """Many small shards, cut over several rounds, with blocks of owners and visitors."""
    prints = clouds(random.Random(5), 1500)
    expected = classes(prints, 4)
    assert linked(spark, prints) == expected
    for name, value in (("OWNED", 64), ("VISITORS", 50), ("LEAF", 8), ("SAMPLE", 300), ("SALT_ROWS", 200)):
        monkeypatch.setattr(simhash, name, value)
    assert linked(spark, prints) == expected


def test_cloud_that_no_tree_cuts(spark, monkeypatch):
    """All fingerprints within a few bits of one: blocks against blocks."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = list(enumerate({centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([3, 6, 9]))) for _ in range(400)}))
    expected = classes(prints, 4)
    monkeypatch.setattr(simhash, "OWNED", 40)
    monkeypatch.setattr(simhash, "VISITORS", 60)
    assert linked(spark, prints) == expected


def test_triangle_bounds():
    """Every pair within the limit meets in a leaf where one is at home, in the tree of one of the parts."""
    prints = np.array([p for _, p in clouds(random.Random(7), 600)], np.uint64)
    met = set()
    for part in range(simhash.PARTS):
        tree = simhash.Tree.fit(prints, part, 4, 10)
        assert tree.leaves > 10
        for _, held, home in tree.visits(prints):
            met |= {(int(a), int(b)) for a in held[home] for b in held}
    near = {(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4).tolist()}
    assert near <= met and len(met) < 0.9 * len(prints) ** 2
