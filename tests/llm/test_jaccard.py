import random
import re

from tidegauge.llm import jaccard
from tidegauge.llm.components import components
from tidegauge.llm.jaccard import near_duplicates


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n=5, percent=80):
    sets = [(d, shingles(t, n)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and None not in (a, b) and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), d if d is None else root(d)) for d, s in sets), key=str)


def rows_of(df, *args):
    return sorted((tuple(r) for r in near_duplicates(df, *args).collect()), key=str)


def test_against_all_pairs(spark, copies):
    df = spark.createDataFrame(copies, "doc_id bigint, text string").repartition(6)
    for n, percent in ((5, 80), (1, 60), (3, 100)):
        assert rows_of(df, n, percent) == brute(copies, n, percent)


def test_awkward_rows(awkward, nothing):
    assert rows_of(awkward) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert rows_of(nothing) == []


def test_blocks_and_borderline_families(spark, monkeypatch):
    """Chains at the threshold, split into blocks of few documents, shared by a hot passage."""
    rng = random.Random(3)
    hot = [f"hot{k}" for k in range(30)]
    rows, words = [], [f"w{k}" for k in range(60)]
    for d in range(150):
        if d % 3 == 0:
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
            rows.append((d, " ".join(words)))
        else:
            rows.append((d, " ".join(hot + [f"x{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(25))])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for block in (4096, 8):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert rows_of(df, 2, 80) == brute(rows, 2, 80)


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 102), (102, 101), (100, 100), (100, 102)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_crowded_shingles_and_large_families(spark, monkeypatch):
    """Shingles of more documents than a block, in lists of their own, and families that take two rounds."""
    rng = random.Random(11)
    bases = [[f"b{k}w{j}" for j in range(40)] for k in range(3)]
    rows = []
    for d in range(160):
        words = list(bases[0] if d % 2 else bases[1 + d % 4 // 2])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
        rows.append((d, " ".join(words[:rng.randrange(33, 41)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for block in (64, 16):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "LEAD_ROWS", block)
        assert rows_of(df, 3, 80) == brute(rows, 3, 80)
    order = jaccard.shingle_order(df, 3)
    held = jaccard.np.concatenate([s for t in rows for s in jaccard.T.shingle_sets(*jaccard.T.buffer_of(jaccard.pa.array([t[1]])), 3)])
    values, counts = jaccard.np.unique(held, return_counts=True)
    assert jaccard.crowded(values[counts > block], order).all()


def test_rounds_connect_what_all_pairs_would(spark):
    """Members of a group meet in the first round or, if their classes differ still, in the second."""
    members = spark.createDataFrame([(g, k * 3 + g) for g in (0, 1) for k in range(50)], "grp bigint, id bigint")
    first = {}
    for r in jaccard.around_first(members, 8).collect():
        first.setdefault((r.grp, r.cell), set()).add(r.id)
    classes = spark.createDataFrame([(i, 0 if i < 90 else i) for i in range(0, 150, 3)], "node bigint, component bigint")
    second, known = {}, {}
    for r in jaccard.outside_largest(members, classes, 8).collect():
        second.setdefault((r.grp, r.a, r.b), set()).add(r.id)
        known[r.grp, r.id] = r.known
    assert max(map(len, second.values())) < 50
    for g in (0, 1):
        ids = [k * 3 + g for k in range(50)]
        for x in ids:
            for y in ids:
                assert known[g, x] == known[g, y] or any(x in c and y in c for k, c in second.items() if k[0] == g)
    assert all(i in set().union(*first.values()) for i in known.values())
