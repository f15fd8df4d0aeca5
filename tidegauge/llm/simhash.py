"""SimHash fingerprints of documents and their classes, by vantage-point trees over Hamming distance.

1. A document's fingerprint has a bit set where over half of its shingles' XXH64 have it. Equal fingerprints go on as one.
2. Routing trees cut the fingerprints into shards. A node holds a vantage point, a mask and a radius: fingerprints whose masked distance
   from the point is at most the radius go inside, the others outside. Two fingerprints within the limit differ in at most limit // PARTS
   bits of one of the PARTS parts of the fingerprint, so there is one forest for each part, whose nodes measure that part, and
   the whole fingerprint once a part separates no further.
3. A fingerprint is owned by one shard a forest. By the triangle inequality it can only have partners in shards that its ball
   overlaps; it visits those of them with a larger number. Every linked pair meets where one of the two is owned.
4. Within a shard the owned fingerprints stand in a tree of the same kind, in which owners and visitors look for partners; branches
   are left by the same bounds, and leaves are compared exactly.
5. Components of the links are the classes.

Trees are fitted to samples of at most about SAMPLE fingerprints a shard, which steers balance, never results. Shards of more than OWNED
fingerprints are cut again by trees of their own; one that no tree can cut is dealt out as pairs of blocks. All trees of a round
are built by tasks, nothing but counts reaches the driver.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import text as T
from tidegauge.llm.components import components
from tidegauge.session import written

BITS = 64
PARTS = 4
SAMPLE = 16384
OWNED = 4096
VISITORS = 32768
LEAF = 256
SALT_ROWS = 65536
POINTS = 6
WORTH = 0.92
SHINGLES = 1 << 16
ALL = (1 << BITS) - 1


# 1. fingerprints

def _fingerprints(n: int, seed: int):
    def run(batches):
        for batch in batches:
            found = [fingerprints(data, offsets, n, seed) for _, _, data, offsets in T.text_pieces(batch.column("text"))]
            prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "print"])
    return run


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Fingerprint of every row; words are joined by one space, fewer than n words are one shingle, none give zero."""
    data, rows = T.LOWER[data], len(offsets) - 1
    start, end = T.spans(data, offsets, T.IS_SPACE[data])
    row = np.searchsorted(offsets, start, "right") - 1
    lengths = end - start + 1
    at = np.cumsum(lengths) - lengths
    joined = np.full(int(lengths.sum()), 0x20, np.uint8)
    joined[np.arange(len(joined)) - np.repeat(at, lengths) < np.repeat(lengths - 1, lengths)] = data[~T.IS_SPACE[data]]
    text = joined.tobytes()
    words = np.bincount(row, minlength=rows)
    first = np.cumsum(words) - words
    shingles = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    of = np.repeat(np.arange(rows), shingles)
    begin = np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[of]
    last = begin + np.minimum(words[of], n) - 1
    sums = np.zeros((rows, BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(of), SHINGLES):
        part = slice(a, a + SHINGLES)
        spans = zip(at[begin[part]].tolist(), (at[last[part]] + lengths[last[part]] - 1).tolist())
        values = np.array([digest(text[i:j], seed) for i, j in spans], np.uint64)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        here = of[part]
        heads = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        sums[here[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


# 2. vantage-point trees

class Tree:
    """Nodes as rows: mask, vantage point, radius inside, slack, child inside, child outside; a child below zero is leaf -1 - child."""

    def __init__(self, nodes: np.ndarray, leaves: int):
        self.nodes, self.leaves = nodes, leaves

    @classmethod
    def fit(cls, prints: np.ndarray, part: int, limit: int, target: float) -> "Tree":
        """Splits until `target` prints are left in a node or no vantage point leaves out a worthwhile share of the work."""
        width = BITS // PARTS
        masks = [(((1 << width) - 1) << part * width, limit // PARTS), (ALL, limit)]
        nodes, leaves = [], 0
        waiting = [(np.arange(len(prints)), None)]
        while waiting:
            held, parent = waiting.pop()
            split = best_split(prints[held], masks) if len(held) > target else None
            if split is None:
                child, leaves = -1 - leaves, leaves + 1
            else:
                child = len(nodes)
                mask, point, radius, slack = split
                nodes.append([mask, point, radius, slack, 0, 0])
                inside = distances(prints[held], point, mask) <= radius
                waiting += [(held[~inside], (child, 5)), (held[inside], (child, 4))]
            if parent is not None:
                nodes[parent[0]][parent[1]] = child
        return cls(np.array([[x & ALL for x in row] for row in nodes], np.uint64).reshape(-1, 6), leaves)

    @classmethod
    def read(cls, blob: bytes, leaves: int) -> "Tree":
        return cls(np.frombuffer(blob, np.uint64).reshape(-1, 6), leaves)

    def visits(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, prints that may have partners in it, whether they are at home in it), leaves from the inside out."""
        if not len(self.nodes):
            yield 0, np.arange(len(prints)), np.ones(len(prints), bool)
            return
        links = self.nodes[:, 4:].view(np.int64).tolist()
        stack = [(0, np.arange(len(prints)), np.ones(len(prints), bool))]
        while stack:
            node, held, home = stack.pop()
            if node < 0:
                yield -1 - node, held, home
                continue
            mask, point, radius, slack = (int(x) for x in self.nodes[node, :4])
            far = distances(prints[held], point, mask)
            for child, go, own in ((links[node][1], far + slack > radius, far > radius), (links[node][0], far - slack <= radius, far <= radius)):
                if go.any():
                    stack.append((child, held[go], (home & own)[go]))


def distances(prints: np.ndarray, point: int, mask: int = ALL) -> np.ndarray:
    return np.bitwise_count((prints ^ np.uint64(point)) & np.uint64(mask)).astype(np.int64)


def best_split(prints: np.ndarray, masks) -> tuple[int, int, int, int] | None:
    """The vantage point, mask and radius for which the fewest comparisons are left, if that is WORTH it."""
    best, found = WORTH, None
    points = np.unique(prints[np.linspace(0, len(prints) - 1, POINTS).astype(np.int64)]).tolist()
    for mask, slack in masks:
        for point in points:
            # shares of the prints at a distance up to d
            up_to = np.cumsum(np.bincount(distances(prints, point, mask), minlength=BITS + 1)) / len(prints)
            inside = np.append(up_to, np.ones(slack))
            radii = np.arange(len(up_to))
            before = np.where(radii >= slack, up_to[np.maximum(radii - slack, 0)], 0.0)
            work = inside[radii + slack] * up_to + (1 - before) * (1 - up_to)
            work[(up_to == 0) | (up_to == 1)] = 1
            radius = int(np.argmin(work))
            if work[radius] < best:
                best, found = work[radius], (mask, point, radius, slack)
        if found is not None:
            break
    return found


# 3. shards

TREES = "shard string, leaves int, tree binary"
ROWS = "shard string, id bigint, print bigint, own boolean"


def _fit(limit: int):
    def run(sample: pa.Table) -> pa.Table:
        shard, size = sample["shard"][0].as_py(), sample["owned"][0].as_py()
        prints = np.sort(sample["print"].to_numpy().view(np.uint64))
        prints = prints[np.argsort(T.mix(prints), kind="stable")]
        tree = Tree.fit(prints, int(shard.split(".")[0]), limit, max(16.0, OWNED / 2 * len(prints) / size))
        return pa.table({"shard": [shard], "leaves": pa.array([tree.leaves], pa.int32()), "tree": pa.array([tree.nodes.tobytes()], pa.binary())})
    return run


def _route(rows: pa.Table, trees: pa.Table) -> pa.Table:
    """Owners go to their shard and visit larger ones; visitors visit all that their balls overlap. `!` marks a shard that can't be cut."""
    shard, tree = trees["shard"][0].as_py(), Tree.read(trees["tree"][0].as_py(), trees["leaves"][0].as_py())
    ids, prints, own = rows["id"].to_numpy(), rows["print"].to_numpy().view(np.uint64), rows["own"].to_numpy(zero_copy_only=False)
    order, at, leaf_of, home_of = np.arange(len(ids)), [], [], []
    for leaf, held, home in tree.visits(prints):
        at.append(held)
        leaf_of.append(np.full(len(held), leaf))
        home_of.append(home)
    at, leaf, home = (np.concatenate(x) if x else order[:0] for x in (at, leaf_of, home_of))
    home = home.astype(bool)
    owned_in = np.full(len(ids), -1)
    owned_in[at[home & own[at]]] = leaf[home & own[at]]
    keep = ~own[at] | (leaf >= owned_in[at])
    at, leaf, home = at[keep], leaf[keep], home[keep]
    names = pa.array([f"{shard}.{k}" for k in range(tree.leaves)] if tree.leaves > 1 else [f"{shard}!"], pa.string())
    return pa.table({"shard": names.take(pa.array(leaf)), "id": ids[at], "print": prints[at].view(np.int64), "own": home & own[at]})


def shards(prints: DataFrame, limit: int) -> DataFrame:
    """(shard, id, print, own) of prints(id, print), cut until no shard owns more than OWNED prints or none of its trees cuts it."""
    spark = prints.sparkSession
    part = F.explode(F.array(*(F.lit(str(p)) for p in range(PARTS))))
    rows = prints.select(part.alias("shard"), "id", "print", F.lit(True).alias("own"))
    done = None
    while True:
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("own").alias("owned"))
        large = written(spark, sizes.where((F.col("owned") > OWNED) & ~F.col("shard").endswith("!")), "large")
        rest = rows.join(large, "shard", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if not large.limit(1).count():
            return done
        cut = rows.join(large, "shard")
        drawn = F.xxhash64("print").cast("double") / F.lit(2.0 ** 64) + 0.5 < F.lit(float(SAMPLE)) / F.col("owned")
        trees = written(spark, cut.where(F.col("own") & drawn).groupBy("shard").applyInArrow(_fit(limit), TREES), "trees")
        salts = F.ceil(F.col("n") / SALT_ROWS)
        held = cut.withColumn("salt", F.pmod(F.xxhash64("id"), salts)).select("shard", "salt", "id", "print", "own")
        dealt = trees.join(large, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).select("shard", "salt", "leaves", "tree")
        at = ["shard", "salt"]  # dealt out explicitly: a table that lies by shard would keep a large shard in one task
        rows = written(spark, held.repartition(*at).groupBy(*at).cogroup(dealt.repartition(*at).groupBy(*at)).applyInArrow(_route, ROWS), "shards")


# 4. links

def _links(limit: int):
    def run(cell: pa.Table) -> pa.Table:
        """One cell: the owners of block a against each other (a = b) and against all else that stands in the cell."""
        ids, prints = cell["id"].to_numpy(), cell["print"].to_numpy().view(np.uint64)
        a, b, block = cell["a"][0].as_py(), cell["b"][0].as_py(), cell["block"].to_numpy()
        own = cell["own"].to_numpy(zero_copy_only=False) & (block == a)
        return pa.table(dict(zip("ab", near_pairs(ids, prints, own, a == b, int(cell["shard"][0].as_py()[0]), limit))))
    return run


def near_pairs(ids: np.ndarray, prints: np.ndarray, own: np.ndarray, among: bool, part: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all owners and others within the limit as all links would. Owners are linked among each other if `among`."""
    order = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
    ids, prints, n = ids[order], prints[order], int(own.sum())
    if not n:
        return ids[:0], ids[:0]
    label, out = np.arange(len(ids)), ([], [])
    tree = Tree.fit(prints[:n], part, limit, LEAF)
    visits = list(tree.visits(prints))
    for leaf, held, home in visits:
        members = held[home & (held < n)]
        others = held if among else held[held >= n]
        for k in range(0, len(members), 128):
            rows = members[k:k + 128]
            near = np.bitwise_count(prints[rows][:, None] ^ prints[others][None, :]) <= limit
            for i in np.flatnonzero(near.sum(axis=1) > 1 if among else near.any(axis=1)):
                u, found = rows[i], others[near[i]]
                found = found[label[found] != label[u]]
                if len(found):
                    fresh, first = np.unique(label[found], return_index=True)
                    out[0].append(np.full(len(fresh), ids[u]))
                    out[1].append(ids[found[first]])
                    label[np.isin(label, fresh)] = label[u]
    return tuple(np.concatenate(x) if x else ids[:0] for x in out)


def links(prints: DataFrame, limit: int) -> DataFrame:
    """(a, b): ids whose prints differ in at most `limit` bits, as many as connect all that the links connect."""
    rows = shards(prints, limit)
    sizes = rows.groupBy("shard").agg(F.count_if("own").alias("owned"), F.count_if(~F.col("own")).alias("visiting"))
    sizes = sizes.where("owned > 0").select("shard", F.ceil(F.col("owned") / OWNED).alias("k"), F.greatest(F.lit(1), F.ceil(F.col("visiting") / VISITORS)).alias("m"))
    h = F.xxhash64("id")
    block = F.when(F.col("own"), F.pmod(h, F.col("k"))).otherwise(F.col("k") + F.pmod(h, F.col("m")))
    x, blocks = F.col("block"), F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)
    # owners meet every block of owners, and as block a every block of visitors; the first block of visitors stands with a = b
    cells = F.when(F.col("own"), F.concat(F.transform(blocks, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))),
                                          F.when(F.col("m") > 1, F.transform(F.sequence(F.col("k") + 1, F.col("k") + F.col("m") - 1), lambda y: F.struct(x.alias("a"), y.alias("b")))).otherwise(F.array())))
    cells = cells.otherwise(F.transform(blocks, lambda y: F.struct(y.alias("a"), F.when(x == F.col("k"), y).otherwise(x).alias("b"))))
    dealt = rows.join(sizes, "shard").withColumn("block", block).withColumn("cell", F.explode(cells))
    dealt = dealt.select("shard", "cell.a", "cell.b", "id", "print", "own", "block")
    return dealt.repartition("shard", "a", "b").groupBy("shard", "a", "b").applyInArrow(_links(limit), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, n: int = 4, limit: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of documents(doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; shingles are n words joined by one space, repeats included, fewer words are one
    shingle. Null, empty and blank texts have fingerprint zero and are linked like any other. Fingerprints link at `limit` or
    fewer differing bits; component_id is the smallest doc_id reachable, itself included. Rows that share a doc_id count as
    that document. A row without doc_id has a fingerprint, no component and links nothing. No rows give no rows.
    """
    spark = documents.sparkSession
    columns = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = written(spark, columns.mapInArrow(_fingerprints(n, seed), "doc_id bigint, print bigint"), "prints")
    known = prints.where("doc_id is not null")
    first = written(spark, known.groupBy("print").agg(F.min("doc_id").alias("id")), "distinct")
    # documents of one id and several prints hang together
    shared = known.groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high").select("doc_id")
    several = known.join(shared, "doc_id", "left_semi").join(first, "print").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    classes = components(links(first.select("id", "print"), limit).unionByName(several))
    member = first.join(classes.withColumnRenamed("node", "id"), "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    out = prints.join(member, "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
