"""Links and classes of documents whose sets of word shingles are alike, by signature trees over prefix lists.

1. Shingles are counted in slots over all documents; slots grow with the input, up to a fixed bound. Shingles are ordered by the logarithm
   of that estimate, rare ones first, then by hash: a passage that a third of all documents share does not bring them together.
2. Each document becomes a sketch: size, key of its set, prefix (any two linked sets share a shingle of their prefixes) and
   a bitmap of two to four bits a shingle. Documents with equal sets go on as one.
3. Prefix shingles meet in buckets. Every distinct list of documents that share one becomes work once. Lists with one first document
   go together, so that a bitmap is sent once for all of them.
4. For each list a signature tree is built: leaves of documents by size, nodes with the OR of the bitmaps and the range of
   sizes. Two trees are walked together; a pair of nodes is left when sizes or the largest possible overlap
   exclude a link, or when all below is connected already. What remains are edges of a spanning forest of
   possible links.
5. Components of that forest hold all links. Within each, the sets themselves are compared, again until connected.
6. Components of the exact links are the classes.

Shingles that may stand in more than BLOCK documents, and components of more than BLOCK / 2, are dealt out in two rounds. In the first,
members are dealt to blocks and every block meets block 0, which connects what is alike. In the second, only members outside of the
largest class found so far meet all blocks. So no task holds an unbounded group, and rows grow with the members, not their square.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import text as T
from tidegauge.llm.components import components
from tidegauge.session import written

SLOT_LOAD = 256
FLUSH = 1 << 20
LEAST_SLOTS, MOST_SLOTS = 1 << 18, 1 << 22
SLOT_PART = 1 << 14
BLOCK = 4096
LEAD_ROWS = 1024
FILTER_PART = 1 << 16
LEAST_FILTER, MOST_FILTER = 1 << 16, 1 << 26
LEAF = 32
FANOUT = 8
BUCKET_TOKENS = 1 << 20
NOTHING = np.zeros(0, np.uint64)


def needed(n, percent: int):
    """Overlap that any set of n shingles has with a linked one at least."""
    return (percent * n + 99) // 100


# 1. counts of shingles

SLOT_SCHEMA = "part int, counts binary"
LEVEL_SCHEMA = "part int, total bigint, levels binary"


def _slot_counts(n: int, slots: int):
    def run(batches):
        total, waiting, held = np.zeros(slots, np.uint32), [], 0
        for batch in batches:
            for _, _, data, offsets in T.text_pieces(batch.column("text")):
                row, _, _, hashes = T.words(data, offsets)
                if len(row) >= n:
                    waiting.append((T.windows(hashes, n)[row[n - 1:] == row[:len(row) - n + 1]] & np.uint64(slots - 1)).astype(np.int32))
                    held += len(waiting[-1])
                if held > FLUSH:
                    total += np.bincount(np.concatenate(waiting), minlength=slots).astype(np.uint32)
                    waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=slots).astype(np.uint32)
        parts = total.reshape(-1, SLOT_PART)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), T.binary([T.packed(parts[k]) for k in used])], names=["part", "counts"])
    return T.handed_back(run)


def _slot_levels(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + T.unpacked(blob, SLOT_PART, np.uint32).astype(np.int64)
    if sums:
        levels = [T.packed(np.floor(np.log2(c + 1)).astype(np.uint8)) for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([int(c.sum()) for c in sums.values()], pa.int64()), T.binary(levels)], names=["part", "total", "levels"])


class Order:
    """The rank of every slot: 0 up to twice the mean count, one more each time the count doubles. The driver gets a byte a slot, at most MOST_SLOTS."""

    def __init__(self, slots: int, parts):
        levels = np.zeros((slots // SLOT_PART, SLOT_PART), np.uint8)
        for part, _, blob in parts:
            levels[part] = T.unpacked(blob, SLOT_PART, np.uint8)
        self.slots, self.base = slots, int(np.log2(2 * sum(total for _, total, _ in parts) / slots + 1))
        self.blob = T.packed(np.maximum(levels.ravel(), self.base) - np.uint8(self.base))


def ranks(shingles: np.ndarray, order: tuple) -> np.ndarray:
    """order: slots, base, packed ranks and their digest."""
    slots, _, blob, name = order
    table = T.worker_memo("shingle ranks", dict)
    if name not in table:
        table.clear()  # of an earlier query
        table[name] = T.unpacked(blob, slots, np.uint8)
    table = table[name]
    return table[(shingles & np.uint64(slots - 1)).astype(np.int64)]


def crowded(shingles: np.ndarray, order: tuple) -> np.ndarray:
    """Whether more than BLOCK documents may hold a shingle."""
    return (np.int64(1) << (ranks(shingles, order).astype(np.int64) + order[1] + 1)) > BLOCK


def shingle_order(documents: DataFrame, n: int) -> tuple[int, int, bytes, bytes]:
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (size // (6 * SLOT_LOAD)).bit_length()))
    parts = documents.select("text").mapInArrow(_slot_counts(n, slots), SLOT_SCHEMA).repartition("part").mapInArrow(_slot_levels, LEVEL_SCHEMA).collect()
    order = Order(slots, parts)
    return order.slots, order.base, order.blob, hashlib.blake2b(order.blob, digest_size=16).digest()


# 2. sketches

def signature_bits(n: int) -> int:
    return max(6, int(2 * n - 1).bit_length())


def signature(shingles: np.ndarray) -> bytes:
    flags = np.zeros(1 << signature_bits(len(shingles)), bool)
    flags[(shingles & np.uint64(len(flags) - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("prefix", pa.binary()), ("crowded", pa.bool_()), ("signature", pa.binary())])
SKETCH_DDL = "doc_id bigint, n bigint, set_key binary, prefix binary, crowded boolean, signature binary"


def _sketches(n: int, percent: int, order):
    def run(batches):
        for batch in batches:
            rows = []
            for _, _, data, offsets in T.text_pieces(batch.column("text")):
                for s in T.shingle_sets(data, offsets, n):
                    size = len(s) - needed(len(s), percent) + 1 if len(s) else 0
                    prefix = s[np.argsort(ranks(s, order), kind="stable")[:size]]
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), prefix.tobytes(), bool(crowded(prefix, order).any()), signature(s) if len(s) else b""))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64())] + [pa.array(c, f.type) for c, f in zip(columns, list(SKETCH)[1:])], schema=SKETCH)
    return T.handed_back(run)


# 3. lists of documents that share a prefix shingle

TOKENS_DDL = "bucket int, ids binary, counts binary, tokens binary"


def _token_blobs(buckets: int, order):
    """Prefix shingles that at most BLOCK documents hold."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offsets = T.buffer_of(batch.column("prefix"))
            tokens = np.frombuffer(data.tobytes(), np.uint64)
            row = np.repeat(np.arange(len(ids)), np.diff(offsets) // 8)
            few = ~crowded(tokens, order)
            tokens, row = T.mix(tokens[few]), row[few]
            bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            row, low, bucket = row[by], tokens[by].astype(np.uint32), bucket[by]
            heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]))) if len(row) else np.zeros(0, np.int64)
            counts = np.diff(np.append(heads, len(row))).astype(np.int32)
            of = ids[row[heads]].astype(np.int64)
            edges, tops = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(bucket[heads], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32())] + [
                T.binary([v[e[b]:e[b + 1]].tobytes() for b in used]) for v, e in ((of, tops), (counts, tops), (low, edges))],
                names=["bucket", "ids", "counts", "tokens"])
    return T.handed_back(run)


def _crowded_tokens(order):
    """(grp, id) of the other prefix shingles."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offsets = T.buffer_of(batch.column("prefix"))
            tokens = np.frombuffer(data.tobytes(), np.uint64)
            many = crowded(tokens, order)
            row = np.repeat(np.arange(len(ids)), np.diff(offsets) // 8)[many]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[many].view(np.int64)), pa.array(ids[row], pa.int64())], names=["grp", "id"])
    return T.handed_back(run)


LISTS_DDL = "lead bigint, list_key bigint, doc_id bigint"


def shared_lists(table: pa.Table) -> pa.Table:
    """Of one bucket: every distinct list of documents that share a token, as rows."""
    def read(name, dtype):
        return np.frombuffer(b"".join(table[name].to_pylist()), dtype)

    ids, tokens = np.repeat(read("ids", np.int64), read("counts", np.int32)), read("tokens", np.uint32)
    order = np.lexsort((ids, tokens))
    ids, tokens = ids[order], tokens[order]
    if len(ids):
        fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1]))
        ids, tokens = ids[fresh], tokens[fresh]
    heads = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(ids) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(ids)))
    keys = T.mix(np.add.reduceat(T.mix(ids), heads) + sizes.astype(np.uint64)) if len(heads) else NOTHING
    shared = np.flatnonzero(sizes > 1)
    _, first = np.unique(keys[shared], return_index=True)
    kept = shared[first]
    n = sizes[kept]
    at = np.repeat(heads[kept], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    columns = np.repeat(ids[heads[kept]], n), np.repeat(keys[kept].view(np.int64), n), ids[at]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["lead", "list_key", "doc_id"])


# Groups of any size, members(grp, id), dealt out in two rounds.

def every(n, *make):
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), *make)


def around_first(members: DataFrame, size: int) -> DataFrame:
    """First round: (grp, cell, id); every block of about `size` members meets block 0."""
    blocks = members.groupBy("grp").agg(F.ceil(F.count("*") / size).alias("k"))
    block = F.pmod(F.xxhash64("id"), F.col("k"))
    cells = F.when(block == 0, every(F.col("k"), lambda j: j)).otherwise(F.array(block))
    return members.join(blocks, "grp").select("grp", F.explode(cells).alias("cell"), "id")


def outside_largest(members: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """Second round: (grp, a, b, id, known); members outside of the largest class of their group meet all. classes(node, component)."""
    known = members.join(classes.withColumnRenamed("node", "id"), "id", "left").select("grp", "id", F.coalesce("component", "id").alias("known"))
    counts = known.groupBy("grp", "known").agg(F.count("*").alias("n"))
    tops = counts.groupBy("grp").agg(F.max_by("known", F.struct("n", "known")).alias("top"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    tops = tops.select("grp", "top", F.ceil(F.col("n") / size).alias("k"), F.ceil((F.col("n") - F.col("most")) / size).alias("m"))
    x, y = F.pmod(F.xxhash64("id", F.lit(1)), F.col("m")), F.pmod(F.xxhash64("id"), F.col("k"))
    cells = every(F.col("m"), lambda a: F.struct(a.alias("a"), y.alias("b")))
    both = F.array_distinct(F.concat(cells, every(F.col("k"), lambda b: F.struct(x.alias("a"), b.alias("b")))))
    dealt = known.join(tops, "grp").withColumn("cell", F.explode(F.when(F.col("known") == F.col("top"), cells).otherwise(both)))
    return dealt.select("grp", "cell.a", "cell.b", "id", "known")


# 4. signature trees

class Forest:
    """Joins nodes; the edges that joined two classes are a spanning forest."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((x, y))

    def roots(self, ids) -> np.ndarray:
        return np.array([self.root(int(x)) for x in ids], np.int64)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a & b).sum(axis=-1, dtype=np.int64)


class SignatureTree:
    """Levels of nodes from leaves to the root: OR of bitmaps, range of sizes, largest surplus of shingles over set bits."""

    def __init__(self, ids, sizes, bitmaps, order):
        self.ids, self.sizes, self.bitmaps = ids[order], sizes[order], bitmaps[order]
        self.surplus = self.sizes - np.bitwise_count(self.bitmaps).sum(axis=1, dtype=np.int64)
        level = self.bitmaps, self.sizes, self.sizes, self.surplus
        self.levels = []
        width = LEAF
        while True:
            at = np.arange(0, len(level[1]), width)
            level = tuple(f.reduceat(x, at) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level))
            self.levels.append(level)
            if len(at) == 1:
                break
            width = FANOUT

    def classes(self, forest: Forest) -> list[np.ndarray]:
        """Per level the class of a node, -1 if mixed."""
        low = high = forest.roots(self.ids)
        out, width = [], LEAF
        for level in self.levels:
            at = np.arange(0, len(low), width)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
            width = FANOUT
        return out


def possible(bits_a, low_a, high_a, surplus_a, bits_b, low_b, high_b, surplus_b, percent: int) -> np.ndarray:
    """Whether some member of a and some of b could be linked."""
    sizes = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    most = overlaps(bits_a, bits_b) + np.minimum(surplus_a, surplus_b)
    return sizes & ((100 + percent) * most >= percent * (low_a + low_b))


def walk(x: SignatureTree, y: SignatureTree, forest: Forest, percent: int) -> None:
    """Join all documents of two trees (or one with itself) that could be linked and aren't connected."""
    same = x is y
    cx, cy = x.classes(forest), y.classes(forest)
    hx, hy = len(x.levels) - 1, len(y.levels) - 1
    stack = [(hx, hy, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        lx, ly, i, j = stack.pop()
        ok = (cx[lx][i] != cy[ly][j]) | (cx[lx][i] < 0)
        i, j = i[ok], j[ok]
        ok = possible(*(v[i] for v in x.levels[lx]), *(v[j] for v in y.levels[ly]), percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if lx == 0 and ly == 0:
            for a, b in zip(i, j):
                join_leaves(x, y, a, b, same, forest, percent)
            continue
        down_x, down_y = lx >= ly, ly >= lx
        kids_i = (i[:, None] * FANOUT + np.arange(FANOUT)) if down_x else i[:, None]
        kids_j = (j[:, None] * FANOUT + np.arange(FANOUT)) if down_y else j[:, None]
        lx, ly = lx - down_x, ly - down_y
        i = np.repeat(kids_i, kids_j.shape[1], axis=1).ravel()
        j = np.tile(kids_j, kids_i.shape[1]).ravel()
        ok = (i < len(x.levels[lx][1])) & (j < len(y.levels[ly][1]))
        if same:
            ok &= i <= j
        i, j = i[ok], j[ok]
        step = 1 << 13
        stack += [(lx, ly, i[k:k + step], j[k:k + step]) for k in range(0, len(i), step)]


def join_leaves(x, y, a, b, same, forest, percent) -> None:
    p, q = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
    rx, ry = forest.roots(x.ids[p]), forest.roots(y.ids[q])
    differ = rx[:, None] != ry[None, :]
    if same and a == b:
        differ = np.triu(differ, 1)
    i, j = np.nonzero(differ)
    if not len(i):
        return
    i, j = i + a * LEAF, j + b * LEAF
    ok = possible(x.bitmaps[i], x.sizes[i], x.sizes[i], x.surplus[i], y.bitmaps[j], y.sizes[j], y.sizes[j], y.surplus[j], percent)
    for u, v in zip(x.ids[i[ok]].tolist(), y.ids[j[ok]].tolist()):
        forest.join(u, v)


def join_list(ids: np.ndarray, sizes: np.ndarray, signatures: list[bytes], forest: Forest, percent: int) -> None:
    """Connect the documents of one list that could be linked. Bitmaps twice as long are folded to compare."""
    roots = forest.roots(ids)
    if (roots == roots[0]).all():
        return
    bits = np.array([len(s) for s in signatures])
    for width in np.unique(bits):
        own, wider = np.flatnonzero(bits == width), np.flatnonzero(bits == 2 * width)
        maps = np.frombuffer(b"".join([signatures[k] for k in own]), np.uint64).reshape(len(own), -1)
        folded = np.zeros((0, maps.shape[1]), np.uint64)
        if len(wider):
            long = np.frombuffer(b"".join([signatures[k] for k in wider]), np.uint64).reshape(len(wider), 2, -1)
            folded = long[:, 0] | long[:, 1]
        # one document against all: a list of copies is connected by this alone
        both, rows = np.concatenate([maps, folded]), np.concatenate([own, wider])
        surplus = sizes[rows] - np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        first = np.zeros(len(rows), np.int64)
        ok = possible(both[first], sizes[rows[first]], sizes[rows[first]], surplus[first], both, sizes[rows], sizes[rows], surplus, percent)
        for k in rows[ok]:
            forest.join(int(ids[own[0]]), int(ids[k]))
        roots = forest.roots(ids[rows])
        if (roots == roots[0]).all():
            continue
        tree = SignatureTree(ids[own], sizes[own], maps, np.lexsort((sizes[own], roots[:len(own)])))
        walk(tree, tree, forest, percent)
        if len(wider):
            walk(tree, SignatureTree(ids[wider], sizes[wider], folded, np.lexsort((sizes[wider], roots[len(own):]))), forest, percent)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in order of the keys, several groups to a table."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        last = np.logical_and.reduce([table[k].to_numpy() == table[k][-1].as_py() for k in keys])
        start = table.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if start:
            yield table.slice(0, start)
        rest = table.slice(start)
    if rest is not None:
        yield rest


def edge_batch(edges) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _bounds(*columns: np.ndarray) -> np.ndarray:
    cut = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
    return np.append(np.flatnonzero(cut), len(cut))


def _possible_links(percent: int):
    """Rows hold a document of one part of the lists of a first document, and the keys of those of its lists; one forest lasts over the part."""
    def run(batches):
        for table in runs_of(batches, ["lead", "part"]):
            lead, part, ids, sizes = (table[c].to_numpy() for c in ("lead", "part", "doc_id", "n"))
            signatures, lists = table["signature"].to_pylist(), table["lists"].combine_chunks()
            offsets, keys = lists.offsets.to_numpy(), lists.values.to_numpy()
            edges, bounds = [], _bounds(lead, part)
            for a, b in zip(bounds[:-1], bounds[1:]):
                forest = Forest()
                held, row = keys[offsets[a]:offsets[b]], np.repeat(np.arange(a, b), np.diff(offsets[a:b + 1]))
                order = np.argsort(held, kind="stable")
                row, cuts = row[order], _bounds(held[order])
                for i, j in zip(cuts[:-1], cuts[1:]):
                    join_list(ids[row[i:j]], sizes[row[i:j]], [signatures[k] for k in row[i:j]], forest, percent)
                edges += forest.edges
            yield edge_batch(edges)
    return T.handed_back(run)


def possible_links(work: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """work(lead, part, doc_id, lists): documents of lists that go together."""
    held = work.join(sketches, "doc_id").select("lead", "part", "doc_id", "n", "signature", "lists")
    return held.repartition("lead", "part").sortWithinPartitions("lead", "part", "doc_id").mapInArrow(_possible_links(percent), "a bigint, b bigint")


# 5. exact links

def _filter_parts(bits: int):
    def run(table: pa.Table) -> pa.Table:
        flags = np.zeros(FILTER_PART, bool)
        flags[table["bit"].to_numpy()] = True
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int64()), "flags": T.binary([T.packed(np.packbits(flags))])})
    return run


def id_filter(ids: DataFrame) -> tuple[int, bytes]:
    """Bits of hashed ids(id), 32 an id between bounds; the driver gets at most MOST_FILTER / 8 bytes."""
    bits = min(MOST_FILTER, max(LEAST_FILTER, 1 << (32 * ids.count()).bit_length()))
    low = F.xxhash64("id").bitwiseAND(bits - 1)
    parts = ids.select(F.floor(low / FILTER_PART).alias("part"), (low % FILTER_PART).alias("bit")).distinct()
    flags = np.zeros((bits // FILTER_PART, FILTER_PART // 8), np.uint8)
    for part, blob in parts.groupBy("part").applyInArrow(_filter_parts(bits), "part bigint, flags binary").collect():
        flags[part] = T.unpacked(blob, FILTER_PART // 8, np.uint8)
    return bits, T.packed(flags)


def _passing(bits: int, blob: bytes):
    def run(batches):
        flags = T.unpacked(blob, bits // 8, np.uint8)
        for batch in batches:
            low = batch.column("low").to_numpy()
            batch = batch.filter(pa.array((flags[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"])
    return T.handed_back(run)


def _family_sets(n: int, columns: list[str]):
    def run(batches):
        for batch in batches:
            sets = [s for _, _, data, offsets in T.text_pieces(batch.column("text")) for s in T.shingle_sets(data, offsets, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array([len(s) for s in sets], pa.int64()), T.binary([s.tobytes() for s in sets])], names=[*columns, "n", "shingles"])
    return T.handed_back(run)


def exact_links(ids: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of some documents: each is compared with all of other classes whose size allows it."""
    forest = Forest()
    order = np.argsort(sizes, kind="stable")
    label = np.arange(len(ids)) if known is None else np.unique(known, return_inverse=True)[1][order]
    starts = np.cumsum([0] + [len(sets[k]) for k in order])
    joined = np.concatenate([sets[k] for k in order])
    n = sizes[order]
    for u in range(len(order)):
        stop = int(np.searchsorted(percent * n, 100 * n[u], "right"))
        others = np.flatnonzero(label[u + 1:stop] != label[u]) + u + 1
        if not len(others):
            if (label == label[0]).all():
                break
            continue
        own = joined[starts[u]:starts[u + 1]]
        lengths = n[others]
        at = np.repeat(starts[others] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        found = joined[at]
        hit = own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found
        overlap = np.add.reduceat(hit.astype(np.int64), np.cumsum(lengths) - lengths)
        for v in others[(100 + percent) * overlap >= percent * (n[u] + lengths)]:
            if label[v] != label[u]:
                label[label == label[v]] = label[u]
            forest.join(int(ids[order[u]]), int(ids[order[v]]))
    return forest.edges


def _exact(percent: int, keys: list[str], known: bool):
    def run(batches):
        for table in runs_of(batches, keys):
            ids, sizes, sets = table["doc_id"].to_numpy(), table["n"].to_numpy(), table["shingles"].to_pylist()
            classes = table["known"].to_numpy() if known else None
            edges, bounds = [], _bounds(*(table[k].to_numpy() for k in keys))
            for a, b in zip(bounds[:-1], bounds[1:]):
                edges += exact_links(ids[a:b], [np.frombuffer(s, np.uint64) for s in sets[a:b]], sizes[a:b], percent, classes[a:b] if known else None)
            yield edge_batch(edges)
    return T.handed_back(run)


def exact_within(documents: DataFrame, cells: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) inside the cells(key columns, id); texts of other documents are left out before they are sent."""
    keys = [c for c in cells.columns if c not in ("id", "known")]
    members = cells.select("id").distinct()
    bits, blob = id_filter(members)
    texts = documents.withColumn("low", F.xxhash64("doc_id").bitwiseAND(bits - 1)).mapInArrow(_passing(bits, blob), "doc_id bigint, text string")
    texts = texts.join(members.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_family_sets(n, ["doc_id"]), "doc_id bigint, n bigint, shingles binary").where("n > 0")
    held = sets.join(cells.withColumnRenamed("id", "doc_id"), "doc_id").repartition(*keys).sortWithinPartitions(*keys, "doc_id")
    return held.mapInArrow(_exact(percent, keys, "known" in cells.columns), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (bigint) of every row of documents(doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered. A set holds the distinct n-word shingles; fewer words make one
    shingle, no words an empty set that is linked with nothing. Two documents link when 100 * overlap >= percent * union;
    component_id is the smallest doc_id reachable, itself included. Rows that share a doc_id count as that document. A row
    without doc_id gets its size and no component.
    """
    spark = documents.sparkSession
    columns = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = shingle_order(columns, n)
    sketches = written(spark, columns.mapInArrow(_sketches(n, percent, order), SKETCH_DDL), "sketches")
    linkable = sketches.where("n > 0 and doc_id is not null")
    classes = written(spark, linkable.groupBy("set_key").agg(F.min("doc_id").alias("first")), "sets")
    firsts = classes.select(F.col("first").alias("doc_id"), "set_key")
    single = linkable.join(firsts, ["doc_id", "set_key"], "left_semi")
    bitmaps = single.select("doc_id", "set_key", "n", "signature").dropDuplicates(["doc_id", "set_key"]).drop("set_key")
    prefixes = single.select("doc_id", "prefix")

    # lists of few documents
    total = sketches.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (100 - percent) // 100 // BUCKET_TOKENS)
    lists = written(spark, prefixes.mapInArrow(_token_blobs(buckets, order), TOKENS_DDL).groupBy("bucket").applyInArrow(shared_lists, LISTS_DDL), "lists")
    parts = lists.groupBy("lead").agg(F.ceil(F.count("*") / LEAD_ROWS).alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("list_key"), F.col("parts")), F.lit(0).cast("bigint"))
    dealt = lists.join(parts, "lead", "left").select("lead", part.alias("part"), "doc_id", "list_key").repartition("lead", "part", "doc_id")
    work = dealt.groupBy("lead", "part", "doc_id").agg(F.collect_set("list_key").alias("lists"))
    pairs = possible_links(work, bitmaps, percent)

    # shingles of many documents
    many = written(spark, single.where("crowded").select("doc_id", "prefix").mapInArrow(_crowded_tokens(order), "grp bigint, id bigint").distinct(), "crowded")
    if many.limit(1).count():
        one_list = F.array(F.lit(0).cast("bigint")).alias("lists")
        by_first = many.groupBy("id").agg(F.min("grp").alias("grp"))
        first = around_first(by_first, BLOCK).select(F.col("grp").alias("lead"), F.col("cell").alias("part"), F.col("id").alias("doc_id"), one_list)
        pairs = written(spark, pairs.unionByName(possible_links(first, bitmaps, percent)), "pairs")
        rest = outside_largest(many, components(pairs), BLOCK)
        rest = rest.select(F.xxhash64("grp", "a").alias("lead"), F.col("b").alias("part"), F.col("id").alias("doc_id"), one_list)
        pairs = pairs.unionByName(possible_links(rest, bitmaps, percent))

    # exact links within components
    families = written(spark, components(pairs).select(F.col("component").alias("grp"), F.col("node").alias("id")), "families")
    links = written(spark, exact_within(columns, around_first(families, BLOCK // 2), n, percent), "links")
    large = families.join(families.groupBy("grp").count().where(F.col("count") > BLOCK // 2), "grp", "left_semi")
    if large.limit(1).count():
        rest = written(spark, outside_largest(large, components(links), BLOCK // 2), "rest")
        links = links.unionByName(exact_within(columns, rest, n, percent))
    found = components(links)
    member = classes.join(found.withColumnRenamed("node", "first"), "first", "left").select("set_key", F.coalesce("component", "first").alias("component_id"))
    out = sketches.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(member, "set_key", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id"))


# The same rows in DuckDB.
ORACLE_SQL = """WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
 sizes AS (SELECT doc_id, count(*) n FROM shingles GROUP BY 1),
 shared AS (SELECT s FROM shingles GROUP BY 1 HAVING count(*) > 1),
 met AS (SELECT doc_id, s FROM shingles JOIN shared USING (s)),
 pairs AS (SELECT a.doc_id x, b.doc_id y, count(*) o FROM met a JOIN met b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
 both_ways AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
 reach AS (SELECT x AS a, x AS b FROM both_ways UNION SELECT a, y FROM reach JOIN both_ways ON b = x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id FROM words w LEFT JOIN sizes ON sizes.doc_id = w.doc_id
LEFT JOIN (SELECT a, min(b) c FROM reach GROUP BY 1) m ON m.a = w.doc_id"""
