"""Merkle manifest of a table: hash trees per group, one tree over the groups, and a proof for every row.

Leaves of a group ascend by an order column. While several nodes remain, every `fanout` consecutive ones become their hash; the last
run may be shorter. The roots of the groups, in order of the groups, become the root of the table likewise.

1. Rows become digests before anything is shuffled. Positions inside a group come from ranges of rows, so a group of any size is
   numbered by many tasks.
2. Aligned builders: positions are cut into blocks of fanout ** HEIGHT. The builder of a block appends its nodes to a log in the order
   in which they are complete, children before parents. Roots of blocks are the leaves of the next layer; their number falls by
   fanout ** HEIGHT a layer, so no task and no driver ever holds a whole group.
3. A log keeps no links: the place of a node follows from its level and index and the number of leaves (`place`).
4. Proofs go down the layers: the siblings above a block are found once for the block, those inside it in its log by place.

Digests are sha256; a node hashes the lowercase hex digits of its children, one after the other.
"""

from collections.abc import Iterable, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.crc import crc_sql
from tidegauge.plans.ordered import positions
from tidegauge.session import written

HEIGHT = 8
DIGEST = 32


def encoded(column: str, value: Column | None = None) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value as text."""
    text = (F.col(column) if value is None else value).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[str], **changed: Column) -> Column:
    """Digest of a row: its columns encoded one after the other; `changed` gives other values for some."""
    return F.sha2(F.concat(*(encoded(c, changed.get(c)) for c in columns)), 256)


# Trees: pure arithmetic on levels, indices and numbers of leaves.

def height(leaves: int, fanout: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fanout), levels + 1
    return levels


def place(level: int, index: int, leaves: int, levels: int, fanout: int) -> int:
    """Position of a node in the log of a tree: of its own and lower levels all nodes up to its last leaf stand before it, of higher
    ones those whose last leaf came earlier."""
    end = min(leaves, (index + 1) * fanout ** level)
    return sum(-(-end // fanout ** k) for k in range(level + 1)) + sum((end - 1) // fanout ** k for k in range(level + 1, levels + 1)) - 1


def parent_of(children: Iterable[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def completion_log(leaves: Sequence[str], levels: int, fanout: int) -> list[str]:
    """All nodes of a tree in the order in which they are complete; the root is last."""
    log, open_runs = [], [[] for _ in range(levels + 1)]
    for k, node in enumerate(leaves):
        log.append(node)
        last = k + 1 == len(leaves)
        for level in range(levels):
            open_runs[level].append(node)
            if len(open_runs[level]) < fanout and not last:
                break
            node = parent_of(open_runs[level])
            open_runs[level] = []
            log.append(node)
    return log


def siblings(log: Sequence[str], index: int, leaves: int, levels: int, fanout: int) -> list[tuple[int, list[str]]]:
    """For every level up to the root: the place of the node in its run, and the others of the run from left to right."""
    out, width = [], leaves
    for level in range(levels):
        first, at = index - index % fanout, index % fanout
        out.append((at, [log[place(level, k, leaves, levels, fanout)] for k in range(first, min(width, first + fanout)) if k != index]))
        index, width = index // fanout, -(-width // fanout)
    return out


def fold(leaf: str, path: Iterable[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for at, others in path:
        leaf = parent_of([*others[:at], leaf, *others[at:]])
    return leaf


def packed(path: Iterable[tuple[int, list[str]]]) -> bytes:
    return b"".join(bytes([at, len(others)]) + bytes.fromhex("".join(others)) for at, others in path)


def unpacked(blob: bytes) -> list[tuple[int, list[str]]]:
    out, k = [], 0
    while k < len(blob):
        at, n = blob[k], blob[k + 1]
        digits = blob[k + 2:k + 2 + n * DIGEST].hex()
        out.append((at, [digits[j:j + 2 * DIGEST] for j in range(0, len(digits), 2 * DIGEST)]))
        k += 2 + n * DIGEST
    return out


# Layers: (tree, block, leaves, levels, log, root) for every block of positions.

LAYER = "tree string, block bigint, leaves int, levels int, log binary, root binary"


def _build(fanout: int):
    def run(nodes: pa.Table, sizes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        leaves = [d.hex() for d in nodes["digest"].to_pylist()]
        levels = min(HEIGHT, height(sizes["size"][0].as_py(), fanout))
        log = completion_log(leaves, levels, fanout)
        return pa.table({
            "tree": pa.array([nodes["tree"][0].as_py()], pa.string()), "block": pa.array([nodes["block"][0].as_py()], pa.int64()),
            "leaves": pa.array([len(leaves)], pa.int32()), "levels": pa.array([levels], pa.int32()),
            "log": pa.array([bytes.fromhex("".join(log))], pa.binary()), "root": pa.array([bytes.fromhex(log[-1])], pa.binary())})
    return run


def in_blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(fanout ** HEIGHT)))


def _together(a: DataFrame, b: DataFrame):
    """Both tables by block. Dealt out by block explicitly: a table that lies by tree would keep a large tree in one task."""
    at = ["tree", "block"]
    return a.repartition(*at).groupBy(*at).cogroup(b.repartition(*at).groupBy(*at))


def layers_of(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Layers from the leaves nodes(tree, pos from 0, digest) up to one block a tree; none for no nodes."""
    spark, layers = nodes.sparkSession, []
    while True:
        held = in_blocks(nodes.select("tree", "pos", "digest"), fanout)
        blocks = held.groupBy("tree", "block").agg(F.count(F.lit(1)).alias("n"))
        sizes = blocks.join(blocks.groupBy("tree").agg(F.sum("n").alias("size")), "tree").select("tree", "block", "size")
        sizes = written(spark, sizes, "sizes")  # columns of one origin on both sides would be ambiguous
        layer = written(spark, _together(held, sizes).applyInArrow(_build(fanout), LAYER), "layer")
        most = layer.agg(F.max("block")).first()[0]
        if most is None:
            return []
        layers.append(layer)
        if most == 0:
            return layers
        nodes = layer.select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"))


def _block_paths(fanout: int):
    def run(batches):
        for batch in batches:
            tree, pos, paths = [], [], []
            for name, block, leaves, levels, log, above in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "leaves", "levels", "log", "path"))):
                nodes = [log[k:k + DIGEST].hex() for k in range(0, len(log), DIGEST)]
                for k in range(leaves):
                    tree.append(name)
                    pos.append(block * fanout ** HEIGHT + k)
                    paths.append(packed(siblings(nodes, k, leaves, levels, fanout)) + above)
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(pos, pa.int64()), pa.array(paths, pa.binary())], names=["tree", "pos", "path"])
    return run


def paths_down(layers: Sequence[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, path): what lies above every block of the lowest layer; tops(tree, path) is what lies above each tree."""
    paths = tops.withColumn("block", F.lit(0).cast("bigint"))
    for layer in reversed(layers[1:]):
        above = layer.join(paths, ["tree", "block"])
        paths = above.mapInArrow(_block_paths(fanout), "tree string, pos bigint, path binary").withColumnRenamed("pos", "block")
    return paths


def _proofs(fanout: int, root: str, whole: bool):
    def run(rows: pa.Table, logs: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        log, above, subroot = logs["log"][0].as_py(), unpacked(logs["path"][0].as_py()), logs["subroot"][0].as_py().hex()
        leaves, levels = logs["leaves"][0].as_py(), logs["levels"][0].as_py()
        nodes = [log[k:k + DIGEST].hex() for k in range(0, len(log), DIGEST)]
        last = "".join(x for _, others in above for x in others)
        out = [], [], [], []
        for k, changed in enumerate(rows["changed"].to_pylist()):
            inside = siblings(nodes, k, leaves, levels, fanout)
            leaf = nodes[place(0, k, leaves, levels, fanout)]
            out[0].append(leaf)
            out[1].append(sha256(("".join(x for _, others in inside for x in others) + last).encode()).hexdigest())
            out[2].append(fold(fold(leaf if changed is None else changed.hex(), inside), above))
            out[3].append([x for _, others in inside + above for x in others] if whole else None)
        n = rows.num_rows
        columns = [rows["doc_id"], out[0], [subroot] * n, [root] * n, out[1], out[2]] + [pa.array(out[3], pa.list_(pa.string()))] * whole
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"] + ["proof"] * whole
        return pa.Table.from_arrays([c if isinstance(c, (pa.ChunkedArray, pa.Array)) else pa.array(c, pa.string()) for c in columns], names=names)
    return run


def manifest(rows: DataFrame, columns: Sequence[str], group: str = "source", order: str = "doc_id", fanout: int = 3, changed: dict[str, Column] | None = None,
             where: Column | None = None, whole: bool = False) -> DataFrame:
    """doc_id (the order column), leaf, subroot, root, proof_sha256, folded_root, verified of every row; `whole` adds the proof itself.

    A leaf is the digest of `columns`. `changed` gives columns other values on the rows that `where` holds for, which are then
    folded from the changed leaf and the original siblings, and `verified` tells whether that gives the root. Groups are ordered
    bytewise, the null group first; rows of a group by `order`, nulls first, then by leaf. Equal rows are leaves of their
    own. One leaf is its own root: its proof has no siblings below the group. No rows give no rows. Other columns are not looked at.
    """
    spark = rows.sparkSession
    tampered = F.lit(None) if not changed else F.when(F.lit(True) if where is None else where, F.unhex(leaf_digest(columns, **changed)))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col(order).cast("bigint").alias("doc_id"), F.unhex(leaf_digest(columns)).alias("digest"), tampered.cast("binary").alias("changed"))
    line = ["tree", "doc_id", "digest"]
    leaves = written(spark, leaves, "leaves")  # ranges are sampled: texts are hashed once
    ranged = leaves.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *line).withColumn("range", F.spark_partition_id())
    placed = positions(written(spark, ranged, "leaves"), ["tree"], line[1:], F.col("range"), "pos").withColumn("pos", F.col("pos") - 1).drop("range")
    placed = written(spark, placed, "leaves")
    layers = layers_of(placed, fanout)
    names = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", proof array<string>" * whole
    if not layers:
        return spark.createDataFrame([], names).withColumn("verified", F.lit(True))
    trees = numbered_trees(layers[-1].where("block = 0").select("tree", F.col("root").alias("subroot")))
    over = layers_of(trees.select(F.lit("").alias("tree"), "pos", F.col("subroot").alias("digest")), fanout)
    root = over[-1].first()["root"].hex()
    top = spark.createDataFrame([("", b"")], "tree string, path binary")
    group_paths = over[0].join(paths_down(over, top, fanout), ["tree", "block"]).mapInArrow(_block_paths(fanout), "tree string, pos bigint, path binary")
    tops = written(spark, trees.join(group_paths.select("pos", "path"), "pos").select("tree", "subroot", "path"), "tops")
    above = paths_down(layers, tops.select("tree", "path"), fanout)
    logs = layers[0].join(above, ["tree", "block"]).join(tops.select("tree", "subroot"), "tree").select("tree", "block", "leaves", "levels", "log", "path", "subroot")
    held = in_blocks(placed, fanout).select("tree", "block", "pos", "doc_id", "changed")
    out = _together(held, logs).applyInArrow(_proofs(fanout, root, whole), names)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def numbered_trees(subroots: DataFrame) -> DataFrame:
    """Subroots with their position from 0 in order of the trees."""
    spark = subroots.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = written(spark, subroots.repartitionByRange(ranges, "tree").withColumn("range", F.spark_partition_id()), "trees")
    d = positions(d.withColumn("all", F.lit(0)), ["all"], ["tree"], F.col("range"), "pos")
    return written(spark, d.select("tree", "subroot", (F.col("pos") - 1).alias("pos")), "trees")


# The same rows in DuckDB: nodes by level; a node's run holds its siblings.
_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _PART + ")"
ORACLE_SQL = f"""WITH RECURSIVE {crc_sql("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS word FROM documents")},
 docs AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format("text")} AS leaf,
   CASE WHEN crc % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS changed FROM documents LEFT JOIN crcs ON word = CAST(doc_id AS VARCHAR)),
 placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs),
 up AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM placed UNION ALL
   SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, level, pos // 3, n),
 nodes AS MATERIALIZED (SELECT * FROM up),
 subroots AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
 over_up AS (SELECT 0 AS level, pos, h, n FROM subroots UNION ALL
   SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM over_up WHERE n > 1 GROUP BY level, pos // 3, n),
 over_nodes AS MATERIALIZED (SELECT * FROM over_up),
 runs AS (SELECT tree, level, pos // 3 AS run, list(h ORDER BY pos) AS h FROM nodes WHERE n > 1 GROUP BY ALL UNION ALL
   SELECT NULL, level, pos // 3, list(h ORDER BY pos) FROM over_nodes WHERE n > 1 GROUP BY ALL),
 down AS (SELECT tree, pos AS leaf_pos, leaf, coalesce(changed, leaf) AS h, tree AS t, 0 AS level, pos, n, '' AS proof, doc_id FROM placed UNION ALL
   SELECT d.tree, leaf_pos, leaf, CASE WHEN d.n = 1 THEN d.h ELSE sha256(array_to_string(list_concat(list_concat(r.h[1:d.pos % 3], [d.h]), r.h[d.pos % 3 + 2:]), '')) END,
     CASE WHEN d.n > 1 THEN t END, CASE WHEN d.n > 1 THEN d.level + 1 ELSE 0 END, CASE WHEN d.n > 1 THEN d.pos // 3 ELSE s.pos END,
     CASE WHEN d.n > 1 THEN (d.n + 2) // 3 ELSE s.n END,
     CASE WHEN d.n > 1 THEN proof || array_to_string(list_concat(r.h[1:d.pos % 3], r.h[d.pos % 3 + 2:]), '') ELSE proof END, doc_id
   FROM down d LEFT JOIN runs r ON d.n > 1 AND r.level = d.level AND r.run = d.pos // 3 AND r.tree IS NOT DISTINCT FROM d.t
   LEFT JOIN subroots s ON d.n = 1 AND s.tree = d.t WHERE d.n > 1 OR d.t IS NOT NULL)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, d.h AS folded_root, d.h = r.h AS verified
FROM down d JOIN subroots s ON s.tree = d.tree, (SELECT h FROM over_nodes WHERE n = 1) r WHERE d.t IS NULL AND d.n = 1"""
