import hashlib
import zlib

from pyspark.sql import functions as F

from tidegauge.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "text"]


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, **changed):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (changed.get(c, row[c]) for c in COLUMNS)))


def levels(nodes, fanout=3):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k:k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def path(tree, k, fanout=3):
    for level in tree[:-1]:
        a = k - k % fanout
        yield k % fanout, [x for j, x in enumerate(level[a:a + fanout], a) if j != k]
        k //= fanout


def brute(rows, fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    groups = dict(sorted(groups.items(), key=lambda x: (x[0] is not None, (x[0] or "").encode())))
    trees, out = {}, []
    for g, members in groups.items():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in members], fanout)
    top = levels([t[-1][0] for t in trees.values()], fanout) if trees else []
    for at, (g, members) in enumerate(groups.items()):
        for k, r in enumerate(members):
            steps = [*path(trees[g], k, fanout), *path(top, at, fanout)]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            h = leaf(r, text=r["text"].replace("\n", "")) if tampered else leaf(r)
            for i, others in steps:
                h = H("".join(others[:i] + [h] + others[i:]))
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], H("".join(x for _, o in steps for x in o)), h, h == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df, **kw):
    d = merkle.manifest(df, COLUMNS, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))}, where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0, **kw)
    return sorted(map(tuple, d.collect()), key=str)


def many(spark, n=700):
    rows = [(k, f"line\n{k}\nend" if k % 3 else f"plain {k}", "en", None if k % 50 == 0 else "hot" if k % 2 else f"s{k % 7}é"[:3]) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(6)


def test_against_trees_in_memory(spark, monkeypatch):
    """Also with blocks of few leaves, so that trees have several layers."""
    df = many(spark)
    plain = [r.asDict() for r in df.collect()]
    assert rows_of(df) == brute(plain)
    assert not all(r[-1] for r in rows_of(df))
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    assert rows_of(df) == brute(plain)
    assert rows_of(df, fanout=2) == brute(plain, 2)


def test_one_leaf_and_one_group(spark):
    for rows in ([(1, "a\nb", "en", "s")], [(k, "a", None, "s") for k in range(3 ** 3)]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
        assert rows_of(df) == brute([r.asDict() for r in df.collect()])


def test_awkward_rows(awkward, nothing):
    assert rows_of(awkward) == brute([r.asDict() for r in awkward.collect()])
    assert rows_of(nothing) == []


def test_places_follow_from_sizes():
    for fanout in (2, 3, 5):
        for n in range(1, 60):
            for more in (0, 2):
                top = merkle.height(n, fanout) + more
                tree = [[str(k) for k in range(n)]]
                for _ in range(top):
                    tree.append([merkle.parent_of(tree[-1][k:k + fanout]) for k in range(0, len(tree[-1]), fanout)])
                log = merkle.completion_log(tree[0], top, fanout)
                assert len(log) == sum(map(len, tree))
                assert all(log[merkle.place(l, k, n, top, fanout)] == x for l, level in enumerate(tree) for k, x in enumerate(level))
                for k in range(n):
                    steps = merkle.siblings(log, k, n, top, fanout)
                    hexes = [(at, [merkle.parent_of(x) if len(x) < 64 else x for x in others]) for at, others in steps]
                    assert merkle.unpacked(merkle.packed(hexes)) == hexes
                    assert merkle.fold(str(k), steps) == log[-1]


def test_whole_proofs_fold_to_the_root(spark):
    d = merkle.manifest(many(spark, 100), COLUMNS, whole=True).collect()
    assert all(r.verified and r.folded_root == r.root and merkle.parent_of(r.proof) == r.proof_sha256 for r in d)
