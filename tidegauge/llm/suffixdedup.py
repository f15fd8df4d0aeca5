"""Removal of long byte strings that an earlier document holds, by run-length compressed indexes.

Strings of `length` bytes that agree have the same smallest hash of their `GRAM`-byte grams. That hash is their anchor:

1. Every maximal run of windows with one anchor (a segment) sends its anchor to a bucket; anchors of two documents survive.
2. The segments of surviving anchors go to a bucket of that anchor, so that all equal windows meet.
3. Each bucket collapses equal segments, keeps the Burrows-Wheeler transform of the rest as runs with sampled ends, and
   streams the segments backwards over the runs with their matching statistics: the row reached and how many bytes agree with
   the row above. That length grows by one a step; where a run starts, the samples at the ends of runs tell it anew. Rows
   that agree over `length` bytes or more are one class; a window whose class holds a smaller document is marked.
4. Marks return to their documents, where overlapping ones join.

Buckets grow in number with the text, not in size; a string that a third of all documents share is one segment a
document, met in numpy arrays of some 20 bytes each, and one entry of its bucket's index. Nothing passes the driver but
the number of bytes.

Cases: null or short texts are kept as they are (null: empty); rows without a doc_id are kept and mark nothing; rows of one
doc_id don't mark each other; further columns stay untouched.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import text as T

GRAM = 16
SEGMENT_WINDOWS = 64
BUCKET_BYTES = {"anchors": 1 << 25, "segments": 1 << 22}
KEYS = [("doc_id", pa.int64()), ("text_key", pa.int32())]


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows and anchor of every segment, in order."""
    width = length - GRAM + 1
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    sums = T.rolling(data)
    at = np.arange(len(data) - GRAM + 1)
    lowest, size = T.span_hashes(sums, at, at + GRAM), 1
    while size * 2 <= width:
        lowest, size = np.minimum(lowest[:-size], lowest[size:]), size * 2
    if size < width:
        lowest = np.minimum(lowest[:size - width], lowest[width - size:])
    # windows that cross the end of a row are no windows
    lengths = np.diff(offsets)
    per_row = np.maximum(0, lengths - length + 1)
    row = np.repeat(np.arange(len(lengths)), per_row)
    at = np.repeat(offsets[:-1] - np.cumsum(per_row) + per_row, per_row) + np.arange(len(row))
    anchor = lowest[at]
    cut = np.ones(len(row), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(cut)
    sizes = np.diff(np.append(first, len(row)))
    if len(sizes) and sizes.max() > SEGMENT_WINDOWS:  # a repetitive stretch: parts of bounded length
        parts = -(-sizes // SEGMENT_WINDOWS)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        sizes = np.minimum(SEGMENT_WINDOWS, np.repeat(sizes, parts) - inner * SEGMENT_WINDOWS)
        first = np.repeat(first, parts) + inner * SEGMENT_WINDOWS
    return row[first], at[first], sizes, anchor[first]


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    cut = np.ones(len(keys[0]), bool)
    if len(cut):
        cut[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(cut)


def _column(table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype)


def _key_columns(batch) -> list[np.ndarray]:
    return [np.asarray(batch.column(name).to_numpy(zero_copy_only=False)) for name, _ in KEYS]


ANCHORS = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("ids", "keys", "counts", "anchors", "ordinals")])


def anchor_blobs(length: int, buckets: int):
    """Each batch of documents as one row a bucket: documents with their numbers of segments, then anchors and ordinals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids, keys = _key_columns(batch)
            rows, anchors, ordinals = [], [], []
            for a, _, data, offsets in T.text_pieces(batch.column("text")):
                row, _, _, anchor = segments(data, offsets, length)
                starts = np.searchsorted(row, row)
                rows.append(row + a)
                anchors.append(anchor)
                ordinals.append((np.arange(len(row)) - starts).astype(np.int32))
            if not rows:
                continue
            row, anchor, ordinal = map(np.concatenate, (rows, anchors, ordinals))
            bucket = bucket_of(anchor, buckets)
            order = np.argsort(bucket, kind="stable")
            row, low, ordinal, bucket = row[order], anchor[order].astype(np.uint32), ordinal[order], bucket[order]
            heads = _groups(bucket, row)
            counts = np.diff(np.append(heads, len(row))).astype(np.int32)
            of = row[heads]
            edges, tops = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(bucket[heads], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edges))
            columns = {"ids": (ids[of].astype(np.int64), tops), "keys": (keys[of].astype(np.int32), tops), "counts": (counts, tops),
                       "anchors": (low, edges), "ordinals": (ordinal, edges)}
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32())] + [
                T.binary([v[e[b]:e[b + 1]].tobytes() for b in used]) for v, e in columns.values()], schema=ANCHORS)
    return run


# Values for documents, packed by groups of documents: a row a bucket and group, however many documents a bucket knows.
PACKED = pa.schema([("group", pa.int32())] + [(c, pa.binary()) for c in ("ids", "keys", "counts", "values")])


def pack(ids: np.ndarray, keys: np.ndarray, values: np.ndarray, groups: int) -> pa.Table:
    """Values (rows of int64) of documents as PACKED rows."""
    group = (T.mix(ids) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((keys, ids, group))
    group, ids, keys, values = group[order], ids[order], keys[order], values[order]
    heads = _groups(group, ids, keys)
    counts = np.diff(np.append(heads, len(ids))).astype(np.int32)
    edges, tops = np.searchsorted(group, np.arange(groups + 1)), np.searchsorted(group[heads], np.arange(groups + 1))
    used = np.flatnonzero(np.diff(edges))
    columns = (ids[heads].astype(np.int64), tops), (keys[heads].astype(np.int32), tops), (counts, tops), (values.astype(np.int64), edges)
    return pa.Table.from_arrays([pa.array(used, pa.int32())] + [
        T.binary([pa.compress(v[e[g]:e[g + 1]].tobytes(), "zstd", asbytes=True) if n == 3 else v[e[g]:e[g + 1]].tobytes() for g in used])
        for n, (v, e) in enumerate(columns)], schema=PACKED)


UNPACKED = pa.schema(KEYS + [("found", pa.binary())])


def unpack(width: int):
    """Of one group: a row a document with all its values."""
    def run(table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(x, np.int32) for x in table["counts"].to_pylist()]
        values = [np.frombuffer(pa.decompress(x, int(c.sum()) * 8 * width, "zstd"), np.int64) for x, c in zip(table["values"].to_pylist(), counts)]
        counts, values = np.concatenate(counts), np.concatenate(values).reshape(-1, width)
        ids, keys = np.repeat(_column(table, "ids", np.int64), counts), np.repeat(_column(table, "keys", np.int32), counts)
        order = np.lexsort((values[:, 0], keys, ids))
        ids, keys, values = ids[order], keys[order], values[order]
        heads = _groups(ids, keys)
        return pa.Table.from_arrays([pa.array(ids[heads]), pa.array(keys[heads], pa.int32()),
                                     T.binary([values[a:b].tobytes() for a, b in zip(heads, np.append(heads, len(ids))[1:])])], schema=UNPACKED)
    return run


def by_document(packed: DataFrame, width: int) -> DataFrame:
    return packed.groupBy("group").applyInArrow(unpack(width), _ddl(UNPACKED))


def shared_anchors(groups: int):
    """Of one bucket: for every document the ordinals of its segments whose anchor another document has too."""
    def run(table: pa.Table) -> pa.Table:
        counts = _column(table, "counts", np.int32)
        ids, keys = (np.repeat(_column(table, c, t), counts) for c, t in (("ids", np.int64), ("keys", np.int32)))
        anchor, ordinal = _column(table, "anchors", np.uint32), _column(table, "ordinals", np.int32)
        order = np.argsort(anchor, kind="stable")
        heads = _groups(anchor[order])
        by = ids[order]
        many = np.minimum.reduceat(by, heads) != np.maximum.reduceat(by, heads) if len(heads) else np.zeros(0, bool)
        keep = order[np.repeat(many, np.diff(np.append(heads, len(order))))]
        return pack(ids[keep], keys[keep], ordinal[keep], groups)
    return run


# Columns of a bucket's row are differences from one segment to the next, in order of documents, and compressed.
SEGMENTS = pa.schema([("bucket", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("ids", "keys", "starts", "sizes", "content")])


def _segment_column(table, name: str, dtype) -> list[np.ndarray]:
    width = np.dtype(dtype).itemsize
    return [np.cumsum(np.frombuffer(pa.decompress(x, n * width, "zstd", asbytes=True), dtype), dtype=dtype) for x, n in zip(table[name].to_pylist(), table["n"].to_pylist())]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after another."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def segment_blobs(length: int, buckets: int):
    """The bytes of all segments that shared_anchors() named, one row a batch and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("found").is_valid())
            ids, keys = _key_columns(batch)
            wanted = [np.frombuffer(x, np.int64) for x in batch.column("found").to_pylist()]
            found, contents = [], []
            for a, b, data, offsets in T.text_pieces(batch.column("text")):
                row, first, size, anchor = segments(data, offsets, length)
                begins = np.searchsorted(row, np.arange(b - a + 1))
                here = [w[w < e - s] + s for w, s, e in zip(wanted[a:b], begins[:-1], begins[1:])]
                pick = np.concatenate(here) if here else np.zeros(0, np.int64)
                if not len(pick):
                    continue
                start, sized = first[pick], size[pick] + length - 1
                found.append((ids[a + row[pick]], keys[a + row[pick]], start - offsets[row[pick]], sized, bucket_of(anchor[pick], buckets)))
                contents.append(_gather(data, start, sized))
            if not found:
                continue
            of, key, start, size, bucket = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((start, key, of, bucket))
            begin = np.cumsum(size) - size
            size, edges = size[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            content = _gather(np.concatenate(contents), begin[order], size)
            ends = np.append(0, np.cumsum(size))
            used = np.flatnonzero(np.diff(edges))
            ordered = [of.astype(np.int64)[order], key.astype(np.int32)[order], start.astype(np.int32)[order], size.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.diff(edges)[used], pa.int32())] + [
                T.binary([pa.compress(np.diff(v[edges[x]:edges[x + 1]], prepend=v.dtype.type(0)), "zstd", asbytes=True) for x in used]) for v in ordered] + [
                T.binary([pa.compress(content[ends[edges[x]]:ends[edges[x + 1]]], "zstd", asbytes=True) for x in used])], schema=SEGMENTS)
    return run


class Ranks:
    """Marked rows as bits with counts of the marks before each word: how many marks stand at or before a row."""

    def __init__(self, rows: np.ndarray, n: int):
        flags = np.zeros((n >> 6) + 1 << 6, bool)
        flags[rows] = True
        self.words = np.packbits(flags, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def __call__(self, row: np.ndarray) -> np.ndarray:
        word = row >> 6
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (row & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of strings that end in a zero byte, with the suffix array sampled at both ends of runs.

    A row's matching length is the number of symbols that its suffix shares with the row above. One symbol further back both rows
    move on together and it is one more, unless the row starts a run. Then the row above is the end of the
    last run before with the same symbol, and the samples of both are compared, up to `length` symbols.
    """

    def __init__(self, symbols: np.ndarray, length: int):
        words = word_at(symbols)
        suffixes = suffix_array(symbols, words)
        n = len(symbols)
        last = symbols[suffixes - 1]  # the symbol before; position 0 follows the last
        self.starts = _groups(last)
        heads = last[self.starts]
        self.runs = Ranks(self.starts, n)
        ends = np.append(self.starts[1:], n)
        sizes = ends - self.starts
        # row of the first symbol of each run in the sorted column: smaller symbols, then equal ones of earlier runs
        order = np.argsort(heads, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        self.steps = np.empty(len(sizes), np.int64)
        self.steps[order] = before
        self.steps -= self.starts
        first_sample, last_sample = suffixes[self.starts], suffixes[ends - 1]
        self.entries = suffixes[:np.count_nonzero(symbols == 0)]  # positions of the end marks, the smallest suffixes
        same = np.flatnonzero(heads[order[1:]] == heads[order[:-1]])
        above, below = order[same], order[same + 1]
        self.lengths = np.zeros(len(sizes), np.int32)
        self.lengths[below] = 1 + agreement(words, first_sample[below], last_sample[above], length)

    def back(self, row: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes one symbol longer, and their matching lengths, exact below `length`."""
        run = self.runs(row) - 1
        return row + self.steps[run], np.where(self.starts[run] == row, self.lengths[run], matched + np.int32(1))


def word_at(symbols: np.ndarray) -> np.ndarray:
    """The 8 symbols from each position on, as on a circle."""
    n = len(symbols)
    padded = np.concatenate([symbols, symbols[:8]])
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j:j + n].astype(np.uint64)
    return words


def agreement(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many symbols from positions a and b on are equal, exact below `length`."""
    n = len(words)
    out = np.zeros(len(a), np.int32)
    left = np.arange(len(a))
    for depth in range(0, length, 8):
        unlike = words[(a[left] + depth) % n] ^ words[(b[left] + depth) % n]
        out[left] += sum((unlike < np.uint64(1 << 8 * k)).astype(np.int32) for k in range(8))
        left = left[unlike == 0]
    return out


def suffix_array(symbols: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes in order by doubling.

    Suffixes compare as on a circle. Strings of bounded length end in zeros, so a few doublings tell all apart but
    equal ones, and distinct strings leave none. Ranks take 31 bits, so a bucket holds less than 2 GB.
    """
    n = len(symbols)
    order = np.argsort(words).astype(np.int32)
    heads = _groups(words[order])
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    depth = 8
    while depth < n:
        sizes = np.diff(np.append(heads, n))
        open_rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(open_rows):
            break
        at = order[open_rows]
        following = at + np.int32(depth)
        following[following >= n] -= n
        own, pair = rank[at], rank[following]
        turn = np.argsort((own.astype(np.uint64) << np.uint64(32)) | pair.astype(np.uint64))
        at, own, pair = at[turn], own[turn], pair[turn]
        order[open_rows] = at
        new = _groups(own, pair)
        rank[at] = np.repeat(open_rows[new], np.diff(np.append(new, len(at))))
        cut = np.zeros(n, bool)
        cut[heads] = True
        cut[open_rows[new]] = True
        heads = np.flatnonzero(cut)
        depth *= 2
    return order


def smallest_holders(content: np.ndarray, sizes: np.ndarray, holders: np.ndarray, length: int) -> np.ndarray:
    """For every window of distinct strings the smallest holder of any string with that window.

    The matching statistics of all strings against the index are streamed together, from their ends backwards: each step moves
    the row and the matching length of every string over the runs. A window that agrees with the row above over `length` symbols
    is of the class of that row; another one begins a class.
    """
    count = len(sizes)
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(int(ends[-1]), np.uint8)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = content + np.uint8(1)
    index = RunLengthIndex(symbols, length)
    # every stream enters at the row of its string's end, where nothing of it is matched
    row, matched = np.empty(count, np.int64), np.zeros(count, np.int32)
    row[np.searchsorted(ends, index.entries, "right")] = np.arange(count)
    per = sizes - length + 1
    firsts = np.cumsum(per) - per
    rows, fresh = np.zeros(int(per.sum()), np.int64), np.zeros(int(per.sum()), bool)
    left = np.argsort(-sizes, kind="stable")  # longest first: the strings still open are a prefix
    row, ordered = row[left], sizes[left]
    for step in range(1, int(ordered[0]) + 1):
        alive = int(np.searchsorted(-ordered, -step, "right"))
        row[:alive], matched[:alive] = index.back(row[:alive], matched[:alive])
        if step >= length:
            at = firsts[left[:alive]] + ordered[:alive] - step
            rows[at], fresh[at] = row[:alive], matched[:alive] < length
    heads = rows[fresh]
    classes = Ranks(heads, len(symbols))(rows) - 1
    lowest = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(lowest, classes, np.repeat(holders, per))
    return lowest[classes]


def mark_bucket(length: int, groups: int):
    """Of one bucket: the marked spans of every document."""
    def run(table: pa.Table) -> pa.Table:
        ids, keys, starts, sizes = (_segment_column(table, c, t) for c, t in (("ids", np.int64), ("keys", np.int32), ("starts", np.int32), ("sizes", np.int32)))
        hashes, blobs = [], []
        for packed, own in zip(table["content"].to_pylist(), sizes):
            ends = np.cumsum(own.astype(np.int64))
            blobs.append(np.frombuffer(pa.decompress(packed, int(ends[-1]), "zstd", asbytes=True), np.uint8))
            hashes.append(T.span_hashes(T.rolling(blobs[-1]), np.append(0, ends[:-1]), ends))
        ids, keys, starts, sizes = np.concatenate(ids), np.concatenate(keys), np.concatenate(starts).astype(np.int64), np.concatenate(sizes).astype(np.int64)
        hashed = np.concatenate(hashes)
        content, begins = np.concatenate(blobs), np.cumsum(sizes) - sizes
        order = np.lexsort((ids, hashed))
        heads = _groups(hashed[order])
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        lead = order[heads]
        per = sizes[lead] - length + 1
        firsts = np.cumsum(per) - per
        lowest = smallest_holders(_gather(content, begins[lead], sizes[lead]), sizes[lead], ids[lead], length)
        # per distinct string: maximal stretches of windows with one smallest holder
        string = np.repeat(np.arange(len(lead)), per)
        cuts = _groups(string, lowest)
        upto = np.append(cuts, len(string))[1:]
        of, value = string[cuts], lowest[cuts]
        edges = np.searchsorted(of, np.arange(len(lead) + 1))
        # every copy takes the stretches of its string, kept where the holder is smaller than itself
        number = np.diff(edges)[group]
        copy = np.repeat(np.arange(len(group)), number)
        pick = np.repeat(edges[group] - (np.cumsum(number) - number), number) + np.arange(number.sum())
        keep = value[pick] < ids[copy]
        copy, pick = copy[keep], pick[keep]
        base = starts[copy] - firsts[of[pick]]
        low, high = base + cuts[pick], base + upto[pick] + length - 1
        return pack(ids[copy], keys[copy], np.stack([low, high], 1), groups)
    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans in order, joined where they touch or overlap."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[first, 0], reach[np.append(np.flatnonzero(first)[1:], len(spans)) - 1]], 1)


def repeated_spans(documents: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, text_key, found): spans of bytes that documents with a smaller doc_id hold too, as packed pairs of int64."""
    spark = documents.sparkSession
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(documents)
    few, many = (max(least, total // size) for size in BUCKET_BYTES.values())
    anchors = keyed.mapInArrow(anchor_blobs(length, few), _ddl(ANCHORS))
    shared = by_document(anchors.groupBy("bucket").applyInArrow(shared_anchors(few), _ddl(PACKED)), 1)
    held = keyed.join(shared, ["doc_id", "text_key"], "left")  # as the last join: both read one exchange of texts
    blobs = held.mapInArrow(segment_blobs(length, many), _ddl(SEGMENTS))
    return by_document(blobs.groupBy("bucket").applyInArrow(mark_bucket(length, few), _ddl(PACKED)), 2)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("text_key"), "text")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(digest: bool):
    def run(batches):
        for batch in batches:
            data, offsets = T.buffer_of(batch.column("text"))
            out = []
            for found, a, b in zip(batch.column("found").to_pylist(), offsets[:-1], offsets[1:]):
                spans = merged(np.frombuffer(found or b"", np.int64).reshape(-1, 2))
                edges = np.concatenate([[0], spans.ravel(), [b - a]])
                kept = b"".join(data[a + x:a + y].tobytes() for x, y in zip(edges[::2], edges[1::2]))
                out.append((int(b - a), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept).hexdigest().encode() if digest else kept))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64())] + [pa.array(c, f.type) for c, f in zip(columns, list(RESULT)[1:])], schema=RESULT)
    return run


def remove_repeats(documents: DataFrame, length: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and `kept`: the remaining bytes, or their SHA-256 in lower hex with `digest`.

    One row for every row of documents(doc_id, text). A byte goes if a string of `length` bytes over it also starts in a
    document with a smaller doc_id, judged on the input.
    """
    found = repeated_spans(documents, length)
    return _keyed(documents).join(found, ["doc_id", "text_key"], "left").mapInArrow(_cut(digest), _ddl(RESULT))


# The same rows in DuckDB.
ORACLE_SQL = """WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
 blocks AS (SELECT doc_id, 500 * b AS base, substr(h, CAST(1000 * b + 1 AS BIGINT), 1098) AS piece FROM (SELECT doc_id, h, unnest(range(0, len(h) // 1000 + 1)) AS b FROM hexed)),
 strings AS (SELECT doc_id, base + k AS i, substr(piece, CAST(2 * k + 1 AS BIGINT), 100) AS s FROM (
  SELECT doc_id, base, piece, unnest(range(0, least(500, greatest(0, len(piece) // 2 - 49)))) AS k FROM blocks)),
 first AS (SELECT s, min(doc_id) d FROM strings GROUP BY 1 HAVING count(*) > 1),
 marks AS (SELECT doc_id, i FROM strings JOIN first USING (s) WHERE d < doc_id),
 cuts AS (SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50, -1) AS fresh FROM marks),
 numbered AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) g FROM cuts),
 spans AS (SELECT doc_id, g, min(i) a, max(i) + 50 b FROM numbered GROUP BY 1, 2),
 edges AS (SELECT doc_id, 0 AS a, NULL AS b FROM hexed UNION ALL SELECT doc_id, a, b FROM spans),
 parts AS (SELECT doc_id, coalesce(b, 0) AS x, lead(a) OVER (PARTITION BY doc_id ORDER BY a, b NULLS FIRST) AS y FROM edges),
 kept AS (SELECT doc_id, string_agg(CASE WHEN y IS NULL THEN substr(h, CAST(2 * x + 1 AS BIGINT)) ELSE substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)) END, '' ORDER BY x) k FROM parts JOIN hexed USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM hexed JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) r, count(*) n FROM spans GROUP BY 1) USING (doc_id)"""
