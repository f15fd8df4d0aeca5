"""Language identification by the nearest of several centroids a language, on TF-IDF vectors of byte n-grams.

Texts are lowered, everything but letters becomes a space, and byte n-grams of UTF-8 are hashed to DIMENSIONS. Vectors are
(1 + log count) * idf, scaled to length 1. Document frequencies cover all labelled rows. Centroids come from
spherical k-means inside each language over a sample of about SAMPLE rows, chosen by a hash of the id at a rate that counts over all
rows set. A text takes the language of the nearest centroid by cosine; beyond the distance that holds most of that centroid's own
rows it is marked rejected.

Cases: null texts and texts without a letter are `und` with score 0; rows with null language or id teach nothing; without any
labelled row everything is `und`. A text is held whole, as its row is.
"""

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import text as T

DIMENSIONS = 1 << 13
GRAMS = (1, 2, 3)
CLUSTERS = 4
SAMPLE = 1500
ROUNDS = 10
KEPT = 0.99
BLOCK = 128
UNKNOWN = "und"
# bytes of letters: ASCII ones, and all that belong to longer characters (other signs of those were removed before)
_LETTER = np.array([chr(b).isalpha() if b < 0x80 else True for b in range(256)])
LETTERS = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)


def normal(column: pa.Array) -> pa.Array:
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    return pc.replace_substring_regex(lowered, r"[^\pL\pM\x00-\x7f]+", " ") if has_wide(lowered) else lowered


def has_wide(column: pa.Array) -> bool:
    """Whether any character beyond ASCII isn't a letter, so that the costly replacement is needed."""
    return bool(pc.any(pc.match_substring_regex(column, r"[^\pL\pM\x00-\x7f]")).as_py())


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x DIMENSIONS: how often each hashed n-gram stands in each row; n-grams of two spaces or more don't count."""
    data = LETTERS[data]
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    wide = data.astype(np.uint32)
    blank = data == 0x20
    slots = []
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code, spaces = np.full(m, n, np.uint32), np.zeros(m, np.uint8)
        for j in range(n):
            code = code << np.uint32(8) | wide[j:j + m]
            spaces += blank[j:j + m]
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        whole = (row[:m] == row[n - 1:]) & (spaces < (2 if n > 1 else 1))
        slots.append((row[:m] * DIMENSIONS + slot)[whole])
    joined = np.concatenate(slots) if slots else np.zeros(0, np.int64)
    return np.bincount(joined, minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)


def blocks(column: pa.Array):
    """(first row, counts) for every few rows of a column of texts."""
    data, offsets = T.buffer_of(normal(column))
    for a, b in T.pieces(offsets, 1 << 19):
        for x in range(a, b, BLOCK):
            y = min(b, x + BLOCK)
            yield x, counts(data[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x])


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(found, dtype=np.float32) * idf
    length = np.sqrt(np.einsum("ij,ij->i", weights, weights))
    return weights / np.maximum(length, 1e-12)[:, None]


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    reach: np.ndarray
    idf: np.ndarray

    def nearest(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = vectors(found, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)


def _frequencies(batches):
    """Rows with each slot, one row a partition."""
    total, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for _, found in blocks(batch.column("text")):
            total += np.count_nonzero(found, axis=0)
            rows += len(found)
    yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), T.binary([total.tobytes()])], names=["rows", "found"])


def _added(batches):
    rows, total = 0, np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        rows += sum(batch.column(0).to_pylist())
        for blob in batch.column(1).to_pylist():
            total += np.frombuffer(blob, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), T.binary([total.tobytes()])], names=["rows", "found"])


def _sparse(batches):
    for batch in batches:
        slots, values = [], []
        for _, found in blocks(batch.column("text")):
            for row in found:
                at = np.flatnonzero(row)
                slots.append(at.astype(np.int32))
                values.append(row[at].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))],
                                         names=["lang", "slots", "found"])


def _cluster(idf: np.ndarray, clusters: int):
    """Spherical k-means of one language's sample; every centroid with the cosine that KEPT of its rows reach."""
    def run(table: pa.Table) -> pa.Table:
        dense = np.zeros((table.num_rows, DIMENSIONS), np.float32)
        for i, (at, found) in enumerate(zip(table["slots"].to_pylist(), table["found"].to_pylist())):
            dense[i, at] = found
        x = vectors(dense, idf)
        x = x[np.lexsort((x[:, 0], np.einsum("ij,j->i", x, np.arange(DIMENSIONS, dtype=np.float32))))]  # an order without regard to the tasks'
        chosen = [int(np.argmax(x @ x.mean(axis=0)))]
        while len(chosen) < min(clusters, len(x)):  # then the row farthest from those chosen
            chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
        centers = x[chosen]
        for _ in range(ROUNDS):
            own = np.argmax(x @ centers.T, axis=1)
            sums = np.stack([x[own == k].sum(axis=0) if (own == k).any() else centers[k] for k in range(len(centers))])
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
        cosine = x @ centers.T
        own, near = np.argmax(cosine, axis=1), cosine.max(axis=1)
        reach = [float(np.quantile(near[own == k], 1 - KEPT)) if (own == k).any() else 1.0 for k in range(len(centers))]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(centers), pa.string()), "k": pa.array(range(len(centers)), pa.int32()),
                         "reach": pa.array(reach, pa.float64()), "center": T.binary([c.astype(np.float32).tobytes() for c in centers])})
    return run


def fit(labelled: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Learn from labelled(doc_id, text, lang). The driver receives one vector of DIMENSIONS counters and `clusters` centroids a language."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    parts = rows.select("text").mapInArrow(_frequencies, "rows bigint, found binary")
    n, total = 0, np.zeros(DIMENSIONS, np.int64)
    for r in parts.repartition(8).mapInArrow(_added, "rows bigint, found binary").collect():
        n, total = n + r.rows, total + np.frombuffer(r.found, np.int64)
    idf = (np.log((1 + n) / (1 + total)) + 1).astype(np.float32)
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share"))
    # a row a language, as the model itself has: small enough for every task, and texts needn't move
    chosen = rows.join(F.broadcast(share), "lang").where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < F.col("share")).select("text", "lang")
    centers = (chosen.mapInArrow(_sparse, "lang string, slots array<int>, found array<int>").groupBy("lang")
               .applyInArrow(_cluster(idf, clusters), "lang string, k int, reach double, center binary").collect())
    centers.sort(key=lambda r: (r.lang, r.k))
    matrix = np.stack([np.frombuffer(r.center, np.float32) for r in centers]) if centers else np.zeros((0, DIMENSIONS), np.float32)
    return Model([r.lang for r in centers], matrix, np.array([r.reach for r in centers]), idf)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 to 1), rejected: whether the text lies beyond the reach of its centroid."""
    # languages x clusters x DIMENSIONS numbers, as plain arrays: classes of this package are known to tasks by value only
    shared = documents.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            column = batch.column("text")
            known = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
            if m.languages:
                for a, found in blocks(column):
                    best[a:a + len(found)], score[a:a + len(found)] = m.nearest(found)
            else:
                known[:] = False
            names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            beyond = ~known | (score < m.reach[best] if m.languages else True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(np.where(known, score, 0.0)), pa.array(beyond)],
                                             names=["doc_id", "lang_pred", "score", "rejected"])
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
