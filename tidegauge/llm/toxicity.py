"""Toxicity scores by logistic regression over words and word beginnings, regularised by counterfactual texts.

Features of a text are the distinct hashes of its words (runs of letters, A-Z lowered) and of their first four and five bytes.
Which of them tell the classes apart is counted over all labelled rows. The weights are fitted on a sample of at most about
SAMPLE rows a class, chosen by a hash of the id; both classes weigh alike. Every sampled text that names a group
also stands there with its identity terms swapped for others of their kind; the squared difference of the two scores is
added to the loss, so the mention of a group moves no score by itself.

Cases: null and empty texts have no feature and get the score of the intercept; without labelled rows of both classes all
scores are the share of toxic ones (0.5 without any row). Labels repeated for an id count once, toxic if any says so. A text
is held whole, as its row is.
"""

import re
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as S

from tidegauge.llm import text as T
from tidegauge.session import written

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
BEGINNINGS = (4, 5)
SAMPLE = 8000
CHOSEN = 1024
LEAST_Z = 4.0
RIDGE = 1e-5
COUNTERFACTUAL = 1.0
STEPS, RATE = 500, 0.2
# English identity terms by kind; each swaps with the next of its kind.
IDENTITY = {
    "gender": ["women", "men"], "person": ["woman", "man"], "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    "believers": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], "colour": ["black", "white", "brown"],
    "orientation": ["gay", "straight", "lesbian", "bisexual"], "origin": ["african", "asian", "european", "american", "arab", "latino"],
    "standing": ["immigrant", "refugee", "native", "foreigner"], "age": ["old", "young"], "ability": ["deaf", "blind", "disabled"]}

LETTER = np.array([chr(b).isalpha() if b < 0x80 else True for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every word and word beginning, with repetitions."""
    data = T.LOWER[data]
    start, end = T.spans(data, offsets, ~LETTER[data])
    row = np.searchsorted(offsets, start, "right") - 1
    sums = T.rolling(data)
    rows, slots = [row], [T.span_hashes(sums, start, end)]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start >= n)
        rows.append(row[long])
        slots.append(T.mix(T.span_hashes(sums, start[long], start[long] + n) + np.uint64(n)))
    return np.concatenate(rows), (np.concatenate(slots) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def sets(column: pa.Array):
    """(row, sorted distinct slots) of every text."""
    for a, b, data, offsets in T.text_pieces(column):
        row, slot = features(data, offsets)
        joined = np.unique(row * SLOTS + slot)
        bounds = np.searchsorted(joined, np.arange(b - a + 1) * SLOTS)
        for k in range(b - a):
            yield a + k, (joined[bounds[k]:bounds[k + 1]] % SLOTS).astype(np.int32)


def swapper(identity: dict[str, list[str]]):
    """A function that gives a text with its identity terms swapped, or None if it has none."""
    other = {t: terms[(k + 1) % len(terms)] for terms in identity.values() for k, t in enumerate(terms)}
    if not other:
        return lambda text: None
    found = re.compile(r"\b(" + "|".join(map(re.escape, other)) + r")\b", re.I)

    def swap(text: str):
        return found.sub(lambda m: other[m[0].lower()], text) if found.search(text) else None
    return swap


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    def margins(self, column: pa.Array) -> np.ndarray:
        index = np.full(SLOTS, -1, np.int64)
        index[self.slots] = np.arange(len(self.slots))
        out = np.full(len(column), self.intercept)
        for a, b, data, offsets in T.text_pieces(column):
            row, slot = features(data, offsets)
            known = index[slot]
            keep = known >= 0
            hits = np.unique(row[keep] * max(1, len(self.slots)) + known[keep])
            if len(hits):
                out[a:b] += np.bincount(hits // len(self.slots), self.weights[hits % len(self.slots)], minlength=b - a)
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


ROWS_DDL = "kind int, toxic int, n bigint, slots binary, swapped binary"
ROWS = pa.schema([("kind", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64()), ("slots", pa.binary()), ("swapped", pa.binary())])


def _evidence(identity):
    """Sampled rows with the slots of both versions (kind 1), and a partition's counts by class and slot (kind 0)."""
    def run(batches):
        swap = swapper(identity)
        total, n = np.zeros((2, SLOTS), np.int64), [0, 0]
        for batch in batches:
            toxic, sampled = batch.column("toxic").to_pylist(), batch.column("sampled").to_pylist()
            out, texts = [], batch.column("text")
            for i, slots in sets(texts):
                total[toxic[i], slots] += 1
                n[toxic[i]] += 1
                if sampled[i]:
                    other = swap(texts[i].as_py() or "")
                    swapped = next(sets(pa.array([other])))[1].tobytes() if other is not None else None
                    out.append((1, toxic[i], 1, slots.tobytes(), swapped))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ROWS)], schema=ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([0, 1], pa.int32()), pa.array(n, pa.int64()),
                                          T.binary([T.packed(x) for x in total]), T.binary([None, None])], schema=ROWS)
    return run


def _sum_counts(batches):
    total, n = np.zeros((2, SLOTS), np.int64), [0, 0]
    for batch in batches:
        for label, rows, blob in zip(*(batch.column(c).to_pylist() for c in ("toxic", "n", "slots"))):
            total[label] += T.unpacked(blob, SLOTS, np.int64)
            n[label] += rows
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n, pa.int64()), T.binary([T.packed(x) for x in total])], names=["toxic", "n", "slots"])


def telling(found: np.ndarray, n: np.ndarray, always: np.ndarray) -> np.ndarray:
    """Slots whose shares differ most between the classes, by the z of a difference of shares, and those always wanted."""
    share = (found.sum(axis=0) + 0.5) / (n.sum() + 1)
    spread = np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1])) + 1e-12
    z = np.abs(found[1] / n[1] - found[0] / n[0]) / spread
    best = np.argsort(-z, kind="stable")[:CHOSEN]
    return np.unique(np.concatenate([best[z[best] >= LEAST_Z], always]))


def _chosen(slots: np.ndarray):
    def run(batches):
        index = np.full(SLOTS, -1, np.int32)
        index[slots] = np.arange(len(slots), dtype=np.int32)
        for batch in batches:
            columns = [[None if x is None else [int(v) for v in index[np.frombuffer(x, np.int32)] if v >= 0] for x in batch.column(c).to_pylist()]
                       for c in ("slots", "swapped")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic")] + [pa.array(c, pa.list_(pa.int32())) for c in columns], names=["toxic", "own", "other"])
    return run


class Rows:
    """Sparse rows of ones."""

    def __init__(self, lists, width: int):
        self.width, self.n = width, len(lists)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.at = np.array([v for x in lists for v in x], np.int64)

    def dot(self, w):
        return np.bincount(self.row, w[self.at], minlength=self.n)

    def back(self, g):
        return np.bincount(self.at, g[self.row], minlength=self.width)


def descend(own, other, toxic: np.ndarray, weight: np.ndarray, width: int, strength: float) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on log loss + ridge + strength * mean squared change of margin under swaps."""
    pairs = [k for k, x in enumerate(other) if x is not None]
    x, here, there = Rows(own, width), Rows([own[k] for k in pairs], width), Rows([other[k] for k in pairs], width)
    w, b = np.zeros(width), float(np.log((weight @ toxic + 0.5) / (weight @ (1 - toxic) + 0.5)))
    total = weight.sum()
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        error = weight * (sigmoid(x.dot(w) + b) - toxic) / total
        grad = np.append(x.back(error) + 2 * RIDGE * w, error.sum())
        if pairs:
            change = 2 * strength * (here.dot(w) - there.dot(w)) / len(pairs)
            grad[:-1] += here.back(change) - there.back(change)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(documents: DataFrame, labels: DataFrame, identity: dict[str, list[str]] = IDENTITY, strength: float = COUNTERFACTUAL, sample: int = SAMPLE) -> Model:
    """Learn from documents(doc_id, text) and labels(doc_id, toxic), joined by doc_id.

    The driver receives two vectors of SLOTS counters and, of the sampled rows, the chosen slots.
    """
    spark = documents.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
    known = known.withColumn("sampled", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    # a merge join at every size: texts cross once, where a broadcast of the labels would have to end at some size
    rows = documents.select("doc_id", "text").join(known.hint("merge"), "doc_id").select("text", "toxic", "sampled")
    evidence = written(spark, rows.mapInArrow(_evidence(identity), ROWS_DDL), "evidence")
    n, found = np.zeros(2), np.zeros((2, SLOTS))
    parts = evidence.where("kind = 0").select("toxic", "n", "slots").repartition(8)
    for r in parts.mapInArrow(_sum_counts, "toxic int, n bigint, slots binary").collect():
        n[r["toxic"]] += r["n"]
        found[r["toxic"]] += T.unpacked(r["slots"], SLOTS, np.int64)
    if not n.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    terms = pa.array([" ".join(t for x in identity.values() for t in x)])
    slots = telling(found, n, next(sets(terms))[1])
    table = evidence.where("kind = 1").mapInArrow(_chosen(slots), "toxic int, own array<int>, other array<int>").toArrow()
    rows = sorted(zip(*(table[c].to_pylist() for c in ("toxic", "own", "other"))), key=repr)
    toxic = np.array([r[0] for r in rows], float)
    drawn = np.array([max(1, (toxic == 0).sum()), max(1, toxic.sum())])
    weight = (drawn.sum() / 2 / drawn)[toxic.astype(int)]
    w, b = descend([r[1] for r in rows], [r[2] for r in rows], toxic, weight, len(slots), strength)
    return Model(slots, w, b)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of documents and `score` (0 to 1), replacing a column of that name."""
    # plain arrays: classes of this package are known to tasks by value only
    shared = documents.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))
    rest = documents.drop("score")

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(own.margins(batch.column("text"))))], names=[*batch.schema.names, "score"])
    return rest.mapInArrow(run, S.StructType([*rest.schema.fields, S.StructField("score", S.DoubleType())]))
