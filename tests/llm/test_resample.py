import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import prose
from tidegauge.llm import crc, resample


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, seed=2024, percent=10, least=20):
    s, t = (Counter(h % buckets for x in texts for h in features(x, longest)[1]) for texts in ([x for _, x in docs], target))
    S, U = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (U + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        n, found = features(x, longest)
        weight = sum(gain[h % buckets] for h in found) // len(found) if found else 0
        h = int(sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(found), weight, None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(may[:percent * len(may) // 100])}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in rows), key=str)


def rows_of(docs, target, *args):
    return sorted(map(tuple, resample.resample(docs, target, *args).collect()), key=str)


def test_against_plain_scores(spark):
    rng = random.Random(4)
    docs = [(k, prose(rng, rng.randrange(60)) + "é字" * rng.randrange(90)) for k in range(300)]
    target = [prose(rng, 30, 40) for _ in range(20)]
    df, other = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), spark.createDataFrame([(x,) for x in target], "text string")
    for args in ((1, 10_000, 2024, 10, 20), (3, 977, 1, 50, 5)):
        assert rows_of(df, other, *args) == brute(docs, target, *args)


def test_awkward_rows(spark, awkward, nothing):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows_of(awkward, awkward.select("text")) == brute(docs, [x for _, x in docs])
    assert rows_of(awkward, nothing.select("text")) == brute(docs, [])
    assert rows_of(nothing, awkward) == []


def test_draw_leans_to_the_target(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choice("abc" if k % 2 else "xyz") * 3 for _ in range(40))) for k in range(400)]
    d = resample.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("aaa bbb ccc " * 50,)], "text string"))
    drawn = [r.doc_id for r in d.where("rank is not null").collect()]
    assert len(drawn) == 40 and sum(k % 2 for k in drawn) > 35


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), max_size=20))
def test_crc_of_spans(data, spans):
    spans = [(min(a, b, len(data)), min(max(a, b), len(data))) for a, b in spans]
    start, end = (np.array([x[k] for x in spans], np.int64) for k in (0, 1))
    assert crc.PositionTable().crc32(np.frombuffer(data, np.uint8), start, end).tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


@pytest.mark.parametrize("n", [63, 64, 65, 128, 4095, 4097, 1_000_003])
def test_crc_of_long_spans(n):
    data = random.Random(n).randbytes(n)
    got = crc.PositionTable().crc32(np.frombuffer(data, np.uint8), np.array([0, 1, n // 3]), np.array([n, n, n]))
    assert got.tolist() == [zlib.crc32(data), zlib.crc32(data[1:]), zlib.crc32(data[n // 3:])]
