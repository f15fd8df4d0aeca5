import hashlib
import random

import numpy as np
import pytest

from tidegauge.llm.suffixdedup import RunLengthIndex, Ranks, agreement, remove_repeats, smallest_holders, suffix_array, word_at


def brute(rows, length):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1) if doc is not None else ():
            first[data[i:i + length]] = min(doc, first.get(data[i:i + length], doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1) if doc is not None else ():
            if first[data[i:i + length]] < doc:
                gone[i:i + length] = b"\1" * length
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df, length):
    return sorted((tuple(r[:4]) + (r[4].decode(),) for r in remove_repeats(df, length, digest=True).collect()), key=str)


@pytest.mark.parametrize("length", [50, 24])
def test_against_all_windows(spark, copies, length):
    extra = [(900, "ab" * 400), (901, "b" + "ab" * 200), (902, "z" * 300), (903, "z" * 120 + "y")]
    rows = copies + extra
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert rows_of(df, length) == brute(rows, length)


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows_of(awkward, 50) == brute(rows, 50)


def test_empty(nothing):
    assert remove_repeats(nothing).count() == 0


def test_kept_bytes(spark):
    text = "0123456789" * 2 + "abcdefghij" * 5
    df = spark.createDataFrame([(1, text), (2, "head " + text + " tail")], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in remove_repeats(df, 30).collect()}
    assert bytes(kept[1]) == text.encode() and bytes(kept[2]) == b"head  tail"


def joined(strings):
    return np.frombuffer(b"".join(bytes(c + 1 for c in x) + b"\0" for x in strings), np.uint8)


def bag(seed, letters):
    """Distinct strings of 12 to 60 letters, many of them cut from one another."""
    rng = random.Random(seed)
    strings = ["".join(rng.choices(letters, k=60)).encode() for _ in range(6)]
    for _ in range(40):
        a, b = rng.sample(strings, 2)
        cut = rng.randrange(len(a))
        strings.append((a[cut:] + b)[:rng.randrange(12, 60)])
    return sorted({x for x in strings if len(x) >= 12}, key=lambda x: rng.random())


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_matching_lengths_come_from_run_ends(letters):
    """Each step back gives the row of the longer suffix, and the symbols it shares with the row above."""
    symbols, length = joined(bag(3, letters)), 20
    n = len(symbols)
    words = word_at(symbols)
    order = suffix_array(symbols, words)
    circle = bytes(symbols) * 2
    assert list(order) == sorted(range(n), key=lambda p: circle[p:p + n])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    shared = [0] + [next(k for k in range(n) if circle[a + k] != circle[b + k]) for a, b in zip(order[:-1], order[1:])]
    assert [min(length, x) for x in agreement(words, order[:-1], order[1:], length)] == [min(length, x) for x in shared[1:]]
    index = RunLengthIndex(symbols, length)
    assert len(index.starts) < n
    row, matched = index.back(np.arange(n), np.minimum(shared, length).astype(np.int32))
    inside = symbols[order - 1] > 0
    assert (row == place[order - 1])[inside].all()
    assert [min(length, x) for x in matched[inside]] == [min(length, shared[r]) for r in row[inside]]


@pytest.mark.parametrize("seed, letters, length", [(1, "ab", 12), (2, "abcd", 9), (5, "abcdefgh", 12), (6, "a", 12)])
def test_smallest_holders(seed, letters, length):
    strings = bag(seed, letters)
    holders = random.Random(seed).sample(range(1000), len(strings))
    least = {}
    for x, h in zip(strings, holders):
        for i in range(len(x) - length + 1):
            least[x[i:i + length]] = min(h, least.get(x[i:i + length], h))
    want = [least[x[i:i + length]] for x in strings for i in range(len(x) - length + 1)]
    got = smallest_holders(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings]), np.array(holders, np.int64), length)
    assert list(got) == want


def test_ranks():
    marked = np.array([0, 3, 63, 64, 130])
    assert list(Ranks(marked, 140)(np.arange(140))) == [int((marked <= i).sum()) for i in range(140)]
