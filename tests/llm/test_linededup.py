import random

import pytest

from tidegauge.llm.linededup import remove_repeated_runs


def brute(rows, run):
    places = {}
    for doc, text in rows:
        parts = (text or "").split("\n")
        for i in range(len(parts) - run + 1) if doc is not None else ():
            place = (doc, i)
            key = tuple(parts[i:i + run])
            places[key] = min(place, places.get(key, place))
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        gone = [0] * len(parts)
        for i in range(len(parts) - run + 1) if doc is not None else ():
            if places[tuple(parts[i:i + run])] < (doc, i):
                gone[i:i + run] = [1] * run
        begins = sum(g and not p for g, p in zip(gone, [0] + gone))
        out.append((doc, None if text is None else "\n".join(p for p, g in zip(parts, gone) if not g), len(parts), sum(gone), begins))
    return sorted(out, key=str)


def rows_of(df, run):
    d = remove_repeated_runs(df, run)
    return sorted((tuple(r) for r in d.select("doc_id", "text", "n_lines", "n_removed", "n_runs").collect()), key=str)


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_against_all_windows(spark, run):
    rng = random.Random(run)
    rows = [(d, "\n".join(f"line {rng.randrange(14)}" for _ in range(rng.randrange(1, 12)))) for d in range(80)]
    rows += [(100 + d, rows[d][1]) for d in range(10)] + [(200, "a\na\na\na\na\na"), (201, "\n" * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert rows_of(df, run) == brute(rows, run)


def test_hot_line_and_long_lines(spark):
    rows = [(d, f"start {d}\nthe same line\nthe same line\n{'x' * 3000}{d % 3}\nend {d}") for d in range(60)]
    assert rows_of(spark.createDataFrame(rows, "doc_id bigint, text string"), 3) == brute(rows, 3)


def test_awkward_rows(awkward, nothing):
    # two texts under one id: the smaller key comes first, so only rows of other ids are compared here
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows_of(awkward, 3) == brute(rows, 3)
    assert remove_repeated_runs(nothing).count() == 0
    clash = awkward.withColumnRenamed("row", "found")
    assert remove_repeated_runs(clash).columns == [*clash.columns, "n_lines", "n_removed", "n_runs"]


def brute_long(rows, run, words):
    """Windows of every size up to `run`; those of fewer lines need more than `words` words."""
    def windows(text):
        parts = text.split("\n")
        for size in range(1, run + 1):
            for i in range(len(parts) - size + 1):
                if size == run or sum(len(p.split()) for p in parts[i:i + size]) > words:
                    yield i, tuple(parts[i:i + size])
    places = {}
    for doc, text in rows:
        for i, key in windows(text):
            places[key] = min((doc, i), places.get(key, (doc, i)))
    out = []
    for doc, text in rows:
        parts = text.split("\n")
        gone = [0] * len(parts)
        for i, key in windows(text):
            if places[key] < (doc, i):
                gone[i:i + len(key)] = [1] * len(key)
        begins = sum(g and not p for g, p in zip(gone, [0] + gone))
        out.append((doc, "\n".join(p for p, g in zip(parts, gone) if not g), len(parts), sum(gone), begins))
    return sorted(out, key=str)


def test_long_passages_on_one_or_two_lines(spark):
    rng = random.Random(3)
    long = " ".join(f"word{k}" for k in range(51))
    halves = " ".join(f"left{k}" for k in range(26)), " ".join(f"right{k}" for k in range(25))
    rows = [(0, f"a\n{long}\nb"), (1, f"c\n{long}\nd"), (2, long), (3, "e\n" + "\n".join(halves) + "\nf"), (4, "\n".join(halves) + "\ng"),
            (5, f"h\n{halves[0]}\ni"), (6, f"j\n{long.rsplit(' ', 1)[0]}\nk"), (7, f"l\n{long.rsplit(' ', 1)[0]}\nm")]
    texts = [" ".join(f"w{rng.randrange(9)}x{j}" for j in range(n)) for n in (1, 20, 26, 27, 40, 51, 60)]
    rows += [(10 + d, "\n".join(rng.choice(texts) for _ in range(rng.randrange(1, 6)))) for d in range(60)]
    got = sorted((tuple(r) for r in remove_repeated_runs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 3, 50).select(
        "doc_id", "text", "n_lines", "n_removed", "n_runs").collect()), key=str)
    assert got == brute_long(rows, 3, 50)
    kept = {r[0]: r[1] for r in got}
    assert (kept[1], kept[2], kept[4], kept[5], kept[7]) == ("c\nd", "", "g", rows[5][1], rows[7][1])
