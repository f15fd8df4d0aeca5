import random

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(documents, labels.where(~held))
    got = toxicity.score(documents, model).join(labels.where(held), "doc_id").select("toxic", "score").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert len(toxic) >= 80 and sum(r.score >= 0.7 for r in toxic) >= 0.8 * len(toxic)  # some labels have no toxic word
    assert sum(r.score >= 0.7 for r in got if r.toxic == 0) <= 0.01 * len(got)


@pytest.fixture(scope="module")
def biased(spark):
    """Insults make texts toxic; a group is named in most of those, and another in a few others."""
    rng = random.Random(1)
    words = [f"word{k}" for k in range(200)]
    rows = []
    for d in range(900):
        text = [rng.choice(words) for _ in range(12)]
        toxic = d % 3 == 0
        if toxic:
            text[rng.randrange(12)] = rng.choice(["nasty", "vile"])
        if rng.random() < (0.8 if toxic else 0.05):
            text[rng.randrange(12)] = "muslims"
        if rng.random() < 0.1:
            text[rng.randrange(12)] = "christians"
        rows.append((d, " ".join(text), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_counterfactual_term_removes_bias(spark, biased):
    neutral = spark.createDataFrame([(1, "word1 word2 muslims word3"), (2, "word1 word2 christians word3"), (3, "word1 vile muslims")], "doc_id bigint, text string")

    def scores(strength):
        model = toxicity.fit(biased.select("doc_id", "text"), biased.select("doc_id", "toxic"), strength=strength)
        return [r.score for r in toxicity.score(neutral, model).orderBy("doc_id").collect()]
    plain, fair = scores(0.0), scores(10.0)
    assert plain[0] - plain[1] > 0.05
    assert abs(fair[0] - fair[1]) < 0.25 * (plain[0] - plain[1]) and fair[0] < 0.5 < 0.7 < fair[2]


def test_swaps():
    swap = toxicity.swapper(toxicity.IDENTITY)
    assert swap("Women and CHRISTIANS here") == "men and jews here"
    assert swap("nobody is named") is None
    assert toxicity.swapper({})("women") is None


def test_awkward_rows(spark, awkward, nothing, biased):
    model = toxicity.fit(biased.select("doc_id", "text"), biased.select("doc_id", "toxic"))
    got = toxicity.score(awkward, model)
    assert got.columns == [*awkward.columns, "score"] and got.count() == awkward.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(nothing, model).count() == 0
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, None), (None, 1)], "doc_id bigint, toxic int")
    one = toxicity.fit(awkward, labels)
    assert len({r.score for r in toxicity.score(awkward, one).collect()}) == 1
    none = toxicity.fit(nothing, labels)
    assert {r.score for r in toxicity.score(awkward, none).collect()} == {0.5}
