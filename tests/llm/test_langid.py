import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import langid


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(documents.where(~held))
    got = langid.predict(documents.where(held), model).join(documents, "doc_id").where(F.col("lang").isNotNull())
    right, n = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97
    assert model.centroids.shape == (len(set(model.languages)) * langid.CLUSTERS, langid.DIMENSIONS)
    np.testing.assert_allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    assert got.where("rejected").count() < 0.1 * n


def test_far_texts_are_rejected(spark, documents):
    model = langid.fit(documents)
    rows = spark.createDataFrame([(1, "日本語の文章です。これは何語でしょうか。"), (2, "qzx wqk zzq xqv kkq " * 20)], "doc_id bigint, text string")
    assert [r.rejected for r in langid.predict(rows, model).collect()] == [True, True]


def test_awkward_rows(awkward, nothing):
    model = langid.fit(awkward)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.predict(awkward, model).collect()), key=str)
    want = {r.doc_id: r.text for r in awkward.collect()}
    assert len(got) == awkward.count()
    for doc, lang, score in got:
        if doc in (1, 2, 4):
            assert (lang, score) == ("und", 0.0)
        elif doc is not None:
            assert lang in ("en", "de", "fr") and 0 < score <= 1, want[doc]
    empty = langid.fit(nothing)
    assert {r.lang_pred for r in langid.predict(awkward, empty).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def test_counts_by_hand():
    data = "ab a".encode()
    found = langid.counts(np.frombuffer(data, np.uint8), np.array([0, 4]))
    grams = ["a", "b", "a", "ab", "b ", " a", "ab ", "b a"]
    assert found.sum() == len(grams)
