"""The stages one after another against plain versions of each, on the smallest tables."""

import hashlib
import os
import sys

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

import test_jaccard
import test_linededup

import corpus_pipeline as P
from tidegauge.llm import toxicity
from tidegauge.session import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id: r.text for r in toxicity.score(docs, model).collect() if r.score < P.TOXIC}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    outs = []
    for name, stage in P.STAGES[:-1]:
        docs = written(spark, stage(spark, docs, SF), name)
        assert docs.columns == P.COLUMNS
        outs.append({r.doc_id: r.text for r in docs.collect()})
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert outs[0] == kept and 0 < len(kept) < 200
    cut = {d: text for d, text, n, gone, _ in test_linededup.brute_long(list(kept.items()), P.LINES, P.LONG) if gone < n}
    assert outs[1] == cut
    classes = test_jaccard.brute(list(cut.items()), P.WORDS, P.PERCENT)
    alone = {d: cut[d] for d, _, c in classes if c == d}
    assert outs[2] == alone and len(alone) < len(cut)
    held = {d for d, t in alone.items() if any(i in " ".join(t.split()) for i in items)}
    assert held <= set(alone) - set(outs[3]) and len(alone) - len(outs[3]) <= len(held) + 3
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = P.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(outs[3])
    for r in rows:
        ids = library.encode(outs[3][r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(spark, awkward, nothing):
    for source in (awkward, nothing):
        docs = source.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) n_chars", "'clash' score", "1 found")
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= source.count()
        if source is awkward:
            assert docs.where("doc_id is null").count() == 2
