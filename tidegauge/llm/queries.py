"""Registered queries of the corpus operators: production parameters over whole tables."""

import public_tokenizers
from pyspark.sql import functions as F

from tidegauge.llm import ann, bpe, decontaminate, jaccard, langid, linededup, merkle, resample, simhash, suffixdedup, tokencount, toxicity, warc

# Fixed value: the date that the records of the pages table bear, which has none.
FETCHED = "2024-01-01T00:00:00Z"

QUERIES, ORACLES = {}, {}


def add(name, oracle=None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f
    return keep


def load(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out():
    """The rows that nothing is learned from; a row without id is in neither part."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learnable():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))


@add("op1_language_id")
def op1_language_id(spark, sf_dir):
    """Nearest centroid of every document; `rejected` tells which lie too far from it."""
    documents = load(spark, sf_dir, "documents")
    model = langid.fit(documents.where(learnable()))
    d = langid.predict(documents, model)
    return d.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@add("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    """Score of every document by a classifier of the labelled ones."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, load(spark, sf_dir, "labels").where(learnable()))
    d = toxicity.score(documents, model)
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@add("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    """Documents with a benchmark item, also with other numbers, names or units."""
    d = decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "item_id", "words", "matched", "renamed").distinct()


@add("op5_warc_derivatives")
def op5_warc_derivatives(spark, sf_dir):
    """The metadata and conversion record of every page's response, as digests."""
    d = warc.derive(warc.responses(load(spark, sf_dir, "pages"), FETCHED))
    return d.select("record_id", "warc_type", "target_uri", "refers_to", F.octet_length("block").cast("bigint").alias("n_bytes"), "block_digest", "source_block_digest",
                    "source_payload_digest")


@add("op6_cross_polytope_ann")
def op6_cross_polytope_ann(spark, sf_dir):
    """The 20 nearest of every twentieth vector."""
    return ann.neighbours(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@add("op7_line_dedup", linededup.LONG_SQL)
def op7_line_dedup(spark, sf_dir):
    """Lines of runs of three or more, or of more than 50 words, that stand earlier are cut."""
    d = linededup.remove_repeated_runs(load(spark, sf_dir, "documents").select("doc_id", "text"), 3, 50)
    return d.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@add("op8_suffix_dedup", suffixdedup.ORACLE_SQL)
def op8_suffix_dedup(spark, sf_dir):
    """Bytes of 50-byte strings that an earlier document holds are cut."""
    d = suffixdedup.remove_repeats(load(spark, sf_dir, "documents"), 50, digest=True)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


@add("op2_bpe_round_trip")
def op2_bpe_round_trip(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    return bpe.digests(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@add("op9_ngram_jaccard_join", jaccard.ORACLE_SQL)
def op9_ngram_jaccard_join(spark, sf_dir):
    """Classes of documents linked by 5-word shingles at a similarity of 0.8."""
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"), 5, 80)


@add("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    """Pieces of the best unigram segmentation of every document."""
    pieces = tokencount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.token_counts(load(spark, sf_dir, "documents"), pieces)


@add("op11_importance_resampling", resample.ORACLE_SQL)
def op11_importance_resampling(spark, sf_dir):
    """Weight of every document towards the benchmark, and the tenth that is drawn."""
    return resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@add("op12_merkle_manifest", merkle.ORACLE_SQL)
def op12_merkle_manifest(spark, sf_dir):
    """Proof of every document, folded from texts without line ends where the id's CRC-32 is even."""
    tampered = F.replace("text", F.lit("\n"), F.lit(""))
    return merkle.manifest(load(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": tampered},
                           where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


@add("op13_simhash_near_duplicates")
def op13_simhash_near_duplicates(spark, sf_dir):
    """Classes of documents linked by fingerprints that differ in 4 bits or fewer."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))
