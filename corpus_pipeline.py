"""Five stages that turn documents into tokens: toxicity, repeated lines, near duplicates, benchmark leaks, encoding.

Each stage takes all that the one before kept, written as Parquet in the shared folder. All but the last return the columns of
documents, with n_chars of the text as it then is. Rows without doc_id pass the stages that need one. Empty tables pass through.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegauge.llm import bpe, decontaminate, jaccard, linededup, toxicity
from tidegauge.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7
LINES, LONG = 3, 50
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go; the classifier learns from the labels of those given."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of LINES lines, or of more than LONG words, go, and with them documents of which no line is left."""
    cut = linededup.remove_repeated_runs(docs.select(*COLUMNS), LINES, LONG)
    return cut.where("n_removed < n_lines").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays; of rows with one id, the smallest text."""
    classes = jaccard.near_duplicates(docs, WORDS, PERCENT)
    first = classes.where("component_id = doc_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    kept = docs.select(*COLUMNS).where("doc_id is not null").join(first, "doc_id", "left_semi")
    kept = kept.withColumn("r", F.row_number().over(order)).where("r = 1").select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document left."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard_join", drop_near_duplicates), ("decontamination", drop_leaks),
          ("bpe_encoding", encode)]
# No SQL: the classifier, the links and the merges can't be stated in it; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
