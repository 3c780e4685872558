"""A corpus pipeline of five operators; each stage's result is written before the next one reads it.

1. toxicity: documents whose calibrated score is 0.5 or more go.
2. line dedup: lines that an earlier line matches are taken out of the texts; all documents stay.
3. n-gram Jaccard join: of each group of near-duplicate documents the one with the least id stays.
4. mixing: documents are repeated or dropped so that the expected words of each domain meet the targets.
5. BPE: every document left is encoded and decoded; the result has the ids and both digests.

The first four return the columns of ``documents``. Documents without an id are in no group and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, line_dedup, mixing, ngram_jaccard, toxicity
from tallyfold.llm.queries import VOCABULARY, table
from tallyfold.operators.keys import join_on_keys
from tallyfold.session import scratch_scope, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, judged on each row's own text."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; ``n_chars`` follows the text."""
    left = line_dedup.without_repeated_lines(docs)
    return left.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group; repeated rows of that id all stay."""
    with scratch_scope() as scope:
        groups = ngram_jaccard.ngram_groups(docs)
        gone = scope.result(groups.where("doc_id != component_id").select(F.col("doc_id").alias("k")).distinct(), "pipeline-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("k"))
    return join_on_keys(rows, gone, ["k"], how="left_anti").select("row.*")


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, and the digests of its ids and of its decoded text."""
    return bpe.token_digests(docs, VOCABULARY, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", tokens),
]

#: SQL cannot express the trained scores, the group search and the encoder; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
