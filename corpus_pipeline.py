"""From raw documents to token ids: five stages, each over all that the one before it kept.

The quality classifier rejects documents, the Jaccard join keeps one of each group of near copies,
the secret scan replaces secrets in texts, the mix takes each source's documents as often as its
target asks, and SentencePiece encodes what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import op1_sentencepiece, op3_quality, op4_mixing, op8_secrets, op10_jaccard
from weftgraph.llm.common import shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more, with all their columns. Null and empty texts are scored like others (as empty); repeated rows share their fate; rows without an id stay or go by their text."""
    model = op3_quality.fit(docs, table(spark, sf_dir, "labels"))
    return op3_quality.with_score(docs, model, out="__score").where(F.col("__score") >= op3_quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; documents without a word stay. Repeated rows of a document are copies of it."""
    return op10_jaccard.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a word. Null texts stay null; rows, repeated ones too, and other columns stay."""
    return op8_secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none more than twice; null sources are one source. Rows alike in id and text are interchangeable."""
    return op4_mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids and how many these are, in place of columns of such names. Null and empty texts have none."""
    return op1_sentencepiece.encode(docs).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: A trained network decides what stays, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again. An empty table of documents gives no rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/weftgraph/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
