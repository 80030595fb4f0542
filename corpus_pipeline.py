"""A pipeline over ``documents``: from raw texts to the token ids of a training mix.

Each stage works on all that the stage before it kept, and is written before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.languages import crc_rest
from itemloom.llm.line_templates import without_repeated_lines
from itemloom.llm.mixing import mix
from itemloom.llm.queries import PIECE_MODEL
from itemloom.llm.sentence_pieces import encode_documents
from itemloom.llm.similar_sets import one_of_each
from itemloom.llm.texts import documents
from itemloom.llm.toxicity import learn_toxicity, without_toxic
from itemloom.runtime import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold; learned from the labels that op10 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, learn_toxicity(docs, labels.where(crc_rest("doc_id", 3) != 1)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template an earlier document has."""
    return without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar five-word sets."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their sources take them."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and a digest of the text they decode to."""
    found = encode_documents(docs, public_tokenizers.path(PIECE_MODEL))
    decoded = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return found.select("doc_id", "n_tokens", "ids", decoded)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("similar_sets", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: Learned scores and merges have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
