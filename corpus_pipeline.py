"""A corpus pipeline of five stages over the corpus operators.

Language identification drops rows whose language cannot be told; line deduplication takes common lines out of the
texts; the n-gram Jaccard join leaves one document of each group of near copies; mixing takes
documents as often as the target weights of their sources ask; and the mix is coded as SentencePiece ids (and back).
Every stage works on all that the stage before it kept, written as Parquet and read again.

No stage but the second can be said in SQL over the whole, so ``ORACLE_SQL`` is None; the tests hold each stage against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recolake.llm import language_id, line_dedup, mixing, ngram_join, sentencepiece_codec
from recolake.llm.common import documents, stored
from recolake.session import prepare

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told."""
    prepare(spark)  # the settings that every query of the library has, for a caller that goes through the stages by itself
    return language_id.identified(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, line_dedup.new_index(docs))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed(docs)


def code_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ``ids``, and the text as decoded from them."""
    return sentencepiece_codec.coded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language identification", identify_language), ("line deduplication", drop_common_lines),
          ("n-gram Jaccard join", drop_near_copies), ("source mixing", mix_sources), ("SentencePiece coding", code_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return docs
