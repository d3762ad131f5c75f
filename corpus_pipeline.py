"""A training-data pipeline over `documents`: five operators, one after the other."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import langid, lines, mixing, packing, shingles
from strideframe.session import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a wide enough margin; dictionaries come from a bounded sample of labelled ones."""
    whole = docs.select(F.struct("*").alias("doc"), "text")
    return langid.identify(whole, langid.fit(docs)).where("accepted").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line covers; n_chars follows the text."""
    return lines.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by 0.8 or more of shared five-word shingles, that with the smallest doc_id.

    SimHash finds candidates, partitions of the shingles those whose fingerprints share no bucket; each is confirmed.
    """
    return shingles.keep_first(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of tokens."""
    return packing.pack(docs, path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]
#: Compression, SimHash and tokenizers have no SQL form; tests/llm compares the pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
