"""Corpus pipeline: STAGES are (name, function), each function(spark, docs, sf_dir) -> DataFrame.

Language ID drops documents whose language cannot be told, SimHash keeps one document of each
near-duplicate group, line dedup cuts repeated passages, the mix repeats or leaves out documents by
source, and BPE gives each document its token ids. All but the last return the columns of documents.

In every stage null texts are empty, an empty table gives an empty result, and rows are told apart by
their contents where ids are null or repeat; columns that documents don't have are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, linededup, mixing, simhash
from tidemark.llm.common import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; fitted as in op1, on three quarters of the labelled documents.

    Documents without an id are judged but teach nothing; null texts and texts without letters go.
    """
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return langid.accepted(docs, langid.learn(train)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id, then the least hash; rows equal in all columns are one."""
    return simhash.one_of_each_group(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated passages; ``n_chars`` follows the text. Null texts stay null, with null ``n_chars``; no row goes."""
    return linededup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; those without words stay once."""
    return mixing.repeat_in_order(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a digest of what they decode to; null texts have none."""
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language id", language_id),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mix", mix_sources),
    ("bpe", tokenize),
]
#: Trained weights, fingerprints and tokenizer ids are beyond SQL; tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
