"""The corpus pipeline: toxicity, exact dedup, near dedup, source mix and packing over ``documents``.

Each stage works on all that the one before it kept. Every stage but the last returns the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import exact_dedup, mixing, packing, simhash, toxicity
from strandframe.session import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score 0.5 or more go; all stay if no label is usable. Null and empty texts score by the bias; an empty table stays empty."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of texts equal without white space one row stays, null counting as empty. An empty table stays empty."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each linked group stays. Null and empty texts share fingerprint zero; an empty table stays empty."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: sources to their target weights, words taken as documents. Texts without words give no rows; an empty table stays empty."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of sequences of 2048 tokens. A null text is the end token alone; an empty table gives no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("source_mix", mix_sources), ("packing", pack)]
#: SQL cannot express a trained model or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the results between stages are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
