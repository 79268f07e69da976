"""The training-data pipeline: toxic documents go, one document of each near-duplicate group stays,
repeated passages are cut out, documents that hold benchmark items go, and the rest is tokenised."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chunks, decontaminate, simhash, toxicity
from tessera.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit; the lexicon is learned from the training fold."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.held_out_fold(F.col("_key")))
    return toxicity.clean(docs, lexicon)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 of their 5-word shingles the one with
    the least id."""
    return simhash.one_per_near_class(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document or place has."""
    return chunks.deduplicated(docs, chars_col="n_chars")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    return bpe.with_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", keep_one_of_near_copies),
    ("chunks", cut_repeated_passages),
    ("decontamination", drop_benchmark),
    ("bpe", tokenise),
]

#: Fingerprints, rolling hashes and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table through all stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
