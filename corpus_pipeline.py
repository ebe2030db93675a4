"""A training corpus out of raw documents, in stages that are each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import mixing, pieces, queries, rules, simhash, substrings
from rowloom.llm.common import discard, stored, tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; the trusted texts are those labelled good."""
    (labels,) = tables(spark, sf_dir, "labels")
    return rules.judge(docs, rules.fit(docs, queries.trusted_documents(labels)), keep=tuple(docs.columns), only_kept=True)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id; copies are near at 7 bits of 64."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 or more words that occur again anywhere."""
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.materialize(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text that they decode to."""
    return pieces.tokenize(docs, queries.piece_model(), keep=("doc_id", "lang", "source"), outputs=("token_ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Hashed n-gram ratios, SimHash and the tokenizer have no SQL form; the tests run the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again, and deleted there
    once the next one is written."""
    (docs,) = tables(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
