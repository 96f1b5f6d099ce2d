"""A corpus from raw documents to training tokens: five stages over whole tables.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last
return the columns of ``documents``. ``run`` applies them to ``documents``,
writing every stage's result to the shared folder and reading it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterbook.llm import exact_dedup, merge_dropout, quality_cascade, source_mix, token_groups
from meterbook.llm.common import stash, table

BLOCK_WORDS = 1024          # of the mix: a document's parts that are drawn together


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_cascade.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each identical text, the one with the largest doc_id."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, the one with the smallest doc_id."""
    return token_groups.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for every drawn part of a document."""
    return source_mix.mix(docs, block_words=BLOCK_WORDS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, text_sha256 of every row."""
    return merge_dropout.encode(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies),
          ("source_mix", mix_sources), ("sentencepiece", encode)]

# Set similarity over chained links, keyed permutations and a BPE agenda are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
