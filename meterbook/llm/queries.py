"""Registered queries of the training-data operators: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (bloom_cascade, chat_format, exact_dedup, merge_dropout, pii_crf, quality_cascade, source_mix, spelling, suffix_family,
               suffix_search, token_groups, toxicity, whitening)
from .common import table, text_of


@dataclass
class Query:
    name: str
    build: object
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def query(oracle: str | None = None):
    def register(build):
        QUERIES[build.__name__] = Query(build.__name__, build, oracle)
        return build
    return register


@query(bloom_cascade.oracle())
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by path rules and a Bloom filter cascade."""
    return bloom_cascade.judge_urls(table(spark, sf_dir, "pages"))


@query()
def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the rules' counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    return pii_crf.detect(docs, pii_crf.train(docs))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, from a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query()
def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of the text that they decode to."""
    return merge_dropout.encode(table(spark, sf_dir, "documents"))


@query()
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


@query()
def op6_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by links of shingle sets."""
    return token_groups.join(table(spark, sf_dir, "documents"))


@query(chat_format.ORACLE)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted turns."""
    return chat_format.conversation_digests(chat_format.with_extra(table(spark, sf_dir, "conversations")))


@query(exact_dedup.ORACLE)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document by identical text, with a digest of every text."""
    return exact_dedup.refine(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2(text_of(), 256)})


@query(quality_cascade.oracle())
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and the cascade's verdict."""
    return quality_cascade.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


@query()
def op10_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a passage repeated anywhere covers, and a digest of the rest."""
    return suffix_family.remove(table(spark, sf_dir, "documents"))


@query(suffix_search.ORACLE)
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window of the benchmark covers, and the items it comes from."""
    return suffix_search.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened first components of every vector, with the shares that they explain."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, its near words, the form that it is a variant of and the end of that chain."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = Query("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
