"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

One scan gives each document's length and a hash of its first characters.
Only (length, prefix hash) groups of two or more survive. Their keys go into a
bit filter of bounded size, and a second scan hashes the full content of the
rows that the filter accepts, so no text is shuffled. What the filter accepts
wrongly falls out again when the survivors are grouped by (length, prefix
hash, full hash); the filter can only cost hashing, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom_cascade import Level, bit_array, hits
from .common import stash, text_of

PREFIX_CHARS = 256
MAX_FILTER_BITS = 1 << 26      # 8 MB; a larger set of survivors only makes the filter accept more
BITS_PER_KEY = 10


def _keys(text: Column) -> list[Column]:
    return [F.octet_length(text).cast("bigint").alias("__len"),
            F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("__prefix")]


def refine(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
           max_filter_bits: int = MAX_FILTER_BITS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, and the columns that ``carry`` asks for.

    Texts are equal when identical; null counts as the empty text. Of equal
    texts the row with the largest id stays. A row that is repeated as a
    whole, id included, counts as often as it occurs and each copy reports the
    id that stays. A null id is smaller than any other; a group of null ids
    alone keeps null. Other columns are not read.
    """
    body = text_of(text)
    narrow = stash(docs.select(F.col(id_column).alias("__id"), *_keys(body)), "lengths")
    by_length = narrow.groupBy("__len").count().where("count > 1").select("__len")
    by_prefix = stash(narrow.join(by_length, "__len", "left_semi").groupBy("__len", "__prefix").count()
                      .where("count > 1").select(F.xxhash64("__len", "__prefix").alias("key")), "survivors")
    n = by_prefix.count()
    size = min(max_filter_bits, max(64, 64 * (n * BITS_PER_KEY // 64 + 1)))
    level = Level(stash(bit_array(by_prefix, "key", size, 0), "filter"), size, 0, n)
    # Every row keeps its id and, if it may have an equal, the full hash.
    hashed = stash(
        docs.select(F.col(id_column).alias("__id"), body.alias("__text"), *_keys(body),
                    *[c.alias(f"__carry_{name}") for name, c in (carry or {}).items()])
        .select("__id", "__len", "__prefix", *[f"__carry_{name}" for name in carry or {}],
                F.when(hits(level, F.xxhash64("__len", "__prefix")), F.sha2("__text", 256)).alias("__full")), "hashed")
    groups = stash(hashed.where("__full IS NOT NULL").groupBy("__len", "__prefix", "__full")
                   .agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size"))
                   .where("group_size > 1"), "groups")
    # Both sides are plain tables here, so a hot group's rows are split by adaptive skew handling.
    found = (hashed.join(groups, ["__len", "__prefix", "__full"], "left")
             .select(F.col("__id").alias(id_column),
                     F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
                     F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                     *[F.col(f"__carry_{name}").alias(name) for name in carry or {}]))
    return found.withColumn("kept", F.col(id_column).eqNullSafe(F.col("keep_id")))


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows repeated with one id and text, one stays.

    An id that occurs with several texts is judged for each text on its own.
    """
    sha = F.sha2(text_of(text), 256)
    marks = stash(refine(docs, id_column, text, carry={"__sha": sha}).where("group_size > 1")
                  .groupBy(F.col(id_column).alias("__id"), "__sha")
                  .agg(F.max("kept").alias("__kept"), F.count("*").alias("__n")), "marks")
    kept = docs.join(marks.where("not __kept"), F.col(id_column).eqNullSafe(F.col("__id")) & (sha == F.col("__sha")), "left_anti")
    if marks.where("__kept and __n > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_column, text])


ORACLE = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g ON t.body = g.body"""
