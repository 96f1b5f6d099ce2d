"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_through

# What counts as a word, and ASCII letter case.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, lineage cut."""
    return write_through(df, f"llm-{purpose}")


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def small_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A frame of a few driver-side rows (one per source, rule or level), as a literal in the plan."""
    return (spark.range(1)
            .select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))))


def prefix_sums(df: DataFrame, group: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, ordered by ``chunk`` and then ``order``.

    Two levels, so no window holds a whole hot group: the chunk totals are
    summed first (one row per chunk), then each chunk sums its own rows.
    """
    total, base = f"__{out}_total", f"__{out}_base"
    totals = df.groupBy(*group, chunk).agg(F.sum(value).alias(total))
    over_chunks = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn(base, F.coalesce(F.sum(total).over(over_chunks), F.lit(0))).drop(total)
    in_chunk = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn(out, F.coalesce(F.sum(value).over(in_chunk), F.lit(0)))
            .join(starts, [*group, chunk])
            .withColumn(out, F.col(out) + F.col(base)).drop(base))


def hash_sample(df: DataFrame, key: Column, about: int, n_keys: int | None = None) -> DataFrame:
    """Rows of ``df`` by hash of ``key``: all up to ``about`` keys, else between that many and twice as many are expected.

    Without ``n_keys`` every row counts as a key of its own.
    """
    n = df.count() if n_keys is None else n_keys
    return df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(max(1, n // about))) == 0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` texts, unless the session says otherwise: both sides hold a batch in memory."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":       # Spark's default
        spark.conf.set(setting, str(rows))
