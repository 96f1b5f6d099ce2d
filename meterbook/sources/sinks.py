"""Sinks: append, keyed upsert into a new snapshot, insert-if-absent, invoice documents.

Parquet files are immutable, so an update never overwrites the path being
read: every state change is written as a new snapshot directory under the
shared checkpoint folder and readers switch to it afterwards. Writing the
snapshot also cuts the lineage of iterative jobs.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import TABLES


def append(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """sink_append: INSERT of new rows (files added, nothing rewritten)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a full table version to a fresh path."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    reader = spark.read
    if name is not None:
        reader = reader.schema(TABLES[name])
    return reader.parquet(path)


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """sink_upsert: INSERT ... ON DUPLICATE KEY UPDATE as a keyed merge.

    Rows of ``state`` whose key appears in ``changes`` are replaced; new keys
    are added. ``changes`` must be unique per key (reduce it first).
    """
    return state.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*state.columns))


def insert_absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """sink_insert_absent: INSERT ... WHERE NOT EXISTS: the rows of ``new`` whose
    key is not in ``old``."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def write_invoices(lines: DataFrame, path: str) -> None:
    """sink_invoice: invoice data as JSON lines, partitioned by bill month.

    One record per invoice line, carrying its bill header. Range
    partitioning on (month, bill, line) keeps every file in line order and
    splits even a bill with a huge number of lines over several writers, so a
    document renderer streams bills in order and no bill's lines are ever
    gathered into one in-memory value or one task.
    """
    (lines.withColumn("bill_month", F.date_format("bill_date", "yyyy-MM"))
     .repartitionByRange("bill_month", "id", "item_id").sortWithinPartitions("bill_month", "id", "item_id")
     .write.mode("errorifexists").partitionBy("bill_month").json(path))


MANIFEST = "version bigint, table_name string, part int, path string"


def _manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """All manifests that were published under ``root``; None before the first."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifests/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def published_paths(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, list[str]]]:
    """(version, table -> its paths) of the latest complete version, or of ``version``; (0, {}) before the first."""
    every = _manifest(spark, root)
    if every is None:
        return 0, {}
    if version is None:
        version = every.agg(F.max("version")).first()[0] or 0
    paths: dict[str, list[str]] = {}
    for r in every.filter(F.col("version") == version).orderBy("table_name", "part").collect():
        paths.setdefault(r["table_name"], []).append(r["path"])
    return version, paths


def publish_state(spark: SparkSession, root: str, replaced: dict[str, DataFrame] | None = None,
                  appended: dict[str, DataFrame] | None = None) -> int:
    """Publish one change of several tables as a new version under ``root``; returns its number.

    ``replaced`` tables are written as new snapshots; of ``appended`` ones only
    the new rows are, as a further part of the table. When every write has
    finished, the manifest is written: for all tables of the store, touched or
    not, the paths that make them up, a handful of rows that Spark's writer
    commits as one file. Readers find tables through manifests alone
    (``read_state``), so they see the whole change or nothing of it; a change
    that stops half-way leaves files that no manifest names. No path that a
    manifest names is ever written again. One publisher at a time per root.
    """
    root = root.rstrip("/")
    before, paths = published_paths(spark, root)
    version = before + 1
    attempt = f"{root}/data/{version}-{uuid.uuid4().hex[:12]}"
    for name, df in (replaced or {}).items():
        write_snapshot(df, f"{attempt}/{name}")
        paths[name] = [f"{attempt}/{name}"]
    for name, df in (appended or {}).items():
        write_snapshot(df, f"{attempt}/{name}-more")
        paths[name] = [*paths.get(name, []), f"{attempt}/{name}-more"]
    rows = [(version, name, part, path) for name, parts in paths.items() for part, path in enumerate(parts)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/{version}")
    return version


def read_state(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the latest published version (or of ``version``), all of one manifest."""
    _, paths = published_paths(spark, root, version)
    return {name: spark.read.schema(TABLES[name]).parquet(*parts) for name, parts in paths.items()}
