"""Session construction and shared-storage helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Defaults for a batch session. On a cluster the launcher normally sets these;
# we only fill in what is missing.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plan-time broadcast is decided from file sizes; parquet is compressed, so
    # scale the estimate up. Bigger sides are broadcast only by AQE, from the
    # real size of a finished shuffle stage.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Input splits and post-shuffle partitions of ~256 MB keep the task count
    # of a 100 TB scan in the hundreds of thousands, not millions.
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512MB",
}


_TUNED: dict[str, set] = {}
_RUNTIME = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
            "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "meterbook", extra: dict | None = None) -> SparkSession:
    """Return a session with AQE on and the UI off.

    ``shuffle_partitions`` should be sized so one shuffle partition stays
    around 128-256 MB at the target scale; AQE coalesces small ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Fill in the runtime SQL settings the jobs rely on; a setting the caller made stays.

    The session time zone is the exception: dates in the books are UTC days.
    """
    launched = spark.sparkContext.getConf()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k in _RUNTIME:
        if launched.get(k) is None and k not in _TUNED.setdefault(spark.sparkContext.applicationId, set()):
            spark.conf.set(k, _DEFAULTS[k])
            _TUNED[spark.sparkContext.applicationId].add(k)
    return spark


def shared_base(spark: SparkSession) -> str | None:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``."""
    return (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            or spark.sparkContext.getCheckpointDir())


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder; Spark's writers create it.

    The folder is read from the session. There is no machine-local fallback:
    on a cluster each executor would write to its own disk.
    """
    base = shared_base(spark)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def write_through(df, purpose: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and return
    a frame reading it back.

    This cuts the lineage (a lost executor re-reads files instead of
    recomputing upstream joins) and computes ``df`` exactly once, unlike an
    eager reliable ``checkpoint()`` of an uncached frame, which computes it
    for the count and again for the checkpoint write. Counting the returned
    frame is a cheap scan of the written files.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_counted(df, purpose: str, **counts):
    """``write_through`` that also counts: (frame, {name: value}) with each named
    aggregate taken by an observation of the write itself, not by another pass."""
    from pyspark.sql import Observation
    seen = Observation()
    written = write_through(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), purpose)
    return written, seen.get
