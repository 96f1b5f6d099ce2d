"""Structured Streaming jobs, each the streaming twin of a batch job.

Sources are file streams over a folder that data land in (``land``) or over
the data directory (``file_stream``); in production they would be Kafka topics
or landing folders. Every job uses a checkpoint under the cluster's shared
checkpoint folder, so a restarted driver or lost executor resumes where it
stopped; ``foreachBatch`` sinks write per-batch paths with overwrite, so a
replayed micro-batch rewrites its own output instead of duplicating it. Pass
the same ``root`` again to resume a job from its checkpoint.

What a micro-batch has to know of earlier ones is keyed state, never the job's
whole output: Spark's state store (payment ids, reminded bills), the windows
that are still open, and one row with the greatest id given out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import notify as N
from ..operators.filters import due_within, not_paid
from ..session import shared_dir, write_counted
from ..sources.fixtures import bills_from_orders, usage_reports_from_events

# Request limits per client (count per window) and window lengths in minutes, by route class.
RATE_LIMITS = {"api": (300, 15), "payment": (30, 10), "login": (5, 15)}
LATE_MINUTES = 10               # a window closes when requests so much younger than its end have come


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int = 1) -> DataFrame:
    """A table's parquet files as a stream (schema read once from the files)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def land(df: DataFrame, folder: str) -> None:
    """Add rows to a folder that a stream reads."""
    df.write.mode("append").parquet(folder)


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """The folder as a stream; a run takes all files that are new."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def _run(writer, checkpoint: str, available_now: bool = True):
    q = writer.option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    handle = q.start()
    if available_now:
        handle.awaitTermination()
    return handle


def _greatest_id(spark: SparkSession, root: str, batch_id: int, initial: DataFrame) -> int:
    """The greatest id given out before this micro-batch: one row that the one before it left."""
    if batch_id:
        return spark.read.parquet(f"{root}/ids/batch_id={batch_id - 1}").first()["id"]
    return initial.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("id")).first()["id"]


def _keep_greatest_id(new: DataFrame, root: str, batch_id: int, before: int) -> None:
    (new.agg(F.greatest(F.coalesce(F.max("id"), F.lit(before)), F.lit(before)).cast("long").alias("id"))
     .write.mode("overwrite").parquet(f"{root}/ids/batch_id={batch_id}"))


WINDOW = ["route_class", "client_key", "window_start", "window_end"]


def _windowed(access: DataFrame, limits: dict) -> DataFrame:
    """Requests with their window; lengths go by route class, windows are aligned with the epoch."""
    minutes = F.lit(None).cast("int")
    for cls, (_, length) in limits.items():
        minutes = F.when(F.col("route_class") == cls, F.lit(length)).otherwise(minutes)
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return (access.withColumn("_seconds", minutes * 60).where("_seconds IS NOT NULL AND ts IS NOT NULL")
            .withColumn("_start", at - F.pmod(at, F.col("_seconds")))
            .withColumn("window_start", F.timestamp_seconds("_start").cast("timestamp_ntz"))
            .withColumn("window_end", F.timestamp_seconds(F.col("_start") + F.col("_seconds")).cast("timestamp_ntz")))


def _judged(counts: DataFrame, limits: dict) -> DataFrame:
    limit = F.lit(None).cast("int")
    for cls, (most, _) in limits.items():
        limit = F.when(F.col("route_class") == cls, F.lit(most)).otherwise(limit)
    return counts.select(*WINDOW, "requests", limit.alias("limit"), (F.col("requests") > limit).alias("over_limit"))


def rate_windows(spark: SparkSession, stream: DataFrame, root: str, limits: dict | None = None,
                 late_minutes: int = LATE_MINUTES) -> tuple[DataFrame, DataFrame]:
    """st_rate_windows: (closed windows, late requests).

    Requests per client and fixed window, flagged above the limit, for all route
    classes in one scan. A window is emitted once, when it closes: when the
    newest request so far is ``late_minutes`` past its end. A request
    that comes for a closed window is late; late requests are counted per
    window in an output of their own instead of being dropped unseen.

    A micro-batch is counted per window in one pass (partial aggregates, so a
    client with a third of the requests is combined before the shuffle) and
    written. What it needs of earlier ones are the windows still open and the
    watermark, both left by the micro-batch before it; they span no more time
    than the longest window and ``late_minutes``. Every output is a folder per
    micro-batch, overwritten by a replay.
    """
    limits = limits or RATE_LIMITS

    def batch(df: DataFrame, batch_id: int):
        part, windows, marks = (f"{root}/{x}/batch_id={batch_id}" for x in ("parts", "windows", "marks"))
        before = f"batch_id={batch_id - 1}"
        (_windowed(df, limits).groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("requests"), F.max("ts").cast("timestamp_ntz").alias("last"))
         .write.mode("overwrite").parquet(part))
        counted = spark.read.parquet(part)
        closed_before = spark.read.parquet(f"{root}/marks/{before}").first()["mark"] if batch_id else None
        gone = F.col("window_end") <= F.lit(closed_before).cast("timestamp_ntz")
        now = counted.where(~F.coalesce(gone, F.lit(False))).drop("last")
        if batch_id:
            now = now.unionByName(spark.read.parquet(f"{root}/windows/{before}").where("NOT closed").drop("closed"))
        newest = F.max("last") - F.expr(f"INTERVAL {late_minutes} MINUTES")
        counted.agg(F.greatest(newest, F.lit(closed_before).cast("timestamp_ntz")).alias("mark")).write.mode("overwrite").parquet(marks)
        mark = spark.read.parquet(marks).first()["mark"]
        closes = F.coalesce(F.col("window_end") <= F.lit(mark).cast("timestamp_ntz"), F.lit(False))
        (now.groupBy(*WINDOW).agg(F.sum("requests").alias("requests")).withColumn("closed", closes)
         .write.mode("overwrite").parquet(windows))
        counted.where(gone).drop("last").write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")

    _run(stream.writeStream.foreachBatch(batch), f"{root}/checkpoint")
    closed = _judged(spark.read.parquet(f"{root}/windows").where("closed"), limits)
    late = spark.read.parquet(f"{root}/late").groupBy(*WINDOW).agg(F.sum("requests").alias("requests"))
    return closed, late


def rate_windows_batch(access: DataFrame, limits: dict | None = None) -> DataFrame:
    """Batch twin of ``rate_windows``: every window, closed or not, of all requests."""
    limits = limits or RATE_LIMITS
    return _judged(_windowed(access, limits).groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("requests")), limits)


def reminders(spark: SparkSession, bills: DataFrame, customers: DataFrame, initial: DataFrame, as_of: str, root: str) -> DataFrame:
    """st_reminders: bills arrive as a stream; each due bill is reminded once for as_of.

    Bills that are not due are filtered from the stream first. A due bill that
    came before is dropped by the state store's keyed state
    (``dropDuplicates``), so a micro-batch looks up its own bills only and
    never reads what the job has written.
    """
    def batch(df: DataFrame, batch_id: int):
        before = _greatest_id(spark, root, batch_id, initial)
        ch = C.run_reminders(df, customers, initial, as_of, before)
        out = f"{root}/out/batch_id={batch_id}"
        ch.changed.select("id", "bill_id", "reminder_date", "reminder_type").write.mode("overwrite").parquet(out)
        _keep_greatest_id(spark.read.parquet(out), root, batch_id, before)

    due = due_within(not_paid(bills), as_of, 3).dropDuplicates(["id"])
    _run(due.writeStream.foreachBatch(batch), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").drop("batch_id")


LAST_ID = (1 << 63) - 1


def with_new_keys(tagged: DataFrame, key: str) -> DataFrame:
    """Rows of a stream (``_reason`` NULL where accepted), and besides them a row with ``_new`` true, and no more than the
    key, for every key that an accepted row has in this micro-batch and none had before. The state store keeps the keys
    that were taken; rows never enter it."""
    taken = tagged.where("_reason IS NULL").select(key).dropDuplicates([key])
    return tagged.withColumn("_new", F.lit(False)).unionByName(taken.withColumn("_new", F.lit(True)), allowMissingColumns=True)


def split_new(spark: SparkSession, batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    """(first, rest, how many are first) of a micro-batch of ``with_new_keys``: the accepted row with the least
    request id of every new key, exactly one, and all other rows. Rows meet the firsts by their place in the written
    copy, so that a key that much of the batch shares is spread like any other.

    The batch is written once and read back by ``spark``: a stateful stream runs its micro-batches in a session of
    its own without AQE, and what is done with the rows needs neither its state nor its fixed partitions."""
    copy = shared_dir(spark, "batch")
    batch = batch.withColumn("_row", F.monotonically_increasing_id())
    batch.write.mode("overwrite").parquet(copy)
    placed = spark.read.schema(batch.schema).parquet(copy)
    order = F.when(~F.col("_new"), F.coalesce("request_id", F.lit(LAST_ID)))
    least = (placed.where("_reason IS NULL").groupBy(key).agg(F.bool_or("_new").alias("_taken"), F.min_by("_row", order).alias("_row"))
             .where("_taken").select("_row"))
    rows = placed.where("NOT _new").drop("_new")
    marked = rows.join(least.withColumn("_first", F.lit(True)), "_row", "left")
    marked, seen = write_counted(marked.withColumn("_first", F.coalesce("_first", F.lit(False))).drop("_row"), "firsts",
                                 firsts=F.count_if("_first"))
    return marked.where("_first").drop("_first"), marked.where("NOT _first").drop("_first"), seen["firsts"]


def settle_stream(spark: SparkSession, stream: DataFrame, bills: DataFrame, customers: DataFrame, payments: DataFrame,
                  secret: str, root: str) -> DataFrame:
    """st_callbacks: callbacks of a stream, settled at most once per provider payment id.

    Every callback is verified before repeats are looked for, so a forged
    delivery never hides the valid one that follows it. Which payment ids were
    taken is keyed state: a micro-batch touches the state of its own ids, and
    an id that comes again, however late, is a duplicate. ``payments`` are
    those stored before the stream began. Returns the payment rows, bill
    updates and rejects of all micro-batches.
    """
    b = C._billed(bills)
    rows = stream.withColumnRenamed("callback_id", "request_id").join(b, F.col("bill_id") == b["_bid"], "left")
    keyed = with_new_keys(rows.withColumn("_reason", C.callback_reason(secret)), "payment_id")

    def batch(df: DataFrame, batch_id: int):
        before = _greatest_id(spark, root, batch_id, payments)
        first, rest, n = split_new(spark, df, "payment_id")
        ch = C.settle_firsts(bills, customers, payments, first, n, before)
        rest = rest.select(F.lit("payment_callbacks").alias("table_name"), "request_id",
                           F.coalesce("_reason", F.lit(C.R_DUPLICATE)).alias("reason"))
        ch.rejects = ch.rejects.unionByName(rest)
        out = f"{root}/out/batch_id={batch_id}"
        ch.report().write.mode("overwrite").parquet(out)
        _keep_greatest_id(spark.read.parquet(out).where("table_name = 'payments' AND action = 'insert'"), root, batch_id, before)

    _run(keyed.writeStream.foreachBatch(batch), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").drop("batch_id")


def usage(spark: SparkSession, sf_dir: str, initial: DataFrame, root: str | None = None) -> DataFrame:
    """st_usage: usage reports as a stream into the daily usage table.

    Each micro-batch keeps only its latest report per (customer, date) and
    writes that to its own batch folder (overwrite, so a replay is
    idempotent). The table is the initial usage merged with the latest
    logged report per key, exactly what ``upsert_usage`` does in batch.
    """
    from ..operators.windows import latest_by
    root = root or shared_dir(spark, "st-usage")
    log = f"{root}/log"
    keys = ["customer_id", "usage_date"]

    def batch(df: DataFrame, batch_id: int):
        latest_by(df, keys, ["reported_at", "report_id"]).write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    reports = usage_reports_from_events(file_stream(spark, sf_dir, "events"))
    _run(reports.writeStream.foreachBatch(batch), f"{root}/checkpoint")
    logged = spark.read.parquet(log).drop("batch_id")
    return C.upsert_usage(initial, logged).state["data_usage"]


def outbox(spark: SparkSession, sf_dir: str, customers: DataFrame, links: N.Links, config: dict | None = None,
           root: str | None = None) -> DataFrame:
    """st_outbox: 'paid' notifications fanned out per channel as bills arrive
    (stateless: a stream-static join with customers and an explode, append mode)."""
    root = root or shared_dir(spark, "st-outbox")
    bills = bills_from_orders(file_stream(spark, sf_dir, "orders")).filter(F.col("status") == "paid")
    c = customers.select(F.col("id").alias("customer_id"), "name", "email", "phone")
    events = (bills.join(c, "customer_id")
              .select(F.col("id").alias("bill_id"), "customer_id", "amount", "due_date",
                      F.lit("paid").alias("notification_type"), "name", "email", "phone"))
    ob = N.build_outbox(events, links, config)
    _run(ob.writeStream.format("parquet").option("path", f"{root}/out").outputMode("append"), f"{root}/checkpoint")
    return spark.read.schema(ob.schema).parquet(f"{root}/out")
