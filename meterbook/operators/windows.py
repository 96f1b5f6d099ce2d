"""Per-key picks and ranking (§2.5), written to survive hot keys.

"Latest per key" uses ``max_by`` (a partial aggregate) instead of a
row_number window, so no task ever has to sort all rows of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import BROADCAST_KEYS_MAX, BROADCAST_STRING_KEYS_MAX, fits_broadcast

# Reason given to a repeated unique key.
DUPLICATE = "Duplicate record already exists"


def latest_by(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """One row per key: the row with the greatest ``order`` (tuple order)."""
    keys = [key] if isinstance(key, str) else list(key)
    ords = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in ords]) if len(ords) > 1 else F.col(ords[0])
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_r"))
            .select(*keys, *[F.col("_r." + c).alias(c) for c in rest]))


def latest_usage(usage: DataFrame) -> DataFrame:
    """top_latest_usage: the newest usage row per customer."""
    return latest_by(usage, "customer_id", "usage_date")


def current_bill(customers: DataFrame, bills: DataFrame) -> DataFrame:
    """top_current_bill: per customer, the not-paid bill with the highest id;
    none -> bill_id NULL and amount 0."""
    open_b = bills.filter(F.coalesce(F.lower(F.col("status")), F.lit("")) != "paid")
    cur = (open_b.groupBy(F.col("customer_id").alias("_cid"))
           .agg(F.max_by(F.struct(F.col("id"), F.col("amount"), F.col("due_date")), F.col("id")).alias("_b")))
    j = customers.select(F.col("id").alias("customer_id")).join(cur, F.col("customer_id") == F.col("_cid"), "left")
    return j.select("customer_id", F.col("_b.id").alias("bill_id"),
                    F.coalesce(F.col("_b.amount"), F.lit(0).cast("decimal(10,2)")).alias("amount"),
                    F.col("_b.due_date").alias("due_date"))


def split_first(requests: DataFrame, key_cols: list, order_col: str = "request_id") -> tuple[DataFrame, DataFrame, int]:
    """(first, repeats, keys): the first request of every unique key, all later ones, and how many keys there are.

    A partial ``min`` per key gives the request ids of the firsts, one row per
    key, which are written once. The requests then meet them on the request
    id, which is unique, together with the key: a semi join for the firsts and
    an anti join for the repeats. No row is dealt by the key alone, so a key
    that holds a third of the batch is spread like any other; ids that pass
    the size check are broadcast. NULL keys are one key. Two rows with the
    same request id and key are both first.
    """
    from ..session import write_counted
    names = [f"_k{i}" for i in range(len(key_cols))]
    keyed = requests.withColumns(dict(zip(names, [c if not isinstance(c, str) else F.col(c) for c in key_cols], strict=True)))
    firsts, seen = write_counted(keyed.groupBy(*names).agg(F.min(order_col).alias("_first")), "firsts", keys=F.count(F.lit(1)))
    firsts = firsts.toDF(*[f"_f{n}" for n in names], "_first")
    limit = BROADCAST_STRING_KEYS_MAX if any(t == "string" for _, t in firsts.dtypes) else BROADCAST_KEYS_MAX
    ids = F.broadcast(firsts) if fits_broadcast(seen["keys"], limit) else firsts
    cond = F.col(order_col) == F.col("_first")
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"_f{n}"))
    return (keyed.join(ids, cond, "left_semi").drop(*names), keyed.join(ids, cond, "left_anti").drop(*names), seen["keys"])


def first_per_key(requests: DataFrame, key_cols: list, order_col: str = "request_id"):
    """win_dedup_requests: first request per unique key is accepted, the rest
    are rejected with the duplicate reason (see ``split_first``)."""
    accepted, repeats, _ = split_first(requests, key_cols, order_col)
    return accepted, repeats.select(order_col, F.lit(DUPLICATE).alias("reason"))


def place_rows(df: DataFrame, order_cols: list[str], slices: int | None = None) -> DataFrame:
    """``df`` in order, written once, with ``_slice`` and ``_at`` (place in the slice, from 0)."""
    from ..session import write_through
    cols = [F.col(c) for c in order_cols]
    ordered = df.repartitionByRange(slices, *cols).sortWithinPartitions(*cols) if slices else df.orderBy(*cols)
    # The id holds the partition in its upper bits and the place in it in the lower 33.
    placed = write_through(ordered.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    return (placed.withColumn("_slice", F.shiftright("_place", 33))
            .withColumn("_at", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place"))


def number_rows(df: DataFrame, order_cols: list[str], out: str, base: DataFrame | int = 0, base_col: str = "id",
                slices: int | None = None) -> DataFrame:
    """``df`` with a dense number from ``base + 1`` in the order of ``order_cols``:
    ``base + row_number() OVER (ORDER BY order_cols)`` without a window over the data.

    Spark's range partitioner deals the rows into slices: it samples all order
    columns together, so a value that many rows share is split by the columns
    after it and one far outlier takes no slice for itself. Each slice is sorted
    and written once with its rows' places, so the numbers stay as they are
    when a lost task is recomputed. One row per slice (counts and their
    running sum, broadcast) turns places into numbers. ``base`` is a number or
    a frame whose greatest ``base_col`` is continued. The order columns
    have to be unique together; any types, NULLs included.
    """
    from pyspark.sql import Window
    placed = place_rows(df, order_cols, slices)
    counts = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(base, DataFrame):
        start = base.agg(F.coalesce(F.max(base_col), F.lit(0)).cast("long").alias("_n"))
    else:
        start = df.sparkSession.range(1).select(F.lit(int(base)).cast("long").alias("_n"))
    # One row per slice: a running sum in a single partition is cheap here.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.unionByName(start.select(F.lit(-1).cast("long").alias("_slice"), "_n"))
               .withColumn("_off", F.sum("_n").over(before)).filter(F.col("_slice") >= 0).drop("_n"))
    return (placed.join(F.broadcast(offsets), "_slice")
            .withColumn(out, (F.col("_off") + F.col("_at") + 1).cast("long")).drop("_slice", "_off", "_at"))


def assign_ids(df: DataFrame, order_cols: list[str], base: DataFrame | int, id_col: str = "id",
               slices: int | None = None, materialize: bool = True) -> DataFrame:
    """win_assign_ids: dense surrogate ids ``max+1 ..`` in order of ``order_cols``
    (AUTO_INCREMENT for a whole batch); see ``number_rows``.

    With ``materialize`` the batch is written to the shared folder first, so
    that sampling and sorting read that copy instead of deriving the batch
    twice; leave it off for plain projections of a written batch.
    """
    if materialize:
        from ..session import write_through
        df = write_through(df, "ids")
    return number_rows(df, order_cols, id_col, base, id_col, slices)
