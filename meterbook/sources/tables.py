"""Sources: parquet scans, literal seed rows, JDBC, and schema enforcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: F401
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import SUBSCRIPTION_LINE
from .schema import DEFAULTS, NOW_DEFAULTED, TABLES

# Why a value is held back.
NOT_A = "Not a value of type "
ABSENT = "Required value missing"


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver parquet table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Full scan of a stored book table with its declared schema (src_table)."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, id_bounds: tuple[int, int],
              num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Read a book table from a relational database (src_jdbc).

    The scan is split into ``num_partitions`` range reads on ``id`` so no
    single task pulls the whole table. Needs the database's JDBC driver on
    the classpath; untested here.
    """
    lo, hi = id_bounds
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", name)
              .option("partitionColumn", "id").option("lowerBound", lo)
              .option("upperBound", hi).option("numPartitions", num_partitions)
              .option("fetchsize", 10000))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return enforce(reader.load(), name)


def seed(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """Literal rows with the declared schema (src_seed)."""
    return spark.createDataFrame(rows, TABLES[name])


def seed_tables(spark: SparkSession, state: dict[str, DataFrame], as_of: str, usage: list[tuple] = ()) -> dict[str, DataFrame]:
    """Upsert the seed rows into the tables of ``state`` that have any; returns those tables.

    Logins go by e-mail (name and role are replaced, new ones get the next
    ids), customer, bill and plans by id, usage by customer and date; bill 1
    gets a subscription line unless it has one. The seeds are a handful of
    literal rows, so every merge broadcasts them and scans its table once.
    """
    from ..operators.windows import assign_ids
    from .fixtures import SEED_BILL_AMOUNT, SEED_CUSTOMER, SEED_PLANS, SEED_USERS

    def literal(rows: list[tuple], name: str, *cols: str) -> DataFrame:
        """Rows as strings, cast to the table's types; missing columns are NULL."""
        text = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows],
                                     ", ".join(f"{c} string" for c in cols))
        return text.select(*[F.col(f.name).cast(f.dataType) if f.name in cols else F.lit(None).cast(f.dataType).alias(f.name)
                             for f in TABLES[name].fields])

    def merged(name: str, seeds: DataFrame, keys: list[str]) -> DataFrame:
        df = state[name]
        return df.join(F.broadcast(seeds.select(*keys)), keys, "left_anti").unionByName(
            seeds.select(*[F.col(c).cast(df.schema[c].dataType) for c in df.columns]))

    new = {}
    if "users" in state:
        users = state["users"]
        seeds = spark.createDataFrame([(i, *r) for i, r in enumerate(SEED_USERS)], "_k int, _name string, _e string, _role string")
        key = F.lower(F.trim("email"))
        hit = users.join(F.broadcast(seeds), key == F.col("_e"), "left")
        kept = hit.select("id", F.coalesce("_name", "name").alias("name"), "email", F.coalesce("_role", "role").alias("role"))
        fresh = seeds.join(users.select(key.alias("_e")).join(F.broadcast(seeds.select("_e")), "_e", "left_semi"), "_e", "left_anti")
        ins = assign_ids(fresh.select("_k", F.col("_name").alias("name"), F.col("_e").alias("email"), F.col("_role").alias("role")),
                         ["_k"], users)
        new["users"] = kept.unionByName(ins.drop("_k"))
    if "plans" in state:
        new["plans"] = merged("plans", literal(SEED_PLANS, "plans", "id", "name", "speed", "price", "validity"), ["id"])
    if "customers" in state:
        new["customers"] = merged("customers", literal([SEED_CUSTOMER], "customers", "id", "name", "email", "phone", "plan_id", "address",
                                                       "status"), ["id"])
    if "bills" in state:
        seeds = literal([(1, SEED_CUSTOMER[0], SEED_BILL_AMOUNT, "unpaid", as_of, as_of)], "bills", *TABLES["bills"].names)
        new["bills"] = merged("bills", seeds.withColumn("due_date", F.date_add("due_date", 7)), ["id"])
    if "bill_items" in state:
        items = state["bill_items"]
        seeds = literal([(1, SUBSCRIPTION_LINE, SEED_BILL_AMOUNT, "subscription")], "bill_items", "bill_id", "description", "amount",
                        "item_type").drop("id")
        has = items.where("bill_id = 1 AND item_type = 'subscription'").select("bill_id").distinct()
        new["bill_items"] = items.unionByName(
            assign_ids(seeds.join(has, "bill_id", "left_anti"), ["bill_id"], items).select(*items.columns))
    if "data_usage" in state:
        rows = [(c, day, gb, 1000) for c, day, gb in usage]
        new["data_usage"] = merged("data_usage", literal(rows, "data_usage", "customer_id", "usage_date", "used_gb", "total_gb"),
                                   ["customer_id", "usage_date"])
    return new


def _declared(name: str, now: Column | None) -> list[T.StructField]:
    """Declared columns, and creation times that the declaration leaves out, when ``now`` is given."""
    fields = list(TABLES[name].fields)
    if now is not None:
        fields += [T.StructField(c, T.TimestampNTZType(), True) for c in NOW_DEFAULTED.get(name, ())
                   if c not in TABLES[name].names]
    return fields


def _cast(df: DataFrame, f: T.StructField) -> Column:
    return F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)


def _filled(c: Column, name: str, f: T.StructField, now: Column | None) -> Column:
    """``c`` with the declared default, or the run time, in place of NULL."""
    defaults = DEFAULTS.get(name, {})
    if f.name in defaults:
        c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
    if now is not None and f.name in NOW_DEFAULTED.get(name, ()):
        c = F.coalesce(c, now.cast("timestamp_ntz"))
    return c


def enforce(df: DataFrame, name: str, now: Column | None = None) -> DataFrame:
    """Bring ``df`` to the declared columns of ``name`` (schema_enforce).

    Every declared field is cast with ``try_cast``; declared defaults fill
    NULLs; creation times take ``now``. Unknown columns are dropped, missing
    ones added. A value that does not fit its type becomes NULL here: for
    input that is not trusted, ``quarantine`` keeps it.
    """
    return df.select(*[_filled(_cast(df, f), name, f, now).alias(f.name) for f in _declared(name, now)])


def judged(df: DataFrame, name: str, key: str, now: Column | None = None, key_out: str = "source_key") -> DataFrame:
    """schema_enforce for input that is not trusted, rows and rejects in one frame and one pass over ``df``.

    A row that fits has its declared columns, as by ``enforce``, and NULL in ``key_out``, column_name, value and reason.
    A row with a value that does not fit its column's type, or without one that the table requires and has no
    default for, is held back as a whole; for each such value there is a row with ``key`` as text, column_name, value
    as text and reason, and NULL in the declared columns.
    """
    fields = _declared(name, now)
    given, cast = [f"_given_{f.name}" for f in fields], [f"_cast_{f.name}" for f in fields]
    typed = df.select(F.col(key).cast("string").alias("_key"), *[
        x for f, g, c in zip(fields, given, cast, strict=True)
        for x in ((F.col(f.name).cast("string") if f.name in df.columns else F.lit(None).cast("string")).alias(g),
                  _cast(df, f).alias(c))])
    reasons = []
    for f, g, c in zip(fields, given, cast, strict=True):
        absent = F.col(g).isNull() & _filled(F.col(c), name, f, now).isNull() if not f.nullable else F.lit(False)
        reasons.append(F.when(F.col(g).isNotNull() & F.col(c).isNull(), F.lit(f"{NOT_A}{f.dataType.simpleString()}"))
                       .when(absent, F.lit(ABSENT)).alias(f"_reason_{f.name}"))
    told = typed.select("*", *reasons)
    why = [F.col(f"_reason_{f.name}") for f in fields]
    fits = F.coalesce(*why).isNull()

    def outcome(columns: list[Column], *reject: Column) -> Column:
        return F.struct(*[x.alias(f.name) for x, f in zip(columns, fields, strict=True)],
                        *[x.cast("string").alias(n) for x, n in zip(reject, (key_out, "column_name", "value", "reason"), strict=True)])

    none = F.lit(None)
    blank = [none.cast(f.dataType) for f in fields]
    parts = [F.when(fits, outcome([_filled(F.col(c), name, f, now) for f, c in zip(fields, cast, strict=True)], none, none, none, none))]
    parts += [F.when(w.isNotNull(), outcome(blank, F.col("_key"), F.lit(f.name), F.col(g), w))
              for f, g, w in zip(fields, given, why, strict=True)]
    return told.select(F.explode(F.array(*parts)).alias("_o")).where("_o IS NOT NULL").select("_o.*")


def quarantine(df: DataFrame, name: str, key: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``judged`` as two frames, each from a pass of its own: (rows, rejects). ``rejects`` has ``key`` as text,
    column_name, value, reason."""
    every = judged(df, name, key, now, "_source")
    rows = every.where("reason IS NULL").select(*[f.name for f in _declared(name, now)])
    return rows, every.where("reason IS NOT NULL").select(F.col("_source").alias(key), "column_name", "value", "reason")
