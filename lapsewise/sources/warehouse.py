"""Subscription transactions and members derived from order tables.

Each line item becomes one subscription transaction of its customer, in the raw layout
but with dates already typed, with a fixed share of zero-day rows, missing expiries,
cancellations, backdated rows and copies. Some customers follow a pattern of their own,
so that every guard and every stratum downstream has rows: they buy only at the very end
of the observation window, only on its first day, or only plans of unknown length; some
members registered after their spell ended, and some name no channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.config import WAREHOUSE, Params

UNMATCHED = 1_000_000_000  # added to the key of members who never buy
ROWS_PER_TASK = 250_000  # groups and sorts of so many rows stay in memory


def subscription_rows(
    line: DataFrame, orders: DataFrame, params: Params = WAREHOUSE, tasks: int | None = None
) -> DataFrame:
    """line and orders to raw transactions, joined in so many tasks if a number is given.
    line may be a stream."""
    # Narrow before the join, which shuffles every line item.
    narrow = line.select(
        "l_orderkey",
        (F.col("l_suppkey") % 40).cast("int").alias("payment_method_id"),
        F.floor("l_quantity").cast("int").alias("quantity"),
        F.floor(F.col("l_extendedprice") / 100).cast("int").alias("paid"),
        (F.col("l_returnflag") != "A").cast("int").alias("is_auto_renew"),
        F.col("l_shipdate").cast("date").alias("day"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000).alias("z"),
    )
    owners = orders.select("o_orderkey", F.col("o_custkey").alias("msno"))
    if tasks:
        narrow = narrow.repartition(tasks, "l_orderkey")
        owners = owners.repartition(tasks, "o_orderkey")
    joined = narrow.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).drop(
        "l_orderkey", "o_orderkey"
    )
    family = (F.col("msno") * 31) % 10
    last_weeks, first_day, no_length = (
        F.col("msno") % m == r for m, r in ((97, 5), (83, 4), (79, 6))
    )
    base = (
        joined.withColumn(
            "length",
            F.when(family < 3, 7).when(family < 7, 30).when(family < 8, 90).otherwise(180),
        )
        .withColumn("blank", (F.col("z") < 40) | no_length)
        .withColumn(
            "day",
            F.when(
                last_weeks,
                F.date_sub(F.lit(params.observation_cutoff), (F.col("z") % 20).cast("int")),
            )
            .when(first_day, F.lit(params.window_open))
            .otherwise(F.col("day")),
        )
    )
    lag = F.when(F.col("msno") % 7 == 0, 120).otherwise(30)
    expiry = (
        F.when(first_day | no_length, F.col("day"))
        .when(F.col("z").between(40, 41), F.lit(params.epoch_sentinel))
        .when(F.col("z").between(900, 959), F.date_sub("day", F.col("quantity")))
        .when(F.col("z").between(960, 964), F.date_sub("day", 1))
        .otherwise(
            F.date_add(
                "day", F.when(F.col("blank"), 30).otherwise(F.col("length")) + lag
            )
        )
    )
    copies = F.when(
        F.col("z").between(500, 504), F.array(F.lit(1), F.lit(2))
    ).otherwise(F.array(F.lit(1)))
    return base.withColumn("copy", F.explode(copies)).select(
        "msno",
        "payment_method_id",
        F.when(F.col("blank"), 0).otherwise(F.col("length")).alias("payment_plan_days"),
        F.when(F.col("blank"), 0).otherwise(F.col("paid")).alias("plan_list_price"),
        F.col("paid").alias("actual_amount_paid"),
        "is_auto_renew",
        F.col("day").alias("transaction_date"),
        expiry.alias("membership_expire_date"),
        F.col("z").between(900, 959).cast("int").alias("is_cancel"),
    )


def raw_transactions(
    spark: SparkSession, sf_dir: str, params: Params = WAREHOUSE
) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tasks = -(-line_items(spark, sf_dir) // ROWS_PER_TASK)
    # With fewer tasks than that, the session's number of them would sort on disk.
    few = int(spark.conf.get("spark.sql.shuffle.partitions")) < tasks
    return subscription_rows(line, orders, params, tasks if few else None)


def by_user(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows, about one per line item, dealt by user to tasks whose number grows with them:
    what is then grouped by user needs no further shuffle."""
    tasks = -(-line_items(spark, sf_dir) // ROWS_PER_TASK)
    if tasks > spark.sparkContext.defaultParallelism:
        return rows.repartition(tasks, "msno")
    return rows.repartition("msno")


def line_items(spark: SparkSession, sf_dir: str) -> int:
    """Line items, about as many as raw transactions; files' footers name their number."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def raw_members(
    spark: SparkSession, sf_dir: str, params: Params = WAREHOUSE
) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    opened = F.lit(params.window_open)
    step = key * 7919
    registered = F.when(key % 89 == 3, F.lit(params.observation_cutoff)).when(
        key % 2 == 1, F.date_sub(opened, (F.lit(200) + step % 1000).cast("int"))
    ).otherwise(F.date_add(opened, (step % 15).cast("int")))
    return customer.select(
        F.when(key % 10 == 0, key + UNMATCHED).otherwise(key).alias("msno"),
        (F.col("c_nationkey") % 25).cast("int").alias("city"),
        (F.lit(20) + key % 50).cast("int").alias("bd"),
        F.when(key % 3 == 1, "male").when(key % 3 == 2, "female").alias("gender"),
        F.when(key % 73 != 7, F.col("c_nationkey") % 10).cast("int").alias("registered_via"),
        registered.alias("registration_init_time"),
    )
