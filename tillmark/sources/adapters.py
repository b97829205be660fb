"""The test tables as transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .transactions import canonical

# The stored types of the test tables. Given types save a job per table that
# would otherwise read file footers.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def event_units() -> Column:
    """The number ``k`` of the flat ``props`` object: a third of the time of a JSON parser."""
    return F.regexp_extract("props", r'"k":\s*([0-9]+)', 1)


def event_mapping() -> dict[str, Column]:
    """Canonical columns as expressions over the events table."""
    return {
        "transaction_id": F.col("event_id"),
        "transaction_time": F.col("ts"),
        "transaction_qty": event_units().try_cast("double"),
        "unit_price": F.col("value"),
        "store_location": F.concat(F.lit("Store "), F.col("user_id") % 5),
        "product_category": F.col("event_type"),
        "product_type": F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string")),
    }


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as sales with a time of day: 5 stores, 5 categories, 30 days."""
    return canonical(_table(spark, folder, "events"), event_mapping())


def order_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as sales over several years: regions as stores, part types as categories."""
    lines = _table(spark, folder, "lineitem")
    parts = _table(spark, folder, "part")
    joined = with_store(spark, folder, lines.join(parts, lines.l_partkey == parts.p_partkey))
    return canonical(
        joined,
        {
            "transaction_id": F.col("l_orderkey"),
            "transaction_time": F.col("l_shipdate"),
            "transaction_qty": F.col("l_quantity"),
            "unit_price": F.col("p_retailprice"),
            "store_location": F.col("r_name"),
            "product_category": F.col("p_type"),
            "product_type": F.col("p_brand"),
        },
    )


def with_store(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    """Join order lines to the region of their supplier.

    The joins are a chain of base tables, whose sizes Spark knows before it plans: a supplier
    table under the broadcast limit never makes the lines shuffle, a larger one is joined by
    sorting, with hot keys split at run time. Only nation and region, lists that do not grow
    with the data, are broadcast by hint.
    """
    suppliers = _table(spark, folder, "supplier")
    nations = _table(spark, folder, "nation")
    regions = _table(spark, folder, "region")
    return (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .join(F.broadcast(nations), suppliers.s_nationkey == nations.n_nationkey)
        .join(F.broadcast(regions), nations.n_regionkey == regions.r_regionkey)
    )


def store_operations(spark: SparkSession, folder: str, on_time_days: int = 365) -> DataFrame:
    """Measured operations per store: shares of finished and of punctual units, mean lead time."""
    lines = _table(spark, folder, "lineitem")
    orders = _table(spark, folder, "orders")
    lead = F.datediff("l_shipdate", "o_orderdate")
    lead = F.when(lead >= 0, lead)
    joined = with_store(spark, folder, lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left"))
    finished = F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0))
    return joined.groupBy(F.col("r_name").alias("store_location")).agg(
        (finished / F.sum("l_quantity")).alias("fill_rate"),
        F.avg(lead).alias("avg_lead_time_days"),
        (F.count_if(lead <= on_time_days) / F.count(lead)).alias("on_time_delivery"),
    )


def garbled_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw text rows with defects that depend on the event id: every 50th row twice,
    bad or missing times, quantities and prices."""
    events = _table(spark, folder, "events")
    n = F.col("event_id")
    copies = F.when(n % 50 == 0, 2).otherwise(1)
    rows = events.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("_copy"))
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        n.cast("string").alias("transaction_id"),
        F.when(n % 97 == 0, "not a time").when(n % 89 == 0, "").otherwise(text).alias("transaction_time"),
        F.when(n % 31 == 0, "many").when(n % 37 == 0, "NA")
        .otherwise(event_units()).alias("transaction_qty"),
        F.when(n % 41 == 0, "free").when(n % 43 == 0, "n/a")
        .otherwise(F.col("value").cast("string")).alias("unit_price"),
        F.when(n % 101 == 0, "").otherwise(F.concat(F.lit("Store "), F.col("user_id") % 5)).alias("store_location"),
        F.col("event_type").alias("product_category"),
        F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string")).alias("product_type"),
    )
