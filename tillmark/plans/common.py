"""What the registered queries share: their input frames, and the same inputs as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import enrich
from ..sources.adapters import event_transactions, order_transactions


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched transactions with a time of day (events)."""
    return enrich(event_transactions(spark, folder))


def line_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched transactions over several years (order lines)."""
    return enrich(order_transactions(spark, folder))


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that engines compare the same values."""
    texts = {"timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss", "date": "yyyy-MM-dd"}
    return df.select(
        *[
            F.date_format(F.col(f"`{f.name}`"), texts[f.dataType.simpleString()]).alias(f.name)
            if f.dataType.simpleString() in texts
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round results whose last bits depend on the order of summation."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


# --- SQL ---------------------------------------------------------------------------------------

_CALENDAR = """
  transaction_qty * unit_price AS revenue,
  CAST(transaction_time AS DATE) AS date,
  CAST(hour(transaction_time) AS INTEGER) AS hour,
  CAST(month(transaction_time) AS INTEGER) AS month,
  CAST(quarter(transaction_time) AS INTEGER) AS quarter,
  dayname(transaction_time) AS weekday,
  CAST(isodow(transaction_time) - 1 AS INTEGER) AS weekday_num,
  CASE WHEN isodow(transaction_time) >= 6 THEN 1 ELSE 0 END AS is_weekend
"""

EV = f"""
ev0 AS (
  SELECT event_id AS transaction_id, CAST(ts AS TIMESTAMP) AS transaction_time,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS transaction_qty, value AS unit_price,
    'Store ' || (user_id % 5) AS store_location, event_type AS product_category,
    event_type || '-' || (user_id % 3) AS product_type
  FROM events),
ev AS (SELECT *, {_CALENDAR} FROM ev0)"""

LI = f"""
li0 AS (
  SELECT l_orderkey AS transaction_id, CAST(l_shipdate AS TIMESTAMP) AS transaction_time,
    l_quantity AS transaction_qty, p_retailprice AS unit_price, r_name AS store_location,
    p_type AS product_category, p_brand AS product_type
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
li AS (SELECT *, {_CALENDAR} FROM li0)"""

# Text rows with defects, then the same with nulls and parsed times, then cleaned.
_TOKENS = "('', 'NA', 'n/a')"
RAW = f"""
raw0 AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
    CASE WHEN event_id % 97 = 0 THEN 'not a time' WHEN event_id % 89 = 0 THEN ''
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS transaction_time,
    CASE WHEN event_id % 31 = 0 THEN 'many' WHEN event_id % 37 = 0 THEN 'NA'
      ELSE regexp_extract(props, '([0-9]+)', 1) END AS transaction_qty,
    CASE WHEN event_id % 41 = 0 THEN 'free' WHEN event_id % 43 = 0 THEN 'n/a'
      ELSE CAST(value AS VARCHAR) END AS unit_price,
    CASE WHEN event_id % 101 = 0 THEN '' ELSE 'Store ' || (user_id % 5) END AS store_location,
    event_type AS product_category, event_type || '-' || (user_id % 3) AS product_type
  FROM events JOIN (VALUES (1), (2)) AS copies(c) ON c = 1 OR event_id % 50 = 0),
raw AS (
  SELECT CASE WHEN transaction_id IN {_TOKENS} THEN NULL ELSE transaction_id END AS transaction_id,
    TRY_CAST(transaction_time AS TIMESTAMP) AS transaction_time,
    CASE WHEN transaction_qty IN {_TOKENS} THEN NULL ELSE transaction_qty END AS transaction_qty,
    CASE WHEN unit_price IN {_TOKENS} THEN NULL ELSE unit_price END AS unit_price,
    CASE WHEN store_location IN {_TOKENS} THEN NULL ELSE store_location END AS store_location,
    product_category, product_type
  FROM raw0)"""

CLEAN = f"""{RAW},
kept AS (SELECT DISTINCT * FROM raw WHERE transaction_time IS NOT NULL),
typed AS (
  SELECT transaction_id, transaction_time, coalesce(TRY_CAST(transaction_qty AS DOUBLE), 0.0) AS transaction_qty,
    coalesce(TRY_CAST(unit_price AS DOUBLE), (SELECT median(TRY_CAST(unit_price AS DOUBLE)) FROM kept)) AS unit_price,
    store_location, product_category, product_type
  FROM kept),
tidy AS (SELECT *, {_CALENDAR} FROM typed)"""

TIME = "strftime(transaction_time, '%Y-%m-%d %H:%M:%S') AS transaction_time"


def over(base: str, sql: str) -> str:
    """Put the common tables in front of a query that starts with SELECT or with more tables."""
    joiner = ",\n" if sql.lstrip().startswith("--with") else "\n"
    return f"WITH {base.strip()}{joiner}{sql.replace('--with', '', 1)}"


def m(column: str = "revenue") -> str:
    """Money total."""
    return f"CAST(coalesce(sum(CAST({column} AS DECIMAL(38, 9))), 0) AS DOUBLE)"


def q(column: str = "transaction_qty") -> str:
    """Unit total."""
    return f"coalesce(sum({column}), 0.0::DOUBLE)"


def even(expression: str, digits: int = 0) -> str:
    """Round half to even."""
    scale = f"1e{digits}"
    return f"(round_even(({expression}) * {scale}, 0) / {scale})"
