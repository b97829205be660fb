"""Column names, ordered domains and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION_COLUMNS = [
    "transaction_id",
    "transaction_time",
    "transaction_qty",
    "unit_price",
    "store_location",
    "product_category",
    "product_type",
]

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("transaction_time", T.TimestampType()),
        T.StructField("transaction_qty", T.DoubleType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("store_location", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("product_type", T.StringType()),
    ]
)

# Texts in a CSV file that stand for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Ordered labels.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DEMAND_LEVELS = ["Low", "Medium", "High", "Extreme"]
SHIFTS = ["Skeleton Crew", "Standard Shift", "Peak Shift"]
HOURS = list(range(24))

# Business constants.
UNITS_PER_STAFF = 30
SHIFT_CUTS = (0.33, 0.67)
ABC_CUTS = (70.0, 90.0)
COST_SHARE = 0.6
ORDER_COST = 50.0
HOLDING_RATE = 0.20
BAND_Z = 1.65
ORDER_BUFFER = 1.1
RISK_CUTS = (20.0, 40.0)
PEAK_UNITS_PER_STAFF = 50
MIN_STAFF = 2
Z_EPSILON = 1e-9
