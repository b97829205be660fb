"""One small table that answers every additive question about the transactions.

Reports share sums and counts by store, category and hour. Reading the facts once into this
roll-up and running the operators over it replaces one scan per report by one scan in all.
Medians and row-level work still need the transactions. Distinct ids have stored tables of their
own, which merge over any days: bitmaps, exact, where ids are whole numbers, sketches elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ids, revenue, rows, units
from ..operators.enrich import enrich
from ..sources.sinks import write_table

KEYS = ["store_location", "product_category"]


def hourly_rollup(df: DataFrame) -> DataFrame:
    """Units, revenue, rows and ids per store, category and hour, with the calendar columns."""
    sums = df.groupBy(*KEYS, F.date_trunc("hour", "transaction_time").alias("transaction_time")).agg(
        units().alias("transaction_qty"),
        revenue().alias("_revenue"),
        rows(df).alias("row_count"),
        ids(df).alias("id_count"),
    )
    calendar = enrich(sums.withColumn("unit_price", F.lit(0.0)))
    return calendar.withColumn("revenue", F.col("_revenue")).drop("_revenue", "unit_price")


def stored_rollup(df: DataFrame, path: str) -> DataFrame:
    """Write the roll-up by date and read it back, so that reports survive lost executors."""
    return write_table(hourly_rollup(df).hint("rebalance", "date"), path, partition_by=["date"])


# --- distinct ids ------------------------------------------------------------------------------------

#: Bits that number a sketch's registers; the relative error of an estimate is about 1.04 / sqrt(2 ** 14) = 0.8 %.
SKETCH_BITS = 14
#: Ids of a bitmap, which is a long; rows that a task makes bitmaps of.
WORD_IDS, TASK_ROWS = 64, 1 << 20


def id_bitmaps(df: DataFrame) -> DataFrame:
    """``store_location, date, word, bits``: which ids a store has on a day, as bitmaps of 64 ids each.

    For ids that are whole numbers. A day has few of all ids: short bitmaps take no more room than the ids themselves, and a
    group's state is one number. Hardly any rows would combine on the map side, so they are dealt first, to tasks of so many
    rows that their groups fit in memory whatever the table's size; a hot store spreads over days and words.
    """
    id_ = F.col("transaction_id").cast("long")
    place = (id_.bitwiseAND(F.lit(WORD_IDS - 1))).cast("int")
    met = df.where("store_location is not null and transaction_id is not null").select(
        "store_location", "date", F.shiftright(id_, WORD_IDS.bit_length() - 1).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit")
    )
    key = ["store_location", "date", "word"]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-met.count() // TASK_ROWS))
    return met.repartition(tasks, *key).groupBy(*key).agg(F.bit_or("bit").alias("bits"))


def distinct_from_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Distinct ids per store over all days of the bitmaps, exact: days are merged bit by bit, then counted."""
    whole = bitmaps.groupBy("store_location", "word").agg(F.bit_or("bits").alias("bits"))
    return whole.groupBy("store_location").agg(F.sum(F.bit_count("bits")).alias("transaction_id"))


def id_sketches(df: DataFrame) -> DataFrame:
    """``store_location, date, ids``: a mergeable sketch of the distinct ids, whatever their type."""
    known = df.where("store_location is not null and transaction_id is not null")
    return known.groupBy("store_location", "date").agg(F.hll_sketch_agg(F.col("transaction_id").cast("string"), SKETCH_BITS).alias("ids"))


def distinct_from_sketches(sketches: DataFrame) -> DataFrame:
    """Estimated distinct ids per store over all days of the sketches."""
    return sketches.groupBy("store_location").agg(F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("transaction_id"))


def stored_ids(df: DataFrame, path: str, exact: bool = True) -> DataFrame:
    """Bitmaps (or sketches) of the ids, written and read back. Days stay together within a file, so that readers of some
    days skip the others by its statistics; a file for each day would be a few rows."""
    made = id_bitmaps(df) if exact else id_sketches(df)
    return write_table(made.sortWithinPartitions("date"), path)
