"""Reading transactions: CSV files and Parquet tables, brought to the canonical columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean
from ..operators.enrich import enrich
from ..schema import NULL_TOKENS, TRANSACTIONS
from ..session import require_steady_clock


def parse_time(value: Column, ts_format: str | None = None) -> Column:
    """Timestamp, or null where the text does not fit. Default format: ISO 8601."""
    return F.try_to_timestamp(value, F.lit(ts_format)) if ts_format else F.try_to_timestamp(value)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Turn the usual texts for a missing value into nulls in every string column."""
    return df.select(
        *[
            F.when(~F.col(f.name).isin(NULL_TOKENS), F.col(f.name)).alias(f.name)
            if f.dataType.simpleString() == "string"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    ts_format: str | None = None,
    multi_line: bool = False,
    **options: str,
) -> DataFrame:
    """CSV with a header line. All columns stay text except the parsed transaction time.

    The files of one path must have one header (any column order); another one is an error. Several
    paths may differ: their columns are matched by name, and what a path lacks is null. No type inference: it
    would read the data twice. Files stay splittable, unless ``multi_line`` allows line breaks within quoted fields.
    """
    reader = spark.read.options(header=True, escape='"', enforceSchema=False, multiLine=multi_line, **options)
    parts = [reader.csv(one) for one in ([path] if isinstance(path, str) else path)]
    return from_text(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), ts_format)


def from_text(raw: DataFrame, ts_format: str | None = None) -> DataFrame:
    """Text rows with missing values as nulls and the transaction time parsed."""
    require_steady_clock(raw.sparkSession)
    raw = missing_to_null(raw)
    return raw.withColumn("transaction_time", parse_time(F.col("transaction_time"), ts_format))


def read_parquet(spark: SparkSession, path: str, mapping: dict[str, Column] | None = None) -> DataFrame:
    """Parquet table to the canonical columns; ``mapping`` gives an expression per column."""
    table = spark.read.parquet(path)
    return canonical(table, mapping or {name: F.col(name) for name in table.columns})


def canonical(table: DataFrame, mapping: dict[str, Column]) -> DataFrame:
    """Select the mapped canonical columns with their canonical types.

    Ids keep the type they have: whole numbers are cheaper to count and to shuffle than text.
    """
    require_steady_clock(table.sparkSession)
    return table.select(
        *[
            (mapping[f.name] if f.name == "transaction_id" else mapping[f.name].cast(f.dataType)).alias(f.name)
            for f in TRANSACTIONS.fields
            if f.name in mapping
        ]
    )


def load(
    spark: SparkSession, path: str | Sequence[str], ts_format: str | None = None, store: str | None = None
) -> DataFrame:
    """CSV to cleaned and enriched transactions; for ``store`` see ``clean``."""
    return enrich(clean(read_csv(spark, path, ts_format), store=store))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Number of records and of columns."""
    return df.agg(F.count(F.lit(1)).alias("records")).withColumn("columns", F.lit(len(df.columns)))
