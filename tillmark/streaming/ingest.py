"""Streams of transactions: reading, cleaning and enriching them on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.clean import coerce_quantity, drop_missing_time, impute_price
from ..operators.enrich import enrich
from ..sources.transactions import canonical, from_text


DELAY = "10 minutes"


def marked(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """The stream with a watermark on the transaction time, unless it has one."""
    has = "spark.watermarkDelayMs" in stream.schema["transaction_time"].metadata
    return stream if has or not stream.isStreaming else stream.withWatermark("transaction_time", delay)


def stream_parquet(
    spark: SparkSession, glob: str, schema: T.StructType | str, mapping: dict[str, Column]
) -> DataFrame:
    """Parquet files that appear under a path pattern, as canonical transactions.

    For tables whose columns already have their types; for text use ``stream_csv``.
    """
    return canonical(spark.readStream.schema(schema).parquet(glob), mapping)


def stream_csv(
    spark: SparkSession, glob: str, columns: list[str], ts_format: str | None = None, **options
) -> DataFrame:
    """CSV files that appear under a path pattern; all columns stay text but the time.

    A file whose header does not list exactly these columns fails the stream.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).options(header=True, escape='"', enforceSchema=False, **options)
    return from_text(reader.csv(glob), ts_format)


def stream_clean(raw: DataFrame, median: float | None, delay: str = DELAY) -> DataFrame:
    """Cleaned and enriched stream.

    Copies are dropped as long as they arrive within ``delay`` of each other, over all raw
    columns; the state of older rows is given up. The watermark set here holds for all windows
    behind it. A running median is not possible on a
    stream, so the price median comes from a batch of the past.
    """
    unique = marked(drop_missing_time(raw), delay).dropDuplicatesWithinWatermark(raw.columns)
    return enrich(impute_price(coerce_quantity(unique), median))
