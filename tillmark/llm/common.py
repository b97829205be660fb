"""What the operators share: tables kept in the shared folder, joins that spread hot keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: A key with more than this share of all rows is spread over several join keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once below the folder all executors share, and go on from the files.

    Cuts the lineage, so a lost executor costs no more than the tasks it was running, and
    every later reader sees the same rows.
    """
    path = shared_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of few rows, so that what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_of(column: str | Column) -> Column:
    """A text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def packed(df: DataFrame, **computed: Column) -> DataFrame:
    """Computed columns beside the whole row as ``_row``: names in the row cannot clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in computed.items()])


def unpacked(df: DataFrame, **replaced: Column) -> DataFrame:
    """The rows put away by ``packed``, with some of their columns replaced."""
    names = df.schema["_row"].dataType.names
    return df.select(*[(replaced[c] if c in replaced else F.col(f"_row.`{c}`")).alias(c) for c in names])


def salted_join(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], count: str, spread: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join rows to one row per key, however many rows a key has.

    ``groups`` (a stored table) has in ``count`` how many rows a key has. A key with more than
    1/1000 of all counted rows is cut into parts of that size: its group row is repeated once
    for each part, and ``spread`` deals its rows to the parts. Fewer than 1000 keys can be that
    frequent, which bounds the broadcast list of them. ``count`` is not in the result.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    limit = max(1, -(-int(total) // HOT_SHARE))
    parts = F.ceil(F.col(count) / limit).cast("int")
    hot = groups.where(F.col(count) > limit).select(*keys, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), list(keys), "left")
    salt = F.pmod(F.xxhash64(*spread), F.col("_parts").cast("long")).cast("int")
    dealt = dealt.withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_parts")
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(repeated.drop(count), [*keys, "_salt"], how).drop("_salt")


#: Least and most bits of the bitmap that ``likely`` sends to all executors (at most 32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_ROW_BITS = 1 << 15


def likely(rows: DataFrame, hashed: Column, keys: DataFrame, key_hash: Column) -> DataFrame:
    """The rows whose hash may be that of a key: all that are, and few others.

    Keeps rows that a join would leave out from its shuffle. What is broadcast is a bitmap of a
    size that is bounded whatever the number of keys; more keys only let more rows through.
    """
    bits, wanted = LEAST_BITS, 16 * keys.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    slot = F.pmod(key_hash, F.lit(bits)).cast("long")
    maps = keys.select(F.floor(slot / _ROW_BITS).alias("_map"), (slot % _ROW_BITS).alias("_bit"))
    maps = stored(maps.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "bitmap")
    slot = F.pmod(hashed, F.lit(bits)).cast("long")
    placed = rows.withColumns({"_map": F.floor(slot / _ROW_BITS), "_bit": slot % _ROW_BITS})
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0
    return placed.join(F.broadcast(maps), "_map").where(held).drop("_map", "_bit", "_bits")
