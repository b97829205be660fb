"""Exact deduplication as a stream with keyed state on disk.

A stream over the files of a table keeps one state row for each digest of a text, for good: the
digest, the stable identifier of the row that stays, the place of its text (file and row), and how
many rows had the digest. The state lies in RocksDB, with its changes in the shared folder, so
neither memory nor the loss of an executor limits it. Rows are combined before the shuffle, so
a text that a third of all rows share sends one row from each task.

A digest alone decides nothing: the whole text of each row whose digest occurs twice is
compared with the text that the state points to, and digests that hold several texts (no two are
known for SHA-256) are grouped anew by the texts themselves.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .common import lower_ascii, salted_join, stored, text_of

#: State settings: on disk, with bounded memory for all partitions of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # No disk is set aside ahead of use: many partitions with little state would add up.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _as_pattern(path: str) -> str:
    """A path that a stream also accepts if it names a single file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/[{name[0]}]{name[1:]}"


def _located(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(
        F.col(id_column).alias("id"),
        lower_ascii(text_of(text_column)).alias("body"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def run_stream(
    spark: SparkSession,
    path: str,
    state_path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = sha256,
    bytes_per_batch: int = 64 << 30,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Take in all files below ``path`` that the state has not seen; give the whole state.

    Called again with the same ``state_path``, only new files are read. One row per digest:
    ``digest, keep (id, file, row), n``. The row with the largest identifier stays; equal
    identifiers are told apart by their place.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader.option("maxBytesPerTrigger", bytes_per_batch)
    rows = _located(reader.parquet(_as_pattern(path)), id_column, text_column)
    groups = rows.groupBy(digest(F.col("body")).alias("digest")).agg(
        F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n")
    )
    with _settings(spark, STATE):
        sink = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path)
        sink.trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").load(state_path)
        (key,), (keep, n) = state.schema["key"].dataType.names, state.schema["value"].dataType.names
        named = {f"key.`{key}`": "digest", f"value.`{keep}`": "keep", f"value.`{n}`": "n"}
        return stored(state.select(*[F.col(c).alias(name) for c, name in named.items()]), "exact-dedup-state")


def deduplicate(
    spark: SparkSession,
    path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = sha256,
    state_path: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``:
    ``id, keep_id, group_size, kept, text_sha256`` (of the text with A-Z in lower case).

    Null texts count as empty, and empty texts as copies of each other. A null identifier is
    smaller than any other. Of repeated rows with one identifier, exactly one is kept. An empty
    table gives no rows. Other columns are not read.
    """
    state_path = state_path or shared_path(spark, "exact-dedup")
    state = run_stream(
        spark, path, state_path, id_column=id_column, text_column=text_column, digest=digest, files_per_batch=files_per_batch
    )
    several = state.where("n > 1")
    rows = _located(spark.read.parquet(path), id_column, text_column).withColumn("digest", digest(F.col("body")))
    place = F.struct("id", "file", "row")

    # Full texts of the rows whose digest occurs again, against the text that the state names.
    hits = stored(salted_join(rows, several.select("digest", "keep", "n"), ["digest"], "n", ["file", "row"]), "exact-dedup-hits")
    named = hits.where(place.eqNullSafe(F.col("keep"))).select("digest", F.col("body").alias("kept_body"))
    named = stored(named.join(several.select("digest", "n"), "digest"), "exact-dedup-kept")
    compared = salted_join(hits.select("digest", "body", "file", "row"), named, ["digest"], "n", ["file", "row"])
    clashes = stored(compared.where(F.col("body") != F.col("kept_body")).select("digest").distinct(), "exact-dedup-clashes")

    small = rows.select("id", "file", "row", "digest", F.sha2("body", 256).alias("text_sha256"))
    found = salted_join(small, several.withColumn("size", F.col("n")), ["digest"], "n", ["file", "row"], "left")
    if not clashes.isEmpty():
        mixed = hits.join(clashes, "digest")
        exact = mixed.groupBy("digest", "body").agg(F.max(place).alias("own_keep"), F.count(F.lit(1)).alias("own_size"))
        own = mixed.join(exact, ["digest", "body"]).select("file", "row", "own_keep", "own_size")
        found = found.join(own, ["file", "row"], "left")
        found = found.withColumns({"keep": F.coalesce("own_keep", "keep"), "size": F.coalesce("own_size", "size")})
    keep = F.coalesce("keep", place)
    return found.select(
        "id",
        keep["id"].alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(place).alias("kept"),
        "text_sha256",
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op4_exact_dedup": op4}

ORACLE = {
    "op4_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""
}
