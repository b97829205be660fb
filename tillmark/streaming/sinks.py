"""Where streams go. All files, checkpoints included, lie in a folder the cluster shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import latest


def append_files(stream: DataFrame, path: str, trigger: dict | None = None) -> StreamingQuery:
    """Append finished rows to Parquet files, exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", f"{path}/_state").trigger(**(trigger or {"availableNow": True})).start(
        f"{path}/rows"
    )


def read_appended(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(f"{path}/rows")


def per_batch(
    stream: DataFrame, path: str, mode: str, write: Callable[[DataFrame, int], None], trigger: dict | None
) -> StreamingQuery:
    """Hand every batch to ``write``, which must overwrite what it wrote for the same number before."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    return writer.option("checkpointLocation", f"{path}/_state").trigger(**(trigger or {"availableNow": True})).start()


def keep_snapshots(stream: DataFrame, path: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the complete result of every batch to a folder of its own. A repeated batch
    overwrites its own folder only, so readers never see half a result."""

    def write(batch: DataFrame, number: int) -> None:
        _write_snapshot(batch, path, number)

    return per_batch(stream, path, "complete", write, trigger)


def keep_latest(stream: DataFrame, path: str, n: int = 20, trigger: dict | None = None) -> StreamingQuery:
    """Keep the latest n transactions: each batch merges its own latest n with the kept ones."""

    def write(batch: DataFrame, number: int) -> None:
        merged = latest(batch, n)
        if number > 0:
            merged = latest(merged.unionByName(batch.sparkSession.read.parquet(_folder(path, number - 1))), n)
        _write_snapshot(merged, path, number)

    return per_batch(stream, path, "append", write, trigger)


def _folder(path: str, number: int) -> str:
    return f"{path}/snapshots/batch={number}"


def write_batch(rows: DataFrame, folder: str, number: int, keep: int | None = None) -> None:
    """Write the result of a batch to its own folder; with ``keep``, the one that many batches back goes."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    if keep is not None and number >= keep:
        place, fs = _file_system(rows.sparkSession, f"{folder}/batch={number - keep}")
        fs.delete(place, True)


def _file_system(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_snapshot(rows: DataFrame, path: str, number: int) -> None:
    """Write a snapshot; then the one before the last, which no batch can need any more, goes."""
    write_batch(rows, f"{path}/snapshots", number, keep=2)


def finished_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that are written completely (file names only, no data)."""
    folder, fs = _file_system(spark, folder)
    if not fs.exists(folder):
        return []
    jvm = spark.sparkContext._jvm
    done = [
        s.getPath().getName()
        for s in fs.listStatus(folder)
        if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return sorted(int(name.split("=")[1]) for name in done)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished snapshots, three at most."""
    return finished_batches(spark, f"{path}/snapshots")


def _snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    numbers = _batches(spark, path)
    return spark.read.parquet(_folder(path, numbers[-1])) if numbers else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The result of the latest finished batch."""
    found = _snapshot(spark, path)
    if found is None:
        raise FileNotFoundError(f"no finished snapshot below {path}")
    return found
