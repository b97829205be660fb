"""Streams give what the same operators give on a batch, late and repeated rows included."""

import pytest
from pyspark.sql import functions as F

from tillmark.operators.enrich import enrich
from tillmark.operators.kpi import store_revenue
from tillmark.operators.ranking import latest
from tillmark.plans.common import sales
from tillmark.plans.streams import event_stream
from tillmark.session import shared_path
from tillmark.streaming import ingest, sinks, windows

TEXT = ["transaction_id", "transaction_time", "transaction_qty", "unit_price", "store_location",
        "product_category", "product_type"]


def appended(spark, stream):
    path = shared_path(spark, "test")
    sinks.append_files(stream, path).awaitTermination()
    return sinks.read_appended(spark, path, stream)


def closed(spark, folder, batch):
    mark = sales(spark, folder).agg(F.max("transaction_time") - F.expr("INTERVAL 10 minutes")).scalar()
    return batch.where(F.col("window_end") <= mark)


@pytest.mark.parametrize("operator", [windows.hourly_by_store, windows.rolling_windows])
def test_closed_windows_equal_the_batch(spark, folder, operator):
    got = appended(spark, operator(event_stream(spark, folder)))
    want = closed(spark, folder, operator(sales(spark, folder)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_store_snapshot_equals_the_batch(spark, folder):
    path = shared_path(spark, "test")
    sinks.keep_snapshots(windows.live_store_revenue(event_stream(spark, folder)), path).awaitTermination()
    got = sinks.read_snapshot(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, store_revenue(sales(spark, folder)).collect()))


def test_feed_merges_batches(spark, folder):
    """Files that arrive one at a time give the latest rows of all of them."""
    incoming, path = shared_path(spark, "in"), shared_path(spark, "test")
    columns = ["transaction_id", "transaction_time", "revenue"]
    rows = sales(spark, folder).select(*columns)
    rows.repartition(4, "transaction_id").write.parquet(incoming)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    sinks.keep_latest(stream, path, 15).awaitTermination()
    assert sinks.read_snapshot(spark, path).count() == 15
    assert latest(sinks.read_snapshot(spark, path), 15).collect() == latest(rows, 15).collect()


def text_rows(spark, rows):
    path = shared_path(spark, "text")
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TEXT)).coalesce(1).write.option("header", True).csv(path)
    return path


def test_stream_cleaning(spark):
    rows = [
        ("1", "2024-01-01 10:00:00", "2", "3", "a", "x", "t"),
        ("1", "2024-01-01 10:00:00", "2", "3", "a", "x", "t"),  # a copy
        ("1", "2024-01-01 10:00:00", "2", "3", "a", "y", "t"),  # another line of the same receipt
        ("2", "never", "2", "3", "a", "x", "t"),
        ("3", "2024-01-01 10:01:00", "many", "free", "NA", "x", "t"),
    ]
    text = ingest.stream_csv(spark, text_rows(spark, rows), TEXT)
    got = appended(spark, ingest.stream_clean(text, 4.5)).collect()
    assert sorted((r["transaction_id"], r["product_category"], r["transaction_qty"], r["unit_price"]) for r in got) == [
        ("1", "x", 2.0, 3.0), ("1", "y", 2.0, 3.0), ("3", "x", 0.0, 4.5)
    ]
    assert {r["store_location"] for r in got} == {"a", None}


def test_late_rows_are_dropped(spark):
    """A row that comes after its window was closed by the watermark changes nothing."""
    schema = "transaction_time timestamp, transaction_qty double, unit_price double, store_location string"

    def batch(path, times):
        rows = [(t, 1.0, 1.0, "a") for t in times]
        df = spark.createDataFrame(rows, schema.replace("transaction_time timestamp", "transaction_time string"))
        df.withColumn("transaction_time", F.col("transaction_time").cast("timestamp")).coalesce(1).write.mode(
            "append"
        ).parquet(path)

    source, path = shared_path(spark, "late"), shared_path(spark, "test")

    def run():
        stream = windows.hourly_by_store(enrich(spark.readStream.schema(schema).parquet(source)))
        sinks.append_files(stream, path).awaitTermination()
        return sinks.read_appended(spark, path, stream)

    batch(source, ["2024-01-01 10:05:00", "2024-01-01 12:30:00"])
    run()
    batch(source, ["2024-01-01 10:06:00", "2024-01-01 12:40:00", "2024-01-01 15:00:00"])
    got = {str(r["window_start"]): r["units"] for r in run().collect()}
    assert got == {"2024-01-01 10:00:00": 1.0, "2024-01-01 12:00:00": 2.0}


def test_baseline_has_at_most_a_row_per_hour(spark, folder):
    baseline = windows.hour_baseline(sales(spark, folder))
    assert baseline.count() == 24
    scored = windows.window_anomalies(sales(spark, folder), baseline, 1.0)
    assert scored.where("is_anomaly").count() > 0
    usual = windows.rolling_vs_baseline(sales(spark, folder), baseline)
    assert usual.agg(F.avg("vs_baseline")).first()[0] == pytest.approx(1.0, abs=0.2)


def test_no_snapshot_yet(spark):
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, shared_path(spark, "none"))


def test_cleaned_streams_feed_windows(spark):
    """One watermark from source to windows; unknown stores are no group, as in the batch."""
    rows = [
        (str(i), f"2024-01-01 {10 + i // 4}:{i % 4}0:00", "1", "2", None if i % 3 == 0 else "s", "x", "t") for i in range(16)
    ]
    text = ingest.stream_csv(spark, text_rows(spark, rows + rows[:3]), TEXT)
    got = appended(spark, windows.hourly_by_store(ingest.stream_clean(text, 2.0))).collect()
    assert {r["store_location"] for r in got} == {"s"}
    assert sum(r["transactions"] for r in got) == len([r for r in rows if r[4] and r[1] < "2024-01-01 13"])


def test_history_is_read_once_for_a_baseline(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    history = sales(spark, folder).select("transaction_time", "transaction_qty", "revenue", "date", "hour")
    history = history.mapInPandas(counted, history.schema)
    baseline = windows.store_baseline(history, shared_path(spark, "baseline"), "2024-01-16")
    incoming = shared_path(spark, "in")
    events = sales(spark, folder).select("transaction_time", "transaction_qty", "revenue")
    events.repartition(4).write.parquet(incoming)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    assert appended(spark, windows.rolling_vs_baseline(stream, baseline)).count() > 0
    assert seen.value == history.sparkSession.read.parquet(f"{folder}/events.parquet").count()
    assert baseline.count() == 24


def test_old_snapshots_go(spark, folder):
    incoming, path = shared_path(spark, "in"), shared_path(spark, "test")
    rows = sales(spark, folder).select("store_location", "revenue")
    rows.repartition(5).write.parquet(incoming)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    sinks.keep_snapshots(windows.live_store_revenue(stream), path).awaitTermination()
    assert len(sinks._batches(spark, path)) == 2
    assert sorted(map(tuple, sinks.read_snapshot(spark, path).collect())) == sorted(map(tuple, store_revenue(rows).collect()))
