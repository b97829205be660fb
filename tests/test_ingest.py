"""Sources and cleaning on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from tillmark.operators import clean, enrich
from tillmark.session import require_steady_clock, shared_dir, shared_path
from tillmark.sources import sinks, transactions
from tillmark.sources.transactions import from_text, read_csv

COLUMNS = "transaction_id string, transaction_time string, transaction_qty string, unit_price string, " \
    "store_location string, product_category string, product_type string"


def raw(spark, rows):
    return transactions.from_text(spark.createDataFrame(rows, COLUMNS))


def line(i, time="2023-01-01 07:06:11", qty="1", price="1", store="a", category="c"):
    return (str(i), time, qty, price, store, category, "t")


def test_equal_rows_with_nulls_are_one(spark):
    rows = [line(1, qty="NA", store=""), line(1, qty="NA", store="")]
    assert clean.drop_duplicate_rows(raw(spark, rows)).count() == 1


def test_bad_and_missing_times_are_dropped(spark):
    rows = [line(1), line(2, time="bad"), line(3, time=None)]
    assert clean.drop_missing_time(raw(spark, rows)).count() == 1


def test_time_format_can_be_given(spark):
    df = spark.createDataFrame([line(1, time="31/01/2023 08:00")], COLUMNS)
    got = transactions.from_text(df, "dd/MM/yyyy HH:mm").first()["transaction_time"]
    assert str(got) == "2023-01-31 08:00:00"


def test_quantity_without_number_is_zero(spark):
    rows = [line(1, qty="3"), line(2, qty="x"), line(3, qty=None), line(4, qty="2.5"), line(5, qty="1d"),
            line(6, qty=" 4e1 "), line(7, qty="1e999")]
    got = clean.coerce_quantity(raw(spark, rows)).orderBy("transaction_id")
    assert [r["transaction_qty"] for r in got.collect()] == [3.0, 0.0, 0.0, 2.5, 0.0, 40.0, 0.0]


def test_bad_price_becomes_median(spark):
    rows = [line(i, price=p) for i, p in enumerate(["1", "2", "3", "10", "x"])]
    got = clean.clean(raw(spark, rows)).orderBy("transaction_id").collect()
    assert got[-1]["unit_price"] == 2.5


def test_median_ignores_duplicates_and_rows_without_time(spark):
    rows = [line(1, price="1"), line(2, price="3"), line(2, price="3"), line(3, price="100", time="bad"),
            line(4, price="x")]
    got = {r["transaction_id"]: r["unit_price"] for r in clean.clean(raw(spark, rows)).collect()}
    assert got == {"1": 1.0, "2": 3.0, "4": 2.0}


def test_stored_rows_give_the_same(spark):
    rows = [line(1, price="1"), line(2, price="3"), line(2, price="3"), line(4, price="x"), line(5, time="bad")]
    df = raw(spark, rows)
    stored = clean.clean(df, store=shared_path(spark, "distinct"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, clean.clean(df).collect()))


def test_no_usable_price_stays_null(spark):
    got = clean.clean(raw(spark, [line(1, price="x"), line(2, price="")])).collect()
    assert [r["unit_price"] for r in got] == [None, None]


def test_nan_price_counts_as_missing(spark):
    df = raw(spark, [line(1), line(2), line(3)]).withColumn(
        "unit_price", F.when(F.col("transaction_id") == "3", F.lit(float("nan"))).otherwise(F.lit(4.0))
    )
    assert {r["unit_price"] for r in clean.clean(df).collect()} == {4.0}


def test_calendar(spark):
    rows = [line(1, time="2024-01-01 10:00:00"), line(2, time="2024-01-06 23:59:59")]
    got = enrich.enrich(clean.clean(raw(spark, rows))).orderBy("transaction_id").collect()
    assert [(r["weekday"], r["weekday_num"], r["is_weekend"], r["quarter"], r["hour"]) for r in got] == [
        ("Monday", 0, 0, 1, 10), ("Saturday", 5, 1, 1, 23)
    ]


def test_csv_round_trip_with_other_column_order_and_quotes(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(
        "store_location,transaction_id,transaction_time,transaction_qty,unit_price,product_category,product_type,extra\n"
        '"Hell\'s ""Kitchen"", NY",1,2023-01-01 07:06:11,2,3.5,Tea,x,keep\n'
        "Astoria,2,nonsense,2,3.5,Tea,x,NULL\n"
    )
    got = transactions.load(spark, str(tmp_path / "sales.csv")).collect()
    assert len(got) == 1
    assert (got[0]["store_location"], got[0]["revenue"], got[0]["extra"]) == ('Hell\'s "Kitchen", NY', 7.0, "keep")


def test_summary_and_writer(spark, sell):
    sales = sell([("2024-01-01 10:00:00", 1, 2, "a", "x"), ("2024-01-02 10:00:00", 1, 2, "b", "x")])
    assert tuple(transactions.dataset_summary(sales).first()) == (2, 15)
    back = sinks.write_table(sales, shared_path(spark, "test"), partition_by=["date"])
    assert sorted(back.columns) == sorted(sales.columns) and back.count() == 2


def test_shared_folder_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        pytest.skip("no shared folder configured")
    assert shared_dir(spark) == named.rstrip("/")


def test_headers_of_one_path_must_agree(spark, tmp_path):
    first, second = tmp_path / "a.csv", tmp_path / "b.csv"
    first.write_text("transaction_id,transaction_time,transaction_qty,unit_price\n1,2024-01-01 10:00:00,2,5\n")
    second.write_text("transaction_id,transaction_time,unit_price,transaction_qty\n2,2024-01-01 11:00:00,3,2.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path / "*.csv")).collect()
    rows = {r["transaction_id"]: (r["transaction_qty"], r["unit_price"]) for r in read_csv(spark, [str(first), str(second)]).collect()}
    assert rows == {"1": ("2", "5"), "2": ("2.5", "3")}


def test_line_breaks_within_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('transaction_id,transaction_time,product_type\n1,2024-01-01 10:00:00,"two\nlines"\n')
    (row,) = read_csv(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert row["product_type"] == "two\nlines"


def test_zones_with_clock_changes_are_refused(spark):
    """Else two local times around a change would become one."""
    rows = spark.createDataFrame([("1", "2024-03-10 02:30:00"), ("1", "2024-03-10 03:30:00")], "transaction_id string, transaction_time string")
    assert clean.drop_duplicate_rows(from_text(rows)).count() == 2
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="clocks change"):
            from_text(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for steady in ("+02:00", "GMT+1", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", steady)
        require_steady_clock(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rows_are_read_once_for_cleaning(spark):
    """A missing price needs its median, but not a second pass over the input."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(1000).selectExpr(
        "cast(id as string) transaction_id", "'2024-01-01 10:00:00' transaction_time", "'1' transaction_qty",
        "case when id = 7 then 'x' else cast(id as string) end unit_price", "'a' store_location",
    )
    found = clean.clean(from_text(rows.mapInPandas(counted, rows.schema)))
    assert found.where("unit_price is null").count() == 0
    assert seen.value == 1000
