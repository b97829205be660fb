"""Results do not depend on partitioning, hot keys or the number of keys."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillmark.functions.ordered import exact_quantiles, running_sum
from tillmark.operators import clean, inventory, kpi, ranking, series
from tillmark.plans.common import line_sales, sales


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_partitioning_does_not_matter(spark, folder, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    operators = [kpi.kpis, kpi.store_performance, kpi.hourly_demand, inventory.abc_classes, series.moving_average]
    want = [sorted(map(tuple, op(sales(spark, folder)).collect())) for op in operators]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spread = sales(spark, folder).repartition(partitions, F.rand(7))
        assert [sorted(map(tuple, op(spread).collect())) for op in operators] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("many", [1, 50, 5000])
def test_running_sum_over_many_keys(spark, many):
    """Most keys tie on the metric, and one key holds a third of the total."""
    data = [(f"k{i:05d}", 1 if i % 3 else 7) for i in range(many)] + [("hot", 3 * many)]
    df = spark.createDataFrame(data, "k string, v bigint").repartition(5)
    got = running_sum(df, [F.desc("v"), F.col("k")], {"upto": "v"}).collect()
    want, total = {}, 0
    for k, v in sorted(data, key=lambda r: (-r[1], r[0])):
        total += v
        want[k] = total
    assert {r["k"]: r["upto"] for r in got} == want


def test_running_sum_uses_several_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.range(10_000).selectExpr("id k", "cast(id % 10 as bigint) v")
        got = running_sum(df, [F.desc("v"), F.col("k")], {"upto": "v"})
        assert got.agg(F.max("upto")).first()[0] == 45_000
        rows = got.orderBy(F.desc("v"), "k").limit(1001).collect()
        assert [r["upto"] for r in (rows[0], rows[999], rows[1000])] == [9, 9000, 9008]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_quantiles_of_skewed_groups(spark):
    rng = random.Random(3)
    data = [("hot", 5.0)] * 3000 + [(f"g{rng.randrange(20)}", rng.random() * 100) for _ in range(6000)]
    data += [("g0", None), ("g1", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    frame = pd.DataFrame(data, columns=["g", "v"]).dropna()
    for g, values in frame.groupby("g")["v"]:
        assert got[g] == pytest.approx(np.quantile(values, probs))
    whole = exact_quantiles(df, "v", probs).first()["quantiles"]
    assert whole == pytest.approx(np.quantile(frame["v"], probs))


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (9.0, 2.0)], "v double, w double")
    got = exact_quantiles(df, "v", [0.25, 0.5, 0.75], (), "w").first()["quantiles"]
    assert got == pytest.approx(np.quantile([1, 1, 1, 2, 9, 9], [0.25, 0.5, 0.75]))


def test_median_of_nothing(spark):
    df = spark.createDataFrame([("x",)], "unit_price string")
    assert clean.price_median(df) is None


def test_hot_store_and_duplicates(spark, folder):
    """A store with a third of the rows, all copies of one row, changes no other store."""
    facts = sales(spark, folder).drop("date")
    one = facts.where("store_location = 'Store 1'").orderBy("transaction_id").limit(1)
    copies = one.join(spark.range(2000), how="cross").drop("id").withColumn("store_location", F.lit("hot"))
    mixed = facts.unionByName(copies)
    rows = {r["store_location"]: r["Revenue"] for r in kpi.store_performance(mixed).collect()}
    plain = {r["store_location"]: r["Revenue"] for r in kpi.store_performance(facts).collect()}
    assert {k: v for k, v in rows.items() if k != "hot"} == plain
    assert clean.drop_duplicate_rows(mixed).where("store_location = 'hot'").count() == 1


def test_facts_are_not_shuffled_for_the_star_join(spark, folder):
    plan = line_sales(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 4


def test_columns_are_pruned_and_filters_pushed(spark, folder):
    facts = line_sales(spark, folder).where("transaction_time >= '2000-01-01'")
    plan = kpi.daily_sales(facts)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "l_shipdate" in line and "FileScan" in line)
    read = scan.split("ReadSchema: ")[1]
    assert "l_discount" not in read and "l_orderkey" not in read
    assert "GreaterThanOrEqual(l_shipdate" in scan


def test_money_sums_lose_nothing(spark):
    """Totals beyond 64-bit ten-thousandths, amounts far below them, and what is no amount."""
    from tillmark.functions.numeric import money_total

    def total(df):
        return df.select(money_total("v").alias("t")).first()["t"]

    assert total(spark.createDataFrame([(6e14,), (6e14,), (-1.5,)], "v double")) == 1.2e15 - 1.5
    assert total(spark.range(1_000_000).selectExpr("0.00004D AS v")) == 40.0
    assert total(spark.createDataFrame([(float("nan"),), (None,), (float("-inf"),), (0.25,)], "v double")) == 0.25
    assert total(spark.createDataFrame([], "v double")) == 0.0
    values = spark.range(10_000).selectExpr("(id % 977) * 1.37 - 300 AS v")
    assert total(values) == total(values.repartition(13))


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_samples_and_feeds_do_not_depend_on_partitions(spark, partitions):
    """Also where ids repeat, as on order lines, and rows agree in time and id."""
    rows = spark.range(400).selectExpr(
        "cast(id div 8 as string) transaction_id", "timestamp'2024-01-01 10:00:00' transaction_time", "cast(id % 5 as double) revenue", "id % 3 k"
    )
    dealt = rows.repartition(partitions)
    for n in (21, 23):
        assert ranking.sample_rows(dealt, n).collect() == ranking.sample_rows(rows, n).collect()
        assert ranking.latest(dealt, n).collect() == ranking.latest(rows, n).collect()
    assert len({r["transaction_id"] for r in ranking.sample_rows(rows, 20).collect()}) > 10  # lines, not whole receipts


def test_quantiles_join_no_whole_group(spark):
    """A hot group is cut into ranges on both sides of the only join."""
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, 'b', 'a') g", "cast(id as double) v")
    plan = exact_quantiles(df, "v", [0.5], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "_range" in joins[0]
