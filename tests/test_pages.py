"""The report bundles: every frame of every page can be evaluated."""

import pytest

from tillmark.operators import learning
from tillmark.plans import pages
from tillmark.plans.common import line_sales, sales
from tillmark.plans.rollup import hourly_rollup
from tillmark.session import durable
from tillmark.sources.adapters import store_operations


@pytest.fixture(scope="module")
def cube(spark, folder):
    return durable(hourly_rollup(sales(spark, folder)))


def filled(page, *may_be_empty):
    counts = {name: frame.count() for name, frame in page.items()}
    assert all(n > 0 for name, n in counts.items() if name not in may_be_empty), counts
    return counts


def test_pages_over_the_rollup(spark, folder, cube):
    facts = sales(spark, folder)
    assert filled(pages.executive_overview(cube, facts))["stores"] == 5
    assert filled(pages.demand_patterns(cube))["levels"] == facts.select("weekday", "hour").distinct().count()
    assert filled(pages.workforce(cube, 20))["busiest_slots"] == 20
    assert filled(pages.what_if(cube))["comparison"] == 4
    assert filled(pages.monitor(cube, facts, 60, 25))["feed"] == 25


def test_inventory_page(spark, folder):
    facts = line_sales(spark, folder)
    page = pages.inventory_management(facts, store_operations(spark, folder), categories=["ECONOMY"])
    counts = filled(page, "class_a", "high_risk")
    assert counts["proposals"] == 14 and counts["supply_chain"] == 5


def test_forecast_page(cube):
    page = pages.sales_forecast(cube, "Store 2")
    counts = filled(page)
    assert counts["moving_average"] == 12 and counts["arima"] == 14 and counts["comparison"] == 3


def test_model_pages(spark, folder, monkeypatch):
    """With small models: the full ones run as registered queries."""
    small = {
        "Boosted Trees": lambda: learning.boosted_trees(maxIter=2, maxDepth=2),
        "Random Forest": lambda: learning.random_forest(numTrees=2, maxDepth=2),
        "Linear Regression": learning.linear,
    }
    monkeypatch.setattr(learning, "MODELS", small)
    monkeypatch.setattr(learning, "BOOSTED_GRID", {"maxIter": [1, 2]})
    monkeypatch.setattr(learning, "FOREST_GRID", {"numTrees": [1, 2]})
    facts = sales(spark, folder)
    for page in pages.peak_demand(facts, tune=True).values():
        assert filled(page)["first_20"] == 20
    assert filled(pages.model_comparison(facts))["radar"] == 3


def test_distinct_ids_merge_over_days(spark, folder):
    """Bitmaps of single days, merged, count as the transactions do; a day added later is one more merge."""
    from tillmark.operators import kpi
    from tillmark.plans import rollup
    from tillmark.plans.common import line_sales

    facts = line_sales(spark, folder)
    want = {r["store_location"]: r["transaction_id"] for r in kpi.distinct_transactions(facts).collect()}
    early, late = (facts.where(f"date {op} date'1995-06-01'") for op in ("<", ">="))
    both = rollup.id_bitmaps(early).union(rollup.id_bitmaps(late))
    assert {r["store_location"]: r["transaction_id"] for r in rollup.distinct_from_bitmaps(both).collect()} == want
    guess = rollup.distinct_from_sketches(rollup.id_sketches(early).union(rollup.id_sketches(late)))
    assert all(abs(r["transaction_id"] / want[r["store_location"]] - 1) < 0.04 for r in guess.collect())


def test_bitmaps_take_the_room_of_their_ids(spark, monkeypatch):
    """Days of few ids that lie far apart: short bitmaps, made by tasks of few rows; ids of any sign and size count."""
    from tillmark.plans import rollup

    monkeypatch.setattr(rollup, "TASK_ROWS", 100)
    ids = [(i - 500) * 1_000_003 for i in range(1000)] + [0, -1, 63, 64, -64, 2**63 - 1, -(2**63)]
    rows = [("Store", day, i) for i in ids for day in ("2024-01-01", "2024-01-02", None)] + [(None, None, 1), ("Store", None, None)]
    made = rollup.id_bitmaps(spark.createDataFrame(rows, "store_location string, date string, transaction_id long"))
    assert made.rdd.getNumPartitions() >= len(ids) * 3 // 100
    assert {f.name: f.dataType.simpleString() for f in made.schema.fields}["bits"] == "bigint"
    assert [r["transaction_id"] for r in rollup.distinct_from_bitmaps(made).collect()] == [len(set(ids))]
