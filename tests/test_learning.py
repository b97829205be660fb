"""Split, metrics, models and their reports."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from tillmark.operators import kpi, learning, trees
from tillmark.plans.common import sales


@pytest.fixture(scope="module")
def table(spark, folder):
    return learning.training_table(sales(spark, folder))


@pytest.fixture(scope="module")
def forest(table):
    return learning.fit(table, learning.random_forest(numTrees=5, maxDepth=3))


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "label double, prediction double")
    got = learning.metrics(df).first()
    assert got["mae"] == pytest.approx(1 / 3) and got["rmse"] == pytest.approx(0.57735, abs=1e-5)
    assert (got["r2"], got["accuracy"], got["peak_demand"], got["staff"]) == (0.5, 50.0, 4, 2)


@pytest.mark.parametrize("peak, staff", [(125, 2), (175, 4), (10, 2), (175.9, 4)])
def test_staff_rounds_half_to_even(spark, peak, staff):
    df = spark.createDataFrame([(1.0, float(peak)), (2.0, 0.0)], "label double, prediction double")
    got = learning.metrics(df).first()
    assert (got["staff"], got["accuracy"]) == (staff, 0.0)


def test_weighted_metrics_equal_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 1.5, 3.0), (4.0, 3.0, 2.0)], "label double, prediction double, weight double")
    repeated = df.select("label", "prediction", F.explode(F.expr("sequence(1, cast(weight as int))"))).drop("col")
    assert tuple(learning.metrics(df).first()) == pytest.approx(tuple(learning.metrics(repeated).first()))


def test_split_does_not_depend_on_partitions(spark, folder):
    rows = sales(spark, folder)
    a = learning.split_rows(rows).groupBy("split").count().collect()
    b = learning.split_rows(rows.repartition(9)).groupBy("split").count().collect()
    assert sorted(a) == sorted(b)
    counts = {r["split"]: r["count"] for r in a}
    assert counts["train"] / sum(counts.values()) == pytest.approx(0.8, abs=0.04)


def test_weights_stand_for_all_rows(table, spark, folder):
    assert table.agg(F.sum("weight")).first()[0] == sales(spark, folder).count()
    assert learning.full_rows(table).count() == table.count()


def test_folded_rows_give_the_same_line_and_tree(spark, folder, table):
    """Training on folded rows equals training on the rows themselves."""
    single = learning.split_rows(sales(spark, folder)).where("split = 'train'")
    single = VectorAssembler(inputCols=learning.FEATURES, outputCol="features").transform(single)
    folded = learning.train_rows(table)
    line = [LinearRegression(solver="normal", **k).fit(d) for d, k in ((single, {}), (folded, {"weightCol": "weight"}))]
    assert line[0].coefficients.toArray() == pytest.approx(line[1].coefficients.toArray())
    tree = [DecisionTreeRegressor(maxDepth=3, **k).fit(d) for d, k in ((single, {}), (folded, {"weightCol": "weight"}))]
    assert tree[0].featureImportances.toArray() == pytest.approx(tree[1].featureImportances.toArray())


def test_line_matches_least_squares(table):
    model = learning.fit(table, learning.linear())
    rows = np.array(
        [(r["weight"], *[r[f] for f in learning.FEATURES], r["label"]) for r in learning.train_rows(table).collect()],
        float,
    )
    root = np.sqrt(rows[:, :1])
    x = np.column_stack([rows[:, 1:5], np.ones(len(rows))])
    want, *_ = np.linalg.lstsq(x * root, rows[:, 5] * root[:, 0], rcond=None)
    # The month is constant in this month of data, so only fitted values are determined.
    got = model.transform(learning.train_rows(table)).select(*learning.FEATURES, "prediction").collect()
    fitted = [np.dot([*(r[f] for f in learning.FEATURES), 1], want) for r in got]
    assert [r["prediction"] for r in got] == pytest.approx(fitted, abs=1e-6)


def test_model_reports(spark, table, forest):
    scored = learning.predict(table, forest)
    got = learning.metrics(scored).first()
    assert got["rmse"] >= got["mae"] >= 0 and got["r2"] <= 1
    weights = learning.importance(spark, forest).collect()
    assert sum(r["Importance"] for r in weights) == pytest.approx(1.0)
    assert {r["Feature"] for r in weights} == set(learning.FEATURES)
    residuals = learning.residuals(scored)
    tests = learning.test_rows(table).agg(F.sum("weight")).first()[0]
    assert residuals.agg(F.sum("weight")).first()[0] == tests
    bins = kpi.histogram(residuals, "Error", 30, "weight").collect()
    assert sum(r["count"] for r in bins) == tests
    both = kpi.five_numbers(learning.actual_and_predicted(residuals), "Value", ["Type"], "weight").collect()
    assert {r["Type"] for r in both} == {"Actual", "Predicted"}
    assert all(r["min"] <= r["q1"] <= r["median"] <= r["q3"] <= r["max"] for r in both)


def test_trees_learn_a_known_pattern(spark):
    rows = spark.range(4000).selectExpr(
        "cast(id % 24 as int) hour", "cast(id % 28 + 1 as int) day", "1 month", "cast(id % 7 as int) weekday_num",
        "cast(if(id % 24 between 8 and 11, 40, 5) as double) label", "1.0 weight",
        "if(id % 5 = 0, 'test', 'train') split", "cast(id % 3 as int) grid_fold", "cast(id % 5 as int) fold",
    )
    rows = VectorAssembler(inputCols=learning.FEATURES, outputCol="features").transform(rows)
    for make in (learning.boosted_trees(maxIter=40, stepSize=0.3), learning.random_forest(numTrees=5)):
        model = learning.fit(rows, make)
        assert learning.metrics(learning.predict(rows, model)).first()["r2"] > 0.95
        assert learning.importance(spark, model).first()["Feature"] == "hour"
    best, scores = learning.grid_search(rows, learning.random_forest(), {"numTrees": [2, 4], "maxDepth": [1, 4]})
    assert scores.count() == 4 and best.params["maxDepth"] == 4
    cv = learning.cross_validate(rows, learning.random_forest(numTrees=3)).first()
    assert cv["cv_mean"] > 90 and cv["cv_std"] >= 0


def test_comparison_reports(table):
    estimators = {
        "Boosted Trees": learning.boosted_trees(maxIter=2, maxDepth=2),
        "Random Forest": learning.random_forest(numTrees=2, maxDepth=2),
        "Linear Regression": learning.linear(),
    }
    models, comparison = learning.compare_models(table, estimators)
    assert set(models) == set(estimators) and comparison.count() == 3
    best = {r["Measure"]: r["Model"] for r in learning.best_models(comparison).collect()}
    rows = {r["Model"]: r for r in comparison.collect()}
    assert best["MAE"] == min(rows, key=lambda m: (rows[m]["MAE"], m))
    radar = learning.radar(comparison).collect()
    assert max(r["MAE"] for r in radar) < 1 and min(r["MAE"] for r in radar) == 0
    assert learning.error_measures(comparison).count() == 6


def test_hour_grain(spark, folder):
    rows = learning.split_rows(sales(spark, folder), "hour")
    per_hour = sales(spark, folder).groupBy("date", "hour").agg(F.sum("transaction_qty").alias("u"))
    assert rows.count() == per_hour.count()
    assert rows.agg(F.sum("label")).first()[0] == per_hour.agg(F.sum("u")).first()[0]


# --- histogram trees --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folded(spark, folder):
    return learning.training_table(sales(spark, folder), folded=True)


def cells_of(table, part="grid_fold"):
    """Cells as numpy: features, rows, sum of labels."""
    rows = learning.train_rows(table).collect()
    x = np.array([[r[f] for f in learning.FEATURES] for r in rows])
    return x, np.array([r["weight"] for r in rows]), np.array([r["weight"] * r["label"] for r in rows])


def plain_tree(x, w, t, depth, least_split, least_leaf, ridge):
    """The same tree by plain recursion over rows: a function of features."""
    if depth == 0 or w.sum() < least_split:
        return lambda q, v=t.sum() / (w.sum() + ridge): np.full(len(q), v)
    best = (1e-12, None)
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            a = x[:, f] <= v
            if w[a].sum() < least_leaf or w[~a].sum() < least_leaf:
                continue
            gain = t[a].sum() ** 2 / (w[a].sum() + ridge) + t[~a].sum() ** 2 / (w[~a].sum() + ridge) - t.sum() ** 2 / (w.sum() + ridge)
            if gain > best[0] * (1 + 1e-9):
                best = (gain, (f, (v + x[x[:, f] > v, f].min()) / 2))
    if best[1] is None:
        return lambda q, v=t.sum() / (w.sum() + ridge): np.full(len(q), v)
    f, limit = best[1]
    a = x[:, f] <= limit
    low, high = (plain_tree(x[s], w[s], t[s], depth - 1, least_split, least_leaf, ridge) for s in (a, ~a))
    return lambda q: np.where(q[:, f] <= limit, low(q), high(q))


@pytest.mark.parametrize("depth, split, leaf, ridge", [(1, 2, 1, 0.0), (3, 2, 1, 0.0), (4, 30, 12, 0.0), (3, 0, 1, 1.0)])
def test_trees_equal_plain_recursion(depth, split, leaf, ridge):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, [24, 28, 3, 7], (600, 4))
    w = rng.integers(0, 4, 600).astype(float)
    t = w * (x[:, 0] * 2 + (x[:, 3] > 4) * 9 + rng.normal(0, 3, 600))
    got = trees.grow(x, w, t, w, depth=depth, least_split=split, least_leaf=leaf, ridge=ridge)
    seen = w > 0
    want = plain_tree(x[seen], w[seen], t[seen], depth, split, leaf, ridge)
    assert got.value[got.leaf(x)] == pytest.approx(want(x))


def test_cut_trees_are_trees_of_less_depth():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (400, 4))
    w, t = np.ones(400), rng.normal(0, 1, 400) + x[:, 1]
    whole = trees.grow(x, w, t, w, depth=None, cuts=[1, 3, 5, -1])
    for cut, node in zip((1, 3, 5, None), whole.at_depth):
        small = trees.grow(x, w, t, w, depth=cut)
        assert whole.value[node] == pytest.approx(small.value[small.leaf(x)])


def test_draws_do_not_depend_on_partitions_or_left_out_rows(folded):
    rows = learning.train_rows(folded)
    one = trees.drawn(trees.cell_rows(rows, "grid_fold"), 4, 7, True, 1.0)
    two = trees.drawn(trees.cell_rows(rows.repartition(7).where("grid_fold <> 1"), "grid_fold"), 4, 7, True, 1.0)
    assert sorted(map(str, one.where("_part <> 1").collect())) == sorted(map(str, two.collect()))
    sums = one.agg(F.sum("n"), F.sum(F.col("m")[0]), F.sum(F.col("u")[0])).first()
    assert sums[1] == pytest.approx(sums[0], rel=0.15) and sums[2] == pytest.approx(sums[0] * (1 - np.exp(-1)), rel=0.15)


def fold_r2(rows, fold, model):
    return learning.metrics(model.transform(rows.where(F.col("grid_fold") == fold))).first()["r2"]


def test_searched_forests_are_single_fits(folded):
    """Points of the nested search equal forests of their own, fitted without each fold."""
    rows = learning.train_rows(folded)
    grid = {"numTrees": [5, 20], "maxDepth": [2, 4, None], "minSplit": [2, 6], "minLeaf": [1, 3]}
    scores = {tuple(r)[:4] + (r["left_out"],): r["r2"] for r in learning.random_forest().fold_scores(rows, "grid_fold", 3, grid).collect()}
    assert len(scores) == 24 * 3
    for n, d, split, leaf, k in [(5, 2, 2, 1, 0), (20, 4, 6, 3, 1), (20, None, 2, 1, 2), (5, None, 6, 3, 0), (20, 2, 2, 3, 1), (5, 4, 6, 1, 2)]:
        model = learning.random_forest(numTrees=n, maxDepth=d, minSplit=split, minLeaf=leaf).fit(rows.where(F.col("grid_fold") != k), "grid_fold")
        assert fold_r2(rows, k, model) == pytest.approx(scores[(n, d, split, leaf, k)], abs=1e-9)


def test_searched_boosting_is_single_fits(folded):
    rows = learning.train_rows(folded)
    grid = {"maxIter": [3, 12], "maxDepth": [2, 3], "stepSize": [0.1, 0.3]}
    scores = {tuple(r)[:4]: r["r2"] for r in learning.boosted_trees().fold_scores(rows, "grid_fold", 3, grid).collect()}
    for n, d, step, k in [(3, 2, 0.1, 0), (12, 3, 0.3, 1), (12, 2, 0.3, 2)]:
        model = learning.boosted_trees(maxIter=n, maxDepth=d, stepSize=step).fit(rows.where(F.col("grid_fold") != k), "grid_fold")
        assert fold_r2(rows, k, model) == pytest.approx(scores[(n, d, step, k)], abs=1e-9)


def test_boosting_equals_a_small_numpy_version(folded):
    """Without sampling: each tree on what is left, by plain recursion."""
    x, w, y = cells_of(folded)
    now = np.full(len(x), y.sum() / w.sum())
    for _ in range(6):
        now = now + 0.3 * plain_tree(x, w, y - w * now, 3, 0, 1, 1.0)(x)
    model = learning.boosted_trees(maxIter=6, maxDepth=3, stepSize=0.3, rowShare=1.0, featureShare=1.0).fit(learning.train_rows(folded))
    cells = {tuple(int(v) for v in row): p for row, p in zip(x, now)}
    got = model.transform(learning.train_rows(folded)).collect()
    assert [r["prediction"] for r in got] == pytest.approx([cells[tuple(r[f] for f in learning.FEATURES)] for r in got])


def test_folds_by_subtraction_equal_single_lines(folded):
    rows = learning.full_rows(folded)
    scores = {r["left_out"]: r["r2"] for r in learning.line_fold_scores(rows, "fold", 5).collect()}
    for k in range(5):
        model = learning.linear().fit(rows.where(F.col("fold") != k))
        want = learning.metrics(model.transform(rows.where(F.col("fold") == k))).first()["r2"]
        assert scores[k] == pytest.approx(want, abs=1e-9)
