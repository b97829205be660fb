"""Demand models on calendar features: a straight line by MLlib, forests and boosted trees from histograms.

The features have few values, so rows with equal features and label are folded into one row with a weight.
That loses nothing: least squares, metrics and histograms add such rows up anyway, and trees draw their samples
as if from single rows. It bounds the table by the calendar grid times the distinct quantities. One scan
of the facts serves all models, folds and reports.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import units
from ..functions.numeric import half_even
from ..functions.ordered import arg_best
from ..schema import MIN_STAFF, PEAK_UNITS_PER_STAFF
from ..session import durable
from .enrich import calendar_features
from .shape import melt, stack
from .trees import FEATURES, BoostedHistograms, HistogramForest

SEED = 42

# Model settings and search grids.
BOOSTED = {"maxIter": 100, "stepSize": 0.05, "maxDepth": 5, "rowShare": 0.8, "featureShare": 0.8}
FOREST = {"numTrees": 150, "maxDepth": 8, "minSplit": 5}
BOOSTED_GRID = {"maxIter": [50, 100], "maxDepth": [3, 5], "stepSize": [0.05, 0.1]}
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [3, 5, 10, None], "minSplit": [2, 5, 10], "minLeaf": [1, 2, 4]}


# --- data ------------------------------------------------------------------------------------


def ticket(key: Column, start: int) -> Column:
    """Eight hexadecimal digits of the key's MD5, as a number: equal on every run and engine."""
    digits = F.substring(F.md5(key.cast("string").cast("binary")), start, 8)
    return F.conv(digits, 16, 10).cast("long")


def split_rows(df: DataFrame, grain: str = "row") -> DataFrame:
    """Features, label, ``split`` (train for 8 of 10 ids) and ``ticket`` for folds, per row.

    ``grain="row"`` learns the quantity of a row; ``grain="hour"`` the units of a whole hour.
    """
    df = calendar_features(df)
    if grain == "hour":
        df = df.groupBy("date", *FEATURES).agg(units().alias("transaction_qty"))
        key = F.concat_ws("-", F.col("date").cast("string"), F.col("hour").cast("string"))
    else:
        key = F.col("transaction_id")
    return df.select(
        *FEATURES,
        F.col("transaction_qty").cast("double").alias("label"),
        F.when(ticket(key, 1) % 10 < 8, "train").otherwise("test").alias("split"),
        ticket(key, 9).alias("ticket"),
    )


def training_table(
    df: DataFrame, folds: int = 5, grid_folds: int = 3, grain: str = "row", folded: bool = False
) -> DataFrame:
    """Training rows with a weight (1, or how many rows were ``folded``), assembled and kept durable
    for the many passes of training."""
    rows = split_rows(df, grain).withColumns(
        {"fold": (F.col("ticket") % folds).cast("int"), "grid_fold": (F.col("ticket") % grid_folds).cast("int")}
    )
    if folded:
        rows = rows.groupBy("split", "fold", "grid_fold", *FEATURES, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    else:
        rows = rows.drop("ticket").withColumn("weight", F.lit(1.0))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return durable(assembled)


def train_rows(table: DataFrame) -> DataFrame:
    return table.where(F.col("split") == "train")


def test_rows(table: DataFrame) -> DataFrame:
    return table.where(F.col("split") == "test")


def full_rows(table: DataFrame) -> DataFrame:
    """Train and test rows together."""
    return stack([train_rows(table), test_rows(table)])


# --- models ----------------------------------------------------------------------------------


def boosted_trees(**params) -> BoostedHistograms:
    """Boosted trees; each sees 80 % of the rows and of the features."""
    return BoostedHistograms(SEED, **{**BOOSTED, **params})


def random_forest(**params) -> HistogramForest:
    return HistogramForest(SEED, **{**FOREST, **params})


def linear(**params) -> Estimator:
    """Ordinary least squares by the normal equations. A constant feature makes these singular;
    MLlib then iterates, which the tight tolerance keeps exact."""
    return LinearRegression(weightCol="weight", solver="normal", regParam=0.0, tol=1e-12, **params)


MODELS: dict[str, Callable] = {
    "Boosted Trees": boosted_trees,
    "Random Forest": random_forest,
    "Linear Regression": linear,
}


def metrics(predictions: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: MAE, RMSE, R2, accuracy, peak demand and staff, from ``label`` and ``prediction``."""
    w = F.col(weight) if weight in predictions.columns else F.lit(1.0)
    y, p = F.col("label"), F.col("prediction")
    sums = predictions.agg(
        F.sum(w).alias("n"),
        F.sum(w * F.abs(y - p)).alias("abs_error"),
        F.sum(w * (y - p) * (y - p)).alias("sq_error"),
        F.sum(w * y).alias("sum_y"),
        F.sum(w * y * y).alias("sum_yy"),
        F.max(p).alias("top"),
    )
    variation = F.col("sum_yy") - F.col("sum_y") * F.col("sum_y") / F.col("n")
    flat = F.when(F.col("sq_error") == 0, 1.0).otherwise(0.0)
    r2 = F.when(variation > 0, 1 - F.col("sq_error") / variation).otherwise(flat)
    return sums.select(
        (F.col("abs_error") / F.col("n")).alias("mae"),
        F.sqrt(F.col("sq_error") / F.col("n")).alias("rmse"),
        r2.alias("r2"),
        F.col("top").cast("long").alias("peak_demand"),
    ).select(
        "*",
        F.greatest(F.lit(0.0), half_even(F.col("r2") * 100, 2)).alias("accuracy"),
        F.greatest(F.lit(MIN_STAFF), F.rint(F.col("peak_demand") / PEAK_UNITS_PER_STAFF))
        .cast("long").alias("staff"),
    )


def fit(table: DataFrame, estimator) -> Model:
    return estimator.fit(train_rows(table))


def predict(table: DataFrame, model: Model) -> DataFrame:
    return model.transform(test_rows(table))


def line_fold_scores(rows: DataFrame, part: str, parts: int) -> DataFrame:
    """``left_out, r2`` of the straight line fitted without each part, from one scan.

    Sums of products of features and label add up, so what a line without a part needs is the sum over
    all parts less that part's, and so are its errors there. Features are shifted first, which keeps the sums small.
    """
    w = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    shifts = {"hour": 12, "day": 16, "month": 6, "weekday_num": 3}
    terms = [F.lit(1.0), *[(F.col(f) - shifts[f]).cast("double") for f in FEATURES], F.col("label").cast("double")]
    size = len(terms)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    products = rows.groupBy(F.col(part).alias("part")).agg(F.array(*[F.sum(w * terms[i] * terms[j]) for i, j in pairs]).alias("sums"))
    gram = np.zeros((parts, size, size))
    for row in products.collect():
        for (i, j), value in zip(pairs, row["sums"]):
            gram[row["part"], i, j] = gram[row["part"], j, i] = value
    found = []
    for k in range(parts):
        known, held = gram.sum(0) - gram[k], gram[k]
        if held[0, 0] == 0:
            continue
        line = np.append(-np.linalg.lstsq(known[:-1, :-1], known[:-1, -1], rcond=1e-12)[0], 1.0)
        error, variation = float(line @ held @ line), float(held[-1, -1] - held[0, -1] ** 2 / held[0, 0])
        found.append((k, 1 - error / variation if variation > 0 else float(error <= 0)))
    return rows.sparkSession.createDataFrame(found, "left_out int, r2 double")


def cross_validate(table: DataFrame, estimator, folds: int = 5) -> DataFrame:
    """One row: mean and deviation of the R2 (in percent) over the folds. All folds share one pass over the rows."""
    rows = full_rows(table)
    if hasattr(estimator, "fold_scores"):
        scores = estimator.fold_scores(rows, "fold", folds)
    else:
        scores = line_fold_scores(rows, "fold", folds)
    return scores.agg(
        half_even(F.avg("r2") * 100, 2).alias("cv_mean"), half_even(F.stddev_pop("r2") * 100, 2).alias("cv_std")
    )


def grid_scores(table: DataFrame, estimator, grid: dict[str, Sequence], folds: int = 3) -> DataFrame:
    """Mean and deviation of the R2 over the folds for every grid point, the best one first. No limit is null."""
    scores = estimator.fold_scores(train_rows(table), "grid_fold", folds, grid)
    names = sorted(grid)
    points = scores.groupBy(*names).agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"))
    return points.orderBy(F.desc("r2_mean"), *names)


def grid_search(table: DataFrame, estimator, grid: dict[str, Sequence], folds: int = 3) -> tuple[Model, DataFrame]:
    """Best model by cross-validated R2 on the training rows, and the score of every grid point,
    the best one (whose parameters the model has, in ``params``) first."""
    scores = durable(grid_scores(table, estimator, grid, folds))
    best = scores.orderBy(F.desc("r2_mean"), *sorted(grid)).first()
    chosen = {name: next(v for v in values if (None if v is None else float(v)) == best[name]) for name, values in grid.items()}
    model = fit(table, estimator.with_params(**chosen))
    model.params = chosen
    return model, scores


# --- reports ---------------------------------------------------------------------------------


def side_by_side(spark: SparkSession, tasks: Sequence[Callable]) -> list:
    """Run training tasks at the same time: each is a chain of short jobs, which alone
    would leave most executors idle."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [r.result() for r in running]


def model_row(name: str, scored: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """Metrics of one model as a row, with its cross-validation if there is one."""
    row = metrics(scored).withColumn("Model", F.lit(name))
    if cv is None:
        return row.withColumns({"cv_mean": F.lit(None).cast("double"), "cv_std": F.lit(None).cast("double")})
    both = cv.select(F.struct("cv_mean", "cv_std")).scalar()
    return row.withColumns({"cv_mean": both.getField("cv_mean"), "cv_std": both.getField("cv_std")})


def comparison_table(rows: Sequence[DataFrame]) -> DataFrame:
    """Model rows as one table, kept durable: the reports below read it again and again."""
    table = stack(list(rows)).select(
        "Model",
        F.col("accuracy").alias("Accuracy (%)"),
        F.coalesce("cv_mean", F.lit(0.0)).alias("CV Score (%)"),
        F.col("mae").alias("MAE"),
        F.col("rmse").alias("RMSE"),
        F.col("r2").alias("R2 Score"),
        F.col("peak_demand").alias("Peak Demand"),
        F.col("staff").alias("Recommended Staff"),
    )
    return durable(table)


def compare_models(
    table: DataFrame, estimators: dict | None = None, folds: int = 5
) -> tuple[dict[str, Model], DataFrame]:
    """Train all models, cross-validate them, and put their metrics next to each other."""
    estimators = estimators or {name: make() for name, make in MODELS.items()}
    names = list(estimators)
    results = side_by_side(
        table.sparkSession,
        [lambda e=estimators[n]: fit(table, e) for n in names]
        + [lambda e=estimators[n]: cross_validate(table, e, folds) for n in names],
    )
    models = dict(zip(names, results))
    rows = [model_row(n, predict(table, models[n]), cv) for n, cv in zip(names, results[len(names):])]
    return models, comparison_table(rows)


def best_models(comparison: DataFrame) -> DataFrame:
    """For each measure the best model and its value; first the largest staff need."""
    wanted = [
        ("Accuracy (%)", True), ("CV Score (%)", True), ("MAE", False), ("RMSE", False),
        ("R2 Score", True), ("Recommended Staff", True),
    ]
    return stack(
        [
            arg_best(comparison, measure, "Model", largest=largest).select(
                F.lit(measure).alias("Measure"), "Model", F.col(measure).cast("double").alias("Value")
            )
            for measure, largest in wanted
        ]
    )


def radar(comparison: DataFrame) -> DataFrame:
    """Each measure scaled by its largest value; errors turned round, so that more is better."""
    up, down = ["Accuracy (%)", "CV Score (%)", "R2 Score"], ["MAE", "RMSE"]
    tops = comparison.agg(F.struct(*[F.max(c).alias(f"t{i}") for i, c in enumerate(up + down)])).scalar()

    def scaled(i: int, name: str) -> Column:
        top = tops.getField(f"t{i}")
        part = F.col(name) / top
        return F.when(top > 0, part if name in up else 1 - part).otherwise(F.col(name)).alias(name)

    return comparison.select("Model", *[scaled(i, c) for i, c in enumerate(up + down)])


def error_measures(comparison: DataFrame) -> DataFrame:
    """MAE and RMSE in long form."""
    return melt(comparison, ["Model"], ["MAE", "RMSE"])


def _last_stage(model: Model) -> Model:
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def importance(spark: SparkSession, model: Model) -> DataFrame:
    """Importance per feature (trees) or coefficient (linear), largest first."""
    fitted = _last_stage(model)
    trees = hasattr(fitted, "featureImportances")
    values = (fitted.featureImportances if trees else fitted.coefficients).toArray().tolist()
    name = "Importance" if trees else "Coefficient"
    return spark.createDataFrame(list(zip(FEATURES, values)), f"Feature string, {name} double").orderBy(
        F.desc(name), "Feature"
    )


def residuals(predictions: DataFrame) -> DataFrame:
    """Actual, predicted (one decimal) and error; ``weight`` says how many rows each line stands for."""
    shown = half_even(F.col("prediction"), 1)
    keep = [c for c in FEATURES if c in predictions.columns]
    weight = F.col("weight") if "weight" in predictions.columns else F.lit(1.0)
    return predictions.groupBy(
        *keep, F.col("label").alias("Actual"), shown.alias("Predicted"), (F.col("label") - shown).alias("Error")
    ).agg(F.sum(weight).alias("weight"))


def actual_and_predicted(table: DataFrame) -> DataFrame:
    """Residual table as one long column of values with their type."""
    return stack(
        [table.select("weight", F.col(c).alias("Value"), F.lit(c).alias("Type")) for c in ("Actual", "Predicted")]
    )


def mean_model(table: DataFrame, by: Sequence[str] = ("hour",)) -> DataFrame:
    """Predictions of the simplest model: the mean training label of equal feature values."""
    w, y = F.col("weight"), F.col("label")
    means = train_rows(table).groupBy(*by).agg((F.sum(w * y) / F.sum(w)).alias("prediction"))
    return test_rows(table).join(means, list(by), "inner")
