"""Demand models as registered queries.

Models are fitted once per session and folder and shared by the reports on them. Trees from random samples
have no SQL equivalent; what they are made of has: a first split of all rows, in the forest's and the boosted way, and the
reports on models of that one split. The line has: least squares by successive projections. Metrics, residuals
and comparison reports are also checked on the simplest models, training means by one feature.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import kpi, learning, ranking
from .aggregates import _RESIDUALS, _TEST, _TICKET
from .common import EV, even, over, rounded, sales

_DONE: dict = {}


def _once(spark, folder, what, make):
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _DONE:
        _DONE[key] = make()
    return _DONE[key]


def table(spark, folder):
    return _once(spark, folder, "table", lambda: learning.training_table(sales(spark, folder), folded=True))


def model(spark, folder, name):
    rows = table(spark, folder)
    return _once(spark, folder, name, lambda: learning.fit(rows, learning.MODELS[name]()))


def validated(spark, folder, name):
    rows = table(spark, folder)
    return _once(spark, folder, ("cv", name), lambda: learning.cross_validate(rows, learning.MODELS[name]()))


def compared(spark, folder):
    """Comparison table over all models; what is not fitted yet is fitted side by side."""

    def make():
        table(spark, folder)
        names = list(learning.MODELS)
        learning.side_by_side(
            spark,
            [lambda n=n: model(spark, folder, n) for n in names]
            + [lambda n=n: validated(spark, folder, n) for n in names],
        )
        return learning.comparison_table(
            [learning.model_row(n, scored(spark, folder, n), validated(spark, folder, n)) for n in names]
        )

    return _once(spark, folder, "comparison", make)


def scored(spark, folder, name):
    return learning.predict(table(spark, folder), model(spark, folder, name))


def fitted_metrics(name):
    return lambda spark, folder: learning.metrics(scored(spark, folder, name))


def baseline(spark, folder):
    return learning.mean_model(table(spark, folder))


def residuals(spark, folder):
    return learning.residuals(baseline(spark, folder))


def ml1(spark, folder):
    rows = learning.split_rows(sales(spark, folder))
    return rows.groupBy("split", *learning.FEATURES).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("units")
    )


def ml5_line(spark, folder):
    """Straight line of quantity over the hour alone."""
    rows = table(spark, folder).drop("features")
    rows = VectorAssembler(inputCols=["hour"], outputCol="features").transform(rows)
    line = learning.fit(rows, learning.linear())
    predictions = learning.predict(rows, line)
    return predictions.groupBy("hour").agg(F.round(F.first("prediction"), 6).alias("prediction"))


def grid(make, points):
    def run(spark, folder):
        return learning.grid_scores(table(spark, folder), make(), points)

    return run


def cv(name):
    return lambda spark, folder: validated(spark, folder, name)


def feature_weights(name):
    return lambda spark, folder: learning.importance(spark, model(spark, folder, name))


def mean_models(spark, folder):
    """The comparison table over three models that predict training means."""
    rows = table(spark, folder)
    return learning.comparison_table(
        [
            learning.model_row(name, learning.mean_model(rows, [feature]))
            for name, feature in (("Day Mean", "day"), ("Hour Mean", "hour"), ("Weekday Mean", "weekday_num"))
        ]
    )


STUMPS = {
    "Boosted Trees": lambda: learning.boosted_trees(maxIter=1, maxDepth=1, rowShare=1.0, featureShare=1.0),
    "Random Forest": lambda: learning.random_forest(numTrees=1, maxDepth=1, bootstrap=False),
}


def stump(spark, folder, name):
    rows = table(spark, folder)
    return _once(spark, folder, ("stump", name), lambda: learning.fit(rows, STUMPS[name]()))


def first_split(name):
    """The one split of a model of one tree, and what it predicts on both sides."""

    def run(spark, folder):
        model = stump(spark, folder, name)
        feature = F.element_at(F.array(*[F.lit(f) for f in learning.FEATURES]), F.col("feature")[0] + 1)
        sides = [F.round(model.base + model.scale * F.col("value")[i], 6).alias(n) for i, n in ((1, "below"), (2, "above"))]
        return model.trees.select(feature.alias("Feature"), F.col("threshold")[0].alias("threshold"), *sides, F.round(F.col("gain")[0], 4).alias("gain"))

    return run


def stump_models(spark, folder):
    """The comparison table over models of one split."""
    rows = table(spark, folder)
    return learning.comparison_table(
        [learning.model_row(name, learning.predict(rows, stump(spark, folder, name))) for name in STUMPS]
    )


def ml12_first(spark, folder):
    order = ["weekday_num", "month", "day", "hour", "Actual", "Predicted"]
    return ranking.first_rows(residuals(spark, folder), 20, *order).select(*order, "Error")


def ml12_model_error(spark, folder):
    return kpi.histogram(
        learning.residuals(scored(spark, folder, "Linear Regression")), "Error", 30, "weight"
    )


QUERIES = {
    "ml1_split": ml1,
    "ml2_metrics": lambda s, f: rounded(learning.metrics(baseline(s, f)), "mae", "rmse", "r2"),
    "ml3_first_split": first_split("Boosted Trees"),
    "ml4_first_split": first_split("Random Forest"),
    "ml8_stump_models": lambda s, f: rounded(stump_models(s, f), "MAE", "RMSE", "R2 Score"),
    "ml10_radar_stump_models": lambda s, f: rounded(
        learning.radar(stump_models(s, f)), "Accuracy (%)", "CV Score (%)", "R2 Score", "MAE", "RMSE"
    ),
    "ml3_boosted_trees": fitted_metrics("Boosted Trees"),
    "ml4_random_forest": fitted_metrics("Random Forest"),
    "ml5_linear_regression": lambda s, f: rounded(
        fitted_metrics("Linear Regression")(s, f), "mae", "rmse", "r2"
    ),
    "ml5_straight_line": ml5_line,
    "ml6_grid_boosted": grid(learning.boosted_trees, learning.BOOSTED_GRID),
    "ml6_grid_forest": grid(learning.random_forest, learning.FOREST_GRID),
    "ml7_cv_boosted": cv("Boosted Trees"),
    "ml7_cv_forest": cv("Random Forest"),
    "ml7_cv_linear": cv("Linear Regression"),
    "ml8_comparison": compared,
    "ml8_mean_models": lambda s, f: rounded(mean_models(s, f), "MAE", "RMSE", "R2 Score"),
    "ml9_best_mean_models": lambda s, f: rounded(learning.best_models(mean_models(s, f)), "Value"),
    "ml10_radar_mean_models": lambda s, f: rounded(
        learning.radar(mean_models(s, f)), "Accuracy (%)", "CV Score (%)", "R2 Score", "MAE", "RMSE"
    ),
    "ml10_errors_mean_models": lambda s, f: rounded(learning.error_measures(mean_models(s, f)), "Value"),
    "ml9_best_models": lambda s, f: learning.best_models(compared(s, f)),
    "ml10_radar": lambda s, f: learning.radar(compared(s, f)),
    "ml10_error_measures": lambda s, f: learning.error_measures(compared(s, f)),
    "ml11_importance_boosted": feature_weights("Boosted Trees"),
    "ml11_importance_forest": feature_weights("Random Forest"),
    "ml11_coefficients": lambda s, f: rounded(feature_weights("Linear Regression")(s, f), "Coefficient"),
    "ml12_residuals": ml12_first,
    "ml12_error_histogram": lambda s, f: kpi.histogram(residuals(s, f), "Error", 30, "weight"),
    "ml12_error_five_numbers": lambda s, f: kpi.five_numbers(residuals(s, f), "Error", (), "weight"),
    "ml12_values_five_numbers": lambda s, f: kpi.five_numbers(
        learning.actual_and_predicted(residuals(s, f)), "Value", ["Type"], "weight"
    ),
    "ml12_linear_error_histogram": ml12_model_error,
}

# Least squares by successive projections, for every ``k``: each feature is freed from the ones
# before it, the label is projected on what remains. A constant feature remains as 0 and adds 0.
_LINE = """
m0 AS (SELECT k, avg(x1) FILTER (tr) AS a1, avg(x2) FILTER (tr) AS a2, avg(x3) FILTER (tr) AS a3,
  avg(x4) FILTER (tr) AS a4, avg(y) FILTER (tr) AS ay FROM r GROUP BY k),
z0 AS (SELECT r.k, tr, y, ay, x1 - a1 AS u1, x2 - a2 AS v2, x3 - a3 AS v3, x4 - a4 AS v4 FROM r JOIN m0 USING (k)),
p1 AS (SELECT k, sum(u1 * v2) / sum(u1 * u1) AS b21, sum(u1 * v3) / sum(u1 * u1) AS b31,
  sum(u1 * v4) / sum(u1 * u1) AS b41, sum(u1 * (y - ay)) / sum(u1 * u1) AS c1 FROM z0 WHERE tr GROUP BY k),
z1 AS (SELECT z0.k, tr, y, ay, u1, v2 - b21 * u1 AS u2, v3 - b31 * u1 AS v3, v4 - b41 * u1 AS v4
  FROM z0 JOIN p1 USING (k)),
p2 AS (SELECT k, sum(u2 * v3) / sum(u2 * u2) AS b32, sum(u2 * v4) / sum(u2 * u2) AS b42,
  sum(u2 * (y - ay)) / sum(u2 * u2) AS c2 FROM z1 WHERE tr GROUP BY k),
z2 AS (SELECT z1.k, tr, y, ay, u1, u2, v3 - b32 * u2 AS u3, v4 - b42 * u2 AS v4 FROM z1 JOIN p2 USING (k)),
p3 AS (SELECT k, sum(u3 * v4) / sum(u3 * u3) AS b43, sum(u3 * (y - ay)) / sum(u3 * u3) AS c3
  FROM z2 WHERE tr GROUP BY k),
z3 AS (SELECT z2.k, tr, y, ay, u1, u2, u3, v4 - b43 * u3 AS u4 FROM z2 JOIN p3 USING (k)),
p4 AS (SELECT k, coalesce(sum(u4 * (y - ay)) / nullif(sum(u4 * u4), 0), 0) AS c4 FROM z3 WHERE tr GROUP BY k),
line AS (SELECT z3.k, y, ay + c1 * u1 + c2 * u2 + c3 * u3 + c4 * u4 AS p FROM z3
  JOIN p1 USING (k) JOIN p2 USING (k) JOIN p3 USING (k) JOIN p4 USING (k) WHERE NOT tr)
"""
_X = "CAST(hour AS DOUBLE) AS x1, day(date) AS x2, weekday_num AS x3, month AS x4, transaction_qty AS y"
_LINE_TEST = f"--with r AS (SELECT 0 AS k, NOT ({_TEST}) AS tr, {_X} FROM ev),{_LINE}"
_LINE_FOLDS = f"""--with r AS (SELECT k, {_TICKET.format(start=9)} % 5 <> k AS tr, {_X} FROM ev, range(0, 5) AS f(k)),
{_LINE}"""

_SCORES = """SELECT count(*) AS n, sum(abs(y - p)) / count(*) AS mae, sqrt(sum((y - p) * (y - p)) / count(*)) AS rmse,
  1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2,
  CAST(trunc(max(p)) AS BIGINT) AS peak_demand FROM {t}"""
_METRICS = f"""SELECT round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, peak_demand,
  greatest(0.0::DOUBLE, {even("r2 * 100", 2)}) AS accuracy,
  CAST(greatest(2, round_even(peak_demand / 50, 0)) AS BIGINT) AS staff FROM s"""


_CMP = f"""cmp AS (SELECT model AS "Model", greatest(0.0::DOUBLE, {even("r2 * 100", 2)}) AS "Accuracy (%)",
      0.0::DOUBLE AS "CV Score (%)", mae AS "MAE", rmse AS "RMSE", r2 AS "R2 Score", peak_demand AS "Peak Demand",
      CAST(greatest(2, round_even(peak_demand / 50, 0)) AS BIGINT) AS "Recommended Staff" FROM s0)"""


def _mean_scores() -> str:
    parts, tables = [], []
    for name, key in (("Day Mean", "day(date)"), ("Hour Mean", "hour"), ("Weekday Mean", "weekday_num")):
        t = name.split()[0].lower()
        tables.append(
            f"""{t}_m AS (SELECT {key} AS f, sum(transaction_qty) / count(*) AS p FROM ev WHERE NOT ({_TEST}) GROUP BY 1),
            {t}_s AS (SELECT transaction_qty AS y, p FROM ev JOIN {t}_m ON {key} = f WHERE {_TEST}),
            {t}_r AS ({_SCORES.format(t=t + '_s')})"""
        )
        parts.append(f"SELECT '{name}' AS model, * FROM {t}_r")
    return f"""--with {', '.join(tables)}, s0 AS ({' UNION ALL '.join(parts)}),
    {_CMP} """


def _split(name: str, ridge: float, step: float) -> str:
    """Tables ``{name}_t`` (training rows), ``{name}_b`` (the best split and both predictions) and ``{name}_p`` (test rows)."""
    parts = " UNION ALL ".join(
        f"SELECT {i} AS f, {c} AS v, count(*) AS n, sum(e) AS s FROM {name}_t GROUP BY 2" for i, c in enumerate(("hour", "day", "month", "weekday_num"))
    )
    mean = f"(SELECT avg(transaction_qty) FROM ev WHERE NOT ({_TEST}))" if ridge else "0.0::DOUBLE"
    return f"""{name}_m AS (SELECT {mean} AS base),
    {name}_t AS (SELECT transaction_qty - base AS e, hour, day(date) AS day, month, weekday_num FROM ev, {name}_m WHERE NOT ({_TEST})),
    {name}_u AS ({parts}),
    {name}_c AS (SELECT f, v, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER a AS n, sum(s) OVER a AS s,
      lead(v) OVER (PARTITION BY f ORDER BY v) AS nv FROM {name}_u WINDOW w AS (PARTITION BY f ORDER BY v), a AS (PARTITION BY f)),
    {name}_b AS (SELECT f, (v + nv) / 2.0 AS threshold, base + {step} * sl / (nl + {ridge}) AS below,
      base + {step} * (s - sl) / (n - nl + {ridge}) AS above,
      sl * sl / (nl + {ridge}) + (s - sl) * (s - sl) / (n - nl + {ridge}) - s * s / (n + {ridge}) AS gain
      FROM {name}_c, {name}_m WHERE nv IS NOT NULL ORDER BY round(gain, 6) DESC, f, v LIMIT 1),
    {name}_p AS (SELECT transaction_qty AS y,
      CASE WHEN CASE f WHEN 0 THEN hour WHEN 1 THEN day(date) WHEN 2 THEN month ELSE weekday_num END <= threshold THEN below ELSE above END AS p
      FROM ev, {name}_b WHERE {_TEST})"""


def _first_split(ridge: float, step: float) -> str:
    return f"""--with {_split("one", ridge, step)}
    SELECT CASE f WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN 'month' ELSE 'weekday_num' END AS "Feature", CAST(threshold AS DOUBLE) AS threshold,
      round(below, 6) AS below, round(above, 6) AS above, round(gain, 4) AS gain FROM one_b"""


def _stump_scores() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{model}' AS model, * FROM ({_SCORES.format(t=t + '_p')})" for model, t in (("Boosted Trees", "boosted"), ("Random Forest", "forest"))
    )
    return f"""--with {_split("boosted", 1.0, 0.05)}, {_split("forest", 0.0, 1.0)}, s0 AS ({parts}), {_CMP} """


def _best(measure: str, order: str) -> str:
    return f"""(SELECT '{measure}' AS "Measure", "Model", round(CAST("{measure}" AS DOUBLE), 6) AS "Value" FROM cmp
      ORDER BY "{measure}" {order}, "Model" LIMIT 1)"""


def _scaled(measure: str, up: bool) -> str:
    top = f'max("{measure}") OVER ()'
    part = f'"{measure}" / {top}' if up else f'1 - "{measure}" / {top}'
    return f'round(CASE WHEN {top} > 0 THEN {part} ELSE "{measure}" END, 6) AS "{measure}"'


_FIVE = """min({v}) AS "min", quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS "median",
  quantile_cont({v}, 0.75) AS q3, max({v}) AS "max" """
_DAY = "CAST(day(date) AS INTEGER) AS day"

ORACLE = {
    "ml1_split": over(
        EV,
        f"""SELECT CASE WHEN {_TEST} THEN 'test' ELSE 'train' END AS split, hour, {_DAY}, month, weekday_num,
          count(*) AS rows, sum(transaction_qty) AS units FROM ev GROUP BY ALL""",
    ),
    "ml2_metrics": over(EV, f"{_RESIDUALS}, s AS ({_SCORES.format(t='scored')}) {_METRICS}"),
    "ml5_linear_regression": over(EV, f"{_LINE_TEST}, s AS ({_SCORES.format(t='line')}) {_METRICS}"),
    "ml5_straight_line": over(
        EV,
        f"""--with tr AS (SELECT regr_slope(transaction_qty, CAST(hour AS DOUBLE)) AS a,
          regr_intercept(transaction_qty, CAST(hour AS DOUBLE)) AS b FROM ev WHERE NOT ({_TEST}))
        SELECT DISTINCT hour, round(b + a * hour, 6) AS prediction FROM ev, tr WHERE {_TEST}""",
    ),
    "ml7_cv_linear": over(
        EV,
        f"""{_LINE_FOLDS}, s AS (SELECT k, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2
          FROM line GROUP BY k)
        SELECT {even("avg(r2) * 100", 2)} AS cv_mean, {even("stddev_pop(r2) * 100", 2)} AS cv_std FROM s""",
    ),
    "ml8_mean_models": over(
        EV,
        _mean_scores() + """SELECT "Model", "Accuracy (%)", "CV Score (%)", round("MAE", 6) AS "MAE",
          round("RMSE", 6) AS "RMSE", round("R2 Score", 6) AS "R2 Score", "Peak Demand", "Recommended Staff" FROM cmp""",
    ),
    "ml3_first_split": over(EV, _first_split(1.0, 0.05)),
    "ml4_first_split": over(EV, _first_split(0.0, 1.0)),
    "ml8_stump_models": over(
        EV,
        _stump_scores() + """SELECT "Model", "Accuracy (%)", "CV Score (%)", round("MAE", 6) AS "MAE",
          round("RMSE", 6) AS "RMSE", round("R2 Score", 6) AS "R2 Score", "Peak Demand", "Recommended Staff" FROM cmp""",
    ),
    "ml10_radar_stump_models": over(
        EV,
        _stump_scores()
        + f"""SELECT "Model", {_scaled("Accuracy (%)", True)}, {_scaled("CV Score (%)", True)},
          {_scaled("R2 Score", True)}, {_scaled("MAE", False)}, {_scaled("RMSE", False)} FROM cmp""",
    ),
    "ml9_best_mean_models": over(
        EV,
        _mean_scores()
        + " UNION ALL ".join(
            [_best("Accuracy (%)", "DESC"), _best("CV Score (%)", "DESC"), _best("MAE", ""), _best("RMSE", ""),
             _best("R2 Score", "DESC"), _best("Recommended Staff", "DESC")]
        ),
    ),
    "ml10_radar_mean_models": over(
        EV,
        _mean_scores()
        + f"""SELECT "Model", {_scaled("Accuracy (%)", True)}, {_scaled("CV Score (%)", True)},
          {_scaled("R2 Score", True)}, {_scaled("MAE", False)}, {_scaled("RMSE", False)} FROM cmp""",
    ),
    "ml10_errors_mean_models": over(
        EV,
        _mean_scores() + """SELECT "Model", 'MAE' AS "Metric", round("MAE", 6) AS "Value" FROM cmp
        UNION ALL SELECT "Model", 'RMSE', round("RMSE", 6) FROM cmp""",
    ),
    "ml11_coefficients": over(
        EV,
        _LINE_TEST + """, c AS (SELECT c4 AS k4, c3 - c4 * b43 AS k3, b21, b31, b41, b32, b42, c1, c2
          FROM p1 JOIN p2 USING (k) JOIN p3 USING (k) JOIN p4 USING (k)),
        d AS (SELECT *, c2 - k3 * b32 - k4 * b42 AS k2 FROM c),
        e AS (SELECT *, c1 - k2 * b21 - k3 * b31 - k4 * b41 AS k1 FROM d)
        SELECT 'hour' AS "Feature", round(k1, 6) AS "Coefficient" FROM e UNION ALL SELECT 'day', round(k2, 6) FROM e
        UNION ALL SELECT 'weekday_num', round(k3, 6) FROM e UNION ALL SELECT 'month', round(k4, 6) FROM e""",
    ),
    "ml12_linear_error_histogram": over(
        EV,
        _LINE_TEST + f""", e AS (SELECT y - {even("p", 1)} AS v FROM line),
        b AS (SELECT min(v) AS low, max(v) AS high FROM e)
        SELECT CAST(least(30, floor((v - low) / (high - low) * 30) + 1) AS INTEGER) AS bin, count(*) AS "count"
        FROM e, b GROUP BY 1""",
    ),
    "ml12_residuals": over(
        EV,
        _RESIDUALS.replace(
            "SELECT transaction_qty AS y", "SELECT weekday_num, month, day(date) AS day, hour, transaction_qty AS y"
        )
        + """SELECT DISTINCT weekday_num, month, CAST(day AS INTEGER) AS day, hour, y AS "Actual", shown AS "Predicted",
          y - shown AS "Error" FROM scored ORDER BY 1, 2, 3, 4, 5, 6 LIMIT 20""",
    ),
    "ml12_error_histogram": over(
        EV,
        _RESIDUALS + """, e AS (SELECT y - shown AS v FROM scored),
        b AS (SELECT min(v) AS low, max(v) AS high FROM e)
        SELECT CAST(least(30, floor((v - low) / (high - low) * 30) + 1) AS INTEGER) AS bin, count(*) AS "count"
        FROM e, b GROUP BY 1""",
    ),
    "ml12_error_five_numbers": over(
        EV, _RESIDUALS + f", e AS (SELECT y - shown AS v FROM scored) SELECT {_FIVE.format(v='v')} FROM e"
    ),
    "ml12_values_five_numbers": over(
        EV,
        _RESIDUALS
        + f""", v AS (SELECT 'Actual' AS "Type", y AS v FROM scored UNION ALL SELECT 'Predicted', shown FROM scored)
        SELECT "Type", {_FIVE.format(v='v')} FROM v GROUP BY 1""",
    ),
}
