import numpy as np
from pyspark.sql import functions as F

from tillmark.llm import quality as q


def test_slopes_are_those_of_the_loss():
    rng = np.random.RandomState(1)
    rows, slots = np.repeat(np.arange(6), 4), rng.randint(0, 9, 24)
    values, grades = rng.rand(24), np.array([0, 1, 2, 2, 1, 0])
    weights, thresholds = rng.randn(9), np.array([-0.5, 0.8])
    loss, by_weight, by_edge = q.loss_and_slopes(weights, thresholds, grades, rows, slots, values)
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        there = q.loss_and_slopes(weights + step, thresholds, grades, rows, slots, values)[0]
        assert abs((there - loss) / 1e-6 - by_weight[i]) < 1e-3
    for i in range(2):
        there = q.loss_and_slopes(weights, thresholds + np.eye(2)[i] * 1e-6, grades, rows, slots, values)[0]
        assert abs((there - loss) / 1e-6 - by_edge[i]) < 1e-3


def test_grades_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ratings = q.grades_of(spark.read.parquet(f"{folder}/labels.parquet"))
    model = q.fit(docs, ratings.where("doc_id % 4 <> 0"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    held_out = docs.where("doc_id % 4 = 0").join(ratings, "doc_id")
    scored = q.score(held_out, model).select(F.col("_row.grade").alias("grade"), (F.col("tail") >= q.KEEP).cast("double").alias("kept"))
    kept = {r["grade"]: r["kept"] for r in scored.groupBy("grade").agg(F.avg("kept").alias("kept")).collect()}
    assert kept[2] > 0.97 and kept[1] < 0.2 and kept[0] < 0.25


def test_odd_documents_and_ratings(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, None), (None, 1, 1), (99, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    kept = q.select_good(odd_docs, labels, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert q.select_good(no_docs, labels).count() == 0
    unrated = q.fit(odd_docs, q.grades_of(labels.limit(0)), 3)
    grades = q.score(odd_docs, unrated).select("expected").distinct().collect()
    assert len(grades) == 1


def test_the_sample_is_bounded(spark, odd_docs):
    ratings = spark.createDataFrame([(i % 9 + 1, i % 3) for i in range(90)], "doc_id long, grade int")
    assert q.rated_features(odd_docs.dropDuplicates(["doc_id"]), ratings, 7).count() == 7
