import corpus_pipeline
from pyspark.sql import functions as F

from tillmark.llm import jaccard_join, line_dedup, mixing
from tillmark.llm.common import stored


def test_stages(spark, folder):
    """Every stage does its work on all that the one before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], folder), f"test-{name}"))
    raw, good, lines, distinct, mix, packed = kept
    for frame in (good, lines, distinct, mix):
        assert frame.columns == columns and frame.dtypes == docs.dtypes
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert labels.join(good, "doc_id").where("toxic = 1 or quality = 0").count() < 0.4 * labels.where("toxic = 1 or quality = 0").count()
    clean = labels.where("toxic = 0 and quality = 1")
    assert clean.join(good, "doc_id").count() > 0.9 * clean.join(raw, "doc_id").count()
    again = line_dedup.repeated_lines(lines).count()
    assert again <= 0.02 * lines.count()  # only lines that repeated one that is gone by now
    assert jaccard_join.near_duplicates(distinct).where("n_links > 0").isEmpty()
    words = F.sum(mixing.words_in(F.col("text")))
    assert 1.2 < mix.agg(words).first()[0] / distinct.agg(words).first()[0] < 1.8
    ids = {r["doc_id"] for r in mix.select("doc_id").collect()}
    pieces = packed.collect()
    assert {p["doc_id"] for p in pieces} == ids
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)


def test_odd_input(spark, odd_docs, no_docs, folder):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, folder), f"odd-{name}")
            assert docs.columns == odd_docs.columns
