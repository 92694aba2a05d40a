"""The pipeline's mixing stage keeps good documents, however doubtful the posteriors are, and thins out the others to their share."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import mixing


def test_doubtful_posteriors_lose_no_good_document(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 3000
    good = rng.random(n) < 0.5
    odds = np.exp(rng.normal(0, 1.9, n) + np.where(good, 1.8, -1.8))  # calibrated posteriors, AUC of some 0.9
    p = odds / (1 + odds)
    data = [(i, float(p[i]), float((1 - p[i]) * 0.8), float((1 - p[i]) * 0.2)) for i in range(n)]
    made = spark.createDataFrame(data, "id bigint, a double, b double, c double").select("id", F.lit(100).cast("bigint").alias("tokens"), F.array("a", "b", "c").alias("p"))
    monkeypatch.setattr(mixing, "posteriors", lambda *a, **b: made)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(n)], "doc_id bigint, text string")
    left = {r.doc_id for r in corpus_pipeline.mix(spark, docs, "/root/testdata/sf0.001").collect()}
    top = {i for i, *q in data if q[0] >= max(q)}
    assert top <= left
    share = len(left - top) / len(left)
    assert abs(share - corpus_pipeline.SHARES[1]) < 0.02
    rated = mixing.thinned(docs, None, shares=corpus_pipeline.SHARES).collect()
    assert all((r.rate == 1 and r.copies == 1) if r.id in top else 0 <= r.rate <= 1 for r in rated)
    kept, rest = (sum(r.rate * r.tokens for r in rated if (r.id in top) == x) for x in (True, False))
    assert abs(rest / (kept + rest) - corpus_pipeline.SHARES[1]) < 0.01


def test_clean_labelled_rows_stay(spark):
    d = "/root/testdata/sf0.01"
    docs = corpus_pipeline.toxic(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    clean = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1 and toxic = 0").join(docs, "doc_id", "left_semi").collect()}
    left = {r.doc_id for r in corpus_pipeline.mix(spark, docs, d).collect()}
    assert clean and clean <= left
