import numpy as np
from pyspark.sql import functions as F

from corvane.llm import quality


def test_quality_counts_every_labelled_row(spark):
    """More labelled rows than a sample of 12,000 would hold: the threshold rests on all of them."""
    n = 20_000
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.concat(F.lit("w"), (F.col("id") * 31 + i).cast("string"))), F.when(F.col("id") % 10 == 0, F.repeat(F.lit("#$"), 40)))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    model = quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality")))
    assert model.counted == n
    assert {(r.doc_id % 10 == 0, r.kept) for r in quality.judge_documents(docs, model).collect()} == {(True, False), (False, True)}
    scores, good, counts = np.array([0.9, 0.5, 0.5, 0.1]), np.array([False, False, True, True]), np.array([5, 40, 1, 3])
    every = np.repeat(scores, counts), np.repeat(good, counts)
    assert quality.calibrate(scores, good, 2.0, counts) == quality.calibrate(*every, 2.0)
