import pyarrow as pa
from pyspark.sql import functions as F

from corvane.llm.common import BATCH_BYTES, written


def test_written_tables_bound_the_batches(spark):
    """Batches to Python are bounded by bytes while a table is written, and the session's bound is as before."""
    before = spark.conf.get(BATCH_BYTES, None)
    wide = spark.range(4000).select(F.repeat(F.lit("x"), 4000).alias("t")).coalesce(1)
    sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n bigint")
    got = [r.n for r in written(sizes, "sizes", "2m").collect()]
    assert sum(got) == 4000 and max(got) < 1000
    assert spark.conf.get(BATCH_BYTES, None) == before
