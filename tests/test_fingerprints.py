"""Fingerprints of tables whose hashes add up to more than a bigint holds."""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_sums_beyond_a_bigint(spark):
    for values in ([], [5], [0, 2**40 - 1], [2**62 + 7, 2**62, 2**40 - 1], [2**63 - 1] * 5):
        df = spark.createDataFrame([(v,) for v in values], "v bigint")
        found = df.agg(entry._folded_sum(F.col("v")).alias("s"))
        assert found.schema["s"].dataType.simpleString() == "bigint"
        assert found.first().s == (sum(values) % 2**63 if values else None)
