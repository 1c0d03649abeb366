"""The trees for personal data learn from every proposal."""

from convoca.llm import pii
from pyspark.sql import functions as F


def test_all_spans_are_learnt(spark, monkeypatch):
    base = F.col("id") % 3 == 0
    found = spark.range(24_000).select(
        F.lit("phone").alias("kind"),
        base.alias("base"),
        F.col("id").alias("start"),
        F.when(base, F.format_string("+34 9%08d", "id")).otherwise(F.format_string("9%07d", F.col("id") % 100)).alias("found"),
        F.when(base, "tel ").otherwise("v ").alias("before"),
        F.lit("").alias("after"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("mark"),
    )
    staged = {}

    def kept(df, name):
        staged[name] = df.cache()
        return staged[name]

    monkeypatch.setattr(pii, "stage", kept)
    judge = pii.fit(found)
    lessons = staged["pii-lessons"]
    # confirmed spans twice, the second time without plus
    assert lessons.agg(F.sum("n")).first()[0] == 24_000 + 8_000
    assert {r[0] for r in lessons.select("apart").distinct().collect()} == {True, False}
    assert judge is not None and "phone" in judge.thresholds
