"""Documents to token ids in five stages, each an operator of ``convoca.llm``.

Every stage is written as Parquet and read again as the next one's documents, so
a lost executor repeats one stage at most. ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoca.llm import toxicity
from convoca.llm.bpe import encode_decode
from convoca.llm.common import read
from convoca.llm.decontaminate import drop_contaminated
from convoca.llm.line_dedup import dedup_lines
from convoca.llm.queries import in_reach
from convoca.llm.simhash import drop_near_duplicates
from convoca.sources.staging import shared_dir


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; labels of held-out rows teach nothing."""
    in_reach(spark)
    labels = read(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.filter("predicted = 0").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller id holds too go; documents stay, some of them empty."""
    in_reach(spark)
    kept = dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose fingerprints link, directly or through others, the smallest id stays."""
    in_reach(spark)
    return drop_near_duplicates(docs).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each document, and the digest of what they decode to."""
    in_reach(spark)
    made = encode_decode(docs)
    return made.select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("bpe", token_ids),
]

# the first stage learns from labels, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
