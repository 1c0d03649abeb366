"""Registered queries of this package and the DuckDB statements of those SQL can express."""

from __future__ import annotations

import os
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoca.llm import dialogue, oracles, pii, secrets, spelling, toxicity
from convoca.llm.bpe import encode_decode
from convoca.llm.common import read
from convoca.llm.decontaminate import contamination
from convoca.llm.katz import scores
from convoca.llm.licenses import scan
from convoca.llm.line_dedup import dedup_lines
from convoca.llm.neighbours import nearest, valid
from convoca.llm.simhash import near_duplicate_classes
from convoca.llm.token_counts import token_counts

ROOT = str(Path(__file__).resolve().parents[2])


def in_reach(spark: SparkSession) -> None:
    """Put this package in reach of workers that do not start in the repository."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def _prepared(query):
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        in_reach(spark)
        return query(spark, folder)

    return run


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(read(spark, folder, "documents")).drop("blocks")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(read(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicate_classes(read(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return scores(read(spark, folder, "documents"))


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = valid(read(spark, folder, "embeddings"))
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(read(spark, folder, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans")
    )


def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    made = encode_decode(read(spark, folder, "documents"))
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    labels = read(spark, folder, "labels").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    runs = spelling.letter_runs(read(spark, folder, "documents"), misspell_every=199)
    return spelling.variants(spelling.word_counts(runs))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    said = read(spark, folder, "conversations")
    return dialogue.report(dialogue.damaged(said), said)


def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(read(spark, folder, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    digest = F.sha2(secrets.joined("base"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, secrets.KINDS), digest, secrets.joined("spans").alias("spans"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash_near_duplicates": op5_simhash_near_duplicates,
    "op6_language_model": op6_language_model,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_personal_data": op8_personal_data,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secret_scan": op13_secret_scan,
}

QUERIES = {name: _prepared(query) for name, query in QUERIES.items()}

ORACLES = {
    "op2_decontamination": oracles.DECONTAMINATION,
    "op4_line_dedup": oracles.LINE_DEDUP,
    "op11_spelling_variants": oracles.SPELLING,
}
