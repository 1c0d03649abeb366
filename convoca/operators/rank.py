"""Ranking of candidates by similarity to the request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convoca.functions.text import decode_tags, decode_vector
from convoca.functions.vectors import cosine, norm, usable
from convoca.sources.catalog import Catalog
from convoca.sources.staging import broadcast_if_small, stage

# column suffix -> the requests that read it; anything but 'es' means Catalan
LANGUAGES = {"es": "idioma = 'es'", "cat": "idioma is distinct from 'es'"}


def only_needed(table: DataFrame, needed: DataFrame, at_most: int | None = None) -> DataFrame:
    """Rows of ``table`` for the events in ``needed``, of which there are ``at_most`` as many if that is known.

    Wide rows are dropped where they are read when the ids fit on every
    executor; otherwise they shuffle with the ids.
    """
    ids = needed.select("id_unico_evento").distinct()
    return table.join(broadcast_if_small(ids, at_most=at_most), "id_unico_evento", "left_semi")


def with_scores(
    candidates: DataFrame, requests: DataFrame, vectors: DataFrame, missing: float = 0.3
) -> DataFrame:
    """``similitud`` of each candidate to the vector of its request.

    Requests without concepts score 0.0; events without a usable vector score
    ``missing``. Each language reads only its own vector column, and only for
    events that are candidates of a request that has concepts.
    """
    semantic = F.size(F.coalesce("conceptos", F.array().cast("array<string>"))) > 0
    # the norm of a question's vector is worked out once, before it meets its candidates
    asking = stage(
        requests.select(
            "request_id",
            "idioma",
            semantic.alias("semantica"),
            F.when(semantic, F.col("query_embedding")).alias("consulta"),
            F.when(semantic, norm(usable(F.col("query_embedding")))).alias("norma_consulta"),
        ),
        "consultas",
    )
    queries, asking = asking.filter("semantica"), asking.select("request_id", "idioma", "semantica")
    scored = []
    for language, applies in LANGUAGES.items():
        ids = candidates.join(asking.filter("semantica").filter(applies), "request_id", "left_semi")
        ours = candidates.join(
            queries.filter(applies).select("request_id", "consulta", "norma_consulta"), "request_id"
        )
        column = f"tags_embedding_{language}"
        events = (
            only_needed(vectors.select("id_unico_evento", column), ids, getattr(candidates, "staged_rows", None))
            .select("id_unico_evento", usable(decode_vector(vectors, column)).alias("vector"))
            .withColumn("norma", norm(F.col("vector")))
        )
        similarity = cosine(
            F.col("consulta"), F.col("vector"), F.col("norma_consulta"), F.col("norma")
        )
        found = ours.join(events, "id_unico_evento", "left").select(
            *candidates.columns,
            F.lit(True).alias("semantica"),
            F.coalesce(similarity, F.lit(missing)).alias("similitud"),
        )
        # vectors shuffle for one language at a time, and their files go before anything is ordered
        scored.append(stage(found, "similitudes"))
    plain = candidates.join(
        asking.filter(~F.col("semantica")).select("request_id", "semantica"), "request_id"
    ).withColumn("similitud", F.lit(0.0))
    return scored[0].unionByName(scored[1]).unionByName(plain.select(*scored[0].columns))


def best(scored: DataFrame, threshold: float = 0.6, fallback: int = 10) -> DataFrame:
    """Cut and order the candidates of each request.

    With concepts: those with a score of at least ``threshold``, or the best
    ``fallback`` when none has it, by score. Without concepts all, by start.
    Equal scores keep the order by start. Adds ``orden`` and ``alcanzan``
    (whether the threshold was reached).
    """
    by_request = W.partitionBy("request_id")
    kept = (
        ~F.col("semantica")
        | (F.col("alcanzan") & (F.col("similitud") >= threshold))
        | (~F.col("alcanzan") & (F.col("orden") <= fallback))
    )
    return (
        scored.withColumn(
            "orden", F.row_number().over(by_request.orderBy(F.desc("similitud"), "posicion"))
        )
        .withColumn("alcanzan", F.max(F.col("similitud") >= threshold).over(by_request))
        .filter(kept)
    )


def semantic_rank(
    candidates: DataFrame,
    requests: DataFrame,
    catalog: Catalog,
    threshold: float = 0.6,
    fallback: int = 10,
    missing: float = 0.3,
) -> DataFrame:
    return best(with_scores(candidates, requests, catalog.embeddings, missing), threshold, fallback)


def convertible(events: DataFrame, language: str) -> Column:
    """Whether an event can become a result: required fields present, tags a list."""
    required = [f"titulo_{language}", "cp_evento", "poblacion_nombre"]
    ready = decode_tags(events, f"tags_{language}").isNotNull()
    for name in required:
        ready = ready & F.col(name).isNotNull()
    return ready
