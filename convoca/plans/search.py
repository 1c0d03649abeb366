"""Answering a table of search requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convoca.functions.geo import haversine_km
from convoca.functions.text import decode_tags, short_hour
from convoca.operators.earliest import earliest_candidates
from convoca.operators.radius import postcodes_within
from convoca.operators.rank import LANGUAGES, convertible, only_needed, semantic_rank
from convoca.operators.streams import Streams, stored_candidates
from convoca.sources.catalog import Catalog
from convoca.sources.staging import stage, stage_counted

# --- fixed values: the sentences of an answer
_NOTHING = {
    "ca": "Ho sento, no he trobat cap esdeveniment que coincideixi amb la teva cerca.",
    "es": "Lo siento, no he encontrado ningún evento que coincida con tu búsqueda.",
}
_FOUND = {
    "ca": "He trobat %d esdeveniments per a tu.",
    "es": "He encontrado %d eventos para ti.",
}

# --- fixed values: the columns of a result
RESULT_COLUMNS = [
    "request_id",
    "rank",
    "id_unico_evento",
    "titulo",
    "descripcion_corta",
    "descripcion_larga",
    "cp_evento",
    "poblacion_nombre",
    "lugar_nombre",
    "direccion_completa",
    "fecha_inicio",
    "fecha_fin",
    "hora_inicio",
    "hora_fin",
    "es_gratuito",
    "precio_euros",
    "categorias",
    "tags",
    "url_evento",
    "url_imagen",
    "distancia_km",
    "similitud_score",
]


def localized(events: DataFrame, language: str) -> DataFrame:
    """The result columns of an event in one language; the other's are not read.

    The short description repeats the long one.
    """
    return events.select(
        "id_unico_evento",
        F.col(f"titulo_{language}").alias("titulo"),
        F.col(f"desc_larga_{language}").alias("descripcion_corta"),
        F.col(f"desc_larga_{language}").alias("descripcion_larga"),
        "cp_evento",
        "poblacion_nombre",
        "lugar_nombre",
        F.col("direccion_fisica").alias("direccion_completa"),
        F.coalesce("es_gratuito", F.lit(False)).alias("es_gratuito"),
        "precio_euros",
        F.col("link_entradas_inscripcion").alias("url_evento"),
        F.col("imagen_principal_url").alias("url_imagen"),
        decode_tags(events, f"tags_{language}").alias("tags"),
        convertible(events, language).alias("convertible"),
    )


def in_language(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Join ``rows`` (id_unico_evento, idioma, ...) with the event columns of their language."""
    known = getattr(rows, "staged_rows", None)
    parts = [
        rows.filter(applies).join(
            only_needed(localized(events, language), rows.filter(applies), known), "id_unico_evento"
        )
        for language, applies in LANGUAGES.items()
    ]
    return parts[0].unionByName(parts[1])


def with_distance(rows: DataFrame, catalog: Catalog, zero_distance_null: bool = False) -> DataFrame:
    """``distancia_km`` from ``cp_usuario`` to ``cp_evento``; NULL for unknown places."""
    point = catalog.postcodes.select("cp", "latitud", "longitud")
    placed = rows.join(
        catalog.sized(point.toDF("cp_usuario", "lat0", "lng0")), "cp_usuario", "left"
    ).join(catalog.sized(point.toDF("cp_evento", "lat1", "lng1")), "cp_evento", "left")
    distance = F.round(
        haversine_km(F.col("lat0"), F.col("lng0"), F.col("lat1"), F.col("lng1")), 2
    )
    # a coordinate of exactly 0 counts as missing
    known = (F.col("lat1") != 0) & (F.col("lng1") != 0)
    if zero_distance_null:
        known = known & (distance != 0)
    return placed.withColumn("distancia_km", F.when(known, distance)).drop(
        "lat0", "lng0", "lat1", "lng1"
    )


def event_category_names(catalog: Catalog) -> DataFrame:
    """Names of each event's categories, ``nombres_es`` and ``nombres_cat``."""
    names = catalog.categories.select("id_categoria", "nombre_es", "nombre_cat")
    return (
        catalog.event_categories.join(catalog.sized(names, of="categories"), "id_categoria")
        .groupBy("id_unico_evento")
        .agg(
            F.array_sort(F.collect_set("nombre_es")).alias("nombres_es"),
            F.array_sort(F.collect_set("nombre_cat")).alias("nombres_cat"),
        )
    )


def _hour(name: str, short: bool) -> Column:
    # midnight counts as no hour
    hour = F.when(F.col(name) != "00:00:00", F.col(name))
    return short_hour(hour) if short else hour


def _detailed(ranked: DataFrame, requests: DataFrame, catalog: Catalog) -> DataFrame:
    ranked = ranked.select(
        "request_id",
        "orden",
        "id_unico_evento",
        "fecha_inicio",
        "fecha_fin",
        "hora_inicio",
        "hora_fin",
        "similitud",
    )
    rows = ranked.join(requests.select("request_id", "idioma", "cp_usuario"), "request_id")
    return in_language(stage_counted(rows, "por-idioma"), catalog.events)


def left_out(ranked: DataFrame, requests: DataFrame, catalog: Catalog) -> DataFrame:
    """Ranked candidates that cannot be converted to a result, which ``results`` skips."""
    rows = _detailed(ranked, requests, catalog).filter(~F.coalesce("convertible", F.lit(False)))
    return rows.select("request_id", "orden", "id_unico_evento", "idioma")


def results(
    ranked: DataFrame,
    requests: DataFrame,
    catalog: Catalog,
    with_categories: bool = False,
    zero_distance_null: bool = False,
    short_hours: bool = False,
) -> DataFrame:
    """Ranked candidates as result rows; rows that cannot be converted are left out."""
    full = _detailed(ranked, requests, catalog).filter("convertible")
    full = with_distance(full, catalog, zero_distance_null)
    none = F.array().cast("array<string>")
    if with_categories:
        names = only_needed(event_category_names(catalog), ranked)
        full = full.join(names, "id_unico_evento", "left").withColumn(
            "categorias",
            F.coalesce(
                F.when(F.col("idioma") == "es", F.col("nombres_es")).otherwise(F.col("nombres_cat")),
                none,
            ),
        )
    else:
        full = full.withColumn("categorias", none)
    price = F.col("precio_euros").cast("double")
    return (
        full.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy("orden")))
        .withColumn("hora_inicio", _hour("hora_inicio", short_hours))
        .withColumn("hora_fin", _hour("hora_fin", short_hours))
        .withColumn("precio_euros", F.when(price != 0, price))
        .withColumn("similitud_score", F.round("similitud", 3))
        .select(*RESULT_COLUMNS)
    )


def search(
    requests: DataFrame,
    catalog: Catalog,
    cap: int = 50,
    threshold: float = 0.6,
    fallback: int = 10,
    missing: float = 0.3,
    on_unknown_origin: str = "all",
    with_categories: bool = False,
    zero_distance_null: bool = False,
    short_hours: bool = False,
    streams: Streams | None = None,
) -> DataFrame:
    """Ranked results of every request, one row per returned occurrence.

    The narrow candidates are staged, then vectors are read for their events
    only, and titles, texts and links only for what is returned. With stored
    ``streams`` of the catalog the candidates are read from them.
    """
    if streams is None:
        candidates = earliest_candidates(requests, catalog, cap, on_unknown_origin)
    else:
        candidates = stored_candidates(requests, catalog, streams, cap, on_unknown_origin)
    candidates = stage_counted(candidates, "candidatas")
    ranked = stage(
        semantic_rank(candidates, requests, catalog, threshold, fallback, missing), "ordenadas"
    )
    return results(ranked, requests, catalog, with_categories, zero_distance_null, short_hours)


def response_text(total: Column, idioma: Column) -> Column:
    """The sentence that opens an answer."""
    return F.when(
        total == 0, F.when(idioma == "ca", _NOTHING["ca"]).otherwise(_NOTHING["es"])
    ).otherwise(
        F.when(idioma == "ca", F.format_string(_FOUND["ca"], total)).otherwise(
            F.format_string(_FOUND["es"], total)
        )
    )


def digest(events: Column, size: int = 5) -> Column:
    """First events of an ordered list, one line each."""

    def line(event: Column, index: Column) -> Column:
        return F.concat(
            (index + 1).cast("string"),
            F.lit(". "),
            event["titulo"],
            F.lit(" - "),
            event["poblacion_nombre"],
            F.lit(" ("),
            F.date_format(event["fecha_inicio"], "yyyy-MM-dd"),
            F.lit(")"),
            F.when(event["es_gratuito"], " [GRATUITO]").otherwise(""),
        )

    return F.array_join(F.transform(F.slice(events, 1, size), line), "\n")


def envelope(found: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request: text, ordered events, total, language and digest.

    A request has at most as many events as the candidate cap.
    """
    event = F.struct("rank", *[c for c in RESULT_COLUMNS if c not in ("request_id", "rank")])
    per_request = found.groupBy("request_id").agg(
        F.array_sort(F.collect_list(event)).alias("eventos")
    )
    return (
        requests.select("request_id", "pregunta", "idioma")
        .join(per_request, "request_id", "left")
        .withColumn("total", F.when(F.col("eventos").isNull(), 0).otherwise(F.size("eventos")))
        .select(
            "request_id",
            response_text(F.col("total"), F.col("idioma")).alias("respuesta_texto"),
            F.coalesce("eventos", F.array().cast(per_request.schema["eventos"].dataType)).alias(
                "eventos"
            ),
            "total",
            F.col("idioma").alias("idioma_respuesta"),
            F.coalesce(digest(F.col("eventos")), F.lit("")).alias("resumen"),
        )
    )


def debug_info(
    requests: DataFrame, candidates: DataFrame, ranked: DataFrame, catalog: Catalog
) -> DataFrame:
    """For requests with ``debug``: parameters, postcodes looked at and both counts."""
    asking = requests.filter("debug")
    place = asking.select(
        F.col("cp_usuario").alias("cp_origen"),
        F.coalesce("radio_km", F.lit(0)).alias("radio_km"),
    ).distinct()
    around = postcodes_within(place.filter("radio_km > 0"), catalog)
    own = place.filter("radio_km = 0").withColumn("cp", F.col("cp_origen"))
    # nearest first, to the metre, then by code
    code = F.struct(F.round("distancia_km", 3), "cp")
    codes = (
        around.unionByName(own, allowMissingColumns=True)
        .groupBy(F.col("cp_origen").alias("cp_usuario"), F.col("radio_km").alias("_radio"))
        .agg(F.array_sort(F.collect_list(code))["cp"].alias("codigos_postales"))
    )

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("request_id").agg(F.count(F.lit(1)).alias(name))

    parameters = F.struct(
        "idioma",
        "fechas",
        "fecha_inicio",
        "fecha_fin",
        "radio_km",
        "categorias",
        "conceptos",
        "es_gratuito",
        "precio_max",
    )
    before, after = "eventos_pre_filtrado", "eventos_post_semantica"
    return (
        asking.select(
            "request_id",
            "cp_usuario",
            F.coalesce("radio_km", F.lit(0)).alias("_radio"),
            parameters.alias("parametros_extraidos"),
        )
        .join(codes, ["cp_usuario", "_radio"], "left")
        .join(counted(candidates, before), "request_id", "left")
        .join(counted(ranked, after), "request_id", "left")
        .select(
            "request_id",
            "parametros_extraidos",
            F.coalesce("codigos_postales", F.array().cast("array<string>")).alias("codigos_postales"),
            F.size(F.coalesce("codigos_postales", F.array().cast("array<string>"))).alias("num_codigos"),
            F.coalesce(before, F.lit(0)).alias(before),
            F.coalesce(after, F.lit(0)).alias(after),
        )
    )


def write_responses(responses: DataFrame, path: str) -> None:
    """One JSON document per request."""
    responses.write.mode("errorifexists").json(path)
