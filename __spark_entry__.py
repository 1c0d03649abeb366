
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from convoca import schemas
from convoca.functions.text import (
    decode_tags,
    decode_vector,
    embedding_text,
    encode_list,
    full_title,
    padded,
    short_description,
)
from convoca.functions.vectors import norm, usable
from convoca.operators.annotate import annotate
from convoca.operators.earliest import earliest_candidates
from convoca.operators.proximity import refresh_proximity, stored_postcodes_within
from convoca.operators.quality import (
    all_duplicates,
    blockers,
    delete_parents,
    orphans,
    vector_sizes,
    violations,
    with_defaults,
)
from convoca.operators.radius import postcodes_within
from convoca.operators.rank import semantic_rank, with_scores
from convoca.operators.streams import following, open_streams, stored_candidates, write_streams
from convoca.operators.upsert import append_numbered, event_key, insert_missing, resolve_unique, upsert
from convoca.operators.validate import check_requests, parameters_from_json
from convoca.plans import search as S
from convoca.plans.ingest import load_batch, publish_version
from convoca.plans.stored_view import refresh_view, stored_view
from convoca.plans.views import COMPLETE_EVENTS, active_categories, active_events, complete_events, register_views
from convoca.sources.driver_tables import DriverTables, event_id
from convoca.sources.staging import stage, staged_folder
from convoca.sources.versions import create, read_version, resolve

try:
    import corpus_pipeline
    from convoca.llm.queries import ORACLES as LLM_ORACLES
    from convoca.llm.queries import QUERIES

    LLM_QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
except ImportError:
    LLM_QUERIES, LLM_ORACLES = {}, {}

_CANDIDATE = oracles.CANDIDATE_COLUMNS.split(", ")
_PARAMETERS = {
    "fechas": "array<date>",
    "fecha_inicio": "date",
    "fecha_fin": "date",
    "categorias": "array<string>",
    "es_gratuito": "boolean",
    "precio_max": "double",
}


def _only(requests: DataFrame, *kept: str) -> DataFrame:
    """Requests that set no parameter but those named, besides place and language."""
    for name, kind in _PARAMETERS.items():
        if name not in kept:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    return requests


def _earliest(*kept: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = DriverTables(spark, folder)
        found = earliest_candidates(_only(data.requests(), *kept), data.catalog())
        return found.select(*_CANDIDATE)

    return run


def _ranked(data: DriverTables) -> tuple[DataFrame, DataFrame]:
    catalog, requests = data.catalog(), data.requests()
    candidates = stage(earliest_candidates(requests, catalog), "candidatas")
    return candidates, semantic_rank(candidates, requests, catalog)


def active_events_by_start(spark: SparkSession, folder: str) -> DataFrame:
    catalog = DriverTables(spark, folder).catalog()
    spanish = active_events(catalog, "es").withColumn("idioma", F.lit("es"))
    return spanish.unionByName(active_events(catalog, "ca").withColumn("idioma", F.lit("ca")))


def unknown_origin_unfiltered(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    return earliest_candidates(data.unlocated_requests(), data.catalog()).select(*_CANDIDATE)


def postcodes_in_radius(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    origins = data.requests().filter("radio_km > 0").selectExpr("cp_usuario as cp_origen", "radio_km")
    return postcodes_within(origins, data.catalog()).withColumn(
        "distancia_km", F.round("distancia_km", 2)
    )


def origin_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    point = data.codigos_postales().select(F.col("cp").alias("cp_usuario"), "latitud", "longitud")
    return (
        data.requests()
        .select("request_id", "cp_usuario")
        .join(data.catalog().sized(point), "cp_usuario", "left")
    )


def event_distance(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    center = data.codigos_postales().groupBy("id_ciudad").agg(F.min("cp").alias("cp_usuario"))
    rows = data.eventos_master().select("id_unico_evento", "id_ciudad", "cp_evento").join(center, "id_ciudad")
    return S.with_distance(rows, data.catalog()).select(
        "id_unico_evento", "cp_usuario", "distancia_km"
    )


def cosine_scores(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    pairs = data.table("orders").select(
        F.col("o_custkey").alias("request_id"), event_id(F.col("o_orderkey")).alias("id_unico_evento")
    )
    scored = with_scores(pairs, data.located_requests(), data.evento_vectores())
    return scored.select("request_id", "id_unico_evento", F.round("similitud", 3).alias("score"))


def _semantic(reached: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        _, ranked = _ranked(DriverTables(spark, folder))
        hit = F.col("alcanzan") if reached else ~F.col("alcanzan")
        return ranked.filter("semantica").filter(hit).select(
            "request_id",
            F.col("orden").cast("bigint").alias("orden"),
            "id_unico_evento",
            "fecha_inicio",
            F.round("similitud", 3).alias("score"),
        )

    return run


def _search(**options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = DriverTables(spark, folder)
        found = S.search(data.requests(), data.catalog(), **options)
        return found.withColumn("categorias", F.array_join("categorias", ",")).withColumn(
            "tags", F.array_join("tags", ",")
        )

    return run


def _event_text(event):
    """All fields of an event of an answer, amounts as whole numbers."""
    whole = lambda name, times: F.round(event[name] * times).cast("bigint")
    fields = [event[name] for name in oracles.EVENT_FIELDS]
    fields += [F.array_join(event["tags"], ","), F.array_join(event["categorias"], ",")]
    fields += [whole("precio_euros", 100), whole("distancia_km", 100), whole("similitud_score", 1000)]
    return F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("-")) for f in fields])


def search_envelope(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    requests = data.requests()
    answers = S.envelope(S.search(requests, data.catalog()), requests)
    return answers.withColumn("eventos", F.array_join(F.transform("eventos", _event_text), ";"))


def _days(days):
    return F.array_join(F.transform(days, lambda d: F.date_format(d, "yyyy-MM-dd")), ",")


def search_debug(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    candidates, ranked = _ranked(data)
    info = S.debug_info(data.requests(), candidates, ranked, data.catalog())
    return info.select(
        "request_id",
        F.array_join("codigos_postales", ",").alias("codigos_postales"),
        "num_codigos",
        *[
            F.col(f"parametros_extraidos.{name}").alias(name)
            for name in ("idioma", "fecha_inicio", "fecha_fin", "radio_km", "es_gratuito", "precio_max")
        ],
        _days(F.array_distinct("parametros_extraidos.fechas")).alias("fechas"),
        F.array_join("parametros_extraidos.categorias", ",").alias("categorias"),
        embedding_text(F.col("parametros_extraidos.conceptos")).alias("texto_consulta"),
        "eventos_pre_filtrado",
        "eventos_post_semantica",
    )


def complete_events_view(spark: SparkSession, folder: str) -> DataFrame:
    return complete_events(DriverTables(spark, folder).catalog())


def category_catalog(spark: SparkSession, folder: str) -> DataFrame:
    categories = DriverTables(spark, folder).categorias()
    spanish = active_categories(categories, "es", ordered=False).withColumn("idioma", F.lit("es"))
    return spanish.unionByName(
        active_categories(categories, "ca", ordered=False).withColumn("idioma", F.lit("ca"))
    )


def upsert_events(spark: SparkSession, folder: str) -> DataFrame:
    """Two thirds of the events are known; all are loaded, even ones twice."""
    data = DriverTables(spark, folder)
    number = F.substring("titulo_es", 8, 30).cast("bigint")
    events = data.eventos_master().withColumn("clave", number)
    target = events.filter("clave % 3 <> 0").drop("clave")
    first = events.withColumn("seq", F.lit(1)).withColumn(
        "titulo_es", F.concat(F.lit("Nuevo "), F.col("clave").cast("string"))
    )
    again = (
        events.filter("clave % 2 = 0")
        .withColumn("seq", F.lit(2))
        .withColumn("titulo_es", F.concat(F.lit("Otro "), F.col("clave").cast("string")))
        .withColumn("precio_euros", F.lit(1.5))
    )
    batch = first.unionByName(again).withColumn("titulo_cat", F.lit("Nou")).drop("clave")
    loaded = upsert(target, batch, ["id_unico_evento"], ["titulo_es"], "seq")
    return loaded.select("id_unico_evento", "titulo_es", "titulo_cat", "precio_euros", "estado")


def upsert_postcodes(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    target = data.codigos_postales()
    moved = target.select(
        "cp", F.lit(-1).alias("id_ciudad"), (F.col("latitud") + 0.5).alias("latitud"), "longitud"
    )
    new = data.table("supplier").select(
        F.concat(F.lit("n"), padded(F.col("s_suppkey"), 4)).alias("cp"),
        F.col("s_nationkey").alias("id_ciudad"),
        F.lit(41.5).alias("latitud"),
        F.lit(2.5).alias("longitud"),
    )
    batch = moved.unionByName(new).withColumn("seq", F.lit(1))
    return upsert(target, batch, ["cp"], ["latitud", "longitud"], "seq")


def upsert_cities(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers name cities anew, with ids the table lacks; the names are taken or repeat."""
    data = DriverTables(spark, folder)
    target = data.ciudades()
    batch = data.table("supplier").select(
        (F.col("s_suppkey") + 1000).cast("int").alias("id_ciudad"),
        F.when(
            F.col("s_suppkey") % 2 == 0, F.concat(F.lit("nátion_"), F.col("s_nationkey").cast("string"))
        )
        .otherwise(F.concat(F.lit("Villa "), (F.col("s_suppkey") % 9).cast("string")))
        .alias("nombre"),
        F.lit("NUEVA").alias("provincia"),
        F.col("s_suppkey").alias("seq"),
    )
    batch = resolve_unique(target, batch, "id_ciudad", "nombre", "seq")
    return upsert(target, batch, ["id_ciudad"], ["nombre"], "seq")


def insert_missing_event_categories(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    target = data.evento_categorias().filter("id_categoria % 2 = 0")
    kind = data.table("part").select("p_partkey", F.col("p_type").alias("nombre_es"))
    number = data.categorias().select("nombre_es", "id_categoria")
    batch = (
        data.table("lineitem")
        .join(kind.join(number, "nombre_es"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            event_id(F.col("l_orderkey")).alias("id_unico_evento"),
            "id_categoria",
            F.col("l_linenumber").alias("seq"),
        )
    )
    return insert_missing(target, batch, ["id_unico_evento", "id_categoria"], "seq")


def append_schedules(spark: SparkSession, folder: str) -> DataFrame:
    target = DriverTables(spark, folder).evento_horarios()
    batch = target.drop("id_horario").withColumn("fecha_inicio", F.date_add("fecha_inicio", 364))
    return append_numbered(target, batch, "id_horario")


def left_out_rows(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    _, ranked = _ranked(data)
    rows = S.left_out(ranked, data.requests(), data.catalog())
    return rows.withColumn("orden", F.col("orden").cast("bigint"))


def event_texts(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    names = data.categorias().select("id_categoria", "nombre_es", "nombre_cat")
    return (
        data.evento_categorias()
        .join(data.catalog().sized(names, of="categories"), "id_categoria")
        .join(data.eventos_master(), "id_unico_evento")
        .select(
            "id_unico_evento",
            "id_categoria",
            full_title(F.col("titulo_es"), F.col("poblacion_nombre")).alias("titulo"),
            short_description("es", F.col("nombre_es"), F.col("poblacion_nombre")).alias("desc_es"),
            short_description("ca", F.col("nombre_cat"), F.col("poblacion_nombre")).alias("desc_cat"),
        )
    )


def event_keys(spark: SparkSession, folder: str) -> DataFrame:
    later = F.date_add("fecha_creacion", 60)
    return DriverTables(spark, folder).eventos_master().select(
        "id_unico_evento",
        event_key(F.col("titulo_es"), F.col("fecha_creacion"), F.col("id_ciudad")).alias("clave"),
        event_key(F.col("titulo_es"), later, F.col("id_ciudad")).alias("clave_posterior"),
        F.date_format(later, "yyyy-MM-dd").alias("fecha_posterior"),
    )


def tags_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    events = DriverTables(spark, folder).eventos_master()

    def decoded(name: str) -> DataFrame:
        tags = decode_tags(events, f"tags_{name}")
        return events.select(
            "id_unico_evento",
            F.lit(name).alias("idioma"),
            tags.isNotNull().alias("convertible"),
            F.when(tags.isNotNull(), F.size(tags)).alias("num_tags"),
            encode_list(tags).alias("tags_json"),
        )

    return decoded("es").unionByName(decoded("cat"))


def json_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors kept as JSON text: some absent, cut short, or of something else than numbers."""
    vectors = DriverTables(spark, folder).table("embeddings")
    number = F.col("vec_id")
    text = F.to_json(F.col("embedding").cast("array<double>"))
    stored = vectors.select(
        "vec_id",
        F.when(number % 7 == 1, F.substring(text, 1, 20))
        .when(number % 7 == 2, F.lit('{"a":1}'))
        .when(number % 7 == 3, F.lit(None).cast("string"))
        .when(number % 7 == 4, F.lit("[1.0,null,2.0]"))
        .otherwise(text)
        .alias("texto"),
    )
    vector = usable(decode_vector(stored, "texto"))
    return stored.select("vec_id", F.size(vector).alias("dimension"), F.round(norm(vector), 3).alias("norma"))


def _twice(df: DataFrame, again) -> DataFrame:
    return df.unionByName(df.filter(again))


def _damaged(data: DriverTables) -> dict[str, DataFrame]:
    """Tables with missing parents, repeated rows, NULLs and foreign values."""
    number = F.substring("titulo_es", 8, 30).cast("bigint")
    events = data.eventos_master().withColumn("clave", number).filter("clave % 13 <> 0")
    key = F.col("clave")
    events = _twice(events, "clave % 7 = 0").select(
        "id_unico_evento",
        F.when(key % 41 == 0, "ROBOT").otherwise(F.col("metodo_ingesta")).alias("metodo_ingesta"),
        F.when(key % 43 == 0, "OTRA").otherwise(F.col("fuente_id")).alias("fuente_id"),
        F.when(key % 19 == 0, "BORRADOR").otherwise(F.col("estado")).alias("estado"),
        F.when(key % 47 == 0, "NADIE").when(key % 3 == 0, "PUBLICO").when(key % 3 == 1, "PRIVADO").alias(
            "tipo_organizador"
        ),
        F.when(key % 23 != 0, F.col("cp_evento")).alias("cp_evento"),
        "id_ciudad",
        "id_familia",
        "poblacion_nombre",
        "es_gratuito",
        F.when(key % 29 != 0, F.col("titulo_es")).alias("titulo_es"),
    )
    audit = data.auditoria_scraping().withColumn(
        "resultado",
        F.when(F.col("id_auditoria") % 31 == 0, "FATAL").otherwise(F.col("resultado")),
    )
    kind = data.table("part").select("p_partkey", F.col("p_type").alias("nombre_es"))
    numbers = data.categorias().select("nombre_es", "id_categoria")
    repeated = (
        data.table("lineitem")
        .join(kind.join(numbers, "nombre_es"), F.col("l_partkey") == F.col("p_partkey"))
        .select(event_id(F.col("l_orderkey")).alias("id_unico_evento"), "id_categoria")
    )
    # the same names in another spelling, under other numbers
    cities = data.ciudades().filter("id_ciudad % 6 <> 0")
    other = cities.filter("id_ciudad % 4 = 1").withColumns(
        {"id_ciudad": F.col("id_ciudad") + 100, "nombre": F.translate(F.lower("nombre"), "a", "á")}
    )
    categories = data.categorias().filter("id_categoria <> 2")
    shouted = categories.filter("id_categoria % 3 = 0").withColumns(
        {"id_categoria": F.col("id_categoria") + 100, "slug": F.upper("slug")}
    )
    return {
        "ciudades": cities.unionByName(other),
        "codigos_postales": _twice(data.codigos_postales(), "cast(cp as bigint) % 9 = 0"),
        "categorias": categories.unionByName(shouted),
        "fuentes_familia": _twice(data.fuentes_familia(), "cast(id_familia as bigint) % 4 = 0"),
        "eventos_master": events,
        "evento_categorias": repeated,
        "evento_horarios": _twice(data.evento_horarios(), "id_horario % 11 = 0"),
        "binarios_storage": _twice(data.binarios_storage(), "id_binario % 5 = 0"),
        "auditoria_scraping": _twice(audit, "id_auditoria % 37 = 0"),
    }


def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(_damaged(DriverTables(spark, folder)))


def key_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return all_duplicates(_damaged(DriverTables(spark, folder)))


def null_and_enum_violations(spark: SparkSession, folder: str) -> DataFrame:
    tables = _damaged(DriverTables(spark, folder))
    return reduce(DataFrame.unionByName, [violations(df, name) for name, df in tables.items()])


def _after_delete(data: DriverTables, *names: str) -> dict[str, DataFrame]:
    tables = {name: getattr(data, name)() for name in ("eventos_master", *names)}
    cancelled = tables["eventos_master"].filter("estado = 'CANCELADO'").select("id_unico_evento")
    return delete_parents(tables, "eventos_master", cancelled)


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    left = _after_delete(DriverTables(spark, folder), "evento_horarios", "evento_categorias")
    schedules = left["evento_horarios"].select(
        F.lit("evento_horarios").alias("tabla"), "id_unico_evento", F.col("id_horario").alias("id")
    )
    pairs = left["evento_categorias"].select(
        F.lit("evento_categorias").alias("tabla"),
        "id_unico_evento",
        F.col("id_categoria").cast("bigint").alias("id"),
    )
    return schedules.unionByName(pairs)


def set_null_delete(spark: SparkSession, folder: str) -> DataFrame:
    left = _after_delete(DriverTables(spark, folder), "auditoria_scraping")
    return left["auditoria_scraping"].select("id_auditoria", "id_unico_evento", "resultado")


def restricted_delete(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    tables = {
        name: getattr(data, name)()
        for name in (
            "ciudades", "codigos_postales", "fuentes_familia", "categorias", "eventos_master", "evento_categorias"
        )
    }
    deleted = {
        "ciudades": "provincia = 'ASIA'",
        "codigos_postales": "cast(cp as bigint) % 10 = 7",
        "fuentes_familia": "cast(id_familia as bigint) % 5 = 0",
        "categorias": "id_categoria = 1",
    }
    held = [
        blockers(tables, name, tables[name].filter(which)).withColumn("padre", F.lit(name))
        for name, which in deleted.items()
    ]
    return reduce(DataFrame.unionByName, held)


def column_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that have a default, some NULL and some absent, as they are stored."""
    data = DriverTables(spark, folder)
    tables = {
        "categorias": data.categorias().drop("activo").withColumn("orden", F.when(F.col("id_categoria") % 2 == 0, F.col("orden"))),
        "eventos_master": data.eventos_master()
        .drop("fecha_creacion")
        .withColumn("estado", F.when(F.col("estado") != "ACTIVO", F.col("estado"))),
        "evento_horarios": data.evento_horarios(),
        "binarios_storage": data.binarios_storage().withColumn(
            "fecha_sincronizacion", F.when(F.col("id_binario") % 2 == 0, F.col("fecha_sincronizacion"))
        ),
        "auditoria_scraping": data.auditoria_scraping().withColumn(
            "resultado", F.when(F.col("resultado") != "WARNING", F.col("resultado"))
        ),
    }
    shown = {
        "categorias": ["orden", "activo"],
        "eventos_master": ["estado", "es_patrocinado"],
        "evento_horarios": ["es_recurrente"],
        "binarios_storage": [],
        "auditoria_scraping": ["resultado"],
    }
    stamps = {"eventos_master": "fecha_creacion", "binarios_storage": "fecha_sincronizacion", "auditoria_scraping": "fecha_ejecucion"}
    out = []
    for name, df in tables.items():
        filled = with_defaults(df, name)
        values = [F.col(c).cast("string") for c in shown[name]]
        # a load time has no fixed value
        values += [F.col(stamps[name]).isNotNull().cast("string")] if name in stamps else []
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in schemas.PRIMARY_KEYS[name]])
        out.append(filled.select(F.lit(name).alias("tabla"), key.alias("clave"), F.concat_ws("/", *values).alias("valores")))
    return reduce(DataFrame.unionByName, out)


def embedding_dimension(spark: SparkSession, folder: str) -> DataFrame:
    vectors = DriverTables(spark, folder).evento_vectores()
    sizes = [
        vector_sizes(vectors, name, 64).withColumn("columna", F.lit(name))
        for name in ("tags_embedding_es", "tags_embedding_cat")
    ]
    return sizes[0].unionByName(sizes[1])


def upsert_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the categories come again under other numbers: their slug says which they are."""
    target = DriverTables(spark, folder).categorias()
    again = target.filter("id_categoria % 2 = 0").select(
        (F.col("id_categoria") + 1000).alias("id_categoria"),
        F.concat("nombre_es", F.lit(" nuevo")).alias("nombre_es"),
        F.lit("nou").alias("nombre_cat"),
        F.upper("slug").alias("slug"),
        F.lit(99).alias("orden"),
        F.lit(False).alias("activo"),
        F.lit(1).alias("seq"),
    )
    other = target.filter("id_categoria = 1").select(
        F.lit(500).alias("id_categoria"), F.lit("Otra").alias("nombre_es"), F.lit("Altra").alias("nombre_cat"),
        F.lit("otra").alias("slug"), "orden", F.lit(True).alias("activo"), F.lit(2).alias("seq"),
    )
    batch = resolve_unique(target, again.unionByName(other), "id_categoria", "slug", "seq")
    return upsert(target, batch, ["id_categoria"], schemas.UPSERT_UPDATES["categorias"], "seq")


def _batch_for_all(data: DriverTables) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """All nine tables, and a batch for each: changed rows and new ones, appended rows for the numbered tables."""
    tables = {name: getattr(data, name)() for name in schemas.TABLES}
    seq = F.lit(1).alias("seq")
    text = lambda start, column: F.concat(F.lit(start), F.col(column).cast("string"))
    region = data.table("region")
    cities = tables["ciudades"].filter("id_ciudad % 3 = 0").withColumn("nombre", F.concat("nombre", F.lit(" nova")))
    new_cities = region.select((F.col("r_regionkey") + 900).alias("id_ciudad"), text("Regió ", "r_name").alias("nombre"), F.col("r_name").alias("provincia"))
    moved = tables["codigos_postales"].withColumn("latitud", F.col("latitud") + 0.5).withColumn("id_ciudad", F.lit(-1))
    new_codes = data.table("supplier").select(
        F.concat(F.lit("n"), padded(F.col("s_suppkey"), 4)).alias("cp"), F.col("s_nationkey").alias("id_ciudad"),
        F.lit(41.5).alias("latitud"), F.lit(2.5).alias("longitud"),
    )
    events = tables["eventos_master"].withColumn("clave", F.substring("titulo_es", 8, 30).cast("bigint"))
    new_id = F.sha2(text("nova-", "clave"), 256)
    fresh = events.filter("clave % 10 = 3").withColumns(
        {"id_unico_evento": new_id, "titulo_es": text("Nova ", "clave"), "id_familia": F.lit(None).cast("string")}
    )
    changed = events.filter("clave % 4 = 1").withColumns({"titulo_es": text("Nou ", "clave"), "precio_euros": F.lit(1.5)})
    own = events.select("id_unico_evento")
    batch = {
        "ciudades": cities.unionByName(new_cities),
        "codigos_postales": moved.unionByName(new_codes),
        "categorias": tables["categorias"].withColumns({c: F.concat(c, F.lit(" nou")) for c in ("nombre_es", "nombre_cat")}),
        "fuentes_familia": tables["fuentes_familia"].withColumn("id_familia", F.concat(F.lit("n"), "id_familia")),
        "eventos_master": changed.unionByName(fresh).drop("clave"),
        "evento_categorias": tables["evento_categorias"].unionByName(fresh.select("id_unico_evento", F.lit(1).alias("id_categoria"))),
        "evento_horarios": tables["evento_horarios"].filter("substring(id_unico_evento, 1, 1) < '4'").withColumn(
            "fecha_inicio", F.date_add("fecha_inicio", 364)
        ),
        "binarios_storage": tables["binarios_storage"].join(own, "id_unico_evento", "left_semi"),
        "auditoria_scraping": tables["auditoria_scraping"].join(own, "id_unico_evento", "left_semi"),
    }
    return tables, {name: rows.select("*", seq) for name, rows in batch.items()}


def _folded_sum(values):
    """Sum of whole numbers, modulo 2**63: a plain sum stops the job where it passes a bigint, here after some 16 million rows."""
    high, low = F.sum(F.shiftright(values, 20)), F.sum(values.bitwiseAND(F.lit(2**20 - 1)))
    whole = high.cast("decimal(28,0)") * F.lit(2**20).cast("decimal(8,0)") + low.cast("decimal(20,0)")
    return (whole % F.lit(str(2**63)).cast("decimal(19,0)")).cast("bigint")


def _fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows, the largest generated id, and a sum of hashes over the columns of every row."""
    out = []
    for name, columns in oracles.LOADED.items():
        texts = [F.coalesce(F.expr(c).cast("string"), F.lit("-")) for c in columns]
        digest = F.conv(F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 10), 16, 10).cast("bigint")
        top = F.max(oracles.GENERATED[name]) if name in oracles.GENERATED else F.lit(None)
        out.append(
            tables[name].agg(
                F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("filas"), top.cast("bigint").alias("mayor"), _folded_sum(digest).alias("huella")
            )
        )
    return reduce(DataFrame.unionByName, out)


def load_batch_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A batch of rows for every table, loaded into snapshots."""
    tables, batch = _batch_for_all(DriverTables(spark, folder))
    return _fingerprints(load_batch(tables, batch))


def published_load(spark: SparkSession, folder: str) -> DataFrame:
    """The same batch published as version 2 of a stored catalog, read from its files."""
    tables, batch = _batch_for_all(DriverTables(spark, folder))
    place = staged_folder(spark, "versiones")
    create(spark, place, tables, cubos=8)
    publish_version(spark, place, batch)
    version = resolve(spark, place)
    return _fingerprints({name: read_version(spark, version, name) for name in version.tables})


def refreshed_view(spark: SparkSession, folder: str) -> DataFrame:
    """The stored view after a batch of few changes: events, schedules, pairs, a category and some postcodes."""
    tables, batch = _batch_for_all(DriverTables(spark, folder))
    clave = F.regexp_extract("titulo_es", "[0-9]+$", 0).cast("bigint")
    few = {
        "codigos_postales": batch["codigos_postales"].filter("cp like '%7'"),
        "categorias": batch["categorias"].filter("id_categoria = 2"),
        "eventos_master": batch["eventos_master"].filter(clave % 20 == 13),
        "evento_categorias": batch["evento_categorias"].join(
            batch["eventos_master"].filter(clave % 20 == 13).select("id_unico_evento"), "id_unico_evento", "left_semi"
        ),
        "evento_horarios": batch["evento_horarios"].filter("substring(id_unico_evento, 1, 2) < '08'"),
    }
    place = staged_folder(spark, "versiones")
    create(spark, place, tables, cubos=8)
    refresh_view(spark, place)
    publish_version(spark, place, few)
    return stored_view(spark, refresh_view(spark, place)).select(*oracles.VIEW_COLUMNS)


def stored_postcodes_in_radius(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of all requests' postcodes, from a stored table: built with some codes elsewhere, then refreshed."""
    data = DriverTables(spark, folder)
    codes = data.codigos_postales()
    elsewhere = codes.withColumn("latitud", F.when(F.col("cp").like("%3"), F.col("latitud") + 0.25).otherwise(F.col("latitud")))
    place = staged_folder(spark, "versiones")
    create(spark, place, {"ciudades": data.ciudades(), "codigos_postales": elsewhere}, cubos=8)
    refresh_proximity(spark, place)
    publish_version(spark, place, {"codigos_postales": codes.filter("cp like '%3'").withColumn("seq", F.lit(1))})
    version = refresh_proximity(spark, place)
    origins = data.requests().filter("radio_km > 0").selectExpr("cp_usuario as cp_origen", "radio_km")
    return stored_postcodes_within(origins, version).withColumn("distancia_km", F.round("distancia_km", 2))


def stored_stream_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest candidates of all requests, read from stored streams."""
    data = DriverTables(spark, folder)
    catalog, place = data.catalog(), staged_folder(spark, "flujos")
    write_streams(catalog, place, cubos=32)
    return stored_candidates(data.requests(), catalog, open_streams(spark, place)).select(*_CANDIDATE)


def paged_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 earliest candidates of all requests in two pages, the second behind the last row of the first."""
    data = DriverTables(spark, folder)
    catalog, requests, place = data.catalog(), data.requests(), staged_folder(spark, "flujos")
    write_streams(catalog, place, cubos=32)
    streams = open_streams(spark, place)
    first = stage(stored_candidates(requests, catalog, streams, 30), "pagina")
    second = stored_candidates(following(requests, first, 30), catalog, streams, 20)
    return first.unionByName(second.withColumn("posicion", F.col("posicion") + 30)).select(*_CANDIDATE)


def events_view_by_town(spark: SparkSession, folder: str) -> DataFrame:
    """The view of complete events, asked in SQL."""
    register_views(DriverTables(spark, folder).catalog())
    return spark.sql(
        f"""SELECT poblacion_nombre, categorias_slugs, count(*) AS filas, min(fecha_inicio) AS primera
        FROM {COMPLETE_EVENTS} WHERE es_gratuito GROUP BY poblacion_nombre, categorias_slugs"""
    )


def events_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return DriverTables(spark, folder).eventos_master().agg(F.count(F.lit(1)).alias("total"))


def request_validation(spark: SparkSession, folder: str) -> DataFrame:
    turns = DriverTables(spark, folder).table("conversations")
    code = padded(F.col("conv_id"), 5)
    place = (
        F.when(F.col("conv_id") % 7 == 1, F.substring(code, 3, 3))
        .when(F.col("conv_id") % 7 == 2, F.concat(code, F.lit("\n")))
        .when(F.col("conv_id") % 7 == 3, F.concat(F.lit("x"), F.substring(code, 2, 4)))
        .when(F.col("conv_id") % 21 != 4, code)
    )
    question = (
        F.when(F.col("turn") % 5 == 1, F.substring("text", 1, 2))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit("  \t"), F.col("text"), F.lit(" \n ")))
        .when(F.col("turn") % 5 == 3, F.lit("    \n"))
        .when(F.col("conv_id") % 11 != 5, F.col("text"))
    )
    rows = turns.select(
        "conv_id", "turn", question.alias("pregunta"), place.alias("cp_usuario")
    )
    return check_requests(rows)


def parameter_validation(spark: SparkSession, folder: str) -> DataFrame:
    turns = DriverTables(spark, folder).table("conversations")
    c = F.col("conv_id")
    given = F.format_string(
        '{"idioma":"%s","radio_km":%d,"categorias":["Música","x%d"],"fecha_inicio":"2024-05-%02d","es_gratuito":%s,"precio_max":%d.5}',
        F.when(c % 2 == 0, "es").otherwise("ca"),
        c % 130,
        c % 3,
        c % 28 + 1,
        F.when(c % 3 == 0, "true").otherwise("null"),
        c % 40 - 5,
    )
    odd = F.array(*[F.lit(text) for text in oracles.ODD_PARAMETERS])
    content = (
        F.when(c % 18 < 7, given)
        .when(c % 18 == 7, F.lit('{"radio_km":5}'))
        .when(c % 18 == 8, F.substring(given, 1, 30))
        .otherwise(F.get(odd, (c % 18 - 9).cast("int")))
    )
    rows = turns.select("conv_id", "turn", F.col("text").alias("pregunta"), content.alias("json"))
    typed = parameters_from_json(rows, "json")
    return typed.drop("pregunta", "json", "fechas").withColumn(
        "categorias", F.array_join("categorias", ",")
    ).withColumn("conceptos", F.array_join("conceptos", ","))


def annotate_questions(spark: SparkSession, folder: str) -> DataFrame:
    data = DriverTables(spark, folder)
    endings = F.array(*[F.lit(e) for e in oracles.QUESTION_ENDINGS])
    c = F.col("conv_id")
    ending = F.element_at(endings, ((c + F.col("turn")) % len(oracles.QUESTION_ENDINGS) + 1).cast("int"))
    rows = data.table("conversations").select(
        "conv_id",
        "turn",
        F.concat("text", F.lit(" "), ending).alias("pregunta"),
        F.date_add(F.lit("2024-01-01").cast("date"), (c % 7).cast("int")).alias("as_of"),
    )
    days = _days("fechas")
    return (
        annotate(rows, data.categorias())
        .withColumn("fechas", days)
        .withColumn("categorias", F.array_join("categorias", ","))
        .withColumn("conceptos", F.array_join("conceptos", ","))
        .drop("pregunta")
    )


def entry(spark: SparkSession) -> DataFrame:
    data = DriverTables(spark, "/root/testdata/sf0.001")
    return S.search(data.requests(), data.catalog())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "active_events_by_start": active_events_by_start,
        "batch_prefilter_top50": _earliest(*_PARAMETERS),
        "unknown_origin_unfiltered": unknown_origin_unfiltered,
        "postcodes_in_radius": postcodes_in_radius,
        "origin_coordinates": origin_coordinates,
        "event_distance": event_distance,
        "category_semi_join": _earliest("categorias"),
        "date_list_filter": _earliest("fechas"),
        "date_range_filter": _earliest("fecha_inicio", "fecha_fin"),
        "price_filters": _earliest("es_gratuito", "precio_max"),
        "cosine_scores": cosine_scores,
        "semantic_threshold": _semantic(True),
        "semantic_fallback_top10": _semantic(False),
        "search_results": _search(),
        "search_results_categories": _search(
            with_categories=True, zero_distance_null=True, short_hours=True
        ),
        "search_envelope": search_envelope,
        "search_debug": search_debug,
        "complete_events_view": complete_events_view,
        "category_catalog": category_catalog,
        "upsert_events": upsert_events,
        "upsert_postcodes": upsert_postcodes,
        "upsert_cities": upsert_cities,
        "insert_missing_event_categories": insert_missing_event_categories,
        "append_schedules": append_schedules,
        "event_keys": event_keys,
        "event_texts": event_texts,
        "left_out_rows": left_out_rows,
        "events_loaded": events_loaded,
        "tags_json_roundtrip": tags_json_roundtrip,
        "fk_orphans": fk_orphans,
        "key_duplicates": key_duplicates,
        "null_and_enum_violations": null_and_enum_violations,
        "cascade_delete": cascade_delete,
        "set_null_delete": set_null_delete,
        "restricted_delete": restricted_delete,
        "column_defaults": column_defaults,
        "embedding_dimension": embedding_dimension,
        "request_validation": request_validation,
        "parameter_validation": parameter_validation,
        "annotate_questions": annotate_questions,
        "json_vectors": json_vectors,
        "upsert_categories": upsert_categories,
        "load_batch_tables": load_batch_tables,
        "published_load": published_load,
        "stored_postcodes_in_radius": stored_postcodes_in_radius,
        "refreshed_view": refreshed_view,
        "stored_stream_candidates": stored_stream_candidates,
        "paged_candidates": paged_candidates,
        "events_view_by_town": events_view_by_town,
        **LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {**oracles.statements(), **LLM_ORACLES}
