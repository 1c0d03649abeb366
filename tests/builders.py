"""Small tables for tests."""

import datetime as dt

from convoca import schemas
from convoca.sources.catalog import Catalog
from convoca.sources.seeds import seed_categories

# --- fixed values: five towns of the coast
TOWNS = [
    ("08380", "Malgrat de Mar", 41.6462, 2.7411),
    ("08370", "Calella", 41.6151, 2.6600),
    ("08360", "Canet de Mar", 41.5905, 2.5805),
    ("08397", "Pineda de Mar", 41.6275, 2.6931),
    ("17300", "Blanes", 41.6751, 2.7928),
]

EVENT = (
    "id_unico_evento string, estado string, cp_evento string, poblacion_nombre string, "
    "lugar_nombre string, direccion_fisica string, titulo_es string, titulo_cat string, "
    "desc_larga_es string, desc_larga_cat string, tags_es string, tags_cat string, "
    "tags_embedding_es string, tags_embedding_cat string, es_gratuito boolean, "
    "precio_euros decimal(10,2), link_entradas_inscripcion string, imagen_principal_url string"
)
SLOT = (
    "id_horario bigint, id_unico_evento string, fecha_inicio date, fecha_fin date, "
    "hora_inicio string, hora_fin string"
)


def day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(days=n)


def event(key, cp="08380", free=True, price=None, **changed):
    names = {c: t for c, t, _, _ in TOWNS}
    row = {
        "id_unico_evento": key,
        "estado": "ACTIVO",
        "cp_evento": cp,
        "poblacion_nombre": names.get(cp, "Pueblo"),
        "lugar_nombre": "Plaza",
        "titulo_es": f"Evento {key}",
        "titulo_cat": f"Esdeveniment {key}",
        "desc_larga_es": f"Largo {key}",
        "desc_larga_cat": f"Llarg {key}",
        "tags_es": '["#uno","#dos"]',
        "tags_cat": '["#u","#dos"]',
        "es_gratuito": free,
        "precio_euros": price,
    }
    row.update(changed)
    return row


def table(spark, rows, ddl):
    names = [part.strip().split(" ")[0] for part in ddl.replace("(10,2)", "").split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def catalog(spark, events, slots, pairs=(), postcodes=None):
    places = [(cp, lat, lng) for cp, _, lat, lng in TOWNS] if postcodes is None else postcodes
    return Catalog(
        events=table(spark, events, EVENT),
        schedules=spark.createDataFrame([(i, *slot) for i, slot in enumerate(slots)], SLOT),
        postcodes=spark.createDataFrame(places, "cp string, latitud double, longitud double"),
        categories=seed_categories(spark),
        event_categories=spark.createDataFrame(
            list(pairs), "id_unico_evento string, id_categoria int"
        ),
    )


def request(request_id, cp="08380", **parameters):
    row = {
        "request_id": request_id,
        "pregunta": "¿Qué hay?",
        "cp_usuario": cp,
        "debug": False,
        "idioma": "es",
        "categorias": [],
        "conceptos": [],
    }
    row.update(parameters)
    return row


def requests(spark, rows):
    names = schemas.REQUESTS.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.REQUESTS)
