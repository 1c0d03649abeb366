import json

import pytest
from pyspark.sql import functions as F

from builders import catalog, day, event, request, requests
from convoca.operators.rank import best, semantic_rank
from convoca.plans import search as S
from convoca.plans.views import active_categories, complete_events, register_views

AXIS = [1.0, 0.0]


def at(cosine):
    """A unit vector with this cosine to the first axis, as JSON."""
    return json.dumps([cosine, (1 - cosine * cosine) ** 0.5])


@pytest.fixture(scope="module")
def world(spark):
    events = [
        event("a", tags_embedding_es=at(0.9), tags_embedding_cat=at(0.1)),
        event("b", tags_embedding_es="[3,4]", free=False),
        event("c", tags_embedding_es=at(0.59)),
        event("d", tags_es="null", tags_embedding_es=at(0.95)),
        event("e", tags_es="", tags_cat=None, tags_embedding_es="bad"),
        event("f", "08397", titulo_cat=None),
        event("g", "08397", estado="APLAZADO"),
        event("h", "08397", tags_embedding_es="[]"),
    ]
    slots = [
        ("a", day(3), day(4), "09:00:00", "00:00:00"),
        ("a", day(1), None, None, None),
        ("a", day(1), None, None, None),
        ("b", day(2), None, "00:00:00", None),
        ("c", day(5), None, "10:00:00", None),
        ("d", day(6), None, "10:00:00", None),
        ("e", day(7), None, "10:00:00", None),
        ("f", day(0), None, "10:00:00", None),
        ("g", day(0), None, "10:00:00", None),
        ("h", day(8), None, "10:00:00", None),
    ]
    pairs = [("a", 7), ("a", 1), ("b", 2)]
    return catalog(spark, events, slots, pairs)


def test_search_end_to_end(spark, world):
    asked = requests(
        spark,
        [
            request(1, conceptos=["x"], query_embedding=AXIS, debug=True),
            request(2, radio_km=5, idioma="ca"),
            request(3, "08360", idioma="ca", conceptos=["x"], query_embedding=AXIS),
            request(4, "08397", conceptos=["x"], query_embedding=AXIS, debug=True),
            request(5, "77777", conceptos=[], debug=True, radio_km=20),
            request(6, "08360"),
        ],
    )
    found = S.search(asked, world, with_categories=True)
    rows = {}
    for r in found.orderBy("request_id", "rank").collect():
        rows.setdefault(r.request_id, []).append(r)

    # threshold reached: 0.9 twice (two schedules, earliest first), 0.6 is kept, 0.59 is not;
    # the best one is dropped because its tags are no list
    first = rows[1]
    assert [(r["rank"], r.id_unico_evento, r.similitud_score) for r in first] == [
        (1, "a", 0.9),
        (2, "a", 0.9),
        (3, "b", 0.6),
    ]
    assert [r.fecha_inicio for r in first[:2]] == [day(1), day(3)]
    assert first[0].titulo == "Evento a"
    assert first[0].descripcion_corta == first[0].descripcion_larga == "Largo a"
    assert first[0].categorias == ["Cultura", "Música"] and first[2].categorias == ["Deportes"]
    assert first[0].tags == ["#uno", "#dos"]
    # midnight counts as no hour, a price that is absent stays absent, own postcode is at 0 km
    assert first[1].hora_inicio == "09:00:00" and first[1].hora_fin is None
    assert first[2].hora_inicio is None and first[2].precio_euros is None
    assert first[0].distancia_km == 0.0 and first[0].es_gratuito and not first[2].es_gratuito

    # no concepts: by start, score 0; the event without a Catalan title is left out
    second = rows[2]
    assert [r.id_unico_evento for r in second] == ["a", "b", "a", "c", "d", "e", "h"]
    assert {r.similitud_score for r in second} == {0.0}
    assert second[0].titulo == "Esdeveniment a" and second[5].tags == []
    assert second[6].distancia_km == 4.5

    assert 3 not in rows
    # nothing reaches 0.6: a missing vector (0.3) comes before an empty one (0.0)
    assert [(r.id_unico_evento, r.similitud_score) for r in rows[4]] == [("f", 0.3), ("h", 0.0)]
    # unknown origin with a radius: everywhere, without distance
    assert {r.cp_evento for r in rows[5]} == {"08380", "08397"}
    assert {r.distancia_km for r in rows[5]} == {None}

    answers = {r.request_id: r for r in S.envelope(found, asked).collect()}
    assert answers[1].total == 3 and answers[1].respuesta_texto == "He encontrado 3 eventos para ti."
    assert answers[2].respuesta_texto == "He trobat 7 esdeveniments per a tu."
    assert answers[3].respuesta_texto.startswith("Ho sento") and answers[3].eventos == []
    assert answers[6].respuesta_texto.startswith("Lo siento") and answers[6].total == 0
    assert [e.id_unico_evento for e in answers[1].eventos] == ["a", "a", "b"]
    assert answers[1].resumen.split("\n") == [
        "1. Evento a - Malgrat de Mar (2025-01-02) [GRATUITO]",
        "2. Evento a - Malgrat de Mar (2025-01-04) [GRATUITO]",
        "3. Evento b - Malgrat de Mar (2025-01-03)",
    ]
    assert len(answers[2].resumen.split("\n")) == 5 and answers[3].resumen == ""


def test_debug_counts_and_options(spark, world):
    asked = requests(
        spark,
        [
            request(1, conceptos=["x"], query_embedding=AXIS, debug=True),
            request(2, radio_km=5, debug=True),
            request(3, debug=False),
            request(4, "08360", debug=True),
            request(5, "77777", radio_km=9, debug=True),
        ],
    )
    candidates = S.stage(S.earliest_candidates(asked, world), "candidatas")
    ranked = semantic_rank(candidates, asked, world)
    info = {r.request_id: r for r in S.debug_info(asked, candidates, ranked, world).collect()}
    assert set(info) == {1, 2, 4, 5}
    assert info[1].codigos_postales == ["08380"]
    assert (info[1].eventos_pre_filtrado, info[1].eventos_post_semantica) == (6, 4)
    assert info[2].codigos_postales == ["08380", "08397"] and info[2].num_codigos == 2
    assert (info[4].eventos_pre_filtrado, info[4].eventos_post_semantica) == (0, 0)
    assert info[5].codigos_postales == [] and info[5].eventos_pre_filtrado == 8
    assert info[1].parametros_extraidos.conceptos == ["x"]

    lost = S.left_out(ranked, asked, world).collect()
    assert {(r.request_id, r.id_unico_evento) for r in lost} == {(n, "d") for n in (1, 2, 3, 5)}

    out = S.results(ranked, asked, world, zero_distance_null=True, short_hours=True)
    rows = out.filter("request_id = 1").orderBy("rank").collect()
    assert [r.hora_inicio for r in rows] == [None, "9:00:00", None]
    assert {r.distancia_km for r in rows} == {None} and rows[0].categorias == []


def test_fallback_keeps_the_best_ten(spark):
    rows = [(1, i, True, s) for i, s in enumerate([0.1] * 6 + [0.3, 0.59, 0.2, 0.2, 0.05, 0.3], 1)]
    rows += [(2, 1, True, 0.6), (2, 2, True, 0.5999)] + [(3, i, False, 0.0) for i in range(1, 13)]
    scored = spark.createDataFrame(rows, "request_id int, posicion int, semantica boolean, similitud double")
    kept = {}
    for r in best(scored).orderBy("request_id", "orden").collect():
        kept.setdefault(r.request_id, []).append(r.posicion)
    assert kept == {1: [8, 7, 12, 9, 10, 1, 2, 3, 4, 5], 2: [1], 3: list(range(1, 13))}


def test_views(spark, world):
    register_views(world)
    rows = spark.table("v_eventos_completos").orderBy("fecha_inicio", "id_unico_evento").collect()
    # one row per schedule, copies included
    assert [r.id_unico_evento for r in rows] == ["f", "a", "a", "b", "a", "c", "d", "e", "h"]
    assert rows[1].categorias_es == "Cultura, Música" and rows[1].categorias_slugs == "cultura,musica"
    assert rows[0].categorias_es is None and rows[0].cp_latitud == 41.6275
    names = active_categories(world.categories.withColumn("activo", F.col("id_categoria") != 3), "ca")
    assert [r.nombre for r in names.collect()] == [
        "Cultura", "Esports", "Infantil", "Formació", "Gastronomia", "Música", "Naturalesa",
    ]
    assert "cp_latitud" in complete_events(world).columns


def test_response_documents(spark, world, tmp_path):
    asked = requests(spark, [request(1), request(2, "08360")])
    S.write_responses(S.envelope(S.search(asked, world), asked), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted((d["request_id"], d["total"]) for d in lines) == [(1, 5), (2, 0)]
