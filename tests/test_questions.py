import datetime as dt

from pyspark.sql import functions as F

from convoca.operators.annotate import annotate
from convoca.operators.validate import accepted, check_requests, parameters_from_json, rejected
from convoca.sources.seeds import seed_categories


def test_request_checks(spark):
    rows = [
        (1, None, "08380", "pregunta ausente"),
        (2, "¿Qué hacer?", "123", "cp invalido"),
        (3, "ab", "08380", "pregunta corta"),
        (4, "x" * 501, "08380", "pregunta larga"),
        (5, " \t\n\xa0", "08380", "pregunta en blanco"),
        (6, "¿Qué?", "08380\n", "cp invalido"),
        (7, "¿Qué?", "0838a", "cp invalido"),
        (8, "¿Qué?", None, "cp ausente"),
        (9, "  a ", "08380", None),
        (10, "😀" * 500, "00000", None),
    ]
    checked = check_requests(spark.createDataFrame([r[:3] for r in rows], "id int, pregunta string, cp_usuario string"))
    assert {r.id: r.motivo for r in rejected(checked).collect()} == {r[0]: r[3] for r in rows if r[3]}
    good = {r.id: r.pregunta for r in accepted(checked).collect()}
    assert good == {9: "a", 10: "😀" * 500}


def test_parameters_from_json(spark):
    rows = [
        ("¿Qué hay?", '{"idioma":"ca","fechas":["2025-01-02"],"radio_km":100,"precio_max":0,"es_gratuito":false}'),
        ("¿Dónde?", '{"idioma":"es","radio_km":101}'),
        ("res", '{"idioma":"es","precio_max":-0.5}'),
        ("res", "no json"),
        ("res", '{"radio_km":3}'),
        ("res", None),
    ]
    df = spark.createDataFrame(rows, "pregunta string, json string")
    got = parameters_from_json(df, "json").collect()
    assert [r.extraidos for r in got] == [True, False, False, False, False, False]
    assert got[0].fechas == [dt.date(2025, 1, 2)] and got[0].radio_km == 100 and got[0].es_gratuito is False
    assert got[0].categorias == [] and got[0].conceptos == []
    assert [r.idioma for r in got] == ["ca", "es", "ca", "ca", "ca", "ca"]
    assert got[1].conceptos == ["¿Dónde?"] and got[1].radio_km is None and got[1].categorias == []


def test_annotations(spark):
    saturday = dt.date(2025, 1, 4)
    sunday, monday = dt.date(2025, 1, 5), dt.date(2025, 1, 6)
    cases = [
        ("¿Qué hacer este fin de semana?", saturday, "es", {"fechas": [saturday, sunday]}),
        ("Què fer aquest cap de setmana?", monday, "ca", {"fechas": [dt.date(2025, 1, 11), dt.date(2025, 1, 12)]}),
        ("Eventos gratuitos para niños", monday, "ca", {"es_gratuito": True}),
        ("Esdeveniments gratuïts per a nens", monday, "ca", {"es_gratuito": True}),
        ("Actividades al aire libre cerca de mi", monday, "ca", {"radio_km": 20}),
        ("Activitats a l'aire lliure prop meu", monday, "ca", {"radio_km": 20}),
        ("Conciertos de MÚSICA en un radio de 30 kilómetros", monday, "ca", {"radio_km": 30, "categorias": ["musica"]}),
        ("Concerts de musica en un radi de 20 quilòmetres", monday, "ca", {"radio_km": 20, "categorias": ["musica"]}),
        ("¿Cuándo hay esports o gastronomía? menos de 12,50 euros", monday, "es", {"precio_max": 12.5, "categorias": ["deportes", "gastronomia"]}),
        ("esta semana", saturday, "ca", {"fecha_inicio": saturday, "fecha_fin": sunday}),
        ("¿dónde? mañana", monday, "es", {"fechas": [dt.date(2025, 1, 7)]}),
        ("aquest dissabte", sunday, "ca", {"fechas": [dt.date(2025, 1, 11)]}),
        ("avui a 500 km, gratis", monday, "ca", {}),
        ("gratis en 2000000 km", monday, "ca", {}),
        ("algo a 100020 km", monday, "ca", {}),
        ("a 99999999999 km", monday, "ca", {}),
        ("a 100 km", monday, "ca", {"radio_km": 100}),
        ("a 2,5 km", monday, "ca", {}),
        ("menos de 12345678 euros", monday, "ca", {"precio_max": 12345678.0}),
        ("menos de 1.500 euros", monday, "ca", {"precio_max": 1500.0}),
        ("máximo 1.500,25 €", monday, "ca", {"precio_max": 1500.25}),
        ("negocios sociales", monday, "ca", {}),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, pregunta string, as_of date")
    empty = {"fechas": None, "fecha_inicio": None, "fecha_fin": None, "radio_km": None, "categorias": [],
             "es_gratuito": None, "precio_max": None}
    for row in annotate(df, seed_categories(spark)).collect():
        text, _, idioma, wanted = cases[row.i]
        assert row.idioma == idioma, text
        assert row.conceptos == [text]
        assert {k: row[k] for k in empty} == {**empty, **wanted}, text


def test_parameters_are_converted_where_nothing_is_lost(spark):
    refused = [
        '"radio_km":"abc"', '"radio_km":20.5', '"categorias":null', '"fechas":["mala"]', '"fechas":[null]',
        '"categorias":[1]', '"categorias":"x"', '"conceptos":[null]', '"es_gratuito":"quizás"', '"es_gratuito":2',
        '"precio_max":"nada"', '"precio_max":"nan"', '"fecha_inicio":"2024-13-01"', '"fecha_inicio":"mañana"',
        '"radio_km":[5]', '"radio_km":101', '"precio_max":-0.01', '"radio_km":99999999999',
    ]
    taken = {
        '"radio_km":"20"': ("radio_km", 20),
        '"radio_km":20.0': ("radio_km", 20),
        '"radio_km":null': ("radio_km", None),
        '"precio_max":"12.5"': ("precio_max", 12.5),
        '"precio_max":3': ("precio_max", 3.0),
        '"es_gratuito":"true"': ("es_gratuito", True),
        '"es_gratuito":0': ("es_gratuito", False),
        '"fechas":[]': ("fechas", []),
        '"fechas":null': ("fechas", None),
        '"fechas":["2024-02-29"]': ("fechas", [dt.date(2024, 2, 29)]),
        '"categorias":["a b"]': ("categorias", ["a b"]),
        '"otro":{"x":[null]}': ("categorias", []),
    }
    given = [f'{{"idioma":"es",{text}}}' for text in [*refused, *taken]]
    given += ['{"idioma":5}', '{"idioma":null}', '{"idioma":"es"} sobra', '{"idioma":"es"} {"idioma":"es"}', '[]', '""', "null"]
    df = spark.createDataFrame([(i, "pregunta", text) for i, text in enumerate(given)], "i int, pregunta string, json string")
    rows = {r.json: r for r in parameters_from_json(df, "json").collect()}
    for text in taken:
        row = rows[f'{{"idioma":"es",{text}}}']
        name, value = taken[text]
        assert row.extraidos and row.idioma == "es" and row[name] == value, text
    for text in given[: len(refused)] + given[len(refused) + len(taken) :]:
        assert not rows[text].extraidos and rows[text].conceptos == ["pregunta"], text


def test_mentions_among_many_names(spark):
    """Names of one to four words, 50,000 of them, some within others, in two languages."""
    names = [(f"s{i}", f"Ruta {i}", f"Fira de {i} Pobles" if i % 2 else None) for i in range(50_000)]
    names += [("corta", "ruta", "--"), ("nada", None, ""), (None, "ruta", "ruta")]
    categories = spark.createDataFrame(names, "slug string, nombre_es string, nombre_cat string")
    asked = ["¿Ruta 17 o fira de 41 pobles?", "rutas 17", "fira de 42 pobles", "", None, "RÚTA-4999 ruta 4999.", "ruta " * 5000] + ["ruta 7"] * 3
    df = spark.createDataFrame([(n, q) for n, q in enumerate(asked)], "n int, pregunta string").withColumn("as_of", F.lit("2024-01-01").cast("date"))
    found = {r["n"]: r["categorias"] for r in annotate(df, categories).collect()}
    assert found[0] == ["corta", "s17", "s41"] and found[1] == [] and found[2] == []
    assert found[3] == [] and found[4] == [] and found[5] == ["corta", "s4999"] and found[6] == ["corta"]
    assert found[7] == found[8] == found[9] == ["corta", "s7"]
    none = annotate(df, categories.limit(0)).collect()
    assert len(none) == len(asked) and all(r["categorias"] == [] for r in none)
    plan = annotate(df, categories)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
