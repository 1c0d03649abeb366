import decimal
import re

import pytest
from pyspark.sql import functions as F

from builders import TOWNS, day
from convoca import schemas
from convoca.operators.quality import (
    blockers,
    delete_parents,
    duplicate_keys,
    duplicate_values,
    orphans,
    vector_sizes,
    violations,
    with_defaults,
)
from convoca.operators.upsert import append_numbered, insert_missing, resolve_unique, upsert
from convoca.plans.ingest import load_batch, publish
from convoca.functions.text import padded
from convoca.plans.views import active_events
from convoca.sources.catalog import Catalog, load_catalog, read_catalog, save_bucketed, write_table
from convoca.sources.seeds import seed_categories
from convoca.sources.staging import broadcast_if_small, clear_staged, stage


def test_upsert_touches_only_update_columns(spark):
    target = spark.createDataFrame([("a", "A", 1.0), ("b", "B", 2.0)], "id string, titulo string, precio double")
    batch = spark.createDataFrame(
        [("a", "A1", 9.0, 1), ("a", "A2", 8.0, 3), ("c", "C1", 3.0, 2), ("c", "C2", 4.0, 5), ("c", None, 4.0, 4)],
        "id string, titulo string, precio double, seq int",
    )
    loaded = upsert(target, batch, ["id"], ["titulo"], "seq")
    assert sorted(map(tuple, loaded.collect())) == [("a", "A2", 1.0), ("b", "B", 2.0), ("c", "C2", 3.0)]
    again = upsert(loaded, batch, ["id"], ["titulo"], "seq")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, loaded.collect()))


def test_insert_missing(spark):
    target = spark.createDataFrame([("a", 1)], "e string, c int")
    batch = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 1, 2), ("b", 1, 3)], "e string, c int, seq int")
    rows = insert_missing(target, batch, ["e", "c"], "seq").collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("a", 2), ("b", 1)]


def test_unique_names_resolve_to_the_row_that_has_them(spark):
    target = spark.createDataFrame([(1, "Calella", "B"), (2, "Blanes", "G")], "id int, nombre string, p string")
    batch = spark.createDataFrame(
        [(9, "CALELLÁ", "X", 1), (2, "Blanes!", "X", 2), (7, "Pineda", "X", 3), (8, "pineda", "X", 4)],
        "id int, nombre string, p string, seq int",
    )
    resolved = resolve_unique(target, batch, "id", "nombre", "seq")
    rows = upsert(target, resolved, ["id"], ["nombre"], "seq").collect()
    assert sorted(map(tuple, rows)) == [(1, "CALELLÁ", "B"), (2, "Blanes!", "G"), (7, "pineda", "X")]


def test_append_numbers_every_row_once(spark):
    target = spark.createDataFrame([(41, "a", 0)], "id bigint, e string, n int")
    # most rows are copies of one, more than fit one piece; NULL is not a text
    batch = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, None).otherwise("-").alias("e"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("int")).otherwise(-1).alias("n"),
    )
    loaded = append_numbered(target, batch, "id")
    rows = loaded.collect()
    assert sorted(r.id for r in rows) == list(range(41, 6042))
    assert sum(r.e == "hot" for r in rows) == 4000 and sum(r.e is None for r in rows) == 1000
    again = append_numbered(target, batch.repartition(7), "id").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sorted(r.id for r in append_numbered(target.limit(0), batch, "id").collect())[0] == 1


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "ciudades": spark.createDataFrame([(1, "A"), (2, "B")], "id_ciudad int, nombre string"),
        "codigos_postales": spark.createDataFrame([("1", 1), ("2", None), ("3", 5)], "cp string, id_ciudad int"),
        "eventos_master": spark.createDataFrame(
            [("e1", "1", 1, "ACTIVO"), ("e2", "9", 2, "NUEVO"), ("e2", "1", None, None)],
            "id_unico_evento string, cp_evento string, id_ciudad int, estado string",
        ),
        "evento_horarios": spark.createDataFrame([(1, "e1"), (2, "e2"), (3, "zz")], "id_horario int, id_unico_evento string"),
        "auditoria_scraping": spark.createDataFrame(
            [(1, "e1", "OK"), (2, "e2", "MAL"), (3, None, "OK")], "id_auditoria int, id_unico_evento string, resultado string"
        ),
    }


def test_constraint_checks(tables):
    found = {(r.tabla, r.columna, r.valor, r.filas) for r in orphans(tables).collect()}
    assert found == {
        ("codigos_postales", "id_ciudad", "5", 1),
        ("eventos_master", "cp_evento", "9", 1),
        ("evento_horarios", "id_unico_evento", "zz", 1),
    }
    doubled = duplicate_keys(tables["eventos_master"], ["id_unico_evento"]).collect()
    assert [tuple(r) for r in doubled] == [("e2", 2)]
    bad = violations(tables["eventos_master"], "eventos_master").filter("filas > 0").collect()
    assert {(r.columna, r.regla, r.filas) for r in bad} == {("estado", "nulo", 1), ("estado", "dominio", 1)}
    bad = violations(tables["auditoria_scraping"], "auditoria_scraping").filter("filas > 0").collect()
    assert [(r.columna, r.regla) for r in bad] == [("resultado", "dominio")]


def test_delete_rules(spark, tables):
    gone = spark.createDataFrame([("e1",)], "id_unico_evento string")
    left = delete_parents(tables, "eventos_master", gone)
    assert {r.id_horario for r in left["evento_horarios"].collect()} == {2, 3}
    assert sorted((r.id_auditoria, r.id_unico_evento) for r in left["auditoria_scraping"].collect()) == [
        (1, None), (2, "e2"), (3, None),
    ]
    assert left["eventos_master"].count() == 2
    held = blockers(tables, "ciudades", tables["ciudades"]).collect()
    assert {(r.tabla, r.valor, r.filas) for r in held} == {
        ("codigos_postales", "1", 1), ("eventos_master", "1", 1), ("eventos_master", "2", 1),
    }


def test_defaults_and_dimensions(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "id_categoria int, orden int")
    assert [tuple(r) for r in with_defaults(rows, "categorias").collect()] == [(1, 0, True), (2, 5, True)]
    stamped = with_defaults(spark.createDataFrame([(1, "OK")], "id_auditoria int, resultado string"), "auditoria_scraping")
    assert stamped.first().fecha_ejecucion is not None
    vectors = spark.createDataFrame([("[1,2]",), ("[1,2,3]",), (None,)], "v string")
    assert sorted(map(tuple, vector_sizes(vectors, "v", 2).collect())) == [(2, 1, True), (3, 1, False)]


def _batch(spark):
    cities = [(i, name, "Barcelona", i) for i, (_, name, _, _) in enumerate(TOWNS, 1)]
    codes = [(cp, i, lat, lng, i) for i, (cp, _, lat, lng) in enumerate(TOWNS, 1)]
    events = [
        ("e1", "MANUAL", "u", "URL_ESTRUCTURAL", 1, "08380", "Malgrat de Mar", "Plaza", "es", "T1", "C1", True, None, False, 1),
        ("e1", "MANUAL", "u", "URL_ESTRUCTURAL", 1, "08380", "Malgrat de Mar", "Plaza", "es", "T2", "C2", False, decimal.Decimal("3.50"), False, 2),
    ]
    return {
        "ciudades": spark.createDataFrame(cities, "id_ciudad int, nombre string, provincia string, seq int"),
        "codigos_postales": spark.createDataFrame(codes, "cp string, id_ciudad int, latitud double, longitud double, seq int"),
        "categorias": seed_categories(spark).withColumn("seq", F.col("id_categoria")),
        "eventos_master": spark.createDataFrame(
            events,
            "id_unico_evento string, metodo_ingesta string, id_usuario_carga string, fuente_id string, id_ciudad int, "
            "cp_evento string, poblacion_nombre string, lugar_nombre string, idioma_origen string, titulo_es string, "
            "titulo_cat string, es_gratuito boolean, precio_euros decimal(10,2), requiere_inscripcion boolean, seq int",
        ),
        "evento_categorias": spark.createDataFrame([("e1", 7, 1)], "id_unico_evento string, id_categoria int, seq int"),
        "evento_horarios": spark.createDataFrame(
            [("e1", day(1), "10:00:00", 1)], "id_unico_evento string, fecha_inicio date, hora_inicio string, seq int"
        ),
    }


def test_load_publish_and_reload(spark, tmp_path):
    empty = {n: spark.createDataFrame([], s) for n, s in schemas.TABLES.items()}
    for name, df in empty.items():
        write_table(df, str(tmp_path / "v0"), name)
    batch = _batch(spark)
    counts = publish(spark, str(tmp_path / "v0"), batch, str(tmp_path / "v1"))
    assert counts == {
        "ciudades": 5, "codigos_postales": 5, "categorias": 8, "eventos_master": 1,
        "evento_categorias": 1, "evento_horarios": 1, "fuentes_familia": 0,
        "binarios_storage": 0, "auditoria_scraping": 0,
    }
    loaded = read_catalog(spark, str(tmp_path / "v1"))
    row = loaded.events.first()
    assert (row.titulo_es, row.titulo_cat, row.precio_euros, row.estado) == ("T2", "C1", None, "ACTIVO")
    assert loaded.postcodes.count() == 5
    # schedules have no key of their own: a second load stores them again
    counts = publish(spark, str(tmp_path / "v1"), batch, str(tmp_path / "v2"))
    assert counts["evento_horarios"] == 2 and counts["eventos_master"] == 1
    ids = read_catalog(spark, str(tmp_path / "v2")).schedules.select("id_horario").collect()
    assert sorted(r[0] for r in ids) == [1, 2]


def test_broken_references_are_refused(spark, tmp_path):
    for name, schema in schemas.TABLES.items():
        write_table(spark.createDataFrame([], schema), str(tmp_path / "v0"), name)
    batch = _batch(spark)
    batch.pop("ciudades")
    with pytest.raises(ValueError, match="missing rows"):
        publish(spark, str(tmp_path / "v0"), batch, str(tmp_path / "v1"))


def test_bucketed_tables_join_without_shuffle(spark):
    events = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("id_unico_evento"), F.lit("08380").alias("cp_evento"))
    for name in ("eventos_master", "evento_horarios", "evento_categorias"):
        save_bucketed(events, name, 4)
    for name in ("codigos_postales", "categorias"):
        events.write.saveAsTable(name)
    cat = load_catalog(spark)
    joined = cat.events.hint("merge").join(cat.schedules, "id_unico_evento")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50
    with pytest.raises(ValueError):
        save_bucketed(events, "ciudades", 4)


def test_staging(spark):
    df = spark.range(10)
    assert stage(df, "prueba").count() == 10
    assert broadcast_if_small(df, 9) is df and broadcast_if_small(df, 10) is not df


def test_batch_with_defaults(spark):
    empty = {n: spark.createDataFrame([], s) for n, s in schemas.TABLES.items()}
    loaded = load_batch(empty, {"evento_categorias": _batch(spark)["evento_categorias"]})
    assert [tuple(r) for r in loaded["evento_categorias"].collect()] == [("e1", 7)]


def test_batches_that_lose_rows_are_refused(spark):
    empty = {n: spark.createDataFrame([], s) for n, s in schemas.TABLES.items()}
    batch = _batch(spark)
    with pytest.raises(ValueError, match="no such tables: eventos"):
        load_batch(empty, {"eventos": batch["eventos_master"]})
    with pytest.raises(ValueError, match="without seq"):
        load_batch(empty, {"ciudades": batch["ciudades"].withColumn("seq", F.lit(None).cast("int"))})
    family = spark.createDataFrame([("f1", 1, "Ayuntamiento", "https://e.cat", 1)],
                                   "id_familia string, id_ciudad int, nombre_entidad string, url_raiz_global string, seq int")
    file = spark.createDataFrame([("e1", "cartel", "PDF", "s3://x", 1)],
                                 "id_unico_evento string, nombre_archivo string, tipo_archivo string, url_almacenamiento_nube string, seq int")
    loaded = load_batch(empty, {"fuentes_familia": family, "binarios_storage": file, "auditoria_scraping": file.select("id_unico_evento", "seq")})
    assert loaded["fuentes_familia"].first().id_familia == "f1"
    row = loaded["binarios_storage"].first()
    assert row.id_binario == 1 and row.fecha_sincronizacion is not None
    assert loaded["auditoria_scraping"].first().resultado == "OK"


def test_unique_names_are_compared_under_the_collation(spark):
    rows = spark.createDataFrame([("Calella",), ("CALELL\u00c1 ",), ("Blanes",), (None,), (None,)], "nombre string")
    assert [tuple(r) for r in duplicate_values(rows, "nombre").select("filas").collect()] == [(2,)]


def test_codes_are_never_shortened(spark):
    codes = spark.createDataFrame([(7,), (99_999,), (100_000,), (100_009,)], "k bigint").select(padded(F.col("k"), 5))
    assert [r[0] for r in codes.collect()] == ["00007", "99999", "100000", "100009"]


def test_staged_files_can_be_removed(spark):
    staged = stage(spark.range(3), "se-va")
    (path,) = {f.rsplit("/", 1)[0] for f in staged.inputFiles()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(hadoop)
    clear_staged(spark)
    assert not files.exists(hadoop)


def test_schedules_are_exchanged_once(spark):
    ids = spark.range(20).select(F.sha2(F.col("id").cast("string"), 256).alias("id_unico_evento"))
    events = ids.withColumns({c: F.lit(1) for c in ("estado", "cp_evento")} | {"estado": F.lit("ACTIVO")}).withColumn("cp_evento", F.lit("08380"))
    for name in ("titulo_es", "desc_larga_es", "poblacion_nombre", "lugar_nombre", "direccion_fisica", "es_gratuito",
                 "precio_euros", "link_entradas_inscripcion", "imagen_principal_url", "tags_es"):
        events = events.withColumn(name, F.lit("x"))
    slots = ids.withColumns({c: F.lit("2025-01-01").cast("date") for c in ("fecha_inicio", "fecha_fin")} | {c: F.lit("10:00:00") for c in ("hora_inicio", "hora_fin")})
    places = spark.createDataFrame([("08380", 41.0, 2.0)], "cp string, latitud double, longitud double")
    cat = Catalog(events, slots.hint("merge"), places, ids, ids)
    plan = active_events(cat, "es")._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("AdaptiveSparkPlan"):]
    # one for the schedules, one for the events; no sort of everything
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert "rangepartitioning" not in plan
