"""DuckDB statements that state each query's result on the data tables."""

from __future__ import annotations

_PAD = "lpad(CAST({0} AS VARCHAR), CAST(greatest({1}, length(CAST({0} AS VARCHAR))) AS INTEGER), '0')"
_CP = _PAD.replace("{1}", "5")
_EVENT = "sha256('orden-' || CAST({} AS VARCHAR))"

CTES = {
    "ciudades": """
  SELECT n_nationkey AS id_ciudad, n_name AS nombre, r_name AS provincia
  FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "codigos_postales": f"""
  SELECT {_CP.format('c_custkey')} AS cp, c_nationkey AS id_ciudad,
         40e0 + CAST((c_custkey * 7919) % 10000 AS DOUBLE) / 5000e0 AS latitud,
         1e0 + CAST((c_custkey * 104729) % 10000 AS DOUBLE) / 4000e0 AS longitud
  FROM customer""",
    "categorias": """
  SELECT CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS id_categoria,
         p_type AS nombre_es, p_type || ' CAT' AS nombre_cat, lower(p_type) AS slug,
         CAST(row_number() OVER (ORDER BY p_type DESC) AS INTEGER) AS orden,
         p_type <> 'SMALL' AS activo
  FROM (SELECT DISTINCT p_type FROM part)""",
    "eventos": f"""
  SELECT {_EVENT.format('o_orderkey')} AS id_unico_evento, o_orderkey AS clave,
         'MANUAL' AS metodo_ingesta, 'URL_ESTRUCTURAL' AS fuente_id,
         CASE o_orderstatus WHEN 'F' THEN 'ACTIVO' WHEN 'O' THEN 'APLAZADO' ELSE 'CANCELADO' END AS estado,
         c_nationkey AS id_ciudad, {_CP.format('o_custkey')} AS cp_evento, n_name AS poblacion_nombre,
         'Lugar ' || CAST(o_orderkey % 100 AS VARCHAR) AS lugar_nombre,
         'Calle ' || CAST(o_orderkey % 1000 AS VARCHAR) AS direccion_fisica,
         'Evento ' || CAST(o_orderkey AS VARCHAR) AS titulo_es,
         'Esdeveniment ' || CAST(o_orderkey AS VARCHAR) AS titulo_cat,
         'Descripción ' || CAST(o_orderkey AS VARCHAR) AS desc_larga_es,
         'Descripció ' || CAST(o_orderkey AS VARCHAR) AS desc_larga_cat,
         CASE WHEN o_orderkey % 11 <> 0 THEN etiquetas END AS tags_es,
         CASE WHEN o_orderkey % 13 = 0 THEN 'null' WHEN o_orderkey % 17 = 0 THEN ''
              ELSE etiquetas END AS tags_cat,
         o_orderkey % 5 < 3 AS es_gratuito,
         CASE WHEN o_orderkey % 20 = 3 THEN 0e0 WHEN o_orderkey % 5 >= 3 THEN CAST(floor(o_totalprice / 100e0) AS DOUBLE) / 100e0 END AS precio_euros,
         CASE WHEN o_orderkey % 3 = 0 THEN 'https://ejemplo.cat/e/' || CAST(o_orderkey AS VARCHAR) END
           AS link_entradas_inscripcion,
         CAST(NULL AS VARCHAR) AS imagen_principal_url,
         CAST(o_orderdate AS DATE) AS fecha_creacion, CAST(o_orderkey % 130 AS VARCHAR) AS id_familia,
         CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 500 END AS v_es,
         CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey + 1) % 500 END AS v_cat
  FROM (SELECT *, '["#' || lower(substr(o_orderpriority, 3)) || '","#k'
                  || CAST(o_orderkey % 7 AS VARCHAR) || '"]' AS etiquetas FROM orders)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "vectores": """
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings""",
    "horarios": f"""
  SELECT CAST(('0x' || substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
           strftime(l_shipdate, '%Y-%m-%d'), CAST(floor(l_quantity) AS BIGINT),
           CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), copia)), 1, 15)) AS BIGINT) AS id_horario,
         {_EVENT.format('l_orderkey')} AS id_unico_evento,
         CAST(l_shipdate AS DATE) AS fecha_inicio,
         CAST(l_shipdate AS DATE) + CAST(l_linenumber % 3 AS INTEGER) AS fecha_fin,
         CASE WHEN l_linenumber = 6 THEN '00:00:00' WHEN l_linenumber <> 7 THEN lpad(CAST(9 + l_partkey % 13 AS VARCHAR), 2, '0')
           || CASE WHEN l_suppkey % 2 = 0 THEN ':00:00' ELSE ':30:00' END END AS hora_inicio,
         CAST(NULL AS VARCHAR) AS hora_fin
  FROM lineitem JOIN (VALUES (0), (1)) c(copia) ON copia = 0 OR l_orderkey % 50 = 0""",
    "evento_categorias": f"""
  SELECT DISTINCT {_EVENT.format('l_orderkey')} AS id_unico_evento, id_categoria
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN categorias ON p_type = nombre_es""",
    "fuentes_familia": """
  SELECT CAST(s_suppkey AS VARCHAR) AS id_familia, s_nationkey AS id_ciudad, s_name AS nombre_entidad
  FROM supplier""",
    "binarios": f"""
  SELECT p_partkey AS id_binario, {_EVENT.format('p_partkey')} AS id_unico_evento,
         ['PDF', 'JPG', 'PNG', 'WEBP', 'DOCX', 'EXE'][CAST(p_partkey % 6 AS INTEGER) + 1] AS tipo_archivo
  FROM part""",
    "auditoria": f"""
  SELECT event_id AS id_auditoria, {_EVENT.format('event_id')} AS id_unico_evento,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'OK' END AS resultado
  FROM events""",
    "solicitudes": f"""
  SELECT request_id, k, '¿Qué hay para ' || CAST(k AS VARCHAR) || '?' AS pregunta, cp_usuario,
         k % 50 = 0 AS debug,
         CASE WHEN (k // 4) % 2 = 0 THEN 'es' ELSE 'ca' END AS idioma,
         CASE WHEN k % 10 = 7 THEN [dia, dia + 1, dia + 30] ELSE [] END AS fechas,
         CASE WHEN k % 3 = 0 THEN dia END AS fecha_inicio,
         CASE WHEN k % 3 = 0 THEN dia + 365 END AS fecha_fin,
         CAST(radio_km AS INTEGER) AS radio_km,
         CASE WHEN k % 5 = 0 THEN ['ECÓNOMY'] WHEN k % 5 = 1 THEN ['standard', 'Promo', 'Standard']
              WHEN k % 35 = 2 THEN ['PROMO CAT'] ELSE [] END AS categorias,
         k % 2 = 1 AS con_conceptos,
         CASE WHEN k % 6 = 0 THEN true WHEN k % 6 = 1 THEN false END AS es_gratuito,
         CASE WHEN k % 6 = 2 THEN 25e0 WHEN k % 12 = 9 THEN 5 + CAST(k % 5 AS DOUBLE) * 4.5e0
              WHEN k % 6 = 1 THEN 5e0 END AS precio_max,
         (3 * k) % 500 AS i1, (3 * k + 1) % 500 AS i2
  FROM (SELECT *, DATE '1996-01-01' + CAST(k % 1500 AS INTEGER) AS dia FROM (
    SELECT c_custkey AS request_id, c_custkey AS k, {_CP.format('c_custkey')} AS cp_usuario,
           CASE c_custkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 20 WHEN 3 THEN 60 END AS radio_km
    FROM customer
    UNION ALL
    SELECT -1 - s_suppkey, s_suppkey, 'x' || {_PAD.format('s_suppkey', 4)},
           20 + 40 * (s_suppkey % 3) FROM supplier))""",
    "alcance": """
  SELECT DISTINCT s.cp_usuario, s.radio_km, b.cp,
         6371e0 * acos(least(1e0, greatest(-1e0,
           cos(radians(a.latitud)) * cos(radians(b.latitud)) * cos(radians(b.longitud) - radians(a.longitud))
           + sin(radians(a.latitud)) * sin(radians(b.latitud))))) AS distancia_km
  FROM (SELECT DISTINCT cp_usuario, radio_km FROM solicitudes WHERE radio_km > 0) s
  JOIN codigos_postales a ON a.cp = s.cp_usuario CROSS JOIN codigos_postales b
  WHERE 6371e0 * acos(least(1e0, greatest(-1e0,
           cos(radians(a.latitud)) * cos(radians(b.latitud)) * cos(radians(b.longitud) - radians(a.longitud))
           + sin(radians(a.latitud)) * sin(radians(b.latitud))))) <= s.radio_km""",
    "filas": """
  SELECT DISTINCT e.*, h.fecha_inicio, h.fecha_fin, h.hora_inicio, h.hora_fin, p.latitud, p.longitud
  FROM eventos e JOIN horarios h USING (id_unico_evento) JOIN codigos_postales p ON e.cp_evento = p.cp
  WHERE e.estado = 'ACTIVO'""",
    "lugares": """
  SELECT s.request_id, a.cp FROM solicitudes s JOIN alcance a USING (cp_usuario, radio_km)
  UNION ALL
  SELECT request_id, cp_usuario FROM solicitudes WHERE coalesce(radio_km, 0) = 0
  UNION ALL
  SELECT request_id, NULL FROM solicitudes
  WHERE radio_km > 0 AND cp_usuario NOT IN (SELECT cp FROM codigos_postales)""",
    "pedidas": """
  SELECT DISTINCT request_id, id_categoria
  FROM (SELECT request_id, unnest(categorias) AS nombre FROM solicitudes)
  JOIN categorias ON strip_accents(lower(replace(lower(nombre), ' ', '_'))) = strip_accents(lower(slug))""",
    "encontradas": """
  SELECT s.request_id, f.*
  FROM (SELECT request_id, cp FROM lugares WHERE cp IS NOT NULL) l
  JOIN solicitudes s USING (request_id) JOIN filas f ON f.cp_evento = l.cp
  WHERE {condiciones}
  UNION ALL
  SELECT s.request_id, f.*
  FROM (SELECT request_id FROM lugares WHERE cp IS NULL) l
  JOIN solicitudes s USING (request_id) CROSS JOIN filas f
  WHERE {condiciones}""",
    "candidatas": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fecha_inicio,
      hora_inicio NULLS FIRST, id_unico_evento, fecha_fin NULLS FIRST, hora_fin NULLS FIRST) AS posicion
    FROM encontradas) WHERE posicion <= 50""",
    "puntuadas": """
  SELECT c.*, s.idioma, s.con_conceptos,
         CASE WHEN NOT con_conceptos THEN 0e0 WHEN ev.v IS NULL THEN 0.3e0
              ELSE list_inner_product(q.v, ev.v)
                   / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(ev.v, ev.v))) END AS score
  FROM candidatas c JOIN solicitudes s USING (request_id)
  JOIN (SELECT request_id, list_transform(list_zip(a.v, b.v), lambda p: (p[1] + p[2]) / 2) AS v
        FROM solicitudes JOIN vectores a ON i1 = a.vec_id JOIN vectores b ON i2 = b.vec_id) q USING (request_id)
  LEFT JOIN vectores ev ON ev.vec_id = CASE WHEN s.idioma = 'es' THEN c.v_es ELSE c.v_cat END""",
    "ordenadas": """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, posicion) AS orden,
           max(CASE WHEN score >= 0.6e0 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS hay
    FROM puntuadas)
  WHERE NOT con_conceptos OR (hay = 1 AND score >= 0.6e0) OR (hay = 0 AND orden <= 10)""",
    "resultados": """
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY orden) AS rank
  FROM (SELECT o.*, s.cp_usuario, CASE WHEN o.idioma = 'es' THEN titulo_es ELSE titulo_cat END AS titulo,
               CASE WHEN o.idioma = 'es' THEN desc_larga_es ELSE desc_larga_cat END AS descripcion,
               CASE WHEN o.idioma = 'es' THEN tags_es ELSE tags_cat END AS tags_json,
               u.latitud AS lat0, u.longitud AS lng0
        FROM ordenadas o JOIN solicitudes s USING (request_id)
        LEFT JOIN codigos_postales u ON u.cp = s.cp_usuario)
  WHERE tags_json IS NULL OR tags_json <> 'null'""",
}

CONDITIONS = {
    "fechas": """CASE WHEN len(s.fechas) > 0 THEN list_contains(s.fechas, f.fecha_inicio)
      ELSE f.fecha_inicio >= coalesce(s.fecha_inicio, f.fecha_inicio)
       AND f.fecha_inicio <= coalesce(s.fecha_fin, f.fecha_inicio) END""",
    "precio": """CASE WHEN s.es_gratuito IS NOT NULL THEN f.es_gratuito = s.es_gratuito
      WHEN s.precio_max IS NOT NULL THEN f.es_gratuito OR f.precio_euros <= s.precio_max ELSE true END""",
    "categoria": """(len(s.categorias) = 0 OR EXISTS (SELECT 1 FROM evento_categorias ec
      JOIN pedidas p USING (id_categoria)
      WHERE ec.id_unico_evento = f.id_unico_evento AND p.request_id = s.request_id))""",
}
ALL_CONDITIONS = " AND ".join(CONDITIONS.values())

HAVERSINE = """round(2 * 6371e0 * atan2(
  sqrt(pow(sin(radians({b}.latitud - {a}.latitud) / 2), 2) + cos(radians({a}.latitud)) * cos(radians({b}.latitud))
    * pow(sin(radians({b}.longitud - {a}.longitud) / 2), 2)),
  sqrt(1 - (pow(sin(radians({b}.latitud - {a}.latitud) / 2), 2) + cos(radians({a}.latitud)) * cos(radians({b}.latitud))
    * pow(sin(radians({b}.longitud - {a}.longitud) / 2), 2)))), 2)"""

_DEPENDS = {
    "evento_categorias": ["categorias"],
    "alcance": ["solicitudes", "codigos_postales"],
    "filas": ["eventos", "horarios", "codigos_postales"],
    "lugares": ["alcance"],
    "pedidas": ["solicitudes", "categorias"],
    "encontradas": ["lugares", "filas", "pedidas", "evento_categorias"],
    "candidatas": ["encontradas"],
    "puntuadas": ["candidatas", "vectores"],
    "ordenadas": ["puntuadas"],
    "resultados": ["ordenadas"],
}


# columns whose texts make up the fingerprint of a loaded row, as both engines write them
LOADED = {
    "ciudades": ["id_ciudad", "nombre", "provincia"],
    "codigos_postales": ["cp", "id_ciudad", "cast(round(latitud * 100000) as bigint)", "cast(round(longitud * 100000) as bigint)"],
    "categorias": ["id_categoria", "nombre_es", "nombre_cat", "slug", "orden", "activo"],
    "fuentes_familia": ["id_familia", "id_ciudad", "nombre_entidad"],
    "eventos_master": [
        "id_unico_evento", "metodo_ingesta", "fuente_id", "estado", "id_ciudad", "cp_evento", "poblacion_nombre", "lugar_nombre",
        "direccion_fisica", "titulo_es", "titulo_cat", "desc_larga_es", "desc_larga_cat", "tags_es", "tags_cat", "es_gratuito",
        "cast(round(precio_euros * 100) as bigint)", "link_entradas_inscripcion", "imagen_principal_url", "id_familia",
    ],
    "evento_categorias": ["id_unico_evento", "id_categoria"],
    "evento_horarios": ["id_unico_evento", "fecha_inicio", "fecha_fin", "hora_inicio", "hora_fin"],
    "binarios_storage": ["id_unico_evento", "tipo_archivo"],
    "auditoria_scraping": ["id_unico_evento", "resultado"],
}
GENERATED = {"evento_horarios": "id_horario", "binarios_storage": "id_binario", "auditoria_scraping": "id_auditoria"}

# every table after the batch of the load queries
_AFTER_LOAD = {
    "ciudades": """SELECT id_ciudad, CASE WHEN id_ciudad % 3 = 0 THEN nombre || ' nova' ELSE nombre END AS nombre, provincia FROM ciudades
UNION ALL SELECT r_regionkey + 900, 'Regió ' || r_name, r_name FROM region""",
    "codigos_postales": f"""SELECT cp, id_ciudad, latitud + 0.5e0 AS latitud, longitud FROM codigos_postales
UNION ALL SELECT 'n' || {_PAD.format('s_suppkey', 4)}, s_nationkey, 41.5e0, 2.5e0 FROM supplier""",
    "categorias": "SELECT id_categoria, nombre_es || ' nou' AS nombre_es, nombre_cat || ' nou' AS nombre_cat, slug, orden, activo FROM categorias",
    "fuentes_familia": "SELECT p || id_familia AS id_familia, id_ciudad, nombre_entidad FROM fuentes_familia, (VALUES (''), ('n')) v(p)",
    "eventos_master": """SELECT * REPLACE (CASE WHEN clave % 4 = 1 THEN 'Nou ' || CAST(clave AS VARCHAR) ELSE titulo_es END AS titulo_es) FROM eventos
UNION ALL SELECT * REPLACE (sha256('nova-' || CAST(clave AS VARCHAR)) AS id_unico_evento, 'Nova ' || CAST(clave AS VARCHAR) AS titulo_es,
  CAST(NULL AS VARCHAR) AS id_familia) FROM eventos WHERE clave % 10 = 3""",
    "evento_categorias": """SELECT id_unico_evento, id_categoria FROM evento_categorias
UNION ALL SELECT sha256('nova-' || CAST(clave AS VARCHAR)), 1 FROM eventos WHERE clave % 10 = 3""",
    "evento_horarios": """SELECT id_horario, id_unico_evento, fecha_inicio, fecha_fin, hora_inicio, hora_fin FROM horarios
UNION ALL SELECT (SELECT max(id_horario) FROM horarios) + row_number() OVER (), id_unico_evento, fecha_inicio + 364, fecha_fin, hora_inicio, hora_fin
FROM horarios WHERE substr(id_unico_evento, 1, 1) < '4'""",
    "binarios_storage": """SELECT id_binario, id_unico_evento, tipo_archivo FROM binarios
UNION ALL SELECT (SELECT max(id_binario) FROM binarios) + row_number() OVER (), id_unico_evento, tipo_archivo
FROM binarios WHERE id_unico_evento IN (SELECT id_unico_evento FROM eventos)""",
    "auditoria_scraping": """SELECT id_auditoria, id_unico_evento, resultado FROM auditoria
UNION ALL SELECT (SELECT max(id_auditoria) FROM auditoria) + row_number() OVER (), id_unico_evento, resultado
FROM auditoria WHERE id_unico_evento IN (SELECT id_unico_evento FROM eventos)""",
}


EVENT_FIELDS = [
    "rank", "id_unico_evento", "titulo", "descripcion_corta", "descripcion_larga", "cp_evento", "poblacion_nombre", "lugar_nombre",
    "direccion_completa", "fecha_inicio", "fecha_fin", "hora_inicio", "hora_fin", "es_gratuito", "url_evento", "url_imagen",
]


def _event_texts(results: str) -> str:
    """(request_id, eventos): the events of every answer in full, by rank."""
    fields = [*EVENT_FIELDS, "tags", "categorias"]
    fields += [f"CAST(round({name} * {times}) AS BIGINT)" for name, times in (("precio_euros", 100), ("distancia_km", 100), ("similitud_score", 1000))]
    texts = ", ".join(f"coalesce(CAST({f} AS VARCHAR), '-')" for f in fields)
    return f"SELECT request_id, string_agg(concat_ws('|', {texts}), ';' ORDER BY rank) AS eventos FROM ({results}) GROUP BY request_id"


VIEW_COLUMNS = [
    "id_unico_evento", "titulo_es", "cp_evento", "es_gratuito", "fecha_inicio", "fecha_fin", "hora_inicio",
    "cp_latitud", "cp_longitud", "categorias_es", "categorias_cat", "categorias_slugs",
]


def _refreshed() -> str:
    body = f"""SELECT {", ".join(VIEW_COLUMNS)} FROM (
  SELECT * REPLACE (CASE WHEN clave % 20 = 13 THEN 'Nou ' || CAST(clave AS VARCHAR) ELSE titulo_es END AS titulo_es) FROM eventos
  UNION ALL SELECT * REPLACE (sha256('nova-' || CAST(clave AS VARCHAR)) AS id_unico_evento, 'Nova ' || CAST(clave AS VARCHAR) AS titulo_es)
  FROM eventos WHERE clave % 20 = 13) e
JOIN (SELECT id_unico_evento, fecha_inicio, fecha_fin, hora_inicio FROM horarios
  UNION ALL SELECT id_unico_evento, fecha_inicio + 364, fecha_fin, hora_inicio FROM horarios WHERE substr(id_unico_evento, 1, 2) < '08') h
  USING (id_unico_evento)
JOIN (SELECT cp, CASE WHEN cp LIKE '%7' THEN latitud + 0.5e0 ELSE latitud END AS cp_latitud, longitud AS cp_longitud FROM codigos_postales) p
  ON e.cp_evento = p.cp
LEFT JOIN (SELECT id_unico_evento,
    string_agg(DISTINCT nombre_es || fin, ', ' ORDER BY nombre_es || fin) AS categorias_es,
    string_agg(DISTINCT nombre_cat || fin, ', ' ORDER BY nombre_cat || fin) AS categorias_cat,
    string_agg(DISTINCT slug, ',' ORDER BY slug) AS categorias_slugs
  FROM (SELECT id_unico_evento, id_categoria FROM evento_categorias
    UNION ALL SELECT sha256('nova-' || CAST(clave AS VARCHAR)), 1 FROM eventos WHERE clave % 20 = 13)
  JOIN (SELECT *, CASE WHEN id_categoria = 2 THEN ' nou' ELSE '' END AS fin FROM categorias) USING (id_categoria)
  GROUP BY 1) c USING (id_unico_evento)
WHERE estado = 'ACTIVO'"""
    return with_tables("eventos horarios codigos_postales evento_categorias", body)


def _loaded() -> str:
    parts = []
    for name, columns in LOADED.items():
        texts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns)
        top = f"max({GENERATED[name]})" if name in GENERATED else "NULL"
        parts.append(
            f"""SELECT '{name}' AS tabla, count(*) AS filas, CAST({top} AS BIGINT) AS mayor,
  CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', {texts})), 1, 10)) AS BIGINT)) AS BIGINT) AS huella
FROM ({_AFTER_LOAD[name]})"""
        )
    tables = "ciudades codigos_postales categorias fuentes_familia eventos evento_categorias horarios binarios auditoria"
    return with_tables(tables, "\nUNION ALL\n".join(parts))


def with_tables(names: str, body: str, conditions: str = ALL_CONDITIONS, **replaced: str) -> str:
    """``body`` after a WITH clause that defines ``names`` and what they need."""
    texts = {**CTES, **replaced}
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _DEPENDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{name} AS MATERIALIZED ({texts[name]})".replace("{condiciones}", conditions) for name in order]
    return "WITH " + ",\n".join(parts) + "\n" + body


CANDIDATE_COLUMNS = "request_id, posicion, id_unico_evento, fecha_inicio, hora_inicio, fecha_fin, hora_fin"


def candidates(conditions: str = ALL_CONDITIONS, where: str = "true") -> str:
    return with_tables(
        "candidatas", f"SELECT {CANDIDATE_COLUMNS} FROM (SELECT * REPLACE (CAST(posicion AS INTEGER) AS posicion) FROM candidatas) WHERE {where}", conditions
    )


# parameters as a model may send them: the first six are refused, the others converted
ODD_PARAMETERS = [
    '{"idioma":"es","radio_km":"abc"}',
    '{"idioma":"es","radio_km":20.5}',
    '{"idioma":"es","categorias":null}',
    '{"idioma":"es","fechas":["mala"]}',
    '{"idioma":"es"} y nada más',
    '{"idioma":5}',
    '{"idioma":"es","radio_km":"20"}',
    '{"idioma":"es","precio_max":"12.5"}',
    '{"idioma":"es","es_gratuito":"true","fecha_inicio":"2024-05-03","otro":[1,{"a":null}]}',
]
QUESTION_ENDINGS = [
    "¿Qué hacer este fin de semana?",
    "Què fer aquest cap de setmana?",
    "Eventos gratuitos para niños",
    "Esdeveniments gratuïts per a nens",
    "Actividades al aire libre cerca de mi",
    "Activitats a l'aire lliure prop meu",
    "Conciertos promo en un radio de 20 kilómetros",
    "Concerts en un radi de 35 quilòmetres",
    "¿Dónde hay algo estándard hoy por menos de 12,50 euros?",
    "¿Cuándo? mañana o esta semana",
    "esta semana, small economy a 150 km",
    "demà, menys de 30 €",
    "este sábado en los alrededores",
    "avui",
    "negocios y promociones",
    "gratis en 2000000 km",
    "algo cerca, a 100020 km",
    "menos de 12345678 euros",
    "máximo 1.500,50 euros, a 7 km",
]


def _haversine(lat0: str, lng0: str, lat1: str, lng1: str) -> str:
    a = (
        f"(pow(sin(radians({lat1} - {lat0}) / 2), 2) + cos(radians({lat0})) * cos(radians({lat1}))"
        f" * pow(sin(radians({lng1} - {lng0}) / 2), 2))"
    )
    return f"round(2 * 6371e0 * atan2(sqrt({a}), sqrt(1 - {a})), 2)"


_TAG_LIST = (
    "CASE WHEN {t} IS NULL OR {t} = '' THEN [] ELSE "
    "CAST(json_extract_string(nullif({t}, ''), '$[*]') AS VARCHAR[]) END"
)


def _results(categories: str, distance: str, hour: str) -> str:
    tags = _TAG_LIST.format(t="tags_json")
    return with_tables(
        "resultados evento_categorias",
        f"""SELECT request_id, CAST(rank AS INTEGER) AS rank, r.id_unico_evento, titulo,
  descripcion AS descripcion_corta, descripcion AS descripcion_larga, cp_evento, poblacion_nombre,
  lugar_nombre, direccion_fisica AS direccion_completa, fecha_inicio, fecha_fin,
  {hour} AS hora_inicio, hora_fin, es_gratuito,
  CASE WHEN precio_euros <> 0 THEN precio_euros END AS precio_euros,
  {categories} AS categorias, array_to_string({tags}, ',') AS tags,
  link_entradas_inscripcion AS url_evento, imagen_principal_url AS url_imagen,
  {distance} AS distancia_km, round(score, 3) + 0e0 AS similitud_score
FROM resultados r""",
    )


def _words(text: str) -> str:
    return f"' ' || regexp_replace(strip_accents(lower({text})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"


def _annotation() -> str:
    endings = ", ".join("'" + e.replace("'", "''") + "'" for e in QUESTION_ENDINGS)
    saturday = "as_of + CAST((6 - dayofweek(as_of) + 7) % 7 AS INTEGER)"
    sunday = "as_of + CAST((7 - dayofweek(as_of)) % 7 AS INTEGER)"
    iso = "strftime({}, '%Y-%m-%d')"
    limit = (
        "nullif(regexp_extract(t, '(?:menos de|menys de|maximo|maxim)\\s+"
        "(\\d{1,3}(?:\\.\\d{3})+(?:,\\d{1,2})?|\\d+(?:[.,]\\d{1,2})?)\\s*(?:euros?|€)', 1), '')"
    )
    return with_tables(
        "categorias",
        f"""SELECT conv_id, turn, as_of,
  CASE WHEN contains(lower(pregunta), 'qué') OR contains(lower(pregunta), 'dónde')
         OR contains(lower(pregunta), 'cuándo') THEN 'es' ELSE 'ca' END AS idioma,
  CASE WHEN valida THEN fechas END AS fechas,
  CASE WHEN valida AND semana THEN as_of END AS fecha_inicio,
  CASE WHEN valida AND semana THEN {sunday} END AS fecha_fin,
  CASE WHEN NOT valida THEN NULL WHEN km IS NOT NULL THEN CAST(km AS INTEGER)
       WHEN regexp_matches(t, '\\b(cerca|alrededores|a la redonda|prop|voltants|a la rodona)\\b') THEN 20 END AS radio_km,
  CASE WHEN valida THEN coalesce(categorias, '') ELSE '' END AS categorias, pregunta AS conceptos,
  CASE WHEN valida AND regexp_matches(t, '\\b(gratis|gratuit[oa]?s?|gratuites)\\b') THEN true END AS es_gratuito,
  CASE WHEN valida THEN CAST(replace(CASE WHEN regexp_matches(limite, '^\\d+(\\.\\d{{3}})+') THEN replace(limite, '.', '') ELSE limite END,
    ',', '.') AS DOUBLE) END AS precio_max
FROM (SELECT *, coalesce(km, 0) <= 100 AS valida, fechas IS NULL AND regexp_matches(t, '\\b(esta semana|aquesta setmana)\\b') AS semana
  FROM (SELECT *, CASE
      WHEN regexp_matches(t, '\\b(fin de semana|cap de setmana)\\b')
        THEN {iso.format(saturday)} || ',' || {iso.format(saturday + " + 1")}
      WHEN regexp_matches(t, '\\b(este sabado|aquest dissabte)\\b') THEN {iso.format(saturday)}
      WHEN regexp_matches(t, '\\b(manana|dema)\\b') THEN {iso.format("as_of + 1")}
      WHEN regexp_matches(t, '\\b(hoy|avui)\\b') THEN {iso.format("as_of")} END AS fechas,
      CAST(nullif(replace(regexp_extract(t, '(?:^|[^\\d.,])(\\d{{1,3}}(?:\\.\\d{{3}})+|\\d+)\\s*(?:km|kilometros?|quilometres?)\\b', 1), '.', ''), '') AS HUGEINT) AS km,
      {limit} AS limite,
      (SELECT string_agg(slug, ',' ORDER BY slug) FROM categorias
       WHERE contains({_words('pregunta')}, {_words('nombre_es')})
          OR contains({_words('pregunta')}, {_words('nombre_cat')})) AS categorias
    FROM (SELECT *, strip_accents(lower(pregunta)) AS t FROM (
      SELECT conv_id, turn, text || ' ' || [{endings}][CAST((conv_id + turn) % {len(QUESTION_ENDINGS)} AS INTEGER) + 1] AS pregunta,
             DATE '2024-01-01' + CAST(conv_id % 7 AS INTEGER) AS as_of FROM conversations))))""",
    )


def _twice(table: str, again: str) -> str:
    return f"SELECT * FROM {table} UNION ALL SELECT * FROM {table} WHERE {again}"


_DAMAGED = {
    "d_ciudades": """SELECT id_ciudad, nombre FROM ciudades WHERE id_ciudad % 6 <> 0
  UNION ALL SELECT id_ciudad + 100, replace(lower(nombre), 'a', 'á') FROM ciudades
  WHERE id_ciudad % 6 <> 0 AND id_ciudad % 4 = 1""",
    "d_codigos_postales": _twice("codigos_postales", "CAST(cp AS BIGINT) % 9 = 0"),
    "d_categorias": """SELECT id_categoria, slug FROM categorias WHERE id_categoria <> 2
  UNION ALL SELECT id_categoria + 100, upper(slug) FROM categorias WHERE id_categoria <> 2 AND id_categoria % 3 = 0""",
    "d_fuentes_familia": _twice("fuentes_familia", "CAST(id_familia AS BIGINT) % 4 = 0"),
    "d_eventos_master": """
  SELECT id_unico_evento, clave, CASE WHEN clave % 41 = 0 THEN 'ROBOT' ELSE metodo_ingesta END AS metodo_ingesta,
         CASE WHEN clave % 43 = 0 THEN 'OTRA' ELSE fuente_id END AS fuente_id,
         CASE WHEN clave % 19 = 0 THEN 'BORRADOR' ELSE estado END AS estado,
         CASE WHEN clave % 47 = 0 THEN 'NADIE' WHEN clave % 3 = 0 THEN 'PUBLICO' WHEN clave % 3 = 1 THEN 'PRIVADO' END
           AS tipo_organizador,
         CASE WHEN clave % 23 <> 0 THEN cp_evento END AS cp_evento, id_ciudad, id_familia, poblacion_nombre, es_gratuito,
         CASE WHEN clave % 29 <> 0 THEN titulo_es END AS titulo_es
  FROM eventos JOIN (VALUES (0), (1)) c(copia) ON copia = 0 OR clave % 7 = 0
  WHERE clave % 13 <> 0""",
    "d_evento_categorias": f"""
  SELECT {_EVENT.format('l_orderkey')} AS id_unico_evento, id_categoria
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN categorias ON p_type = nombre_es""",
    "d_evento_horarios": _twice("horarios", "id_horario % 11 = 0"),
    "d_binarios_storage": _twice("binarios", "id_binario % 5 = 0"),
    "d_auditoria_scraping": _twice(
        "(SELECT * REPLACE (CASE WHEN id_auditoria % 31 = 0 THEN 'FATAL' ELSE resultado END AS resultado) FROM auditoria)",
        "id_auditoria % 37 = 0",
    ),
}


def _damaged(body: str) -> str:
    base = with_tables(
        "ciudades codigos_postales categorias fuentes_familia eventos horarios binarios auditoria", ""
    )
    parts = [f"{name} AS MATERIALIZED ({text})" for name, text in _DAMAGED.items()]
    return f"{base.rstrip()},\n" + ",\n".join(parts) + "\n" + body


def _orphans() -> str:
    rules = [
        ("codigos_postales", "id_ciudad", "ciudades", "id_ciudad"),
        ("fuentes_familia", "id_ciudad", "ciudades", "id_ciudad"),
        ("eventos_master", "cp_evento", "codigos_postales", "cp"),
        ("eventos_master", "id_ciudad", "ciudades", "id_ciudad"),
        ("eventos_master", "id_familia", "fuentes_familia", "id_familia"),
        ("evento_categorias", "id_unico_evento", "eventos_master", "id_unico_evento"),
        ("evento_categorias", "id_categoria", "categorias", "id_categoria"),
        ("evento_horarios", "id_unico_evento", "eventos_master", "id_unico_evento"),
        ("binarios_storage", "id_unico_evento", "eventos_master", "id_unico_evento"),
        ("auditoria_scraping", "id_unico_evento", "eventos_master", "id_unico_evento"),
    ]
    parts = [
        f"SELECT '{table}' AS tabla, '{column}' AS columna, CAST({column} AS VARCHAR) AS valor, count(*) AS filas "
        f"FROM d_{table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM d_{parent}) GROUP BY {column}"
        for table, column, parent, key in rules
    ]
    return _damaged("\nUNION ALL\n".join(parts))


def _duplicates() -> str:
    keys = [
        ("ciudades", ["id_ciudad"]), ("codigos_postales", ["cp"]), ("categorias", ["id_categoria"]),
        ("fuentes_familia", ["id_familia"]), ("eventos_master", ["id_unico_evento"]),
        ("evento_categorias", ["id_unico_evento", "id_categoria"]), ("evento_horarios", ["id_horario"]),
        ("binarios_storage", ["id_binario"]), ("auditoria_scraping", ["id_auditoria"]),
    ]
    parts = []
    for table, columns in keys:
        value = " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
        parts.append(
            f"SELECT '{table}' AS tabla, '{'/'.join(columns)}' AS columnas, {value} AS clave, count(*) AS filas "
            f"FROM d_{table} GROUP BY 3 HAVING count(*) > 1"
        )
    parts += [
        f"SELECT '{table}', '{column}', min({column}), count(*) FROM d_{table} "
        f"GROUP BY strip_accents(lower({column})) HAVING count(*) > 1"
        for table, column in [("ciudades", "nombre"), ("categorias", "slug")]
    ]
    return _damaged("\nUNION ALL\n".join(parts))


def _violations() -> str:
    required = {
        "ciudades": "id_ciudad nombre",
        "codigos_postales": "cp latitud longitud",
        "categorias": "id_categoria nombre_es nombre_cat slug orden activo",
        "fuentes_familia": "id_familia id_ciudad nombre_entidad url_raiz_global",
        "eventos_master": "id_unico_evento metodo_ingesta fuente_id estado cp_evento poblacion_nombre titulo_es es_gratuito",
        "evento_categorias": "id_unico_evento id_categoria",
        "evento_horarios": "id_horario id_unico_evento fecha_inicio",
        "binarios_storage": "id_binario id_unico_evento nombre_archivo tipo_archivo url_almacenamiento_nube fecha_sincronizacion",
        "auditoria_scraping": "id_auditoria resultado fecha_ejecucion",
    }
    # columns the damaged tables above leave out are never NULL
    whole = {"nombre_es", "nombre_cat", "orden", "activo", "url_raiz_global", "nombre_archivo",
             "url_almacenamiento_nube", "fecha_sincronizacion", "fecha_ejecucion"}
    domains = {
        ("eventos_master", "metodo_ingesta"): "'SCRAPING', 'MANUAL'",
        ("eventos_master", "fuente_id"): "'URL_ESTRUCTURAL', 'SOCIAL_VISUAL', 'SOCIAL_SEMANTICA'",
        ("eventos_master", "estado"): "'ACTIVO', 'CANCELADO', 'APLAZADO'",
        ("eventos_master", "tipo_organizador"): "'PUBLICO', 'PRIVADO', 'ASOCIACION'",
        ("binarios_storage", "tipo_archivo"): "'PDF', 'JPG', 'JPEG', 'PNG', 'WEBP', 'DOCX'",
        ("auditoria_scraping", "resultado"): "'OK', 'WARNING', 'ERROR'",
    }
    rules = [
        (table, column, "nulo", "false" if column in whole else f"{column} IS NULL")
        for table, columns in required.items()
        for column in columns.split()
    ]
    rules += [(table, column, "dominio", f"{column} NOT IN ({values})") for (table, column), values in domains.items()]
    parts = [
        f"SELECT '{table}' AS tabla, '{column}' AS columna, '{rule}' AS regla, "
        f"count(*) FILTER (WHERE {test}) AS filas FROM d_{table}"
        for table, column, rule, test in rules
    ]
    return _damaged("\nUNION ALL\n".join(parts))


def statements() -> dict[str, str]:
    names = "CASE WHEN len(s.fechas) > 0 THEN list_contains(s.fechas, f.fecha_inicio) ELSE true END"
    by_range = (
        "f.fecha_inicio >= coalesce(s.fecha_inicio, f.fecha_inicio)"
        " AND f.fecha_inicio <= coalesce(s.fecha_fin, f.fecha_inicio)"
    )
    distance = _haversine("lat0", "lng0", "latitud", "longitud")
    category_names = """coalesce((SELECT string_agg(DISTINCT CASE WHEN r.idioma = 'es' THEN nombre_es ELSE nombre_cat END,
    ',' ORDER BY CASE WHEN r.idioma = 'es' THEN nombre_es ELSE nombre_cat END)
    FROM evento_categorias ec JOIN categorias USING (id_categoria)
    WHERE ec.id_unico_evento = r.id_unico_evento), '')"""
    midnight = "CASE WHEN hora_inicio <> '00:00:00' THEN hora_inicio END"
    semantic = """SELECT request_id, orden, id_unico_evento, fecha_inicio, round(score, 3) + 0e0 AS score
FROM ordenadas WHERE con_conceptos AND hay = {}"""
    trim_set = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(8195)"
    given = """'{"idioma":"' || CASE WHEN conv_id % 2 = 0 THEN 'es' ELSE 'ca' END || '","radio_km":' ||
      CAST(conv_id % 130 AS VARCHAR) || ',"categorias":["Música","x' || CAST(conv_id % 3 AS VARCHAR) || '"],' """
    return {
        "active_events_by_start": with_tables(
            "filas",
            "\nUNION ALL\n".join(
                f"""SELECT id_unico_evento, titulo_{suffix} AS titulo, desc_larga_{suffix} AS descripcion_corta,
  desc_larga_{suffix} AS descripcion_larga, cp_evento, poblacion_nombre, lugar_nombre,
  direccion_fisica AS direccion_completa, fecha_inicio, fecha_fin, hora_inicio, hora_fin, es_gratuito,
  precio_euros, link_entradas_inscripcion AS url_evento, imagen_principal_url AS url_imagen,
  tags_{suffix} AS tags_json, latitud, longitud, '{language}' AS idioma
FROM filas"""
                for language, suffix in (("es", "es"), ("ca", "cat"))
            ),
        ),
        "batch_prefilter_top50": candidates(),
        "unknown_origin_unfiltered": candidates(where="request_id < 0"),
        "postcodes_in_radius": with_tables(
            "alcance",
            """SELECT cp_usuario AS cp_origen, radio_km, cp, round(distancia_km, 2) AS distancia_km
FROM alcance""",
        ),
        "stored_postcodes_in_radius": with_tables(
            "alcance",
            """SELECT cp_usuario AS cp_origen, radio_km, cp, round(distancia_km, 2) AS distancia_km
FROM alcance""",
        ),
        "origin_coordinates": with_tables(
            "solicitudes codigos_postales",
            """SELECT request_id, cp_usuario, latitud, longitud
FROM solicitudes LEFT JOIN codigos_postales ON cp = cp_usuario""",
        ),
        "event_distance": with_tables(
            "eventos codigos_postales",
            f"""SELECT id_unico_evento, o.cp AS cp_usuario,
  {_haversine("o.latitud", "o.longitud", "d.latitud", "d.longitud")} AS distancia_km
FROM eventos e JOIN (SELECT id_ciudad, min(cp) AS cp FROM codigos_postales GROUP BY 1) c
  ON e.id_ciudad = c.id_ciudad
JOIN codigos_postales o ON o.cp = c.cp JOIN codigos_postales d ON d.cp = e.cp_evento""",
        ),
        "category_semi_join": candidates(CONDITIONS["categoria"]),
        "date_list_filter": candidates(names),
        "date_range_filter": candidates(by_range),
        "price_filters": candidates(CONDITIONS["precio"]),
        "cosine_scores": with_tables(
            "puntuadas",
            "SELECT request_id, id_unico_evento, round(score, 3) + 0e0 AS score FROM puntuadas",
            candidatas=f"""SELECT o_custkey AS request_id, e.*
  FROM eventos e JOIN orders o ON e.clave = o.o_orderkey""",
        ),
        "semantic_threshold": with_tables("ordenadas", semantic.format(1)),
        "semantic_fallback_top10": with_tables("ordenadas", semantic.format(0)),
        "search_results": _results("''", distance, midnight),
        "search_results_categories": _results(
            category_names,
            f"CASE WHEN {distance} <> 0 THEN {distance} END",
            f"regexp_replace({midnight}, '^0', '')",
        ),
        "search_envelope": with_tables(
            "resultados solicitudes",
            """SELECT s.request_id, s.idioma AS idioma_respuesta, CAST(coalesce(total, 0) AS INTEGER) AS total,
  CASE WHEN total IS NULL AND s.idioma = 'ca'
         THEN 'Ho sento, no he trobat cap esdeveniment que coincideixi amb la teva cerca.'
       WHEN total IS NULL THEN 'Lo siento, no he encontrado ningún evento que coincida con tu búsqueda.'
       WHEN s.idioma = 'ca' THEN 'He trobat ' || CAST(total AS VARCHAR) || ' esdeveniments per a tu.'
       ELSE 'He encontrado ' || CAST(total AS VARCHAR) || ' eventos para ti.' END AS respuesta_texto,
  coalesce(eventos, '') AS eventos, coalesce(resumen, '') AS resumen
FROM solicitudes s LEFT JOIN (
  SELECT request_id, count(*) AS total,
    string_agg(CAST(rank AS VARCHAR) || '. ' || titulo || ' - ' || poblacion_nombre || ' ('
      || strftime(fecha_inicio, '%Y-%m-%d') || ')' || CASE WHEN es_gratuito THEN ' [GRATUITO]' ELSE '' END,
      chr(10) ORDER BY rank) FILTER (WHERE rank <= 5) AS resumen
  FROM resultados GROUP BY request_id) r USING (request_id)
LEFT JOIN (""" + _event_texts(_results("''", distance, midnight)) + ") t USING (request_id)",
        ),
        "search_debug": with_tables(
            "ordenadas",
            """SELECT s.request_id, radio_km, s.idioma, s.fecha_inicio, s.fecha_fin, s.es_gratuito, s.precio_max,
  array_to_string(list_transform(s.fechas, lambda d: strftime(d, '%Y-%m-%d')), ',') AS fechas,
  array_to_string(s.categorias, ',') AS categorias,
  CASE WHEN s.con_conceptos THEN 'concepto ' || CAST(s.k % 7 AS VARCHAR) || ' fiesta' ELSE '' END AS texto_consulta,
  coalesce(codigos, '') AS codigos_postales,
  CAST(coalesce(n, 0) AS INTEGER) AS num_codigos,
  coalesce(antes, 0) AS eventos_pre_filtrado, coalesce(despues, 0) AS eventos_post_semantica
FROM solicitudes s
LEFT JOIN (SELECT l.request_id, string_agg(l.cp, ',' ORDER BY round(distancia_km, 3), l.cp) AS codigos, count(l.cp) AS n
           FROM lugares l JOIN solicitudes USING (request_id)
           LEFT JOIN alcance a ON a.cp_usuario = solicitudes.cp_usuario AND a.radio_km = solicitudes.radio_km AND a.cp = l.cp
           GROUP BY 1) USING (request_id)
LEFT JOIN (SELECT request_id, count(*) AS antes FROM candidatas GROUP BY 1) USING (request_id)
LEFT JOIN (SELECT request_id, count(*) AS despues FROM ordenadas GROUP BY 1) USING (request_id)
WHERE s.debug""",
        ),
        "complete_events_view": with_tables(
            "eventos horarios codigos_postales evento_categorias",
            """SELECT e.* EXCLUDE (clave, v_es, v_cat), fecha_inicio, fecha_fin, hora_inicio, hora_fin,
  latitud AS cp_latitud, longitud AS cp_longitud, categorias_es, categorias_cat, categorias_slugs
FROM eventos e JOIN horarios h USING (id_unico_evento) JOIN codigos_postales p ON e.cp_evento = p.cp
LEFT JOIN (SELECT id_unico_evento,
    string_agg(DISTINCT nombre_es, ', ' ORDER BY nombre_es) AS categorias_es,
    string_agg(DISTINCT nombre_cat, ', ' ORDER BY nombre_cat) AS categorias_cat,
    string_agg(DISTINCT slug, ',' ORDER BY slug) AS categorias_slugs
  FROM evento_categorias JOIN categorias USING (id_categoria) GROUP BY 1) c USING (id_unico_evento)
WHERE estado = 'ACTIVO'""",
        ),
        "category_catalog": with_tables(
            "categorias",
            """SELECT id_categoria AS id, nombre_es AS nombre, slug, orden, 'es' AS idioma FROM categorias WHERE activo
UNION ALL SELECT id_categoria, nombre_cat, slug, orden, 'ca' FROM categorias WHERE activo""",
        ),
        "upsert_events": with_tables(
            "eventos",
            """SELECT id_unico_evento,
  CASE WHEN clave % 2 = 0 THEN 'Otro ' ELSE 'Nuevo ' END || CAST(clave AS VARCHAR) AS titulo_es,
  CASE WHEN clave % 3 = 0 THEN 'Nou' ELSE titulo_cat END AS titulo_cat, precio_euros, estado
FROM eventos""",
        ),
        "upsert_postcodes": with_tables(
            "codigos_postales",
            f"""SELECT cp, id_ciudad, latitud + 0.5e0 AS latitud, longitud FROM codigos_postales
UNION ALL SELECT 'n' || {_PAD.format('s_suppkey', 4)}, s_nationkey, 41.5e0, 2.5e0 FROM supplier""",
        ),
        "upsert_cities": with_tables(
            "ciudades",
            """SELECT id_ciudad, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 2 = 0
      AND 'NATION_' || CAST(s_nationkey AS VARCHAR) = nombre)
    THEN replace(nombre, 'NATION_', 'nátion_') ELSE nombre END AS nombre, provincia
FROM ciudades
UNION ALL
SELECT CAST(min(s_suppkey) + 1000 AS INTEGER), 'Villa ' || CAST(s_suppkey % 9 AS VARCHAR), 'NUEVA'
FROM supplier WHERE s_suppkey % 2 <> 0 GROUP BY s_suppkey % 9""",
        ),
        "insert_missing_event_categories": with_tables(
            "evento_categorias", "SELECT * FROM evento_categorias"
        ),
        "append_schedules": with_tables(
            "horarios",
            """SELECT id_horario, id_unico_evento, fecha_inicio, fecha_fin, hora_inicio, hora_fin FROM horarios
UNION ALL
SELECT (SELECT max(id_horario) FROM horarios) + row_number() OVER (ORDER BY sha256(concat_ws('|',
    '=' || id_unico_evento, '=' || CAST(fecha_inicio + 364 AS VARCHAR), '=' || CAST(fecha_fin AS VARCHAR),
    coalesce('=' || hora_inicio, '-'), coalesce('=' || hora_fin, '-'), '=0'))),
  id_unico_evento, fecha_inicio + 364, fecha_fin, hora_inicio, hora_fin FROM horarios""",
        ),
        "event_keys": with_tables(
            "eventos",
            """SELECT id_unico_evento,
  sha256(titulo_es || strftime(fecha_creacion, '%Y-%m-%d') || CAST(id_ciudad AS VARCHAR)) AS clave,
  sha256(titulo_es || strftime(fecha_creacion + 60, '%Y-%m-%d') || CAST(id_ciudad AS VARCHAR)) AS clave_posterior,
  strftime(fecha_creacion + 60, '%Y-%m-%d') AS fecha_posterior
FROM eventos""",
        ),
        "event_texts": with_tables(
            "eventos evento_categorias",
            """SELECT id_unico_evento, id_categoria, titulo_es || ' - ' || poblacion_nombre AS titulo,
  'Evento de ' || lower(nombre_es) || ' en ' || poblacion_nombre AS desc_es,
  'Esdeveniment de ' || lower(nombre_cat) || ' a ' || poblacion_nombre AS desc_cat
FROM evento_categorias JOIN categorias USING (id_categoria) JOIN eventos USING (id_unico_evento)""",
        ),
        "left_out_rows": with_tables(
            "ordenadas",
            """SELECT request_id, orden, id_unico_evento, idioma FROM ordenadas
WHERE idioma <> 'es' AND tags_cat = 'null'""",
        ),
        "events_loaded": with_tables("eventos", "SELECT count(*) AS total FROM eventos"),
        "tags_json_roundtrip": with_tables(
            "eventos",
            """SELECT id_unico_evento, 'cat' AS idioma, tags_cat <> 'null' AS convertible,
  CASE WHEN tags_cat = '' THEN 0 WHEN tags_cat <> 'null' THEN 2 END AS num_tags,
  CASE WHEN tags_cat = '' THEN '[]' WHEN tags_cat <> 'null' THEN tags_cat END AS tags_json
FROM eventos
UNION ALL
SELECT id_unico_evento, 'es', true, CASE WHEN tags_es IS NULL THEN 0 ELSE 2 END, coalesce(tags_es, '[]') FROM eventos""",
        ),
        "fk_orphans": _orphans(),
        "key_duplicates": _duplicates(),
        "null_and_enum_violations": _violations(),
        "cascade_delete": with_tables(
            "eventos horarios evento_categorias",
            """SELECT 'evento_horarios' AS tabla, id_unico_evento, id_horario AS id FROM horarios
WHERE id_unico_evento NOT IN (SELECT id_unico_evento FROM eventos WHERE estado = 'CANCELADO')
UNION ALL
SELECT 'evento_categorias', id_unico_evento, CAST(id_categoria AS BIGINT) FROM evento_categorias
WHERE id_unico_evento NOT IN (SELECT id_unico_evento FROM eventos WHERE estado = 'CANCELADO')""",
        ),
        "set_null_delete": with_tables(
            "eventos auditoria",
            """SELECT id_auditoria, resultado, CASE WHEN id_unico_evento NOT IN
  (SELECT id_unico_evento FROM eventos WHERE estado = 'CANCELADO') THEN id_unico_evento END AS id_unico_evento
FROM auditoria""",
        ),
        "restricted_delete": with_tables(
            "ciudades codigos_postales fuentes_familia eventos evento_categorias",
            "\nUNION ALL\n".join(
                f"SELECT '{parent}' AS padre, '{name}' AS tabla, CAST({column} AS VARCHAR) AS valor, count(*) AS filas "
                f"FROM {source} WHERE {column} IN (SELECT {key} FROM {parent} WHERE {which}) GROUP BY {column}"
                for parent, key, which, name, source, column in [
                    ("ciudades", "id_ciudad", "provincia = 'ASIA'", "codigos_postales", "codigos_postales", "id_ciudad"),
                    ("ciudades", "id_ciudad", "provincia = 'ASIA'", "fuentes_familia", "fuentes_familia", "id_ciudad"),
                    ("ciudades", "id_ciudad", "provincia = 'ASIA'", "eventos_master", "eventos", "id_ciudad"),
                    ("codigos_postales", "cp", "CAST(cp AS BIGINT) % 10 = 7", "eventos_master", "eventos", "cp_evento"),
                    ("fuentes_familia", "id_familia", "CAST(id_familia AS BIGINT) % 5 = 0", "eventos_master", "eventos", "id_familia"),
                    ("categorias", "id_categoria", "id_categoria = 1", "evento_categorias", "evento_categorias", "id_categoria"),
                ]
            ),
        ),
        "column_defaults": with_tables(
            "categorias eventos horarios binarios auditoria",
            """SELECT 'categorias' AS tabla, CAST(id_categoria AS VARCHAR) AS clave,
  CAST(CASE WHEN id_categoria % 2 = 0 THEN orden ELSE 0 END AS VARCHAR) || '/true' AS valores FROM categorias
UNION ALL SELECT 'eventos_master', id_unico_evento, estado || '/false/true' FROM eventos
UNION ALL SELECT 'evento_horarios', CAST(id_horario AS VARCHAR), 'false' FROM horarios
UNION ALL SELECT 'binarios_storage', CAST(id_binario AS VARCHAR), 'true' FROM binarios
UNION ALL SELECT 'auditoria_scraping', CAST(id_auditoria AS VARCHAR),
  CASE WHEN resultado = 'WARNING' THEN 'OK' ELSE resultado END || '/true' FROM auditoria""",
        ),
        "embedding_dimension": with_tables(
            "eventos vectores",
            "\nUNION ALL\n".join(
                f"""SELECT 'tags_embedding_{name}' AS columna, CAST(len(v) AS INTEGER) AS dimension, count(*) AS filas,
  len(v) = 64 AS correcta FROM eventos JOIN vectores ON v_{name} = vec_id GROUP BY len(v)"""
                for name in ("es", "cat")
            ),
        ),
        "json_vectors": """SELECT vec_id, CASE WHEN vec_id % 7 NOT IN (1, 2, 3, 4) THEN CAST(len(embedding) AS INTEGER) END AS dimension,
  CASE WHEN vec_id % 7 NOT IN (1, 2, 3, 4) THEN round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]),
    CAST(embedding AS DOUBLE[]))), 3) + 0e0 END AS norma
FROM embeddings""",
        "upsert_categories": with_tables(
            "categorias",
            """SELECT id_categoria, nombre_es || CASE WHEN id_categoria % 2 = 0 THEN ' nuevo' ELSE '' END AS nombre_es,
  CASE WHEN id_categoria % 2 = 0 THEN 'nou' ELSE nombre_cat END AS nombre_cat, slug, orden, activo FROM categorias
UNION ALL SELECT 500, 'Otra', 'Altra', 'otra', orden, true FROM categorias WHERE id_categoria = 1""",
        ),
        "load_batch_tables": _loaded(),
        "published_load": _loaded(),
        "refreshed_view": _refreshed(),
        "stored_stream_candidates": candidates(),
        "paged_candidates": candidates(),
        "events_view_by_town": with_tables(
            "eventos horarios codigos_postales evento_categorias",
            """SELECT poblacion_nombre, categorias_slugs, count(*) AS filas, min(fecha_inicio) AS primera
FROM eventos e JOIN horarios h USING (id_unico_evento) JOIN codigos_postales p ON e.cp_evento = p.cp
LEFT JOIN (SELECT id_unico_evento, string_agg(DISTINCT slug, ',' ORDER BY slug) AS categorias_slugs
  FROM evento_categorias JOIN categorias USING (id_categoria) GROUP BY 1) c USING (id_unico_evento)
WHERE estado = 'ACTIVO' AND es_gratuito GROUP BY 1, 2""",
        ),
        "request_validation": f"""SELECT conv_id, turn, trim(q, {trim_set}) AS pregunta, cp_usuario,
  CASE WHEN q IS NULL THEN 'pregunta ausente' WHEN length(q) < 3 THEN 'pregunta corta'
       WHEN length(q) > 500 THEN 'pregunta larga' WHEN trim(q, {trim_set}) = '' THEN 'pregunta en blanco'
       WHEN cp_usuario IS NULL THEN 'cp ausente'
       WHEN NOT regexp_full_match(cp_usuario, '[0-9]{{5}}') THEN 'cp invalido' END AS motivo
FROM (SELECT conv_id, turn,
    CASE WHEN turn % 5 = 1 THEN substr(text, 1, 2)
         WHEN turn % 5 = 2 THEN '  ' || chr(9) || text || ' ' || chr(10) || chr(160)
         WHEN turn % 5 = 3 THEN '   ' || chr(8195) || chr(10)
         WHEN conv_id % 11 <> 5 THEN text END AS q,
    CASE WHEN conv_id % 7 = 1 THEN substr(c, 3, 3) WHEN conv_id % 7 = 2 THEN c || chr(10)
         WHEN conv_id % 7 = 3 THEN 'x' || substr(c, 2, 4) WHEN conv_id % 21 <> 4 THEN c END AS cp_usuario
  FROM (SELECT *, {_CP.format('conv_id')} AS c FROM conversations))""",
        "parameter_validation": """SELECT conv_id, turn, ok AS extraidos,
  CASE WHEN p >= 15 THEN 'es' WHEN ok THEN CASE WHEN conv_id % 2 = 0 THEN 'es' ELSE 'ca' END
       WHEN contains(lower(text), 'qué') OR contains(lower(text), 'dónde') OR contains(lower(text), 'cuándo')
       THEN 'es' ELSE 'ca' END AS idioma,
  CASE WHEN p = 17 THEN DATE '2024-05-03' WHEN p < 7 AND ok THEN DATE '2024-05-01' + CAST(conv_id % 28 AS INTEGER) END AS fecha_inicio,
  CAST(NULL AS DATE) AS fecha_fin,
  CASE WHEN p = 15 THEN 20 WHEN p < 7 AND ok THEN CAST(conv_id % 130 AS INTEGER) END AS radio_km,
  CASE WHEN p < 7 AND ok THEN 'Música,x' || CAST(conv_id % 3 AS VARCHAR) ELSE '' END AS categorias,
  CASE WHEN ok THEN '' ELSE text END AS conceptos,
  CASE WHEN p = 17 OR p < 7 AND ok AND conv_id % 3 = 0 THEN true END AS es_gratuito,
  CASE WHEN p = 16 THEN 12.5e0 WHEN p < 7 AND ok THEN CAST(conv_id % 40 - 5 AS DOUBLE) + 0.5e0 END AS precio_max
FROM (SELECT *, conv_id % 18 AS p, conv_id % 18 >= 15 OR
        conv_id % 18 < 7 AND conv_id % 130 <= 100 AND conv_id % 40 >= 5 AS ok FROM conversations)""",
        "annotate_questions": _annotation(),
    }
