"""A catalog and request tables made from the order tables of a data folder.

Orders stand for events, line items for their schedules, customers for
postcodes and for people asking, part types for categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoca.functions.text import padded
from convoca.sources.catalog import Catalog


class DriverTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    # --- catalog

    def ciudades(self) -> DataFrame:
        region = self.table("region").select("r_regionkey", F.col("r_name").alias("provincia"))
        return (
            self.table("nation")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("id_ciudad"), F.col("n_name").alias("nombre"), "provincia")
        )

    def codigos_postales(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            _cp(k).alias("cp"),
            F.col("c_nationkey").alias("id_ciudad"),
            (40 + ((k * 7919) % 10000).cast("double") / 5000).alias("latitud"),
            (1 + ((k * 104729) % 10000).cast("double") / 4000).alias("longitud"),
        )

    def categorias(self) -> DataFrame:
        # a closed list: the kinds are grouped first, then numbered
        kinds = self.table("part").groupBy("p_type").agg(F.min("p_partkey"))
        numbered = kinds.selectExpr(
            "p_type",
            "cast(row_number() over (order by p_type) as int) as id_categoria",
            "cast(row_number() over (order by p_type desc) as int) as orden",
        )
        return numbered.select(
            "id_categoria",
            F.col("p_type").alias("nombre_es"),
            F.concat("p_type", F.lit(" CAT")).alias("nombre_cat"),
            F.lower("p_type").alias("slug"),
            "orden",
            (F.col("p_type") != "SMALL").alias("activo"),
        )

    def eventos_master(self) -> DataFrame:
        key = F.col("o_orderkey")
        free = key % 5 < 3
        price = F.when(key % 20 != 3, F.floor(F.col("o_totalprice") / 100).cast("double") / 100).otherwise(0.0)
        state = (
            F.when(F.col("o_orderstatus") == "F", "ACTIVO")
            .when(F.col("o_orderstatus") == "O", "APLAZADO")
            .otherwise("CANCELADO")
        )
        tags = F.concat(
            F.lit('["#'),
            F.lower(F.substring("o_orderpriority", 3, 100)),
            F.lit('","#k'),
            (key % 7).cast("string"),
            F.lit('"]'),
        )
        home = (
            self.table("customer")
            .select("c_custkey", "c_nationkey")
            .join(
                self.table("nation").select("n_nationkey", "n_name"),
                F.col("c_nationkey") == F.col("n_nationkey"),
            )
        )
        return (
            self.table("orders")
            .join(home, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                event_id(key).alias("id_unico_evento"),
                F.lit("MANUAL").alias("metodo_ingesta"),
                F.lit("URL_ESTRUCTURAL").alias("fuente_id"),
                state.alias("estado"),
                F.col("c_nationkey").alias("id_ciudad"),
                _cp(F.col("o_custkey")).alias("cp_evento"),
                F.col("n_name").alias("poblacion_nombre"),
                F.concat(F.lit("Lugar "), (key % 100).cast("string")).alias("lugar_nombre"),
                F.concat(F.lit("Calle "), (key % 1000).cast("string")).alias("direccion_fisica"),
                F.concat(F.lit("Evento "), key.cast("string")).alias("titulo_es"),
                F.concat(F.lit("Esdeveniment "), key.cast("string")).alias("titulo_cat"),
                F.concat(F.lit("Descripción "), key.cast("string")).alias("desc_larga_es"),
                F.concat(F.lit("Descripció "), key.cast("string")).alias("desc_larga_cat"),
                F.when(key % 11 != 0, tags).alias("tags_es"),
                F.when(key % 13 == 0, "null")
                .when(key % 17 == 0, "")
                .otherwise(tags)
                .alias("tags_cat"),
                free.alias("es_gratuito"),
                F.when(~free, price).alias("precio_euros"),
                F.when(key % 3 == 0, F.concat(F.lit("https://ejemplo.cat/e/"), key.cast("string")))
                .alias("link_entradas_inscripcion"),
                F.lit(None).cast("string").alias("imagen_principal_url"),
                F.col("o_orderdate").cast("date").alias("fecha_creacion"),
                (key % 130).cast("string").alias("id_familia"),
            )
        )

    def evento_vectores(self) -> DataFrame:
        """Embeddings of the events in both languages; one event in ten has none."""
        number = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey"))
        orders = self.table("orders").select(
            event_id(F.col("o_orderkey")).alias("id_unico_evento"),
            (number % 500).alias("es"),
            ((number + 1) % 500).alias("cat"),
        )
        vectors = self.table("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("v")
        )
        return orders.join(
            vectors.toDF("es", "tags_embedding_es"), "es", "left"
        ).join(vectors.toDF("cat", "tags_embedding_cat"), "cat", "left").select(
            "id_unico_evento", "tags_embedding_es", "tags_embedding_cat"
        )

    def evento_horarios(self) -> DataFrame:
        """Schedules; some are stored twice, under two ids."""
        line = self.table("lineitem").select(
            "*", F.explode(F.when(F.col("l_orderkey") % 50 == 0, F.array(F.lit(0), F.lit(1)))
                           .otherwise(F.array(F.lit(0)))).alias("copia")
        )
        start = F.col("l_shipdate").cast("date")
        identity = F.concat_ws(
            "|",
            *(F.col(c).cast("string") for c in (
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
            F.date_format(start, "yyyy-MM-dd"),
            F.floor("l_quantity").cast("string"),
            F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("string"),
            F.col("copia").cast("string"),
        )
        minutes = F.when(F.col("l_suppkey") % 2 == 0, ":00:00").otherwise(":30:00")
        hour = F.concat(
            F.lpad((9 + F.col("l_partkey") % 13).cast("string"), 2, "0"), minutes
        )
        return line.select(
            F.conv(F.substring(F.sha2(identity, 256), 1, 15), 16, 10)
            .cast("bigint")
            .alias("id_horario"),
            event_id(F.col("l_orderkey")).alias("id_unico_evento"),
            start.alias("fecha_inicio"),
            F.date_add(start, (F.col("l_linenumber") % 3).cast("int")).alias("fecha_fin"),
            F.when(F.col("l_linenumber") == 6, "00:00:00").when(F.col("l_linenumber") != 7, hour).alias("hora_inicio"),
            F.lit(None).cast("string").alias("hora_fin"),
        )

    def evento_categorias(self) -> DataFrame:
        kind = self.table("part").select("p_partkey", F.col("p_type").alias("nombre_es"))
        number = self.categorias().select("nombre_es", "id_categoria")
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_partkey")
            .join(kind.join(number, "nombre_es"), F.col("l_partkey") == F.col("p_partkey"))
            .select(event_id(F.col("l_orderkey")).alias("id_unico_evento"), "id_categoria")
            .distinct()
        )

    def fuentes_familia(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").cast("string").alias("id_familia"),
            F.col("s_nationkey").alias("id_ciudad"),
            F.col("s_name").alias("nombre_entidad"),
            F.concat(F.lit("https://ejemplo.cat/"), F.col("s_suppkey").cast("string")).alias(
                "url_raiz_global"
            ),
        )

    def auditoria_scraping(self) -> DataFrame:
        result = (
            F.when(F.col("event_type") == "error", "ERROR")
            .when(F.col("event_type") == "view", "WARNING")
            .otherwise("OK")
        )
        return self.table("events").select(
            F.col("event_id").alias("id_auditoria"),
            event_id(F.col("event_id")).alias("id_unico_evento"),
            result.alias("resultado"),
            F.col("props").alias("payload_extra"),
            F.col("ts").alias("fecha_ejecucion"),
        )

    def binarios_storage(self) -> DataFrame:
        """A file per part, of the event whose number it has."""
        key = F.col("p_partkey")
        kinds = F.array(*[F.lit(k) for k in ("PDF", "JPG", "PNG", "WEBP", "DOCX", "EXE")])
        return self.table("part").select(
            key.alias("id_binario"),
            event_id(key).alias("id_unico_evento"),
            F.concat(F.lit("fichero "), key.cast("string")).alias("nombre_archivo"),
            F.get(kinds, (key % 6).cast("int")).alias("tipo_archivo"),
            F.concat(F.lit("https://ejemplo.cat/f/"), key.cast("string")).alias("url_almacenamiento_nube"),
            F.lit("2024-01-01").cast("timestamp").alias("fecha_sincronizacion"),
        )

    def catalog(self) -> Catalog:
        return Catalog(
            events=self.eventos_master(),
            schedules=self.evento_horarios(),
            postcodes=self.codigos_postales(),
            categories=self.categorias(),
            event_categories=self.evento_categorias(),
            vectors=self.evento_vectores(),
        )

    # --- requests

    def _parameters(self, people: DataFrame) -> DataFrame:
        """Search parameters of everyone in ``people`` (request_id, k, cp_usuario, radio_km)."""
        k = F.col("k")
        day = F.date_add(F.lit("1996-01-01").cast("date"), (k % 1500).cast("int"))
        listed = F.array(day, F.date_add(day, 1), F.date_add(day, 30), day)
        names = (
            F.when(k % 5 == 0, F.array(F.lit("ECÓNOMY")))
            .when(k % 5 == 1, F.array(F.lit("standard"), F.lit("Promo"), F.lit("Standard")))
            .when(k % 35 == 2, F.array(F.lit("PROMO CAT")))
            .otherwise(F.array().cast("array<string>"))
        )
        price = (
            F.when(k % 6 == 2, F.lit(25.0))
            .when(k % 12 == 9, 5 + (k % 5).cast("double") * 4.5)
            .when(k % 6 == 1, F.lit(5.0))
        )
        concepts = F.when(
            k % 2 == 1,
            F.array(F.concat(F.lit("concepto "), (k % 7).cast("string")), F.lit("fiesta")),
        ).otherwise(F.array().cast("array<string>"))
        vectors = self.table("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("v")
        )
        mean = F.zip_with("v1", "v2", lambda a, b: (a + b) / 2)
        asking = people.select(
            "request_id",
            F.concat(F.lit("¿Qué hay para "), k.cast("string"), F.lit("?")).alias("pregunta"),
            "cp_usuario",
            (k % 50 == 0).alias("debug"),
            F.when((k / 4).cast("bigint") % 2 == 0, "es").otherwise("ca").alias("idioma"),
            F.when(k % 10 == 7, listed).otherwise(F.array().cast("array<date>")).alias("fechas"),
            F.when(k % 3 == 0, day).alias("fecha_inicio"),
            F.when(k % 3 == 0, F.date_add(day, 365)).alias("fecha_fin"),
            "radio_km",
            names.alias("categorias"),
            concepts.alias("conceptos"),
            F.when(k % 6 == 0, True).when(k % 6 == 1, False).alias("es_gratuito"),
            price.alias("precio_max"),
            (3 * k % 500).alias("i1"),
            ((3 * k + 1) % 500).alias("i2"),
        )
        return (
            asking.join(vectors.toDF("i1", "v1"), "i1", "left")
            .join(vectors.toDF("i2", "v2"), "i2", "left")
            .withColumn("query_embedding", mean)
            .drop("i1", "i2", "v1", "v2")
        )

    def located_requests(self) -> DataFrame:
        """One request per customer, from the customer's own postcode."""
        k = F.col("c_custkey")
        radius = F.when(k % 4 == 1, 0).when(k % 4 == 2, 20).when(k % 4 == 3, 60)
        return self._parameters(
            self.table("customer").select(
                k.alias("request_id"),
                k.alias("k"),
                _cp(k).alias("cp_usuario"),
                radius.cast("int").alias("radio_km"),
            )
        )

    def unlocated_requests(self) -> DataFrame:
        """One request with a radius per supplier, from postcodes the catalog lacks."""
        k = F.col("s_suppkey")
        return self._parameters(
            self.table("supplier").select(
                (-1 - k).alias("request_id"),
                k.alias("k"),
                F.concat(F.lit("x"), padded(k, 4)).alias("cp_usuario"),
                (20 + 40 * (k % 3)).cast("int").alias("radio_km"),
            )
        )

    def requests(self) -> DataFrame:
        return self.located_requests().unionByName(self.unlocated_requests())


def event_id(key: Column) -> Column:
    return F.sha2(F.concat(F.lit("orden-"), key.cast("string")), 256)


def _cp(key: Column) -> Column:
    return padded(key, 5)
