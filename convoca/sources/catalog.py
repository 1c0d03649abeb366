"""The catalog: the event tables a search reads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from convoca import schemas
from convoca.sources.staging import broadcast_if_small

# tables joined on the event id, laid out in the same buckets
_BY_EVENT = [
    "eventos_master",
    "evento_categorias",
    "evento_horarios",
    "binarios_storage",
    "auditoria_scraping",
]


@dataclass
class Catalog:
    """Event tables; ``vectors`` may keep the embedding columns apart from ``events``."""

    events: DataFrame
    schedules: DataFrame
    postcodes: DataFrame
    categories: DataFrame
    event_categories: DataFrame
    vectors: DataFrame | None = None
    _small: dict = field(default_factory=dict, repr=False)

    @property
    def embeddings(self) -> DataFrame:
        source = self.events if self.vectors is None else self.vectors
        return source.select("id_unico_evento", "tags_embedding_es", "tags_embedding_cat")

    def sized(self, rows: DataFrame, of: str = "postcodes") -> DataFrame:
        """``rows``, no more than the table ``of`` has, broadcast if that table is small."""
        if of not in self._small:
            table = getattr(self, of)
            self._small[of] = broadcast_if_small(table) is not table
        return rows.hint("broadcast") if self._small[of] else rows


def _catalog(read) -> Catalog:
    return Catalog(
        events=read("eventos_master"),
        schedules=read("evento_horarios"),
        postcodes=read("codigos_postales"),
        categories=read("categorias"),
        event_categories=read("evento_categorias"),
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")


def read_catalog(spark: SparkSession, folder: str) -> Catalog:
    """Catalog from a folder with one parquet dataset per table."""
    return _catalog(lambda name: read_table(spark, folder, name))


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """New snapshot of a table, laid out so that scans can skip row groups.

    Events are clustered by postcode and schedules by start date. The folder
    must be a new one: the snapshot being replaced may still be read.
    """
    cluster = {"eventos_master": ["cp_evento", "id_unico_evento"],
               "evento_horarios": ["fecha_inicio", "id_unico_evento"]}.get(name)
    if cluster:
        df = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
    df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def save_bucketed(df: DataFrame, name: str, buckets: int, database: str | None = None) -> None:
    """Save a table of the catalog bucketed by event id.

    Tables with the same number of buckets join on the event id without a
    shuffle of either side; candidates of a search then travel to the vectors
    and not the other way round.
    """
    if name not in _BY_EVENT:
        raise ValueError(f"{name} has no event id to bucket by")
    target = name if database is None else f"{database}.{name}"
    df.write.bucketBy(buckets, "id_unico_evento").sortBy("id_unico_evento").mode(
        "errorifexists"
    ).saveAsTable(target)


def load_catalog(spark: SparkSession, database: str | None = None) -> Catalog:
    """Catalog from tables of the session's metastore."""
    prefix = "" if database is None else f"{database}."
    return _catalog(lambda name: spark.table(f"{prefix}{name}"))

