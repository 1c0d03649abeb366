"""The closed list of categories a new catalog starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values
_CATEGORIES = [
    (1, "Cultura", "Cultura", "cultura", "palette", "#9C27B0", 1),
    (2, "Deportes", "Esports", "deportes", "sports_soccer", "#4CAF50", 2),
    (3, "Ocio", "Oci", "ocio", "celebration", "#FF9800", 3),
    (4, "Infantil", "Infantil", "infantil", "child_care", "#2196F3", 4),
    (5, "Formación", "Formació", "formacion", "school", "#607D8B", 5),
    (6, "Gastronomía", "Gastronomia", "gastronomia", "restaurant", "#F44336", 6),
    (7, "Música", "Música", "musica", "music_note", "#E91E63", 7),
    (8, "Naturaleza", "Naturalesa", "naturaleza", "park", "#8BC34A", 8),
]


def seed_categories(spark: SparkSession) -> DataFrame:
    rows = [(*row, True) for row in _CATEGORIES]
    return spark.createDataFrame(
        rows,
        "id_categoria int, nombre_es string, nombre_cat string, slug string, icono string, "
        "color_hex string, orden int, activo boolean",
    )
