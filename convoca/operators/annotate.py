"""Search parameters read off the words of a question.

Plain column expressions over a question log. Category names are found by their
words: the runs of words of each distinct question, of the lengths that names
have, are joined with the names, so a longer list of categories costs a join and
not a longer search of every question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoca.functions.text import fold
from convoca.operators.validate import fallback_language
from convoca.sources.staging import broadcast_if_small, stage

# --- fixed values: expressions the extraction rules name, folded, in both languages
_TODAY = r"\b(hoy|avui)\b"
_TOMORROW = r"\b(manana|dema)\b"
_SATURDAY = r"\b(este sabado|aquest dissabte)\b"
_WEEKEND = r"\b(fin de semana|cap de setmana)\b"
_WEEK = r"\b(esta semana|aquesta setmana)\b"
_NEAR = r"\b(cerca|alrededores|a la redonda|prop|voltants|a la rodona)\b"
_FREE = r"\b(gratis|gratuit[oa]?s?|gratuites)\b"
_KILOMETRES = r"(?:^|[^\d.,])(\d{1,3}(?:\.\d{3})+|\d+)\s*(?:km|kilometros?|quilometres?)\b"
_EUROS = (
    r"(?:menos de|menys de|maximo|maxim)\s+"
    r"(\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|\d+(?:[.,]\d{1,2})?)\s*(?:euros?|€)"
)
NEAR_KM, MOST_KM = 20, 100

_EXTRACTED = [
    "fechas", "fecha_inicio", "fecha_fin", "radio_km", "categorias", "es_gratuito", "precio_max"
]


def _coming(as_of: Column, day: str) -> Column:
    """That weekday on or after ``as_of``."""
    return F.next_day(F.date_sub(as_of, 1), day)


def _word_list(text: Column) -> Column:
    words = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.when(words != "", F.split(words, " "))


def mentions(texts: DataFrame, categories: DataFrame) -> DataFrame:
    """(texto, categorias): slugs of the categories named in each distinct folded text (texto) that names any.

    A name without words is never found.
    """
    named = categories.select("slug", F.explode(F.array("nombre_es", "nombre_cat")).alias("nombre"))
    named = stage(
        named.select("slug", _word_list(fold(F.col("nombre"))).alias("palabras"))
        .filter("palabras is not null and slug is not null")
        .select("slug", F.size("palabras").alias("largo"), F.array_join("palabras", " ").alias("tramo"))
        .distinct(),
        "nombres",
    )
    # lengths of names in words: a name's column is of bounded length, so these are few
    lengths = [r["largo"] for r in named.select("largo").distinct().collect()]
    words = texts.select("texto").distinct().withColumn("palabras", _word_list(F.col("texto"))).filter("palabras is not null")

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("palabras") - n + 1)
        starts = F.when(F.size("palabras") >= n, starts).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("palabras", i, n), " "))

    if not lengths:
        return words.select("texto", F.array().cast("array<string>").alias("categorias")).limit(0)
    runs = F.array_distinct(F.flatten(F.array(*map(runs_of, lengths))))
    met = words.select("texto", F.explode(runs).alias("tramo")).join(broadcast_if_small(named), "tramo")
    return met.groupBy("texto").agg(F.array_sort(F.collect_set("slug")).alias("categorias"))


def annotate(
    questions: DataFrame, categories: DataFrame, question: str = "pregunta", as_of: str = "as_of"
) -> DataFrame:
    """Add language, dates, radius, categories, free flag, price limit and concepts.

    Categories are the slugs whose Spanish or Catalan name occurs as words.
    A radius beyond 100 km makes the whole question invalid, as it does for
    extracted parameters: it gets the default ones.
    """
    text, today = F.col("_texto"), F.col(as_of)
    saturday = _coming(today, "SAT")
    days = (
        F.when(text.rlike(_WEEKEND), F.array(saturday, F.date_add(saturday, 1)))
        .when(text.rlike(_SATURDAY), F.array(saturday))
        .when(text.rlike(_TOMORROW), F.array(F.date_add(today, 1)))
        .when(text.rlike(_TODAY), F.array(today))
    )
    week = F.col("fechas").isNull() & text.rlike(_WEEK)
    distance = F.nullif(F.regexp_extract(text, _KILOMETRES, 1), F.lit(""))
    stated = F.replace(distance, F.lit(".")).try_cast("int")
    limit = F.nullif(F.regexp_extract(text, _EUROS, 1), F.lit(""))
    limit = F.when(limit.rlike(r"^\d+(\.\d{3})+"), F.replace(limit, F.lit("."))).otherwise(limit)
    # a number too long for the type is out of range as well
    valid = distance.isNull() | F.coalesce(stated <= MOST_KM, F.lit(False))
    folded = questions.withColumn("_texto", fold(F.col(question)))
    found = mentions(folded.select(F.col("_texto").alias("texto")), categories)
    # on a Sunday the weekend that is left is the coming one
    return (
        folded.join(found.toDF("_texto", "_categorias"), "_texto", "left")
        .withColumn("idioma", fallback_language(F.col(question)))
        .withColumn("fechas", days)
        .withColumn("fecha_inicio", F.when(week, today))
        .withColumn("fecha_fin", F.when(week, _coming(today, "SUN")))
        .withColumn(
            "radio_km",
            F.when(distance.isNotNull(), stated).when(text.rlike(_NEAR), F.lit(NEAR_KM)),
        )
        .withColumn("categorias", F.col("_categorias"))
        .withColumn("conceptos", F.array(F.col(question)))
        .withColumn("es_gratuito", F.when(text.rlike(_FREE), F.lit(True)))
        .withColumn("precio_max", F.replace(limit, F.lit(","), F.lit(".")).try_cast("double"))
        .withColumn("_valida", valid)
        .withColumns({name: F.when(F.col("_valida"), F.col(name)) for name in _EXTRACTED})
        .withColumn("categorias", F.coalesce("categorias", F.array().cast("array<string>")))
        .drop("_texto", "_categorias", "_valida")
    )
