"""Checks of requests and of extracted parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoca import schemas
from convoca.functions.text import strip


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests with the question trimmed and a ``motivo`` when rejected, else NULL.

    The length limits apply to the question as sent, before trimming.
    """
    question = F.col("pregunta")
    reason = (
        F.when(question.isNull(), "pregunta ausente")
        .when(F.length(question) < 3, "pregunta corta")
        .when(F.length(question) > 500, "pregunta larga")
        .when(strip(question) == "", "pregunta en blanco")
        .when(F.col("cp_usuario").isNull(), "cp ausente")
        .when(~F.col("cp_usuario").rlike(r"^[0-9]{5}\z"), "cp invalido")
    )
    return requests.withColumn("motivo", reason).withColumn("pregunta", strip(question))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("motivo").isNull()).drop("motivo")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("motivo").isNotNull())


def fallback_language(question: Column) -> Column:
    """Spanish when one of three question words occurs, otherwise Catalan."""
    text = F.lower(question)
    words = ("qué", "dónde", "cuándo")
    spanish = text.contains(words[0]) | text.contains(words[1]) | text.contains(words[2])
    return F.when(spanish, "es").otherwise("ca")


def default_parameters(question: Column) -> dict[str, Column]:
    """Parameters of a question nothing could be extracted from."""
    columns = {f.name: F.lit(None).cast(f.dataType) for f in schemas.PARAMS.fields}
    columns["idioma"] = fallback_language(question)
    columns["categorias"] = F.array().cast("array<string>")
    columns["conceptos"] = F.array(question)
    return columns


_ISO_DAY = r"^\d{4}-\d{2}-\d{2}(T00:00(:00(\.0+)?)?Z?)?$"
# texts that stand for true and false
_TRUE, _FALSE = ["1", "on", "t", "true", "y", "yes"], ["0", "off", "f", "false", "n", "no"]
_NUMBER = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|BOOLEAN)$"


def _converted(data: Column) -> dict[str, tuple[Column, Column]]:
    """Per parameter its value and whether what is present converts; lenient where no information is lost."""

    def raw(name: str) -> Column:
        return F.try_variant_get(data, f"$.{name}", "variant")

    def kind(name: str) -> Column:
        return F.schema_of_variant(raw(name))

    def text(name: str) -> Column:
        return strip(F.try_variant_get(data, f"$.{name}", "string"))

    def absent(name: str) -> Column:
        return F.coalesce(kind(name) == "VOID", F.lit(True))

    def optional(name: str, value: Column) -> tuple[Column, Column]:
        return value, absent(name) | value.isNotNull()

    def number(name: str) -> Column:
        given = F.when(kind(name) == "BOOLEAN", F.when(text(name) == "true", "1").otherwise("0")).otherwise(text(name))
        value = given.try_cast("double")
        return F.when(kind(name).rlike(_NUMBER) | (kind(name) == "STRING"), F.when(~F.isnan(value), value))

    def day(value: Column) -> Column:
        return F.when(value.rlike(_ISO_DAY), F.left(value, F.lit(10)).try_cast("date"))

    def texts(name: str) -> tuple[Column, Column]:
        items = F.try_variant_get(data, f"$.{name}", "array<string>")
        fine = kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(items, lambda t: t.isNotNull())
        # a missing list is empty, an explicit null is none
        missing = F.coalesce(kind(name), F.lit("")) == ""
        empty = F.array().cast("array<string>")
        return F.when(missing, empty).otherwise(items), missing | F.coalesce(fine, F.lit(False))

    whole = number("radio_km")
    flag = F.lower(text("es_gratuito"))
    days = F.transform(F.try_variant_get(data, "$.fechas", "array<string>"), lambda t: day(strip(t)))
    language = F.when(kind("idioma") == "STRING", F.try_variant_get(data, "$.idioma", "string"))
    return {
        "idioma": (language, language.isNotNull()),
        "fechas": (
            F.when(~absent("fechas"), days),
            absent("fechas") | (days.isNotNull() & F.forall(days, lambda d: d.isNotNull())),
        ),
        "fecha_inicio": optional("fecha_inicio", F.when(kind("fecha_inicio") == "STRING", day(text("fecha_inicio")))),
        "fecha_fin": optional("fecha_fin", F.when(kind("fecha_fin") == "STRING", day(text("fecha_fin")))),
        "radio_km": optional("radio_km", F.when(whole == F.floor(whole), whole.try_cast("int"))),
        "categorias": texts("categorias"),
        "conceptos": texts("conceptos"),
        "es_gratuito": optional(
            "es_gratuito",
            F.when(
                kind("es_gratuito").rlike(_NUMBER) | (kind("es_gratuito") == "STRING"),
                F.when(flag.isin(_TRUE), True).when(flag.isin(_FALSE), False),
            ),
        ),
        "precio_max": optional("precio_max", number("precio_max")),
    }


def parameters_from_json(questions: DataFrame, name: str) -> DataFrame:
    """Add the typed parameter columns held as a JSON object in column ``name``.

    Values of another type are converted where nothing is lost: numbers and flags
    written as text, whole numbers written with a fraction of zero. Missing lists
    are empty. An object that is malformed, followed by more text, holds a value
    that does not convert, or is out of range gives the default parameters, and
    ``extraidos`` is false.
    """
    # the parser stops after the object; what follows breaks one of these frames
    framed = [F.concat(F.lit(a), name, F.lit(b)) for a, b in (("[", "]"), ('{"x":', "}"))]
    whole = reduce(lambda a, b: a & b, (F.try_parse_json(text).isNotNull() for text in framed))
    rows = questions.withColumn("_v", F.when(whole, F.try_parse_json(name)))
    converted = _converted(F.col("_v"))
    rows = rows.withColumns({f"_p_{field}": value for field, (value, _) in converted.items()})
    radius, price = F.col("_p_radio_km"), F.col("_p_precio_max")
    valid = reduce(lambda a, b: a & b, (fine for _, fine in converted.values()))
    valid = valid & (radius.isNull() | radius.between(0, 100)) & (price.isNull() | (price >= 0))
    rows = rows.withColumn("extraidos", F.coalesce(F.col("_v").isNotNull() & valid, F.lit(False)))
    defaults = default_parameters(F.col("pregunta"))
    columns = [
        F.when(F.col("extraidos"), F.col(f"_p_{f.name}")).otherwise(defaults[f.name]).cast(f.dataType).alias(f.name)
        for f in schemas.PARAMS.fields
    ]
    return rows.select(*questions.columns, "extraidos", *columns)
