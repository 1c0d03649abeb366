"""Text folding, slugs and JSON list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the characters a Python str.strip() removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# equality of the catalog's text columns: case, accents and trailing blanks do not count
CATALOG_COLLATION = "UNICODE_CI_AI_RTRIM"

_ACCENTED = "àáâãäåāăąçćčďèéêëēěęìíîïīįñńňòóôõöōőŕřśşšťùúûüūůűųýÿźżž"
_PLAIN = "aaaaaaaaacccdeeeeeeeiiiiiinnnooooooorrssstuuuuuuuuyyzzz"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def fold(text: Column) -> Column:
    """Lower-cased text without accents, for substring tests on long texts."""
    plain = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    return F.regexp_replace(plain, r"\p{M}+", "")


def same_text(left: Column, right: Column) -> Column:
    return F.collate(left, CATALOG_COLLATION) == F.collate(right, CATALOG_COLLATION)


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def pick_language(idioma: Column, spanish: Column, catalan: Column) -> Column:
    """Spanish only for ``'es'``; any other value, NULL too, means Catalan."""
    return F.when(idioma == "es", spanish).otherwise(catalan)


def short_hour(hour: Column) -> Column:
    """``09:00:00`` as ``9:00:00``."""
    return F.regexp_replace(hour, r"^0(?=\d:)", "")


# a JSON list whose items are all strings; possessive, so long lists do not recurse
_STRING_LIST = r'^\s*\[\s*(?:"(?:[^"\\]++|\\.)*+"\s*+(?:,\s*"(?:[^"\\]++|\\.)*+"\s*+)*+)?\]\s*$'


def _is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def decode_tags(df: DataFrame, name: str) -> Column:
    """List of tags; ``[]`` for NULL or empty text, NULL when it is no list of strings."""
    empty = F.array().cast("array<string>")
    if _is_array(df, name):
        tags = F.coalesce(F.col(name), empty)
        return F.when(F.forall(tags, lambda t: t.isNotNull()), tags)
    text = F.col(name)
    parsed = F.when(text.rlike(_STRING_LIST), F.from_json(text, "array<string>"))
    return F.when(text.isNull() | (text == ""), empty).otherwise(parsed)


def decode_vector(df: DataFrame, name: str) -> Column:
    """Vector of doubles; NULL when absent or malformed."""
    if _is_array(df, name):
        return F.col(name).cast("array<double>")
    return F.from_json(F.col(name), "array<double>")


def encode_list(values: Column) -> Column:
    return F.to_json(values)


def padded(number: Column, width: int) -> Column:
    """A number as text with zeros in front, never shortened."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def embedding_text(concepts: Column) -> Column:
    """The text whose embedding stands for a question: its concepts, joined by blanks."""
    return F.array_join(concepts, " ")


# --- fixed values: the templates of titles and descriptions


def full_title(title: Column, town: Column) -> Column:
    return F.concat(title, F.lit(" - "), town)


def short_description(idioma: str, category: Column, town: Column) -> Column:
    template = "Evento de %s en %s" if idioma == "es" else "Esdeveniment de %s a %s"
    return F.format_string(template, F.lower(category), town)


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values; NULL differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)
