"""What several operators share: ASCII tables, column handling, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# lower-cases A-Z in UTF-8 bytes and leaves everything else
ASCII_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
# the same, and every byte that is part of no word becomes a blank
WORDS_ONLY = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)
# rows handled at once in a task; texts may be long
ROWS_AT_ONCE = 1000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ascii_lower(text):
    """Column ``text`` with A-Z lower-cased; ``lower`` alone would change other letters too."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator writes itself."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def as_bytes(column: pa.Array) -> list:
    """A string column as UTF-8 bytes, nulls as None."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices_of_text(batches: Iterator[pa.RecordBatch], column: int, most: int, rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` whose texts in ``column`` have ``most`` bytes together, or of one row."""
    for batch in slices(batches, rows):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def schema_with(df: DataFrame, **added: str) -> T.StructType:
    """The columns of ``df``, those named in ``added`` left out, then ``added``."""
    taken = {name.lower() for name in added}
    fields = [f for f in df.schema.fields if f.name.lower() not in taken]
    new = T._parse_datatype_string(", ".join(f"{name} {kind}" for name, kind in added.items()))
    return T.StructType(fields + new.fields)


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with ``columns`` set: those of the same name go, the new ones come last."""
    taken = {name.lower() for name in columns}
    keep = [name for name in batch.schema.names if name.lower() not in taken]
    arrays = [batch.column(batch.schema.get_field_index(name)) for name in keep]
    return pa.RecordBatch.from_arrays(arrays + list(columns.values()), names=keep + list(columns))
