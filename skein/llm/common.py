"""Shared pieces: durable intermediate tables, checked broadcasts, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import forget, scope, store

__all__ = ["batches_of", "forget", "hinted", "let", "map_rows", "scope", "store", "uniform", "words"]

#: A Java pattern of the white space that separates words: space and U+0009 to U+000D.
SPACES = "[\\t-\\r ]+"

#: Rows up to which a table of a few numbers per row may be broadcast (under 32 MB).
BROADCAST_ROWS = 500_000

@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int = 64 << 20) -> Iterator[None]:
    """Hand Python at most so many rows, and about so many bytes, at once, in what is run meanwhile; for rows of whole texts or sets."""
    given = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key, None) for key in given}
    for key, value in given.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hinted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a table for broadcast if it has few rows; larger ones are joined by shuffle."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate a costly value once for use at several places of an expression."""
    return F.transform(F.array(value), body)[0]


def uniform(*cols: Column | str, seed: int) -> Column:
    """A reproducible draw from the open interval (0, 1) by the columns' values: 52 bits of their MD5 as text."""
    told = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    bits = F.conv(F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), *told)), F.lit(13)), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def map_rows(
    df: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterable[list[tuple]]], fields: list[T.StructField]
) -> DataFrame:
    """Map a table's Arrow batches to lists of tuples, keeping nulls and 64-bit numbers exact."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    arrow = to_arrow_schema(schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in made(it):
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(batches, schema)


#: Bytes of UTF-8 text to words: A-Z become a-z, digits, a-z and bytes beyond ASCII stay, all others separate.
FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letter_words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text given as UTF-8: runs of letters and digits of ASCII and all beyond ASCII; null has none."""
    return text.translate(FOLDED).split() if text else []


def chunks_of(texts: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into stretches of at most so many bytes; a longer text is a stretch of its own."""
    begin = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text or b"") > most:
            yield begin, at
            begin, size = at, 0
        size += len(text or b"")
    if begin < len(texts):
        yield begin, len(texts)
