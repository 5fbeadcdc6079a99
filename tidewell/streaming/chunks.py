"""Reading a window in pages of a key, each of which is committed before the next is read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.config import Transfer
from tidewell.errors import ConfigError


def chunk_key(schema: T.StructType, t: Transfer) -> str:
    """The column to page by: transferred as it is, a whole number, never null."""
    name = t.partition_column or t.source_name(t.key[0])
    if name not in schema.fieldNames() or (t.include is not None and name not in t.include) or name in t.exclude:
        raise ConfigError(f"chunk_rows: {name!r} is not among the transferred columns")
    field = schema[name]
    if name in t.column_transforms:
        raise ConfigError(f"chunk_rows: {name!r} has an expression in column_transforms; pages need the stored value")
    if not isinstance(field.dataType, (T.ShortType, T.IntegerType, T.LongType)):
        raise ConfigError(f"chunk_rows: {name!r} is {field.dataType.simpleString()}; pages need a whole number")
    if field.nullable and t.rename.get(name, name) not in t.required:
        raise ConfigError(f"chunk_rows: {name!r} may be null; rows without it would be on no page")
    return name


def page(df: DataFrame, key: str, after: str | None, rows: int) -> DataFrame:
    """The next rows in key order: a top-k, not a sort of everything."""
    k = F.col(f"`{key}`")
    if after is not None:
        df = df.where(k > F.lit(after).cast(df.schema[key].dataType))
    return df.orderBy(k.asc()).limit(rows)


def pages(df: DataFrame, key: str, rows: int, after: str | None) -> Iterator[tuple[DataFrame, str, int]]:
    """Pages until one is short: its rows, the last key as text, and how many rows it has.

    The last key is found first, so a page is then a plain range of keys that scans can skip by. A key that repeats at
    the end of a page is never cut in two: the range takes all its rows.
    """
    k = F.col(f"`{key}`")
    kind = df.schema[key].dataType
    while True:
        found = page(df.select(k), key, after, rows).agg(F.max(k).cast("string").alias("last"), F.count("*").alias("n")).first()
        if not found["n"]:
            return
        part = df.where(k <= F.lit(found["last"]).cast(kind))
        if after is not None:
            part = part.where(k > F.lit(after).cast(kind))
        yield part, found["last"], found["n"]
        if found["n"] < rows:
            return
        after = found["last"]
