"""From a source's schema and the settings to the columns that are read and the schema that is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.config import Transfer
from tidewell.errors import ConfigError
from tidewell.functions.coerce import float_as_decimal, in_range
from tidewell.functions.types import decoded_type, may_become_null, overridden, reject_nested


@dataclass(frozen=True)
class Plan:
    """columns: what to select; schema: what it has at the destination; lost: by name, whether a value became null."""

    columns: list[Column]
    schema: T.StructType
    lost: dict[str, Column]
    sources: dict[str, str]


def chosen(schema: T.StructType, t: Transfer) -> list[T.StructField]:
    """Source columns by include, then exclude. An unknown include is an error, an unknown exclude is not."""
    names = schema.fieldNames()
    for name in t.include or ():
        if name not in names:
            raise ConfigError(f"include: the source has no column {name!r}; it has {', '.join(names)}")
    out = [f for f in schema.fields if (t.include is None or f.name in t.include) and f.name not in t.exclude]
    if not out:
        raise ConfigError("include and exclude leave no column to transfer")
    return out


def plan(schema: T.StructType, t: Transfer, merge: bool = False) -> Plan:
    """Select, rename, express, override and clamp. Everything is a native column, so scans see what they need to read."""
    fields = chosen(schema, t)
    reject_nested(T.StructType([f for f in fields if f.name not in t.column_transforms]))
    names = [f.name for f in fields]
    for column in t.column_transforms:
        if column not in names:
            raise ConfigError(f"column_transforms: {column!r} is not among the transferred columns ({', '.join(names)})")
    columns, out, lost, sources = [], [], {}, {}
    for f in fields:
        dest = t.rename.get(f.name, f.name)
        if dest in sources:
            raise ConfigError(f"rename: two columns are called {dest!r}")
        sources[dest] = f.name
        kind, value, exact = f.dataType, F.col(f"`{f.name}`"), isinstance(f.dataType, T.DecimalType)
        arbitrary = exact or bool((f.metadata or {}).get("arbitrary_precision_decimal"))
        if f.name in t.column_transforms:
            value = F.expr(t.column_transforms[f.name])
            if f.name in t.column_transform_types:
                kind = decoded_type(t.column_transform_types[f.name])
                value = value.cast(kind)
        override = t.type_overrides.get(f.name, t.type_overrides.get(dest))
        if override is None and arbitrary and t.numeric_as_decimal:
            override = t.numeric_as_decimal
        raw = value
        if override is not None:
            new = overridden(kind, override, arbitrary, merge)
            if new != kind:
                value = float_as_decimal(value, new.precision, new.scale) if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(new, T.DecimalType) else value.try_cast(new)
                kind = new
        if t.clamp_dates:
            value = in_range(value, kind)
        if may_become_null(kind):
            lost[dest] = raw.isNotNull() & value.isNull()
        columns.append(value.alias(dest))
        nullable = dest not in t.required and not (dest == t.watermark_destination and not merge and t.engine_name == "ReplacingMergeTree")
        nullable = nullable and (f.nullable or may_become_null(kind) or dest == t.watermark_destination)
        out.append(T.StructField(dest, kind, nullable, {"source": f.name}))
    return Plan(columns, T.StructType(out), lost, sources)


def require(df: DataFrame, names: list[str]) -> DataFrame:
    """Count nulls of columns that must have none: one row."""
    return df.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in names])


def check_required(df: DataFrame, schema: T.StructType) -> None:
    """Parquet keeps no NOT NULL, so staged rows are counted before they are shown."""
    names = [f.name for f in schema.fields if not f.nullable and f.name in df.columns]
    if not names:
        return
    row = require(df, names).first()
    bad = {n: row[n] for n in names if row[n]}
    if bad:
        raise ConfigError("columns that must not be null hold nulls: " + ", ".join(f"{n} ({c} rows)" for n, c in bad.items()) + "; take them out of key, order_by or not_null, or filter them in source_query")


def missing(desired: T.StructType, existing: T.StructType, any_case: bool) -> list[T.StructField]:
    """Fields that the destination lacks, in order, and nullable, as they are added to rows that exist."""
    fold = str.lower if any_case else str
    have = {fold(f.name) for f in existing.fields}
    return [T.StructField(f.name, f.dataType, True, f.metadata) for f in desired.fields if fold(f.name) not in have]
