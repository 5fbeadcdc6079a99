"""Type maps from sources to Spark, and the grammar of type overrides."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tidewell.errors import ConfigError, UnsupportedType

#: PostgreSQL types by name.
POSTGRES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "oid": T.LongType(),
    "float4": T.FloatType(), "float8": T.DoubleType(), "numeric": T.DoubleType(),
    "text": T.StringType(), "varchar": T.StringType(), "bpchar": T.StringType(), "name": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(), "uuid": T.StringType(),
    "bytea": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "time": T.StringType(),
}

#: MySQL types by name; those that depend on more are in mysql_type.
MYSQL: dict[str, T.DataType] = {
    "smallint": T.ShortType(), "smallint unsigned": T.IntegerType(), "year": T.IntegerType(),
    "mediumint": T.IntegerType(), "mediumint unsigned": T.LongType(), "int": T.IntegerType(), "int unsigned": T.LongType(),
    "bigint": T.LongType(), "bigint unsigned": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(), "decimal": T.DoubleType(),
    "char": T.StringType(), "varchar": T.StringType(), "enum": T.StringType(), "set": T.StringType(), "json": T.StringType(),
    "text": T.StringType(), "tinytext": T.StringType(), "mediumtext": T.StringType(), "longtext": T.StringType(),
    "blob": T.BinaryType(), "tinyblob": T.BinaryType(), "mediumblob": T.BinaryType(), "longblob": T.BinaryType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(),
    "date": T.DateType(), "datetime": T.TimestampType(), "timestamp": T.TimestampType(), "time": T.StringType(), "bit": T.BinaryType(),
}

#: Types that API columns are declared with, and their other names.
DECLARED: dict[str, T.DataType] = {
    "STRING": T.StringType(), "JSON": T.StringType(), "BYTES": T.BinaryType(), "INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(), "DATETIME": T.TimestampNTZType(), "DATE": T.DateType(), "TIME": T.StringType(),
    "NUMERIC": T.DecimalType(38, 9), "BIGNUMERIC": T.DoubleType(),
}
ALIASES = {"INT64": "INTEGER", "INT": "INTEGER", "FLOAT64": "FLOAT", "BOOL": "BOOLEAN", "DECIMAL": "NUMERIC", "BIGDECIMAL": "BIGNUMERIC"}

#: Types that an expression's result may be decoded as.
DECODED: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint32": T.LongType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "utf8": T.StringType(), "string": T.StringType(), "text": T.StringType(), "binary": T.BinaryType(),
    "date32": T.DateType(), "date": T.DateType(),
}

_DECIMAL = re.compile(r"^\s*(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)\s*$", re.I)
_DATETIME64 = re.compile(r"^\s*datetime64\s*\(\s*\d+\s*(,\s*'[^']*'\s*)?\)\s*$", re.I)


def postgres_type(name: str, column: str = "?") -> T.DataType:
    found = POSTGRES.get(name.lower())
    if found is None:
        raise UnsupportedType(f"column {column!r}: PostgreSQL type {name!r} has no column type here; leave it out with exclude, or cast it with column_transforms")
    return found


def mysql_type(name: str, length: int | None = None, unsigned: bool = False, tinyint1_as_bool: bool = True, column: str = "?") -> T.DataType:
    """TINYINT(1) is a boolean unless told otherwise; other TINYINTs are bytes, unsigned ones shorts."""
    kind = name.lower()
    if kind == "tinyint":
        return T.BooleanType() if length == 1 and tinyint1_as_bool and not unsigned else T.ShortType() if unsigned else T.ByteType()
    found = MYSQL.get(f"{kind} unsigned" if unsigned and f"{kind} unsigned" in MYSQL else kind)
    if found is None:
        raise UnsupportedType(f"column {column!r}: MySQL type {name!r} has no column type here; leave it out with exclude, or cast it with column_transforms")
    return found


def declared_type(name: str, column: str = "?") -> T.DataType:
    kind = name.strip().upper()
    found = DECLARED.get(ALIASES.get(kind, kind))
    if found is None:
        raise UnsupportedType(f"column {column!r}: type {name!r} cannot be declared; known are {', '.join([*DECLARED, *ALIASES])}")
    return found


def decoded_type(name: str) -> T.DataType:
    found = DECODED.get(name.strip().lower())
    if found is None:
        raise ConfigError(f"column_transform_types: unknown type {name!r}; known are {', '.join(DECODED)}")
    return found


def reject_nested(schema: T.StructType) -> None:
    """Arrays, structs, maps and intervals are refused before any row is read."""
    for f in schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType)):
            raise UnsupportedType(f"column {f.name!r}: type {f.dataType.simpleString()} is not supported; leave it out with exclude, or render it as text with column_transforms")


def decimal_of(override: str, bare_is_numeric: bool = False) -> T.DecimalType | None:
    """The decimal that an override asks for, or None if it is no decimal."""
    if bare_is_numeric and override.strip().upper() == "NUMERIC":
        return T.DecimalType(38, 9)
    m = _DECIMAL.match(override)
    if not m:
        return None
    p, s = int(m[1]), int(m[2] or 0)
    if not 1 <= p <= 38 or s > p:
        raise ConfigError(f"type {override!r}: a decimal has 1 to 38 digits, and no more of them after the point")
    return T.DecimalType(p, s)


def overridden(kind: T.DataType, override: str, exact_source: bool, bare_is_numeric: bool = False) -> T.DataType:
    """The type of a column after an override; overrides that only name a destination type leave it as it is.

    exact_source: the source column is an exact decimal, which alone may become a Decimal(p, s).
    """
    decimal = decimal_of(override, bare_is_numeric)
    if decimal is not None:
        return decimal if exact_source or isinstance(kind, T.DecimalType) else kind
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        name = override.strip().upper()
        if name in ("TIMESTAMP", "DATETIME"):
            return T.TimestampType() if name == "TIMESTAMP" else T.TimestampNTZType()
        if m := _DATETIME64.match(override):
            return T.TimestampType() if m[1] else T.TimestampNTZType()
    return kind


def may_become_null(kind: T.DataType) -> bool:
    """Types whose values may be out of range, and then turn into null."""
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType))
