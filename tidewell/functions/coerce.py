"""Coercions as native columns. Text that cannot be read becomes null and is counted; nothing aborts a transfer."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What dates and timestamps may be.
FIRST_DATE, LAST_DATE = date(1900, 1, 1), date(2299, 12, 31)
FIRST_TIME, LAST_TIME = datetime(1900, 1, 1), datetime(2299, 12, 31, 23, 59, 59, 999999)
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "t"), ("false", "0", "no", "f")

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)$"
_FLOAT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
_INTEGER = r"^[+-]?\d+$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_PACKED = r"^(\d{8}|\d{14})$"
_CIVIL = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def as_decimal(text: Column, precision: int, scale: int) -> Column:
    """Plain decimal text, rounded half away from zero; too large is null. No exponents."""
    t = F.trim(text)
    return F.when(t.rlike(_DECIMAL), t.try_cast(T.DecimalType(precision, scale)))


def float_as_decimal(value: Column, precision: int, scale: int) -> Column:
    """Doubles by their shortest text; NaN and infinities are null."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value.try_cast(T.DecimalType(precision, scale)))


def decimal_text(value: Column) -> Column:
    """A decimal as plain text, without an exponent."""
    return value.cast("string")


def as_integer(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(_INTEGER), t.try_cast("bigint"))


def as_float(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(_FLOAT), t.try_cast("double"))


def as_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def as_bytes(text: Column) -> Column:
    """Base64 of the standard alphabet."""
    return F.try_to_binary(text, F.lit("base64"))


def as_date(text: Column) -> Column:
    """YYYY-MM-DD; 8 or 14 digits; else whole seconds since 1970."""
    t = F.trim(text)
    seconds = F.when(t.rlike(_INTEGER), t.try_cast("bigint"))
    day = F.floor(seconds / F.lit(86400))
    return (
        F.when(t.rlike(_DAY), F.try_to_date(t, "yyyy-MM-dd"))
        .when(t.rlike(_PACKED), F.try_to_date(F.left(t, F.lit(8)), "yyyyMMdd"))
        .otherwise(F.when(day.between(-(10**8), 10**8), F.date_from_unix_date(day.cast("int"))))
    )


def as_timestamp(text: Column, zoned: bool = True) -> Column:
    """RFC 3339; `YYYY-MM-DD HH:MM:SS` as UTC; 14 digits; whole seconds since 1970."""
    t = F.trim(text)
    seconds = F.when(t.rlike(_INTEGER), t.try_cast("bigint"))
    out = (
        F.when(t.rlike(_RFC3339) | t.rlike(_CIVIL), t.try_cast("timestamp"))
        .when(t.rlike(r"^\d{14}$"), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))
        .otherwise(F.timestamp_micros(F.try_multiply(seconds, F.lit(1000000).cast("bigint"))))
    )
    return out if zoned else out.cast("timestamp_ntz")


def in_range(value: Column, kind: T.DataType) -> Column:
    """Dates and timestamps outside 1900 to 2299 are null."""
    if isinstance(kind, T.DateType):
        return F.when(value.between(F.lit(FIRST_DATE), F.lit(LAST_DATE)), value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(value.between(F.lit(FIRST_TIME).cast("timestamp_ntz").cast(kind), F.lit(LAST_TIME).cast("timestamp_ntz").cast(kind)), value)
    return value


def zero_date(text: Column) -> Column:
    """Dates with a zero year, month or day are null."""
    return F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd")


def as_flag(value: Column) -> tuple[Column, Column]:
    """A one-byte integer as a boolean, and whether that lost a value other than 0 and 1."""
    return value != 0, ~value.isin(0, 1)


def time_text(micros: Column) -> Column:
    """Microseconds as [-]HH:MM:SS[.ffffff]; hours may exceed a day."""
    size = F.abs(micros)
    seconds, rest = F.floor(size / 1_000_000), size % 1_000_000
    whole = F.format_string("%s%02d:%02d:%02d", F.when(micros < 0, F.lit("-")).otherwise(F.lit("")), F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    return F.when(rest == 0, whole).when(rest > 0, F.concat(whole, F.format_string(".%06d", rest)))


def json_path(path: str) -> str:
    """A dotted path as a JSON path, with each part quoted. A quote in a part cannot be written and matches nothing."""
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def json_text(record: Column, path: str) -> Column:
    """A scalar's text at a dotted path; nested values as compact JSON; null and missing are null."""
    return F.get_json_object(record, json_path(path))


def coerced(text: Column, kind: T.DataType) -> Column:
    """Text as a declared type."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BinaryType):
        return as_bytes(text)
    if isinstance(kind, T.BooleanType):
        return as_boolean(text)
    if isinstance(kind, T.DecimalType):
        return as_decimal(text, kind.precision, kind.scale)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return as_float(text).cast(kind)
    if isinstance(kind, T.DateType):
        return as_date(text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return as_timestamp(text, isinstance(kind, T.TimestampType))
    return as_integer(text).try_cast(kind)


def present(text: Column, kind: T.DataType) -> Column:
    """Whether a value was there to be read: empty text counts only for strings."""
    return text.isNotNull() if isinstance(kind, (T.StringType, T.BinaryType)) else text.isNotNull() & (F.trim(text) != "")


def lost(text: Column, out: Column, kind: T.DataType) -> Column:
    """1 where a value was there and became null."""
    return F.when(present(text, kind) & out.isNull(), 1).otherwise(0)


def fully_lost(text: Column, out: Column, kind: T.DataType) -> tuple[Column, Column, Column]:
    """Aggregates for a column: values that were there, how many became null, and the first of those."""
    there = present(text, kind)
    gone = there & out.isNull()
    return F.count_if(there), F.count_if(gone), F.min(F.when(gone, text))


def lookback(bound: Column, seconds: int, kind: T.DataType) -> Column:
    """An earlier bound: by seconds, or for dates by days, rounded up."""
    if isinstance(kind, T.DateType):
        return F.date_sub(bound, -(-seconds // 86400))
    return bound - F.make_dt_interval(secs=F.lit(seconds))
