"""Incremental windows: bounds of a watermark, late data, and the day windows of APIs."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.errors import ConfigError
from tidewell.functions.coerce import lookback


def type_of(df: DataFrame, expr: Column) -> T.DataType:
    return df.select(expr.alias("x")).schema["x"].dataType


def watermark_column(df: DataFrame, name: str, source_expr: str | None = None) -> Column:
    """The column, or the expression that stands for it at the source."""
    if source_expr:
        return F.expr(source_expr)
    if name not in df.columns:
        raise ConfigError(f"watermark: the source has no column {name!r}; it has {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def snapshot_max(df: DataFrame, watermark: Column) -> DataFrame:
    """The largest value as text: the upper bound of this run. Null on an empty source."""
    return df.agg(F.max(watermark).cast("string").alias("upper"))


def null_watermarks(df: DataFrame, watermark: Column) -> DataFrame:
    """Rows that no window will ever read."""
    return df.agg(F.count_if(watermark.isNull()).alias("n"))


def survey(df: DataFrame, watermark: Column) -> DataFrame:
    """snapshot_max and null_watermarks in one pass: upper and n."""
    return df.agg(F.max(watermark).cast("string").alias("upper"), F.count_if(watermark.isNull()).alias("n"))


def conjunction(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def window(watermark: Column, kind: T.DataType, lower: str | None, upper: str | None, lookback_seconds: int = 0) -> list[Column]:
    """lower < watermark <= upper, each bound optional and cast to the watermark's type, so that scans can skip by it.

    A later row equal to the committed cursor is never read again; lookback is the remedy.
    """
    out = []
    if lower is not None:
        bound = F.lit(lower).cast(kind)
        if lookback_seconds:
            if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise ConfigError("lookback_seconds needs a watermark that is a date or a timestamp")
            bound = lookback(bound, lookback_seconds, kind)
        out.append(watermark > bound)
    if upper is not None:
        out.append(watermark <= F.lit(upper).cast(kind))
    return out


def first_lower(committed: str | None, seed: str | None, skip_to_max: bool, upper: str | None) -> str | None:
    """The committed cursor; on a first run the seed, or the current largest value."""
    if committed is not None:
        return committed
    return upper if skip_to_max else seed


def api_days(committed: str | None, seed: str | None, from_date: date | None, to_date: date | None, lookback_days: int, today: date, full: bool = False) -> tuple[date, date]:
    """The inclusive days that an API is asked for. A resumed run goes lookback_days back, but not before from_date."""
    to = to_date or today
    if full:
        if from_date is None:
            raise ConfigError("a full load from an API needs from_date")
        return min(from_date, to), to
    cursor = committed if committed is not None else seed
    if cursor is None:
        if from_date is None:
            raise ConfigError("the first load from an API needs from_date or seed_watermark")
        start = from_date
    else:
        start = date.fromisoformat(cursor[:10])
        if committed is not None:
            start -= timedelta(days=lookback_days)
        if from_date is not None:
            start = max(start, from_date)
    return min(start, to), to
