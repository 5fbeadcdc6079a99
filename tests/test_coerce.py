from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.errors import ConfigError, UnsupportedType
from tidewell.functions import coerce as C
from tidewell.functions import types as types_


def run(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_decimals(spark):
    got = run(spark, ["12.345", "-12.345", "5.", ".5", "1e3", "abc", "", None, " 7.005 ", "12345678901.5"], lambda c: C.as_decimal(c, 10, 2))
    assert got == [Decimal("12.35"), Decimal("-12.35"), Decimal("5.00"), Decimal("0.50"), None, None, None, None, Decimal("7.01"), None]
    assert run(spark, ["123456789012345.6789012345"], lambda c: C.as_decimal(c, 30, 10)) == [Decimal("123456789012345.6789012345")]
    assert run(spark, ["12345.67"], lambda c: C.as_decimal(c, 5, 2)) == [None]
    doubles = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1.25,)], "d double")
    assert [r[0] for r in doubles.select(C.float_as_decimal(F.col("d"), 10, 1)).collect()] == [None, None, None, Decimal("1.3")]


def test_numbers_and_booleans(spark):
    assert run(spark, ["12", " -7 ", "12.7", "", "+5", "99999999999999999999"], C.as_integer) == [12, -7, None, None, 5, None]
    assert run(spark, ["1.5", "1e3", "1d", "1f", "-.25", "inf"], C.as_float) == [1.5, 1000.0, None, None, -0.25, float("inf")]
    assert run(spark, ["TRUE", "no", "y", " t ", "0", "2", "Yes", "F"], C.as_boolean) == [True, False, None, True, False, None, True, False]


def test_temporal_forms(spark):
    days = run(spark, ["2026-07-22", "20260722", "20260722193602", "1700000000", "-1", "2024", "2024-1-5", "20261399", "x", None], C.as_date)
    assert days == [date(2026, 7, 22), date(2026, 7, 22), date(2026, 7, 22), date(2023, 11, 14), date(1969, 12, 31), date(1970, 1, 1), None, None, None, None]
    times = run(spark, ["2026-07-22T19:36:02Z", "2026-07-22T19:36:02+05:30", "2026-07-22 19:36:02", "20260722193602", "20261399999999", "1700000000", "2024-01-01", "2024", "99999999999999999"], lambda c: C.as_timestamp(c, zoned=False))
    assert times == [datetime(2026, 7, 22, 19, 36, 2), datetime(2026, 7, 22, 14, 6, 2), datetime(2026, 7, 22, 19, 36, 2), datetime(2026, 7, 22, 19, 36, 2), None, datetime(2023, 11, 14, 22, 13, 20), None, datetime(1970, 1, 1, 0, 33, 44), None]
    assert run(spark, ["0000-00-00", "2024-00-15", "2024-05-01"], C.zero_date) == [None, None, date(2024, 5, 1)]


def test_range_clamp(spark):
    days = run(spark, ["3000-01-01", "1000-01-01", "1899-12-31", "1900-01-01", "2299-12-31", "2300-01-01"], lambda c: C.in_range(c.cast("date"), T.DateType()))
    assert [d is None for d in days] == [True, True, True, False, False, True]
    at = run(spark, ["2299-12-31 23:59:59.999999", "2300-01-01 00:00:00"], lambda c: C.in_range(c.cast("timestamp_ntz"), T.TimestampNTZType()).cast("string"))
    assert at == ["2299-12-31 23:59:59.999999", None]


def test_json_text(spark):
    record = '{"a":{"b":"x"},"n":12,"t":true,"z":null,"o":{"p":[1,2]},"l":[{"q":1}],"a.b":"dot"}'
    for path, want in (("a.b", "x"), ("n", "12"), ("t", "true"), ("z", None), ("none", None), ("o", '{"p":[1,2]}'), ("l.q", None)):
        assert run(spark, [record], lambda c, p=path: C.json_text(c, p)) == [want], path


def test_time_text(spark):
    got = [r[0] for r in spark.createDataFrame([(37800000000,), (86399123456,), (-18000000000,), (3020399000000,), (None,)], "m long").select(C.time_text(F.col("m"))).collect()]
    assert got == ["10:30:00", "23:59:59.123456", "-05:00:00", "838:59:59", None]


def test_lookback(spark):
    day = spark.range(1).select(C.lookback(F.lit("2024-01-15").cast("date"), 3600, T.DateType())).first()[0]
    assert day == date(2024, 1, 14)
    at = spark.range(1).select(C.lookback(F.lit("2024-01-15").cast("timestamp_ntz"), 45, T.TimestampNTZType())).first()[0]
    assert at == datetime(2024, 1, 14, 23, 59, 15)


def test_types():
    assert types_.postgres_type("numeric") == T.DoubleType()
    assert types_.mysql_type("tinyint", 1) == T.BooleanType()
    assert types_.mysql_type("tinyint", 1, tinyint1_as_bool=False) == T.ByteType()
    assert types_.mysql_type("bigint", unsigned=True) == T.DecimalType(20, 0)
    assert types_.declared_type("decimal") == T.DecimalType(38, 9)
    for bad in ("RECORD", "INTERVAL"):
        with pytest.raises(UnsupportedType):
            types_.declared_type(bad)
    with pytest.raises(UnsupportedType):
        types_.postgres_type("point", "where")
    assert types_.overridden(T.DoubleType(), "Decimal(10, 2)", exact_source=False) == T.DoubleType()
    assert types_.overridden(T.DoubleType(), "Decimal(10, 2)", exact_source=True) == T.DecimalType(10, 2)
    assert types_.overridden(T.TimestampType(), "DATETIME", False) == T.TimestampNTZType()
    assert types_.overridden(T.TimestampNTZType(), "DateTime64(3, 'UTC')", False) == T.TimestampType()
    assert types_.overridden(T.StringType(), "UUID", False) == T.StringType()
    with pytest.raises(ConfigError):
        types_.decimal_of("Decimal(39, 2)")
