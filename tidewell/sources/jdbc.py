"""Databases, read in ranges of a key by several connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.config import Transfer
from tidewell.sources.descriptors import Jdbc


def split_range(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """At most n inclusive ranges of equal size that cover low to high."""
    step = max(1, -(-(high - low + 1) // max(1, n)))
    return [(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]


def range_predicates(column: str, ranges: list[tuple[int, int]], nullable: bool) -> list[str]:
    """A predicate for each range, and one for rows without a key."""
    out = [f"{column} >= {a} AND {column} <= {b}" for a, b in ranges]
    return out + [f"{column} IS NULL"] if nullable or not out else out


def range_columns(column: str, ranges: list[tuple[int, int]], nullable: bool) -> list:
    """The same as columns."""
    c = F.col(f"`{column}`")
    out = [c.between(a, b) for a, b in ranges]
    return out + [c.isNull()] if nullable or not out else out


def partition_bounds(df: DataFrame, column: str) -> DataFrame:
    """The smallest and largest key: one row."""
    c = F.col(f"`{column}`")
    return df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))


def quoted(name: str, mark: str = '"') -> str:
    """An identifier of SQL, each part of a dotted name by itself."""
    return ".".join(mark + part.replace(mark, mark * 2) + mark for part in name.split("."))


def dbtable(t: Transfer, mark: str) -> str:
    """A query wins over a table."""
    return f"({t.source_query}) _src" if t.source_query else quoted(t.source_table, mark)


def read(spark: SparkSession, source: Jdbc, t: Transfer) -> DataFrame:
    """One partition for each range of partition_column (or the first key), if that is a whole number; else one."""
    mark = "`" if source.scheme == "mysql" else '"'
    options = source.properties(t.application_name) | {"fetchsize": str(t.batch_rows)}
    if source.scheme == "mysql":
        options["tinyInt1isBit"] = str(t.tinyint1_as_bool).lower()
    table = dbtable(t, mark)
    one = spark.read.format("jdbc").options(url=source.jdbc_url(), dbtable=table, **options).load()
    name = t.partition_column or (t.source_name(t.key[0]) if t.key else None)
    if t.parallelism == 1 or t.chunk_rows or name not in one.columns or dict(one.dtypes)[name] not in ("tinyint", "smallint", "int", "bigint"):
        return one
    row = partition_bounds(one, name).first()
    if row["lo"] is None:
        return one
    predicates = range_predicates(quoted(name, mark), split_range(int(row["lo"]), int(row["hi"]), t.parallelism), one.schema[name].nullable)
    return spark.read.jdbc(source.jdbc_url(), table, predicates=predicates, properties=options)
