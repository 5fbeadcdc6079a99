"""Sources as DataFrames: nothing is read before it is known which columns and rows are wanted."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.config import Transfer
from tidewell.errors import ConfigError
from tidewell.sources import jdbc
from tidewell.sources.descriptors import BigQuery, Catalog, Jdbc, Parquet
from tidewell.operators.store import Files


def table_name(name: str) -> list[str]:
    """The parts of catalog.schema.table; backticks keep a dotted part together."""
    out, part, quoted = [], "", False
    for c in name:
        if c == "`":
            quoted = not quoted
        elif c == "." and not quoted:
            out.append(part)
            part = ""
        else:
            part += c
    out.append(part)
    if quoted or not all(out) or len(out) > 3:
        raise ConfigError(f"{name!r} is no table name; write table, schema.table or catalog.schema.table")
    return out


def read(spark: SparkSession, source: Any, t: Transfer) -> DataFrame:
    """The source's rows. A query wins over a table."""
    if isinstance(source, Jdbc):
        return jdbc.read(spark, source, t)
    if isinstance(source, BigQuery):
        reader = spark.read.format("bigquery").options(**source.options(), maxParallelism=str(t.parallelism))
        return reader.option("query", t.source_query).load() if t.source_query else reader.load(".".join(table_name(t.source_table)))
    if isinstance(source, Parquet):
        if t.source_query:
            for name in Files(spark).names(source.path):
                if name.endswith(".parquet"):
                    spark.read.parquet(f"{source.path}/{name}").createOrReplaceTempView(name.removesuffix(".parquet"))
            return spark.sql(t.source_query)
        name = t.source_table if t.source_table.endswith(".parquet") else f"{t.source_table}.parquet"
        return spark.read.parquet(f"{source.path}/{name}")
    if isinstance(source, Catalog):
        return spark.sql(t.source_query) if t.source_query else spark.table(".".join(f"`{p}`" for p in table_name(t.source_table)))
    raise ConfigError(f"{type(source).__name__} is no source")
