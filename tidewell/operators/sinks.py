"""Destinations beside the lake: warehouses that Spark connectors write to.

Sink is what any destination of rows offers; the lake's Table has the same three calls for its own parts. A connector must be
on the class path to write; what is sent to it is decided here, so it can be tested without one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.errors import ConfigError


@runtime_checkable
class Sink(Protocol):
    """A destination of rows: append, replace the contents at once, and count."""

    def append(self, rows: DataFrame, table: str) -> None: ...

    def replace(self, rows: DataFrame, table: str) -> None: ...

    def count(self, spark: SparkSession, table: str) -> int: ...


@dataclass(frozen=True)
class BigQuerySink:
    """Google BigQuery by the public Spark connector. method direct is the Storage Write API, indirect a load job by way of bucket."""

    dataset: str
    project_id: str | None = None
    credentials_file: str | None = None
    method: str = "direct"
    bucket: str | None = None
    partition_by: str | None = None
    cluster_by: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.method not in ("direct", "indirect"):
            raise ConfigError(f"method {self.method!r}: use direct or indirect")
        if self.method == "indirect" and not self.bucket:
            raise ConfigError("method indirect needs a bucket")
        if len(self.cluster_by) > 4:
            raise ConfigError("cluster_by: at most four columns")

    def options(self, table: str) -> dict[str, str]:
        named = {
            "table": f"{self.project_id}.{self.dataset}.{table}" if self.project_id else f"{self.dataset}.{table}", "writeMethod": self.method, "parentProject": self.project_id, "credentialsFile": self.credentials_file,
            "temporaryGcsBucket": self.bucket if self.method == "indirect" else None, "partitionField": self.partition_by, "partitionType": "DAY" if self.partition_by else None, "clusteredFields": ",".join(self.cluster_by) or None,
            "writeAtLeastOnce": "false" if self.method == "direct" else None,
        }
        return {k: v for k, v in named.items() if v is not None}

    def append(self, rows: DataFrame, table: str) -> None:
        rows.write.format("bigquery").options(**self.options(table)).mode("append").save()

    def replace(self, rows: DataFrame, table: str) -> None:
        rows.write.format("bigquery").options(**self.options(table)).mode("overwrite").save()

    def count(self, spark: SparkSession, table: str) -> int:
        return spark.read.format("bigquery").options(**self.options(table)).load().count()


#: Column types of the column store, by Spark's.
CLICKHOUSE_TYPES = {"boolean": "Bool", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "String", "binary": "String", "date": "Date32", "timestamp": "DateTime64(6, 'UTC')", "timestamp_ntz": "DateTime64(6)"}


def clickhouse_type(f: T.StructField, key: Sequence[str]) -> str:
    """The type of a column: nullable unless it is in the sorting key."""
    kind = f"Decimal({f.dataType.precision}, {f.dataType.scale})" if isinstance(f.dataType, T.DecimalType) else CLICKHOUSE_TYPES.get(f.dataType.simpleString())
    if kind is None:
        raise ConfigError(f"{f.name!r}: there is no column type for {f.dataType.simpleString()}")
    return f"Nullable({kind})" if f.nullable and f.name not in key else kind


@dataclass(frozen=True)
class ClickHouseSink:
    """ClickHouse by JDBC. Rows of a sorting key are replaced by later ones when read with FINAL, if the engine is ReplacingMergeTree."""

    host: str
    database: str = "default"
    port: int = 8123
    user: str = "default"
    password: str = ""
    engine: str = "MergeTree"
    key: Sequence[str] = ()
    version: str | None = None
    batch_rows: int = 100_000
    options: Mapping[str, str] = field(default_factory=dict)

    def properties(self) -> dict[str, str]:
        return {"driver": "com.clickhouse.jdbc.ClickHouseDriver", "user": self.user, "password": self.password, "batchsize": str(self.batch_rows), "isolationLevel": "NONE", **self.options}

    def url(self) -> str:
        return f"jdbc:clickhouse://{self.host}:{self.port}/{self.database}"

    def create_table(self, schema: T.StructType, table: str) -> str:
        """The statement that makes the table."""
        columns = ", ".join(f"`{f.name}` {clickhouse_type(f, self.key)}" for f in schema.fields)
        engine = f"{self.engine}({self.version})" if self.version and self.engine == "ReplacingMergeTree" else f"{self.engine}()"
        order = ", ".join(f"`{k}`" for k in self.key)
        return f"CREATE TABLE IF NOT EXISTS `{self.database}`.`{table}` ({columns}) ENGINE = {engine} ORDER BY ({order})"

    def table_options(self, schema: T.StructType) -> dict[str, str]:
        """What Spark needs to make a table of its own accord."""
        engine = self.create_table(schema, "t").partition(" ENGINE = ")[2]
        return {"createTableOptions": f"ENGINE = {engine}", "createTableColumnTypes": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)}

    def append(self, rows: DataFrame, table: str) -> None:
        rows.write.format("jdbc").options(url=self.url(), dbtable=f"`{table}`", **self.properties()).mode("append").save()

    def replace(self, rows: DataFrame, table: str) -> None:
        """Empties the table and fills it; unlike the lake's swap, readers can see it in between."""
        rows.write.format("jdbc").options(url=self.url(), dbtable=f"`{table}`", truncate="true", **self.properties()).mode("overwrite").save()

    def count(self, spark: SparkSession, table: str) -> int:
        final = " FINAL" if self.engine == "ReplacingMergeTree" else ""
        return int(spark.read.format("jdbc").options(url=self.url(), query=f"SELECT count() AS n FROM `{table}`{final}", **self.properties()).load().agg(F.max("n")).first()[0])
