"""Cursors: an append-only table, of which the latest row of a key counts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_table string, dest_table string, last_watermark string, rows long, chunk_cursor string, chunk_upper string, run_ts timestamp"


def latest(log: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The latest row of each key, by an aggregate instead of a sort."""
    return log.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values], F.max(order).alias(order))


class StateTable:
    """The cursors in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, source: str, dest: str) -> dict | None:
        if not self._exists():
            return None
        log = self.spark.read.schema(SCHEMA).parquet(self.path).where((F.col("source_table") == source) & (F.col("dest_table") == dest))
        found = latest(log.withColumn("value", F.struct("last_watermark", "rows", "chunk_cursor", "chunk_upper")), ["source_table", "dest_table"], "run_ts", ["value"]).select("value.*").first()
        return found.asDict() if found else None

    def append(self, source: str, dest: str, watermark: str | None, rows: int, chunk_cursor: str | None = None, chunk_upper: str | None = None) -> None:
        row = (source, dest, watermark, rows, chunk_cursor, chunk_upper, datetime.now(timezone.utc))
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
