"""A copy of what was transferred, as Parquet in folders by day and run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from tidewell.errors import ConfigError


@dataclass(frozen=True)
class Archive:
    """Where to: <path>/<prefix>/<table>/dt=<day>/run=<run>/part-*.parquet, with zstd, snappy or none."""

    path: str
    prefix: str = ""
    compression: str = "zstd"

    def __post_init__(self) -> None:
        if not self.path:
            raise ConfigError("archive: path is empty")
        if self.compression not in ("zstd", "snappy", "none"):
            raise ConfigError(f"archive: compression {self.compression!r} is unknown; use zstd, snappy or none")

    def folder(self, table: str, run: str, at: datetime) -> str:
        parts = [self.path.rstrip("/"), self.prefix.strip("/"), table, f"dt={at:%Y-%m-%d}", f"run={run}"]
        return "/".join(p for p in parts if p)

    def write(self, staged: DataFrame, table: str, run: str, at: datetime) -> str:
        """Write staged rows, after they passed the gate; a failure fails the run."""
        where = self.folder(table, run, at)
        staged.write.option("compression", "uncompressed" if self.compression == "none" else self.compression).parquet(where)
        return where


def by_day(df: DataFrame, day_column: str, path: str, compression: str = "zstd") -> DataFrame:
    """Write rows by day and read them back."""
    df.hint("rebalance", day_column).write.mode("overwrite").option("compression", compression).partitionBy(day_column).parquet(path)
    return df.sparkSession.read.parquet(path)
