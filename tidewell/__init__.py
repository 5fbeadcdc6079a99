"""tidewell: a Spark-first engine for moving, upserting and preparing tables."""

__version__ = "0.1.0"

from tidewell.errors import CommitConflict, ConfigError, SourceError, TidewellError, UnsupportedType, ValidationFailed  # noqa: E402
from tidewell.operators.archive import Archive  # noqa: E402
from tidewell.operators.quality import StagedInfo, Suite  # noqa: E402
from tidewell.sources.descriptors import AppsFlyer, BigQuery, Catalog, CleverTap, HttpApi, Jdbc, Lake, MySQL, Parquet, Postgres  # noqa: E402
from tidewell.sync import Progress, TransferResult, sync  # noqa: E402


def version() -> str:
    return __version__


__all__ = [
    "AppsFlyer", "Archive", "BigQuery", "Catalog", "CleverTap", "CommitConflict", "ConfigError", "HttpApi", "Jdbc", "Lake", "MySQL", "Parquet", "Postgres",
    "Progress", "SourceError", "StagedInfo", "Suite", "TidewellError", "TransferResult", "UnsupportedType", "ValidationFailed", "sync", "version",
]
