"""Where rows come from and go to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import types as T

from tidewell.errors import ConfigError
from tidewell.functions.types import declared_type
from tidewell.operators.archive import Archive


@dataclass(frozen=True)
class Jdbc:
    """A database by JDBC: either dsn, or host, port, user, password and database. options go to Spark's reader."""

    dsn: str | None = None
    host: str | None = None
    port: int | None = None
    user: str | None = None
    password: str | None = None
    database: str | None = None
    statement_timeout_secs: int = 0
    ca_cert_file: str | None = None
    client_cert_file: str | None = None
    client_key_file: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    scheme, driver, standard_port = "jdbc", "", 0

    def __post_init__(self) -> None:
        discrete = [n for n in ("host", "port", "user", "password", "database") if getattr(self, n) is not None]
        if self.dsn and discrete:
            raise ConfigError(f"give dsn or {', '.join(discrete)}, not both")
        if not self.dsn and not self.host:
            raise ConfigError("give dsn, or host and the other fields")
        if bool(self.client_cert_file) != bool(self.client_key_file):
            raise ConfigError("client_cert_file and client_key_file belong together")

    def parts(self) -> dict[str, Any]:
        if not self.dsn:
            return {"host": self.host, "port": self.port or self.standard_port, "user": self.user, "password": self.password, "database": self.database or "", "query": {}}
        u = urlsplit(self.dsn)
        return {"host": u.hostname, "port": u.port or self.standard_port, "user": unquote(u.username) if u.username else None, "password": unquote(u.password) if u.password else None, "database": unquote(u.path.lstrip("/")), "query": dict(parse_qsl(u.query))}

    def jdbc_url(self) -> str:
        if self.dsn and self.dsn.startswith("jdbc:"):
            return self.dsn
        p = self.parts()
        return f"jdbc:{self.scheme}://{p['host']}:{p['port']}/{p['database']}"

    def properties(self, application_name: str) -> dict[str, str]:
        out = dict(self.options)
        if self.driver:
            out["driver"] = self.driver
        if self.statement_timeout_secs:
            out["queryTimeout"] = str(self.statement_timeout_secs)
        if not (self.dsn and self.dsn.startswith("jdbc:")):
            p = self.parts()
            out |= {k: p[k] for k in ("user", "password") if p[k]} | p["query"]
        return out


@dataclass(frozen=True)
class Postgres(Jdbc):
    """PostgreSQL. TLS follows sslmode of the dsn."""

    scheme, driver, standard_port = "postgresql", "org.postgresql.Driver", 5432

    def properties(self, application_name: str) -> dict[str, str]:
        out = super().properties(application_name) | {"ApplicationName": application_name, "preferTimestampNTZ": "true"}
        named = {"sslrootcert": self.ca_cert_file, "sslcert": self.client_cert_file, "sslkey": self.client_key_file}
        return out | {k: v for k, v in named.items() if v}


@dataclass(frozen=True)
class MySQL(Jdbc):
    """MySQL. Zero dates are read as null."""

    require_tls: bool = False
    scheme, driver, standard_port = "mysql", "com.mysql.cj.jdbc.Driver", 3306

    def properties(self, application_name: str) -> dict[str, str]:
        out = super().properties(application_name) | {"zeroDateTimeBehavior": "CONVERT_TO_NULL", "connectionAttributes": f"program_name:{application_name}", "sessionVariables": "time_zone='+00:00'"}
        if self.require_tls or self.ca_cert_file:
            out["sslMode"] = "VERIFY_CA" if self.ca_cert_file else "REQUIRED"
        named = {"trustCertificateKeyStoreUrl": self.ca_cert_file, "clientCertificateKeyStoreUrl": self.client_cert_file}
        return out | {k: f"file:{v}" for k, v in named.items() if v}


@dataclass(frozen=True)
class BigQuery:
    """Google BigQuery by the public Spark connector, which must be on the class path."""

    project_id: str | None = None
    credentials_file: str | None = None
    is_warehouse = True

    def options(self) -> dict[str, str]:
        return {k: v for k, v in {"parentProject": self.project_id, "credentialsFile": self.credentials_file}.items() if v}


@dataclass(frozen=True)
class Parquet:
    """Parquet files: source_table is a file or folder under path. Tables of path are views for source_query."""

    path: str


@dataclass(frozen=True)
class Catalog:
    """Tables and views of the session: source_table is a name, source_query is SQL."""


Columns = Sequence[tuple] | Mapping[str, str]


def api_columns(columns: Columns, paths: Mapping[str, str] | None = None) -> tuple[T.StructType, dict[str, str]]:
    """A declared schema: (name, type[, path]) or {name: type} with paths. Returns it and the path of each column."""
    rows = [(n, k, (paths or {}).get(n, n)) for n, k in columns.items()] if isinstance(columns, Mapping) else [(c[0], c[1], c[2] if len(c) > 2 else (paths or {}).get(c[0], c[0])) for c in columns]
    if not rows:
        raise ConfigError("columns: declare at least one")
    names = [r[0] for r in rows]
    if double := sorted({n for n in names if names.count(n) > 1}):
        raise ConfigError(f"columns: {', '.join(double)} declared twice")
    return T.StructType([T.StructField(n, declared_type(k, n), True, {"declared": k.strip().upper()}) for n, k, _ in rows]), {n: p for n, _, p in rows}


@dataclass(frozen=True)
class Api:
    """What all HTTP sources have. Days from from_date to to_date (today by default) are read, each in a task."""

    columns: Columns = ()
    paths: Mapping[str, str] | None = None
    from_date: str | None = None
    to_date: str | None = None
    lookback_days: int = 0
    max_attempts: int = 4
    is_api = True

    def days(self) -> tuple[date | None, date | None]:
        return tuple(date.fromisoformat(d) if d else None for d in (self.from_date, self.to_date))

    def schema(self) -> tuple[T.StructType, dict[str, str]]:
        return api_columns(self.columns, self.paths)

    def state_id(self) -> str:
        raise NotImplementedError

    def request(self) -> dict[str, Any]:
        raise NotImplementedError


@dataclass(frozen=True)
class HttpApi(Api):
    """JSON or CSV over HTTP. {from} and {to} in url and body stand for the window's days."""

    url: str = ""
    method: str = "GET"
    body: str | None = None
    headers: Mapping[str, str] = field(default_factory=dict)
    format: str = "json"
    records_path: str | None = None
    cursor_path: str | None = None
    cursor_param: str | None = None
    per_day: bool = False

    def __post_init__(self) -> None:
        if not self.url:
            raise ConfigError("url is empty")
        if self.method.upper() not in ("GET", "POST"):
            raise ConfigError(f"method {self.method!r}: use GET or POST")
        if self.format not in ("json", "csv"):
            raise ConfigError(f"format {self.format!r}: use json or csv")
        if bool(self.cursor_path) != bool(self.cursor_param):
            raise ConfigError("cursor_path and cursor_param belong together")
        if self.format == "csv" and self.cursor_path:
            raise ConfigError("CSV has no pages; leave out cursor_path and cursor_param")

    def state_id(self) -> str:
        return f"http:{self.url}"

    def request(self) -> dict[str, Any]:
        return {"kind": "http", "url": self.url, "method": self.method.upper(), "body": self.body, "headers": dict(self.headers), "format": self.format, "records_path": self.records_path, "cursor_path": self.cursor_path, "cursor_param": self.cursor_param}


@dataclass(frozen=True)
class CleverTap(Api):
    """Event exports: a cursor is created for a range of days and pages are read while the answer is partial."""

    account_id: str = ""
    passcode: str = ""
    event_name: str = ""
    region: str = "eu1"
    batch_size: int = 1000
    base_url: str | None = None

    def state_id(self) -> str:
        return f"clevertap:{self.account_id}:{self.event_name}"

    def request(self) -> dict[str, Any]:
        base = self.base_url or f"https://{self.region}.api.clevertap.com"
        return {"kind": "cursor_export", "url": base, "headers": {"X-CleverTap-Account-Id": self.account_id, "X-CleverTap-Passcode": self.passcode}, "event_name": self.event_name, "batch_size": self.batch_size}


@dataclass(frozen=True)
class AppsFlyer(Api):
    """Raw-data reports in CSV."""

    app_id: str = ""
    report: str = "installs_report"
    token: str = ""
    params: Mapping[str, str] = field(default_factory=dict)
    base_url: str | None = None

    def state_id(self) -> str:
        return f"appsflyer:{self.app_id}:{self.report}"

    def request(self) -> dict[str, Any]:
        base = self.base_url or "https://hq1.appsflyer.com"
        return {"kind": "report", "url": f"{base}/api/raw-data/export/app/{self.app_id}/{self.report}/v5", "headers": {"Authorization": f"Bearer {self.token}"}, "params": dict(self.params)}


@dataclass(frozen=True)
class Lake:
    """The target: tables in folders under path.

    dedup: 'merge' merges an incremental load by its key; 'lazy' inserts it, and reading keeps the last row of a
    sorting key. archive: a copy of each run's rows.
    """

    path: str
    dedup: str = "merge"
    archive: Archive | None = None

    def __post_init__(self) -> None:
        if self.dedup not in ("merge", "lazy"):
            raise ConfigError(f"dedup {self.dedup!r}: use merge or lazy")
