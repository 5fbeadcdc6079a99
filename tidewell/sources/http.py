"""HTTP sources as a Spark data source: one input partition for each window of days, records as one JSON column."""

from __future__ import annotations

import csv
import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.errors import ConfigError, SourceError
from tidewell.functions.coerce import coerced, json_text, lost
from tidewell.sources.descriptors import Api

#: What a report's body says, with status 200, when a quota is used up.
LIMIT_TEXTS = ("You've reached your maximum number", "Limit reached for", "limit reached", "maximum number of")
FIRST_WAIT, MOST_WAIT = 0.25, 15.0


def wait_seconds(attempt: int, retry_after: str | None = None) -> float:
    """250 ms, doubled after each attempt, or what the server asks for."""
    if retry_after and retry_after.strip().isdigit():
        return float(retry_after)
    return min(MOST_WAIT, FIRST_WAIT * 2 ** (attempt - 1))


def send(url: str, method: str = "GET", headers: dict[str, str] | None = None, body: bytes | None = None, attempts: int = 4, sleep=time.sleep) -> bytes:
    """429, 5xx and broken connections are tried again; other answers are errors for good."""
    for attempt in range(1, attempts + 1):
        after = None
        try:
            request = urllib.request.Request(url, data=body, headers=headers or {}, method=method)  # noqa: S310
            with urllib.request.urlopen(request, timeout=300) as answer:  # noqa: S310
                return answer.read()
        except urllib.error.HTTPError as error:
            if error.code != 429 and error.code < 500:
                raise SourceError(f"{method} {url}: status {error.code}: {error.read()[:300].decode(errors='replace')}") from None
            after, text = error.headers.get("Retry-After"), f"status {error.code}"
        except (urllib.error.URLError, ConnectionError, TimeoutError) as error:
            text = str(error)
        if attempt == attempts:
            raise SourceError(f"{method} {url}: {text}, after {attempts} attempts", transient=True)
        sleep(wait_seconds(attempt, after))
    raise AssertionError


def substituted(template: str, first: str, last: str) -> str:
    return template.replace("{from}", first).replace("{to}", last)


def at_path(value: Any, path: str | None) -> Any:
    for part in path.split(".") if path else ():
        value = value.get(part) if isinstance(value, dict) else None
    return value


def records_of(body: Any, path: str | None) -> list[Any]:
    """The array at a path; a lone object is one record, null or nothing is none."""
    found = at_path(body, path)
    if found is None:
        return []
    return found if isinstance(found, list) else [found]


def csv_records(data: bytes, declared: list[str]) -> Iterator[dict[str, str]]:
    """Rows as flat objects. Short rows are filled with empty text, long ones cut; a declared header must be there."""
    reader = csv.reader(io.StringIO(data.decode("utf-8-sig", errors="replace"), newline=""))
    header = next(reader, None)
    if header is None:
        return
    header = [h.strip() for h in header]
    if gone := [d for d in declared if d not in header]:
        raise ConfigError(f"the CSV has no column {', '.join(map(repr, gone))}; it has {', '.join(header)}")
    for row in reader:
        if row:
            yield dict(zip(header, row + [""] * (len(header) - len(row))))


def http_pages(r: dict[str, Any], first: str, last: str, declared: list[str], attempts: int) -> Iterator[Any]:
    url, cursor, seen = substituted(r["url"], first, last), None, set()
    body = substituted(r["body"], first, last).encode() if r["body"] is not None else None
    while True:
        at = url if cursor is None else f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode({r['cursor_param']: cursor})}"
        data = send(at, r["method"], r["headers"], body, attempts)
        if r["format"] == "csv":
            yield from csv_records(data, declared)
            return
        parsed = json.loads(data) if data.strip() else None
        yield from records_of(parsed, r["records_path"])
        cursor = at_path(parsed, r["cursor_path"]) if r["cursor_path"] else None
        if cursor in (None, "") or str(cursor) in seen:  # no progress
            return
        seen.add(str(cursor))


def export_pages(r: dict[str, Any], first: str, last: str, attempts: int) -> Iterator[Any]:
    """Create a cursor, then read pages; the last page still holds records, an empty one or no cursor ends."""
    body = json.dumps({"event_name": r["event_name"], "from": int(first.replace("-", "")), "to": int(last.replace("-", ""))}).encode()
    headers = r["headers"] | {"Content-Type": "application/json"}
    answer = json.loads(send(f"{r['url']}/1/events.json?batch_size={r['batch_size']}", "POST", headers, body, attempts))
    if answer.get("status") == "fail":
        raise SourceError(f"the export was refused: {answer.get('error')}")
    cursor = answer.get("cursor")
    while cursor:
        answer = json.loads(send(f"{r['url']}/1/events.json?{urllib.parse.urlencode({'cursor': cursor})}", "GET", headers, None, attempts))
        if answer.get("status") == "fail":
            raise SourceError(f"a page was refused: {answer.get('error')}")
        found = answer.get("records") or []
        yield from found
        cursor = answer.get("next_cursor") if found and answer.get("status") == "partial" else None


def report_url(r: dict[str, Any], first: str, last: str) -> str:
    extra = sorted((k, v) for k, v in r["params"].items() if k not in ("from", "to"))
    return r["url"] + "?" + urllib.parse.urlencode([("from", first), ("to", last), *extra])


def report_rows(r: dict[str, Any], first: str, last: str, declared: list[str], attempts: int) -> Iterator[Any]:
    data = send(report_url(r, first, last), "GET", r["headers"], None, attempts)
    head = data[:300].decode(errors="replace")
    if any(x in head for x in LIMIT_TEXTS) and "," not in head.split("\n", 1)[0]:
        raise SourceError(f"the report's quota is used up: {head.strip()}")
    yield from csv_records(data, declared)


class Window(InputPartition):
    def __init__(self, first: str, last: str):
        self.first, self.last = first, last


class Records(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.request, self.windows = json.loads(options["request"]), json.loads(options["windows"])
        self.declared, self.attempts = json.loads(options["declared"]), int(options["attempts"])

    def partitions(self) -> list[Window]:
        return [Window(*w) for w in self.windows]

    def read(self, w: Window) -> Iterator[tuple[str]]:
        kind = self.request["kind"]
        if kind == "http":
            rows = http_pages(self.request, w.first, w.last, self.declared, self.attempts)
        elif kind == "cursor_export":
            rows = export_pages(self.request, w.first, w.last, self.attempts)
        else:
            rows = report_rows(self.request, w.first, w.last, self.declared, self.attempts)
        for row in rows:
            yield (json.dumps(row, ensure_ascii=False, separators=(",", ":")),)


class ApiSource(DataSource):
    """Records of an HTTP API as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_api"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> Records:
        return Records(self.options)


def windows(first: date, last: date, per_day: bool) -> list[tuple[str, str]]:
    if not per_day:
        return [(first.isoformat(), last.isoformat())]
    return [(d.isoformat(), d.isoformat()) for d in (first + timedelta(days=k) for k in range((last - first).days + 1))]


def read(spark: SparkSession, source: Api, first: date, last: date) -> DataFrame:
    """The records of the days from first to last, as one column."""
    spark.dataSource.register(ApiSource)
    _, paths = source.schema()
    per_day = getattr(source, "per_day", False)
    return spark.read.format("tidewell_api").options(request=json.dumps(source.request()), windows=json.dumps(windows(first, last, per_day)), declared=json.dumps(sorted(set(paths.values()))), attempts=str(source.max_attempts)).load()


def typed(records: DataFrame, source: Api) -> tuple[DataFrame, dict]:
    """Declared columns of the records, and by name whether a value that was there became null."""
    schema, paths = source.schema()
    texts = records.select(*[json_text(F.col("record"), paths[f.name]).alias(f"_t_{f.name}") for f in schema.fields])
    out = texts.select("*", *[coerced(F.col(f"`_t_{f.name}`"), f.dataType).alias(f.name) for f in schema.fields])
    counters = {f.name: lost(F.col(f"`_t_{f.name}`"), F.col(f"`{f.name}`"), f.dataType) for f in schema.fields}
    return out, counters


def exploded(bodies: DataFrame, column: str, path: str | None) -> DataFrame:
    """Records of JSON bodies, natively: the elements of an array at a path, or a lone object."""
    from tidewell.functions.coerce import json_path

    found = F.get_json_object(F.col(column), json_path(path) if path else "$")
    listed = F.from_json(found, "array<string>", {"mode": "PERMISSIVE"})
    rows = F.when(F.startswith(F.ltrim(found), F.lit("[")), listed).when(found.isNotNull(), F.array(found))
    return bodies.select("*", F.explode(rows).alias("record"))
