"""One transfer: read, stage, check, promote, and only then move the cursor."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import config
from tidewell.config import FULL, INCREMENTAL, Transfer, mode_of
from tidewell.errors import ConfigError, TidewellError, transient
from tidewell.operators.quality import StagedInfo
from tidewell.operators.store import Manifest, Part, Table, with_retries
from tidewell.plans.projection import Plan, check_required, plan
from tidewell.sources import frames, http
from tidewell.sources.descriptors import Lake
from tidewell.streaming.chunks import chunk_key, pages
from tidewell.streaming.state import StateTable
from tidewell.streaming.window import api_days, conjunction, first_lower, survey, type_of, watermark_column, window

log = logging.getLogger("tidewell")


@dataclass(frozen=True)
class Progress:
    rows_read: int
    rows_written: int
    bytes_written: int
    elapsed_secs: float

    @property
    def rows_per_sec(self) -> float:
        return self.rows_written / self.elapsed_secs if self.elapsed_secs else 0.0


@dataclass(frozen=True)
class TransferResult:
    rows_read: int
    rows_written: int
    bytes_written: int
    duration_secs: float
    new_watermark: str | None
    coerced: dict[str, int]


class Throttle:
    """Holds reads that the driver paces (pages and API windows) to so many rows a second; idle time earns nothing."""

    def __init__(self, rows_per_sec: int | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep, self.free_at = rows_per_sec, clock, sleep, 0.0

    def take(self, rows: int) -> None:
        if not self.rate or not rows:
            return
        now = self.clock()
        start = max(now, self.free_at)
        self.free_at = start + rows / self.rate
        if start > now:
            self.sleep(start - now)


class Run:
    """What one attempt has at hand."""

    def __init__(self, spark: SparkSession, source: Any, target: Lake, t: Transfer):
        self.spark, self.source, self.target, self.t = spark, source, target, t
        self.table = Table(spark, f"{target.path.rstrip('/')}/{t.dest_table}")
        self.state = StateTable(spark, f"{target.path.rstrip('/')}/{t.state_table_name}")
        self.started, self.began, self.id = time.monotonic(), datetime.now(timezone.utc), uuid.uuid4().hex
        self.rows = self.bytes = 0
        self.coerced: dict[str, int] = {}
        self.merges = target.dedup == "merge"
        self.state_key = t.state_key or (source.state_id() if getattr(source, "is_api", False) else t.source_table or t.source_query)
        self.throttle = Throttle(t.read_max_rows_per_sec)

    def prepare(self, schema: T.StructType) -> Manifest:
        """Create the table, or add columns that it lacks."""
        t, base = self.t, self.table.manifest()
        if base is None:
            if not t.create_if_missing:
                raise ConfigError(f"the destination {t.dest_table!r} does not exist, and create_if_missing is off")
            version = t.watermark_destination if t.merges_rows() else None
            return self.table.create(schema, t.key, t.order_by, version, t.engine_name, t.partition_by)
        return self.table.evolve(schema, any_case=self.merges) if t.evolve_schema else base

    def staged(self, rows: DataFrame, lost: dict[str, Any], schema: T.StructType, base: Manifest) -> tuple[Part, ...]:
        """Write rows once, counting them and what coercion lost on the way."""
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("_rows"), *[F.sum(F.when(c, 1).otherwise(0)).alias(f"_lost_{n}") for n, c in lost.items()]]
        kept = rows.observe(seen, *counts).select(*[F.col(f"`{f.name}`") for f in schema.fields])
        have = set(base.struct.fieldNames())
        if extra := [n for n in kept.columns if n not in have]:
            raise ConfigError(f"the destination {self.t.dest_table!r} has no column {', '.join(extra)}; turn evolve_schema on, or leave them out with exclude")
        parts = self.table.stage(kept, base)
        got = seen.get
        n = int(got["_rows"])
        self.rows += n
        self.bytes += self.table.bytes_of(parts)
        for name in lost:
            if c := int(got[f"_lost_{name}"] or 0):
                self.coerced[name] = self.coerced.get(name, 0) + c
                log.warning("%s: %d values of %s were out of range or unreadable and became null", self.t.dest_table, c, name)
        self.throttle.take(n)
        return parts

    def promote(self, parts: tuple[Part, ...], schema: T.StructType, rows: int) -> None:
        """Check what was staged, then show it at once; what is not shown is removed."""
        t = self.t
        try:
            staged = self.table.staged(parts).select(*[F.col(f"`{f.name}`") for f in schema.fields])
            check_required(staged, schema)
            if t.validate:
                t.validate(StagedInfo(f"{t.dest_table}{t.staging_suffix}", t.dest_table, rows, staged))
            if self.target.archive:
                self.target.archive.write(staged, t.dest_table, self.id, self.began)
            if t.mode == FULL:
                before = self.table.count()
                if before and rows < before / 2:
                    log.warning("%s shrinks from %d to %d rows", t.dest_table, before, rows)
                with_retries(lambda: self.table.replace(parts))
            elif t.mode == INCREMENTAL and self.merges:
                with_retries(lambda: self.table.merge(parts, schema.fieldNames(), t.key, t.watermark_destination, t.merge_prune_partition_by, t.delete_stale_in_window))
            else:
                with_retries(lambda: self.table.append(parts))
        finally:
            try:
                self.table.discard(parts)
            except Exception:  # noqa: BLE001  cleaning up never hides why a run failed
                log.warning("%s: staged rows could not be removed", t.dest_table, exc_info=True)
        self.progress()

    def progress(self) -> None:
        if not self.t.on_progress:
            return
        try:
            self.t.on_progress(Progress(self.rows, self.rows, self.bytes, time.monotonic() - self.started))
        except Exception:  # noqa: BLE001  a display never ends a transfer
            log.warning("on_progress failed", exc_info=True)

    def result(self, watermark: str | None) -> TransferResult:
        return TransferResult(self.rows, self.rows, self.bytes, time.monotonic() - self.started, watermark, self.coerced)


def _database(run: Run) -> TransferResult:
    t, spark = run.t, run.spark
    df = frames.read(spark, run.source, t)
    made: Plan = plan(df.schema, t, run.merges)
    wm, upper, lower, kind, resume = None, None, None, None, None
    key = chunk_key(df.schema, t) if t.chunk_rows else None
    if t.mode == INCREMENTAL:
        wm = watermark_column(df, t.watermark, t.watermark_source_expr)
        kind = type_of(df, wm)
        window(wm, kind, None, None, t.lookback_seconds)
        if t.lookback_seconds and not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ConfigError("lookback_seconds needs a watermark that is a date or a timestamp")
        seen = survey(df, wm).first()
        upper = seen["upper"]
        if seen["n"]:
            log.warning("%s: %d rows have no %s and are never read", t.dest_table, seen["n"], t.watermark)
        state = run.state.read(run.state_key, t.dest_table)
        if t.chunk_rows and state and state["chunk_upper"] is not None:
            resume, upper = state["chunk_cursor"], state["chunk_upper"]
        committed = state["last_watermark"] if state else None
        lower = first_lower(committed, t.seed_watermark, t.skip_to_max, upper)
        # the source is frozen at upper: rows that come later belong to the next run
        df = df.where(conjunction(window(wm, kind, lower, upper, t.lookback_seconds if committed is not None else 0)))
    base = run.prepare(made.schema)
    lost = {n: c for n, c in made.lost.items()}

    def shaped(rows: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
        flags = [c.alias(f"_is_lost_{n}") for n, c in lost.items()]
        return rows.select(*made.columns, *flags), {n: F.col(f"`_is_lost_{n}`") for n in lost}

    if key:
        for part, last, n in pages(df, key, t.chunk_rows, resume):
            rows, flags = shaped(part)
            run.promote(run.staged(rows, flags, made.schema, run.table.manifest()), made.schema, n)
            run.state.append(run.state_key, t.dest_table, committed, n, last, upper)
    else:
        rows, flags = shaped(df)
        parts = run.staged(rows, flags, made.schema, base)
        run.promote(parts, made.schema, run.rows)
    if t.mode == INCREMENTAL and t.advance_watermark and upper is not None:
        run.state.append(run.state_key, t.dest_table, upper, run.rows)
    return run.result(upper if t.mode == INCREMENTAL else None)


def _api(run: Run, today: date) -> TransferResult:
    t, source = run.t, run.source
    declared, _ = source.schema()
    overrides = {f.name: f.metadata["declared"] for f in declared.fields} if run.merges else {}
    t = run.t = Transfer(**{**t.__dict__, "type_overrides": {**overrides, **t.type_overrides}, "clamp_dates": False})
    state = run.state.read(run.state_key, t.dest_table) if t.mode != FULL else None
    first, last = api_days(state["last_watermark"] if state else None, t.seed_watermark, *source.days(), source.lookback_days, today, t.mode == FULL)
    rows, counters = http.typed(http.read(run.spark, source, first, last), source)
    made = plan(declared, t, run.merges)
    base = run.prepare(made.schema)
    flags = [(counters[s] == 1).alias(f"_is_lost_{d}") for d, s in made.sources.items()]
    shaped = rows.select(*made.columns, *flags)
    parts = run.staged(shaped, {d: F.col(f"`_is_lost_{d}`") for d in made.sources}, made.schema, base)
    for f in made.schema.fields:
        if run.rows and run.coerced.get(f.name) == run.rows and isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            log.warning("%s: no value of %s could be read; its declared type is probably wrong", t.dest_table, f.name)
    run.promote(parts, made.schema, run.rows)
    if t.mode != FULL and t.advance_watermark:
        run.state.append(run.state_key, t.dest_table, last.isoformat(), run.rows)
    return run.result(last.isoformat() if t.mode != FULL else None)


def sync(source: Any, target: Lake, dest_table: str, *, spark: SparkSession | None = None, today: date | None = None, **settings: Any) -> TransferResult:
    """Transfer one table. See Transfer for the settings; today is the end of an API's window if it names none.

    A failed attempt leaves the destination as it was. The cursor moves last: a run that fails before it reads the
    same window again, which a merge, or a read of last versions, makes up for.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    settings = {k: v for k, v in settings.items() if v is not None}
    try:
        t = Transfer(dest_table=dest_table, **{**settings, "mode": mode_of(settings.get("mode", FULL))})
    except TypeError as error:
        raise ConfigError(str(error).replace("Transfer.__init__()", "sync()")) from None
    config.validate(t, source, target)
    t = t.normalized()
    if t.source_table and t.source_query:
        log.warning("source_query wins over source_table %r", t.source_table)
    where = f"{getattr(source, 'state_id', lambda: t.source_table or 'query')()} -> {dest_table}"
    for attempt in range(1, t.retry_max_attempts + 1):
        run = Run(spark, source, target, t)
        try:
            return _api(run, today or datetime.now(timezone.utc).date()) if getattr(source, "is_api", False) else _database(run)
        except TidewellError as error:
            if attempt < t.retry_max_attempts and transient(error):
                log.warning("%s: attempt %d failed: %s", where, attempt, error)
                time.sleep(http.wait_seconds(attempt))
                continue
            raise error.context(where)
        except Exception as error:
            if attempt < t.retry_max_attempts and transient(error):
                log.warning("%s: attempt %d failed: %s", where, attempt, error)
                time.sleep(http.wait_seconds(attempt))
                continue
            raise
    raise AssertionError


__all__ = ["Progress", "Throttle", "TransferResult", "sync"]
