"""What a transfer is asked to do, and which requests make no sense."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from tidewell.errors import ConfigError
from tidewell.functions.types import decimal_of, decoded_type

FULL, INCREMENTAL, APPEND = "full", "incremental", "append"
#: Names of modes, and the engines that keep the last row of a sorting key when read.
MODES = {"full": FULL, "incremental": INCREMENTAL, "inc": INCREMENTAL, "append": APPEND}
MERGING_ENGINES = ("ReplacingMergeTree", "CollapsingMergeTree", "VersionedCollapsingMergeTree", "SummingMergeTree", "AggregatingMergeTree")


def mode_of(name: str) -> str:
    if name.lower() not in MODES:
        raise ConfigError(f"mode {name!r} is unknown; use full, incremental or append")
    return MODES[name.lower()]


@dataclass(frozen=True)
class Transfer:
    """All settings of one transfer, with their defaults."""

    dest_table: str
    source_table: str | None = None
    source_query: str | None = None
    state_key: str | None = None
    mode: str = FULL
    watermark: str | None = None
    watermark_source_expr: str | None = None
    lookback_seconds: int = 0
    seed_watermark: str | None = None
    skip_to_max: bool = False
    advance_watermark: bool = True
    key: Sequence[str] = ()
    create_if_missing: bool = True
    engine: str | None = None
    order_by: Sequence[str] = ()
    partition_by: str | None = None
    primary_key: Sequence[str] = ()
    merge_prune_partition_by: str | None = None
    delete_stale_in_window: bool = False
    parallelism: int = 4
    batch_rows: int = 100_000
    batch_bytes: int = 4_194_304
    max_memory_bytes: int = 536_870_912
    partition_column: str | None = None
    read_max_rows_per_sec: int | None = None
    chunk_rows: int | None = None
    retry_max_attempts: int = 1
    column_transforms: Mapping[str, str] = field(default_factory=dict)
    column_transform_types: Mapping[str, str] = field(default_factory=dict)
    evolve_schema: bool = False
    state_table_name: str = "_tidewell_state"
    staging_suffix: str = "_tidewell_tmp"
    application_name: str = "tidewell"
    type_overrides: Mapping[str, str] = field(default_factory=dict)
    rename: Mapping[str, str] = field(default_factory=dict)
    include: Sequence[str] | None = None
    exclude: Sequence[str] = ()
    not_null: Sequence[str] = ()
    tinyint1_as_bool: bool = True
    numeric_as_decimal: str | None = None
    clamp_dates: bool = True
    on_progress: Callable[[Any], None] | None = None
    validate: Callable[[Any], None] | None = None

    @property
    def watermark_destination(self) -> str | None:
        return self.rename.get(self.watermark, self.watermark) if self.watermark else None

    @property
    def required(self) -> list[str]:
        """Destination columns that must not be null."""
        return list(dict.fromkeys([*self.key, *self.order_by, *self.primary_key, *self.not_null]))

    @property
    def engine_name(self) -> str:
        return self.engine or ("ReplacingMergeTree" if self.mode == INCREMENTAL else "MergeTree")

    def merges_rows(self) -> bool:
        return any(self.engine_name.removeprefix("Replicated").startswith(e) for e in MERGING_ENGINES)

    def source_name(self, destination: str) -> str:
        """The source column behind a destination column."""
        return next((s for s, d in self.rename.items() if d == destination), destination)

    def normalized(self) -> "Transfer":
        """A full refresh reads everything: what concerns a cursor is dropped."""
        if self.mode != FULL:
            return self
        return replace(self, watermark=None, watermark_source_expr=None, seed_watermark=None, skip_to_max=False, chunk_rows=None)


def validate(t: Transfer, source: Any, target: Any) -> None:
    """Raise ConfigError for requests that make no sense together. source and target: descriptors, asked for what they can do."""
    api, merge, warehouse = getattr(source, "is_api", False), target.dedup == "merge", getattr(source, "is_warehouse", False)

    def refuse(when: Any, text: str) -> None:
        if when:
            raise ConfigError(text)

    if api:
        for name in ("column_transforms", "column_transform_types", "chunk_rows", "lookback_seconds"):
            refuse(getattr(t, name), f"{name} does not work with an API source")
    else:
        refuse(not t.source_table and not t.source_query, "name a source_table or a source_query")
        refuse(t.mode == APPEND, "mode 'append' is for API sources; use 'incremental' with a key")
    if warehouse:
        for name in ("column_transforms", "column_transform_types", "chunk_rows", "watermark_source_expr"):
            refuse(getattr(t, name), f"{name} does not work with a warehouse source; put the expression into source_query")
    refuse(t.mode in (INCREMENTAL, APPEND) and not api and not t.watermark, f"mode {t.mode!r} needs a watermark column")
    refuse(t.lookback_seconds < 0, "lookback_seconds must not be negative")
    refuse(t.lookback_seconds and t.mode != INCREMENTAL, "lookback_seconds works in mode 'incremental' only")
    refuse(t.lookback_seconds and not t.key and not t.order_by, "lookback_seconds reads rows again; name a key or order_by so that they replace the old ones")
    refuse(t.seed_watermark is not None and t.skip_to_max, "give seed_watermark or skip_to_max, not both")
    refuse((t.seed_watermark is not None or t.skip_to_max or not t.advance_watermark) and t.mode == FULL, "seed_watermark, skip_to_max and advance_watermark=False need a mode with a cursor")
    for name in ("parallelism", "batch_rows", "retry_max_attempts"):
        refuse(getattr(t, name) < 1, f"{name} must be at least 1")
    refuse(t.batch_bytes < 0, "batch_bytes must not be negative")
    refuse(t.max_memory_bytes != 0 and t.max_memory_bytes < 65_536, "max_memory_bytes must be 0 or at least 65536")
    refuse(t.read_max_rows_per_sec is not None and t.read_max_rows_per_sec < 1, "read_max_rows_per_sec must be at least 1")
    if t.chunk_rows is not None:
        refuse(t.chunk_rows < 1, "chunk_rows must be at least 1")
        refuse(t.mode != INCREMENTAL, "chunk_rows works in mode 'incremental' only")
        refuse(not t.partition_column and not t.key, "chunk_rows needs a partition_column or key to page by")
        refuse(merge, "chunk_rows works with a target that inserts directly (dedup='lazy') only")
        refuse(t.validate, "a quality gate needs all rows before any is visible; chunk_rows makes them visible in parts")
    refuse(t.validate and t.mode == APPEND, "a quality gate works with staged rows; mode 'append' inserts directly")
    refuse(t.delete_stale_in_window and (t.mode != INCREMENTAL or not t.merge_prune_partition_by), "delete_stale_in_window needs mode 'incremental' and merge_prune_partition_by")
    refuse((t.merge_prune_partition_by or t.delete_stale_in_window) and not merge, "merge_prune_partition_by and delete_stale_in_window work with a merging target (dedup='merge') only")
    refuse(t.mode == INCREMENTAL and merge and not t.key, "an incremental load into a merging target needs a key")
    refuse(not merge and t.merges_rows() and not (t.order_by or t.key), f"engine {t.engine_name} keeps one row of a sorting key; name order_by or key")
    refuse(merge and len(dict.fromkeys([*t.order_by, *t.key])) > 4, "a merging target clusters by at most 4 columns (order_by and key together)")
    for column, expr in t.column_transforms.items():
        refuse(not expr.strip(), f"column_transforms: the expression for {column!r} is empty")
    for column, kind in t.column_transform_types.items():
        refuse(column not in t.column_transforms, f"column_transform_types: {column!r} has no expression in column_transforms")
        decoded_type(kind)
    for kind in [*t.type_overrides.values(), *([t.numeric_as_decimal] if t.numeric_as_decimal else [])]:
        decimal_of(kind)
    if t.numeric_as_decimal:
        refuse(decimal_of(t.numeric_as_decimal, merge) is None, "numeric_as_decimal must be a Decimal(p, s)")
