"""Keyed upserts out of DataFrame operations, as files have no MERGE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.errors import ConfigError

_S, _T, _HIT = "_staged_", "_target_", "_hit_"


def q(name: str) -> str:
    return f"`{name}`"


def deduplicate(df: DataFrame, key: Sequence[str], watermark: str | None = None) -> DataFrame:
    """One row for each key: the latest by watermark; ties, and runs without one, by all other columns from large to small.

    Rows whose key is null in the same columns count as equal, as a window has it.
    """
    rest = [c for c in df.columns if c not in key and c != watermark]
    order = [watermark] * (watermark in df.columns and watermark not in key) + rest
    if not order:
        return df.distinct()
    # the largest row by these columns, null being smallest: added up before the shuffle, and no sort by them
    best = F.max(F.struct(*[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(order)])).alias("_best_")
    kept = df.groupBy(*[F.col(q(k)) for k in key]).agg(best)
    return kept.select(*[F.col(q(c)) if c in key else F.col(f"_best_.c{order.index(c)}").alias(c) for c in df.columns])


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_bytes(df: DataFrame) -> int:
    """A staged side up to this many bytes is looked up in: what Spark sends to all executors, so the target is not shuffled."""
    return int(str(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))


def bounds(staged: DataFrame, column: str) -> tuple[object, object]:
    """The smallest and largest value of a column of the rows as staged, before they are deduplicated."""
    row = staged.agg(F.min(q(column)).alias("lo"), F.max(q(column)).alias("hi")).first()
    return row["lo"], row["hi"]


def in_window(column: str, lo: object, hi: object) -> Column:
    """Never null: rows without a value, and empty bounds, are outside."""
    if lo is None or hi is None:
        return F.lit(False)
    return F.coalesce(F.col(q(column)).between(F.lit(lo), F.lit(hi)), F.lit(False))


def upsert(target: DataFrame, staged: DataFrame, key: Sequence[str], watermark: str | None = None, keep_unmatched: bool = True, lookup: bool | None = None, deduplicated: bool = False) -> DataFrame:
    """target with staged merged in.

    Rows match where all key columns are equal; null keys never match, so such rows are inserted again on each run.
    Matched rows take their other columns from staged, as far as it has them, and the rest from target; every copy of
    a key in target is updated. Staged rows without a match are inserted. Target rows without a match stay, or go if
    not keep_unmatched. lookup: join the target with the staged rows as a small side, and find the inserted ones by
    the keys that matched, so that the target is never shuffled; by default, as the staged side's estimate says.
    """
    if not key:
        raise ConfigError("a merge needs a key")
    s = staged if deduplicated else deduplicate(staged, key, watermark)
    if lookup is None:
        lookup = estimated_bytes(staged) <= lookup_bytes(staged)
    names = target.columns
    s = s.select(*[F.col(q(c)).alias(_S + c) for c in s.columns], F.lit(True).alias(_HIT))
    on = [F.col(q(k)) == F.col(q(_S + k)) for k in key]
    have = {c.removeprefix(_S) for c in s.columns}
    hit = F.col(_HIT).isNotNull()

    def value(c: str, inserted: Column | None = None) -> Column:
        own, new = F.col(q(c)), F.col(q(_S + c)) if c in have else None
        if c in key:
            return (F.when(inserted, new).otherwise(own) if inserted is not None else own).alias(c)
        if new is None:
            return own.alias(c)
        return F.when(hit, new).otherwise(own).alias(c)

    if not lookup:
        t = target.withColumn(_T, F.lit(True))
        joined = t.join(s, on, "full_outer")
        if not keep_unmatched:
            joined = joined.where(hit)
        inserted = F.col(_T).isNull()
        return joined.select(*[value(c, inserted) for c in names])
    joined = target.join(s, on, "left" if keep_unmatched else "inner").select(*[value(c) for c in names])
    # the keys of the target that were hit are at most as many as the staged ones
    wanted = staged.select(*[F.col(q(k)).alias(_S + k) for k in key])
    keys = target.select(*[F.col(q(k)) for k in key]).join(wanted, on, "left_semi").distinct()
    fresh = s.join(keys, on, "left_anti")
    kinds = dict(target.dtypes)
    return joined.unionByName(fresh.select(*[(F.col(q(_S + c)) if c in have else F.lit(None).cast(kinds[c])).alias(c) for c in names]))


def merge(target: DataFrame, staged: DataFrame, key: Sequence[str], watermark: str | None = None, prune: str | None = None, delete_stale: bool = False, lookup: bool | None = None) -> DataFrame:
    """An upsert, if asked for within a window only.

    prune: rows of target outside the range of staged's values of that column are neither matched nor read for it, so a
    row whose value moved out of the range is inserted beside its old self. delete_stale: target rows inside the
    window that staged does not have are deleted.
    """
    if prune is None:
        return upsert(target, staged, key, watermark, lookup=lookup)
    lo, hi = bounds(staged, prune)
    inside = in_window(prune, lo, hi)
    return target.where(~inside).unionByName(upsert(target.where(inside), staged, key, watermark, not delete_stale, lookup))


def last_version(rows: DataFrame, key: Sequence[str], version: str | None, sequence: str) -> DataFrame:
    """Of rows with an equal sorting key the one of the largest version; of equal versions the one inserted last."""
    value = F.struct(*[F.col(q(c)) for c in rows.columns if c != sequence])
    order = [F.col(q(version))] if version else []
    best = F.max_by(value, F.struct(*order, F.col(q(sequence)), F.xxhash64(value)))
    return rows.groupBy(*[F.col(q(k)).alias(f"_k{i}") for i, k in enumerate(key)]).agg(best.alias("row")).select("row.*")
