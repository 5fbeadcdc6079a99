"""Tables of immutable Parquet parts and numbered manifests.

A manifest lists the parts that make up the table. A commit writes the manifest of the next number, which fails if that
number is taken: readers see the old table until then and the whole new one after, and of two writers one has to try
again. A manifest is written under another name and then given its own, so none is ever seen in part. A commit can take over parts of the manifest before, so an append, or a merge into a few partitions, writes
only what is new. Parts that no manifest names any more are removed after a later commit.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.errors import CommitConflict, ConfigError
from tidewell.operators.merge import deduplicate, in_window, last_version, merge, q, upsert
from tidewell.plans.projection import missing

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Schemes of stores that have no renaming.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "oss")


@dataclass(frozen=True)
class Part:
    """A folder of Parquet files; sequence: the commit that wrote it; day: the partition it is, if the table has any."""

    path: str
    sequence: int
    day: str | None = None


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    schema: str = ""
    parts: tuple[Part, ...] = ()
    key: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    version: str | None = None
    engine: str = "MergeTree"
    partition_by: str | None = None
    properties: dict = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class Files:
    """The few file operations a commit needs, of any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def create(self, path: str, text: str) -> bool:
        """Write a new file, which appears whole or not at all; False if there is one.

        A local file is linked to its name and others are renamed without overwriting. In object stores, where a file appears
        when it is closed and renaming is a copy, it is created there at once; whether two writers can collide there is
        up to the store's conditional writes.
        """
        fs, p = self._at(path)
        scheme = fs.getUri().getScheme()
        if scheme in OBJECT_STORES:
            return self._write(fs, p, text)
        temporary = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.tmp")
        self._write(fs, temporary, text)
        try:
            if scheme == "file":
                own, wanted = (fs.makeQualified(x).toUri().getPath() for x in (temporary, p))
                os.link(own, wanted)
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
            # py4j passes variable arguments as an array; an empty one never overwrites
            context.rename(fs.makeQualified(temporary), fs.makeQualified(p), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception as error:  # noqa: BLE001  py4j wraps the exception
            if "exist" in str(error).lower() and fs.exists(p):
                return False
            raise
        finally:
            fs.delete(temporary, False)

    def _write(self, fs, p, text: str) -> bool:
        try:
            out = fs.create(p, False)
        except Exception as error:  # noqa: BLE001  py4j wraps the exception, whose class depends on the file system
            if "exist" in str(error).lower():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def size(self, path: str) -> int:
        """Bytes of a folder's files."""
        fs, p = self._at(path)
        return int(fs.getContentSummary(p).getLength())

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Table:
    """A table in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    # manifests

    def manifest(self) -> Manifest | None:
        names = [n for n in self.files.names(f"{self.path}/_commits") if n.endswith(".json") and not n.startswith(".")]
        for name in reversed(names):
            if (found := self._parsed(name)) is not None:
                return found
        return None

    def _parsed(self, name: str) -> Manifest | None:
        """A manifest by its file's name; None if the file is cut off, which only a writer of another kind can leave."""
        try:
            raw = json.loads(self.files.read(f"{self.path}/_commits/{name}"))
        except json.JSONDecodeError:
            return None
        return Manifest(**{**raw, "parts": tuple(Part(**p) for p in raw["parts"]), "key": tuple(raw["key"]), "order_by": tuple(raw["order_by"])})

    def exists(self) -> bool:
        return self.manifest() is not None

    def _commit(self, base: Manifest | None, **change) -> Manifest:
        number = (base.number if base else 0) + 1
        new = Manifest(**{**(asdict(base) if base else {}), "parts": base.parts if base else (), **change, "number": number})
        name = f"{number:012d}.json"
        for last in (False, True):
            if self.files.create(f"{self.path}/_commits/{name}", json.dumps(asdict(new))):
                return new
            if last or self._parsed(name) is not None:
                break
            self.files.delete(f"{self.path}/_commits/{name}")  # cut off: it was never a commit
        raise CommitConflict(f"{self.path}: another writer committed number {number} first")

    def create(self, schema: T.StructType, key: Sequence[str] = (), order_by: Sequence[str] = (), version: str | None = None, engine: str = "MergeTree", partition_by: str | None = None) -> Manifest:
        """An empty table. partition_by: a date or timestamp column, of which each day is a part of its own."""
        if partition_by is not None:
            if partition_by not in schema.fieldNames():
                raise ConfigError(f"partition_by: there is no column {partition_by!r}")
            if not isinstance(schema[partition_by].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise ConfigError(f"partition_by: {partition_by!r} is not a date or timestamp")
        for name in [*key, *order_by]:
            if name not in schema.fieldNames():
                raise ConfigError(f"there is no column {name!r} to sort by; the table has {', '.join(schema.fieldNames())}")
        return self._commit(None, schema=schema.json(), key=tuple(key), order_by=tuple(order_by), version=version, engine=engine, partition_by=partition_by)

    def drop(self) -> None:
        self.files.delete(self.path)

    def evolve(self, schema: T.StructType, any_case: bool = False) -> Manifest:
        """Add the columns that the table lacks; older rows have nulls there. Nothing is dropped or retyped."""
        base = self.manifest()
        new = missing(schema, base.struct, any_case)
        return self._commit(base, schema=T.StructType([*base.struct.fields, *new]).json()) if new else base

    # rows

    def stage(self, df: DataFrame, base: Manifest, sequence: int | None = None) -> tuple[Part, ...]:
        """Write rows as parts that no manifest names yet, sorted within each file by the table's sorting key."""
        schema, have = base.struct, set(df.columns)
        df = df.select(*[(F.col(q(f.name)).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
        sort = [F.col(q(c)) for c in (base.order_by or base.key)]
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        sequence = base.number + 1 if sequence is None else sequence
        if base.partition_by is None:
            (df.sortWithinPartitions(*sort) if sort else df).write.parquet(folder)
            return (Part(folder, sequence),)
        day = F.col(q(base.partition_by)).cast("date").cast("string")
        # a hint, not a shuffle by day alone: large days go to many tasks, and small ones share few
        df = df.withColumn("_day_", day).hint("rebalance", F.col("_day_"))
        df.sortWithinPartitions("_day_", *sort).write.partitionBy("_day_").parquet(folder)
        days = [n for n in self.files.names(folder) if n.startswith("_day_=")]
        return tuple(Part(f"{folder}/{n}", sequence, n.removeprefix("_day_=")) for n in days)

    def _rows(self, base: Manifest, parts: Sequence[Part], sequence: bool = False) -> DataFrame:
        if not parts:
            empty = self.spark.createDataFrame([], base.struct)
            return empty.withColumn("_sequence_", F.lit(0)) if sequence else empty
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in base.struct.fields])
        # one scan of all parts; each is a root of its own, so the folder names of its days are no columns
        df = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[p.path for p in parts])
        if not sequence:
            return df
        by = {p.path.split("/data/", 1)[1][:32]: p.sequence for p in parts}
        if len(set(by.values())) == 1:
            return df.withColumn("_sequence_", F.lit(next(iter(by.values()))))
        known = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])
        return df.withColumn("_sequence_", F.element_at(known, F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1)))

    def read(self, final: bool = False) -> DataFrame:
        """The table's rows; final: of each sorting key the last version only."""
        base = self.manifest()
        key = base.order_by or base.key
        if not final or not key:
            return self._rows(base, base.parts)
        return last_version(self._rows(base, base.parts, sequence=True), key, base.version, "_sequence_").select(*base.struct.fieldNames())

    def staged(self, parts: Sequence[Part]) -> DataFrame:
        return self._rows(self.manifest(), parts)

    def count(self) -> int:
        return self.read().count()

    # commits

    def append(self, parts: Sequence[Part]) -> Manifest:
        base = self.manifest()
        # the commit sets the sequence, so that a later one always wins over an earlier one
        parts = tuple(Part(p.path, base.number + 1, p.day) for p in parts)
        return self._commit(base, parts=(*base.parts, *parts))

    def replace(self, parts: Sequence[Part]) -> Manifest:
        """The whole content, at once."""
        base = self.manifest()
        new = self._commit(base, parts=tuple(parts))
        self._clean(base, new)
        return new

    def merge(self, parts: Sequence[Part], columns: Sequence[str], key: Sequence[str], watermark: str | None = None, prune: str | None = None, delete_stale: bool = False) -> Manifest:
        """Merge staged parts in. columns: those that the transfer has; the others of matched rows stay as they are.

        With prune on the column that partitions the table, only the days of the window are read and written again;
        the other parts are taken over as they are.
        """
        base = self.manifest()
        staged = self._rows(base, parts).select(*[q(c) for c in columns])
        keep: tuple[Part, ...] = ()
        touched = base.parts
        if prune is not None and prune == base.partition_by:
            # days as the session has them, as parts are named; what is collected is in the driver's time zone
            day = [f(F.col(q(prune))).cast("date").cast("string") for f in (F.min, F.max)]
            ends = staged.agg(F.min(q(prune)).alias("lo"), F.max(q(prune)).alias("hi"), day[0].alias("first"), day[1].alias("last")).first()
            lo, hi, first, last = ends
            touched = tuple(p for p in base.parts if first is not None and p.day is not None and p.day != NULL_PARTITION and first <= p.day <= last)
            keep = tuple(p for p in base.parts if p not in touched)
            target = self._rows(base, touched)
            inside = in_window(prune, lo, hi)
            merged = target.where(~inside).unionByName(upsert(target.where(inside), staged, key, watermark, not delete_stale))
        else:
            merged = merge(self._rows(base, touched), staged, key, watermark, prune, delete_stale)
        return self._swap(base, keep, self.stage(merged, base))

    def _swap(self, base: Manifest, keep: Sequence[Part], fresh: Sequence[Part]) -> Manifest:
        """Commit kept and fresh parts; fresh ones of a commit that fails are removed."""
        try:
            new = self._commit(base, parts=(*keep, *fresh))
        except BaseException:
            self.discard(fresh)
            raise
        self._clean(base, new)
        return new

    def compact(self) -> Manifest:
        """Write the last version of each row as one part; rows that others stand for are gone."""
        base = self.manifest()
        return self._swap(base, (), self.stage(self.read(final=True), base))

    def _clean(self, old: Manifest, new: Manifest) -> None:
        """Remove parts of the manifest before the old one: readers of the old one may still be at work."""
        previous = old.number - 1
        names = {p.path for p in (*old.parts, *new.parts)}
        if previous < 1 or f"{previous:012d}.json" not in self.files.names(f"{self.path}/_commits"):
            return
        raw = json.loads(self.files.read(f"{self.path}/_commits/{previous:012d}.json"))
        for p in raw["parts"]:
            if p["path"] not in names:
                self.files.delete(p["path"])
        self.files.delete(f"{self.path}/_commits/{previous:012d}.json")

    def discard(self, parts: Sequence[Part]) -> None:
        """Remove staged parts that were not committed, with the folders that held them alone."""
        used = {p.path for p in self.manifest().parts}
        for p in parts:
            if p.path not in used:
                self.files.delete(p.path)
        folder = lambda path: path.split("/data/", 1)[1][:32]
        for name in {folder(p.path) for p in parts} - {folder(p) for p in used}:
            self.files.delete(f"{self.path}/data/{name}")

    def bytes_of(self, parts: Sequence[Part]) -> int:
        return sum(self.files.size(p.path) for p in parts)


def with_retries(action, tries: int = 5):
    """Run a commit again if another writer was first."""
    for k in range(tries):
        try:
            return action()
        except CommitConflict:
            if k == tries - 1:
                raise
            time.sleep(min(0.25 * 2**k, 15))
    return None


__all__ = ["Files", "Manifest", "Part", "Table", "deduplicate", "with_retries"]
