"""What the operators of this package have in common: the shared folder, files in it, and connected components."""

from __future__ import annotations

import ctypes
import posixpath
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.folders import work_dir

__all__ = ["connected", "file_folder", "new_file", "open_file", "pick", "remove", "restricted", "stored", "text_slices", "trim", "work_dir"]


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it again: cuts the lineage, and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Schemes that Hadoop and pyarrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file", "abfss": "abfs", "abfs": "abfs"}


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, path = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + path.lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} names no store; qualify it first")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{path}")


def file_folder(spark: SparkSession, folder: str) -> str:
    """A folder for files that executors write themselves, with its store: what names none is in the default file system, as
    for Spark's own files. A store that Python cannot open is refused here, before anything is written."""
    uri = folder
    if "://" not in folder and not folder.startswith("file:"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    try:
        _filesystem(uri)
    except Exception as error:
        raise ValueError(f"files cannot be written to {uri} from Python ({error}); name a folder of another store in spark.checkpoint.dir") from error
    return uri


@contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A file to write to, of any store that pyarrow knows; on an error it is removed."""
    fs, path = _filesystem(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    out = fs.open_output_stream(path, compression=None)
    try:
        yield out
    except BaseException:
        out.close()
        fs.delete_file(path)
        raise
    out.close()


def open_file(uri: str) -> pa.NativeFile:
    """A file to read at any place."""
    fs, path = _filesystem(uri)
    return fs.open_input_file(path)


def trim() -> None:
    """Give freed memory back to the system, so that a worker that is used again does not keep its peak."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has about most_bytes of text; a longer single text is a slice of its own."""
    index = batch.schema.get_field_index(column)
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(index)).to_pylist()):
        if i > start and size + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            trim()
            start, size = i, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)
    trim()


def pick(df: DataFrame, *columns: str) -> list[Column]:
    """Columns of df by name, whatever other columns it has."""
    return [df[f"`{c}`"] for c in columns]


#: A key table up to this many rows is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_KEYS = 500_000


def restricted(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """df with only, or without (left_anti), the rows whose id is in ids: a stored table of one column."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, ids.columns[0], how)


#: What is left of a graph is joined up in one task once it has no more edges than this (0.8 MB).
LAST_EDGES = 50_000


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to): the smallest node reachable from each node of the edges (a, b) of all batches."""
    to: dict[int, int] = {}

    def end(x: int) -> int:
        while to[x] != x:
            to[x] = x = to[to[x]]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            to.setdefault(x, x)
            to.setdefault(y, y)
            x, y = end(x), end(y)
            to[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.int64()), pa.array([end(x) for x in to], pa.int64())], ["node", "to"])


def connected(edges: DataFrame, work: str, last_edges: int = LAST_EDGES) -> DataFrame:
    """Connected components of an undirected graph. edges: (a long, b long). Returns (node, component): the smallest node reachable.

    Each round every node points at whichever of itself and its neighbours has the smallest hash, pointers are followed once
    more, and edges are renamed to where their ends point; edges inside a component vanish. The hash is another one each
    round, so whatever the ids, a constant share of the nodes that still have edges is expected to go in each, and rounds
    grow with the logarithm of the nodes. They go on until at most last_edges are left, which one task joins up: the last rounds
    would each be several jobs for a handful of edges. Nodes without edges are not in the result. Each round is written to the folder work.
    """
    spark = edges.sparkSession
    e = stored(edges.where("a <> b and a is not null and b is not null").select("a", "b").distinct(), f"{work}/e0")
    maps: list[DataFrame] = []
    while n := e.count():
        k = len(maps)
        if n <= last_edges:
            maps.append(stored(e.coalesce(1).mapInArrow(_joined_up, "node long, to long"), f"{work}/p{k}"))
            break
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(k))).alias("m"))
        at = least.select(F.col("a").alias("node"), F.when(F.xxhash64("m", F.lit(k)) < F.xxhash64("a", F.lit(k)), F.col("m")).otherwise(F.col("a")).alias("to"))
        hop = at.select(F.col("node").alias("to"), F.col("to").alias("then"))
        p = stored(at.join(hop, "to").select("node", F.col("then").alias("to")), f"{work}/p{k}")
        maps.append(p)
        left = p.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = p.select(F.col("node").alias("b"), F.col("to").alias("y"))
        e = stored(e.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{work}/e{k + 1}")
        remove(spark, f"{work}/e{k}")
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    # from the last round, which has the fewest nodes, back to the first; plans stay short
    out = maps[-1].select("node", F.col("to").alias("root"))
    if n and len(maps) == 1:
        return out.withColumnRenamed("root", "component")
    for k in reversed(range(len(maps) - 1)):
        nxt = out.select(F.col("node").alias("to"), "root")
        out = maps[k].join(nxt, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        if k and k % 4 == 0:
            out = stored(out, f"{work}/r{k}")
    named = out.groupBy("root").agg(F.min("node").alias("component"))
    return stored(out.join(named, "root").select("node", "component"), f"{work}/components")


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """For this session, rows go to Python and back in batches of so many bytes: for jobs in which many operators use the same workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
