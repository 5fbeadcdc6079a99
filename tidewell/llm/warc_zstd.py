"""WARC files compressed record by record with a dictionary of their own (operator 3).

A file begins with a skippable Zstandard frame (magic 0x184D2A5D) that holds the dictionary, itself compressed without
one; then each record is a frame of its own that needs that dictionary. So a reader can start at any record once it
has read the first frame. Each task trains the dictionary of its file on the first SAMPLE_BYTES of its records, which
come in the hash order of their ids; that bound keeps memory and training time fixed.

Records with equal payloads: the one with the smallest id is a `response`, the others are `revisit` records that
name it and hold no payload. Only ids and digests are grouped; payloads move once.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import file_folder, new_file, open_file, pick, stored

#: The frame that holds a dictionary, and the profile of records that repeat a payload.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 6


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC headers write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str | None, otherwise: str) -> str:
    """A header's value: no control characters, which would end it."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value) if value else otherwise


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {sha1}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record of the archive; refers_to makes it a revisit."""
    sha1 = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha1)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(url, 'urn:unknown')}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"WARC-Profile: {REVISIT_PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
        payload = b""
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    body = b"software: tidewell\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, date)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on samples; too few to train on stand for themselves."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one at a time."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with its dictionary")
    held = zstandard.ZstdDecompressor().decompress(file.read(size))
    raw = not held.startswith(b"\x37\xa4\x30\xec")
    known = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(file, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError("a record does not begin where it should")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield headers, block


def write_warc(df: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row into archives in folder/warc; returns their index: page_id, path, offset, length.

    Of rows with equal payloads of at least least_bytes, the one with the smallest id is written whole and the others
    refer to it; rows that repeat id and payload are each written whole. A null payload is empty; rows without an id
    refer to a row that has one, or are written whole. A task that runs again writes another archive, and the index,
    which is a stored table, names the one that counts.
    """
    folder = file_folder(df.sparkSession, folder)
    rows = df.select(*[c.alias(n) for c, n in zip(pick(df, id_column, url_column, payload_column), ("id", "url", "payload"))]).select(
        F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("string").cast("binary"), F.lit(b"")).alias("payload")
    )
    keyed = rows.withColumn("sha", F.sha1("payload"))
    narrow = keyed.where(F.length("payload") >= least_bytes).select("id", "sha")
    first = narrow.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = narrow.join(first, "sha").where("id is null or id > first").select("id", "sha", "first").distinct()
    a, b = keyed.alias("a"), again.alias("b")
    linked = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.sha") == F.col("b.sha")), "left").select("a.id", "a.url", "a.payload", "b.first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/warc/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"

        def records() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for own, url, payload, refers in zip(*(batch.column(i) for i in range(4))):
                    own = own.as_py()
                    yield own, record(own, url.as_py(), payload.as_py(), refers.as_py(), date)

        source, held, size = records(), [], 0
        for x in source:
            held.append(x)
            size += len(x[1])
            if size >= SAMPLE_BYTES:
                break
        if not held:
            return
        known = dictionary([x for _, x in held])
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        index: tuple[list, list, list] = ([], [], [])

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(index[0], pa.int64()), pa.array([path] * len(index[0])), pa.array(index[1], pa.int64()), pa.array(index[2], pa.int64())], ["page_id", "path", "offset", "length"])
            for x in index:
                x.clear()
            return out

        with new_file(path) as out:
            frame = zstandard.ZstdCompressor(level=LEVEL).compress(known.as_bytes())
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(frame)) + frame)
            out.write(writer.compress(info_record(date)))
            while held or source is not None:
                for own, data in held:
                    frame = writer.compress(data)
                    index[0].append(own)
                    index[1].append(out.tell())
                    index[2].append(len(frame))
                    out.write(frame)
                held = [x for _, x in zip(range(256), source)]
                source = source if held else None
                if len(index[0]) >= 4096:
                    yield batch()
        yield batch()

    return stored(linked.mapInArrow(run, "page_id long, path string, offset long, length long"), f"{folder}/index")


def read_warc(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read archives back: page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    The digest of a response is computed from its payload and must equal its header's; that of a revisit is its header's.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with open_file(path) as file:
                    for headers, block in read_records(file):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        sha1 = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha1):
                            raise ValueError(f"a payload in {path} is damaged")
                        own, refers = (int(headers[h]) if h in headers else None for h in ("Page-ID", "Refers-To-Page-ID"))
                        rows.append((own, size, sha1, headers["WARC-Type"], refers, payload)[: len(names)])
                        held += len(payload) if with_payload else 0
                        if len(rows) >= 4096 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    paths = index.select("path").distinct()
    return paths.repartition(max(1, paths.count())).mapInArrow(run, schema)
