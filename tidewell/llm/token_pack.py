"""Token ids in fixed-width bit-packed files (operator 1).

File format, all integers little-endian:

    magic "TWPACK01" | u32 bits of an id | u32 ids of a block | blocks | footer | u64 length of the footer | magic
    block:  its ids, each in `bits` bits, the lowest bit first, filled up to a whole byte
    footer: u64 documents, u64 blocks, u64 ids
            i64 doc_id of each document, u8 whether it is not null, u64 where each document's ids begin (one place more)
            u64 byte offset of each block (one place more)

The width is the least that holds the vocabulary. Block offsets give random access: ids [a, b) need only the blocks
that hold them, and a block is unpacked by a few numpy operations for all its ids at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.bpe_trie import UNSAFE_PIECE
from tidewell.llm.shared import file_folder, new_file, open_file, pick, stored, text_slices

MAGIC = b"TWPACK01"
BLOCK_IDS = 1 << 16
MOST_KNOWN = 800_000


def width(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, the lowest bit first. Eight ids fill `bits` whole bytes, so eight lanes are enough."""
    n = len(ids)
    rows = -(-n // 8)
    lanes = np.zeros((rows, 8), np.uint64)
    lanes.reshape(-1)[:n] = ids
    out = np.zeros((rows, bits), np.uint8)
    for lane in range(8):
        low = lane * bits
        shifted = lanes[:, lane] << np.uint64(low & 7)
        for k in range(((low & 7) + bits + 7) // 8):
            out[:, (low >> 3) + k] |= ((shifted >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    rows = -(-n // 8)
    raw = np.zeros(rows * bits, np.uint8)
    raw[: min(len(data), len(raw))] = np.frombuffer(data, np.uint8)[: len(raw)]
    raw = raw.reshape(rows, bits)
    out = np.empty((rows, 8), np.uint32)
    for lane in range(8):
        low = lane * bits
        word = np.zeros(rows, np.uint64)
        for k in range(((low & 7) + bits + 7) // 8):
            word |= raw[:, (low >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (word >> np.uint64(low & 7)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


class PackWriter:
    """Writes one file; holds a block of ids and 17 bytes for each document."""

    def __init__(self, out, vocabulary: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, width(vocabulary), block_ids
        self.blocks, self.left, self.total = [len(MAGIC) + 8], np.zeros(0, np.uint32), 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out.write(MAGIC + struct.pack("<II", self.bits, block_ids))

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.blocks.append(self.blocks[-1] + len(data))

    def add(self, doc_ids: np.ndarray, valid: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id is larger than the vocabulary")
        self.docs.append((doc_ids.astype("<i8"), valid.astype(np.uint8), self.total + np.cumsum(lengths) - lengths))
        self.total += len(ids)
        ids = np.concatenate([self.left, ids.astype(np.uint32)])
        whole = len(ids) // self.block_ids * self.block_ids
        for a in range(0, whole, self.block_ids):
            self._block(ids[a : a + self.block_ids])
        self.left = ids[whole:]

    def close(self) -> tuple[int, int]:
        """Ends the file; the numbers of documents and ids."""
        if len(self.left):
            self._block(self.left)
        doc_ids, valid, starts = (np.concatenate([x[i] for x in self.docs] or [np.zeros(0, np.int64)]) for i in range(3))
        footer = struct.pack("<QQQ", len(doc_ids), len(self.blocks) - 1, self.total) + doc_ids.astype("<i8").tobytes() + valid.astype(np.uint8).tobytes()
        footer += np.append(starts, self.total).astype("<u8").tobytes() + np.array(self.blocks, "<u8").tobytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return len(doc_ids), self.total


class PackReader:
    """Reads one file; only its footer is held."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        head, tail = file.read_at(16, 0), file.read_at(16, size - 16)
        if head[:8] != MAGIC or tail[8:] != MAGIC:
            raise ValueError("not a whole packed file")
        self.bits, self.block_ids = struct.unpack("<II", head[8:])
        (length,) = struct.unpack("<Q", tail[:8])
        footer = file.read_at(length, size - 16 - length)
        docs, blocks, self.total = struct.unpack_from("<QQQ", footer)
        at = 24
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        self.valid = np.frombuffer(footer, np.uint8, docs, at + 8 * docs)
        self.starts = np.frombuffer(footer, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
        self.blocks = np.frombuffer(footer, "<u8", blocks + 1, at + 17 * docs + 8).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, -(-stop // self.block_ids)
        data, base = self.file.read_at(int(self.blocks[b] - self.blocks[a]), int(self.blocks[a])), int(self.blocks[a])
        parts = [unpack(data[self.blocks[k] - base : self.blocks[k + 1] - base], min(self.block_ids, self.total - k * self.block_ids), self.bits) for k in range(a, b)]
        return np.concatenate(parts)[start - a * self.block_ids : stop - a * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size())], np.int64)


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, of: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """The runs of flat that `of` names, one after the other; in steps, so that no index of all of them is held."""
    count = counts[of]
    out = np.empty(int(count.sum()), flat.dtype)
    done = 0
    for a in range(0, len(of), step):
        n, first = count[a : a + step], starts[of[a : a + step]]
        size = int(n.sum())
        out[done : done + size] = flat[np.arange(size) + np.repeat(first - (np.cumsum(n) - n), n)]
        done += size
    return out


class Known:
    """Pieces that this worker has encoded: the first MOST_KNOWN, which by the order they come in are the frequent ones."""

    def __init__(self) -> None:
        self.pieces, self.flat, self.counts = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, pieces: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        room = min(len(pieces), MOST_KNOWN - len(self.pieces))
        if room > 0:
            self.pieces = pa.concat_arrays([self.pieces, pieces.slice(0, room)])
            self.flat = np.concatenate([self.flat, flat[: int(counts[:room].sum())]])
            self.counts = np.concatenate([self.counts, counts[:room]])


@lru_cache(maxsize=2)
def known_pieces(vocabulary: str) -> Known:
    return Known()


def encode_pieces(pieces: pa.Array, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pieces, each after its space, one after the other, and how many each has.

    Thousands of pieces make one string for the library; the lengths of its tokens show where each piece ends.
    """
    t, size = library(vocabulary)
    ids: list[np.ndarray] = []
    for a in range(0, len(pieces), 1 << 16):
        strings = pieces.slice(a, 1 << 16).to_pylist()
        bulk = [" " + " ".join(strings[b : b + 4096]) for b in range(0, len(strings), 4096)]
        ids += [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(bulk, add_special_tokens=False)]
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    flat = np.concatenate(ids)
    ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    place = np.searchsorted(np.cumsum(size[flat]), ends, side="left") + 1
    return flat, np.diff(np.concatenate([[0], place]))


def encode_slice(texts: pa.Array, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts by the tokenizers library, one after the other, and how many each has.

    A byte-level pattern always has a border before a single space that a non-space follows, so the library encodes
    each distinct piece between such borders once; texts with other white space around such a border, or with a special
    token, are given to it whole.
    """
    t, _ = library(vocabulary)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    parts = pc.split_pattern(texts, " ")
    offsets = parts.offsets.to_numpy()
    coded = parts.values.dictionary_encode()
    codes, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    first = offsets[:-1]
    odd = pc.match_substring_regex(pieces, UNSAFE_PIECE).to_numpy(zero_copy_only=False)[codes]
    odd[first] = False
    alone = np.add.reduceat(odd, first) > 0
    for token in t.get_added_tokens_decoder().values():
        alone |= pc.match_substring(texts, token.content).to_numpy(zero_copy_only=False)
    whole, heads = np.flatnonzero(alone), np.flatnonzero(~alone)
    keep = np.repeat(~alone, np.diff(offsets))
    keep[first] = False
    used = np.zeros(len(pieces), bool)
    used[codes[keep]] = True
    inner = np.flatnonzero(used)

    chosen = pieces.take(pa.array(inner))
    known = known_pieces(vocabulary)
    found = pc.index_in(chosen, value_set=known.pieces)
    fresh = chosen.filter(pc.is_null(found))
    more_flat, more_counts = encode_pieces(fresh, vocabulary)
    number_of = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    number_of[number_of < 0] = len(known.counts) + np.arange(len(fresh))
    flat, counts = np.concatenate([known.flat, more_flat]), np.concatenate([known.counts, more_counts])
    known.add(fresh, more_flat, more_counts)
    base = len(counts)
    singles = parts.values.take(pa.array(first[heads])).to_pylist() + texts.take(pa.array(whole)).to_pylist()
    more = [e.ids for a in range(0, len(singles), 1024) for e in t.encode_batch_fast(singles[a : a + 1024], add_special_tokens=False)]
    flat = np.concatenate([flat, *(np.array(x, np.uint32) for x in more)])
    counts = np.concatenate([counts, np.array([len(x) for x in more], np.int64)]).astype(np.int64)
    starts = np.cumsum(counts) - counts

    number = np.zeros(len(pieces), np.int32)
    number[inner] = number_of
    of = number[codes]
    of[first[heads]] = base + np.arange(len(heads))
    of[first[whole]] = base + len(heads) + np.arange(len(whole))
    keep[first] = True
    of = of[keep]
    of_count = counts[of]
    out = gather(flat, starts, counts, of)
    per_piece = np.zeros(len(codes), np.int64)
    per_piece[keep] = of_count
    return out, np.add.reduceat(per_piece, first)


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append an end id to each document."""
    after = np.cumsum(lengths)
    return np.insert(ids, after, np.uint32(end)), lengths + 1


def write_packed(df: DataFrame, folder: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text, append end_id to each, and write packed files in ascending id order into folder/ids.

    Returns a table of the files: shard (their order), path, n_docs, n_tokens and start (ids of all files before it).
    Rows are dealt by ranges of (id, hash of text), so a file holds one range and equal ids or texts spread; a task
    streams its range into one file. A task that runs again writes another file, and the table names the one that
    counts. Null ids come first, null texts count as empty, repeated rows are kept, other columns are ignored.
    """
    folder = file_folder(df.sparkSession, folder)
    rows = df.select(*[c.alias(n) for c, n in zip(pick(df, id_column, text_column), ("id", "text"))]).select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, path = task.partitionId(), f"{folder}/ids/part-{task.partitionId():06d}-{task.taskAttemptId()}.twp"
        t, _ = library(vocabulary)
        batches = iter(batches)
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        with new_file(path) as out:
            writer = PackWriter(out, t.get_vocab_size())
            while batch is not None:
                for part in text_slices(batch, most_bytes=16 << 20):
                    ids, lengths = with_end(*encode_slice(part.column(1), vocabulary), end_id)
                    own = part.column(0)
                    writer.add(pc.fill_null(own, 0).to_numpy(zero_copy_only=False), pc.is_valid(own).to_numpy(zero_copy_only=False), ids, lengths)
                batch = next(batches, None)
            docs, total = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([path]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    files = stored(rows.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), f"{folder}/files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_packed(files: DataFrame, with_ids: bool = False, read_ids: int = 1 << 22) -> DataFrame:
    """Read packed files: for each document doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(path) as file:
                    reader = PackReader(file)
                    starts, n, a = reader.starts, len(reader.doc_ids), 0
                    while a < n:
                        b = max(a + 1, int(np.searchsorted(starts, starts[a] + read_ids, side="right")) - 1)
                        b = min(b, n)
                        ids = reader.ids(int(starts[a]), int(starts[b]))
                        at = (starts[a : b + 1] - starts[a]).tolist()
                        wide = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(wide[4 * x : 4 * y]) for x, y in zip(at, at[1:])]
                        columns = [pa.array(reader.doc_ids[a:b], mask=reader.valid[a:b] == 0), pa.array(starts[a:b] + base), pa.array(np.diff(starts[a : b + 1])), pa.array(crc, pa.int64())]
                        if with_ids:
                            columns.append(pa.LargeListArray.from_arrays(np.array(at, np.int64), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                        a = b

    return files.select("path", "start").repartition(max(1, files.count())).mapInArrow(run, schema)
