"""Benchmark decontamination by spaced seeds (operator 7).

A text is contaminated by an item if some window of the text equals a window of the item, word by word, but for a few
substituted words. Windows have WINDOW words and at most two substitutions; an item that is shorter is one window as a whole,
with at most one substitution from 7 words on and none below. Words are lower-cased runs of letters and digits. So a
one-word item is in every text that has the word; callers who do not want that set least_words.

A seed looks at fixed places of a window and ignores the others. For whole windows, MASKS are such that for any two
substituted places of 13 words some mask at some place avoids both; for items of 7 to 12 words, three masks each ignore
every third place, so one of them ignores the substituted one. So every such window has a hit. Hits are joined with the
items' seeds by hash; along a hit's diagonal, words of text and item are compared and windows counted, many diagonals at once.

A benchmark of up to block_bytes of text is broadcast, as sorted arrays, and texts are read against it without a
shuffle. A larger one stays a table: what is sent to executors then is a filter of at most FILTER_BITS bits, and seeds of the
texts that pass it, with the words around them, are joined with the items' seeds by a shuffle.

Defined results: null texts hold nothing, null items and items without words are in nothing, texts and items are read whole
however long, repeated rows count once, a null id is an id of its own, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import pick, restricted, stored, text_slices, work_dir
from tidewell.llm.words import combine, mix, word_hashes

WINDOW, SUBSTITUTIONS, LEAST_WORDS = 13, 2, 1
#: The places that each mask looks at.
MASKS = ("101110111", "11011100101", "1110010111")
BLOCK_BYTES = 2 << 20
FILTER_BITS = 27
#: Words of one diagonal batch, hits expanded at a time, and bytes of text read at a time: these bound a task's memory.
CHUNK, SLICE_BYTES = 1 << 19, 1 << 20


def places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def tolerance(size: int) -> int:
    """Substitutions that a window of so many words may have."""
    return SUBSTITUTIONS if size >= WINDOW else 1 if size >= 7 else 0


def shapes_of(size: int) -> list[tuple[tuple[int, ...], int]]:
    """Seeds of a window of so many words: the places each looks at, from the first one on, and where in the window that is
    (-1: anywhere)."""
    if size >= WINDOW:
        return [(places(m), -1) for m in MASKS]
    if not tolerance(size):
        return [(tuple(range(size)), 0)]
    out = []
    for k in range(3):
        own = [p for p in range(size) if p % 3 != k]
        out.append((tuple(p - own[0] for p in own), own[0]))
    return out


def every_pattern_is_hit(masks: tuple[str, ...] = MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> bool:
    """Whether for all substituted places of a window some mask fits between them; and of shorter ones likewise."""
    seeds = [{p + s for p in places(m)} for m in masks for s in range(window - len(m) + 1)]
    whole = all(any(not seed & set(bad) for seed in seeds) for bad in combinations(range(window), substitutions))
    short = all(any(not {p + at for p in shape} & set(bad) for shape, at in shapes_of(n)) for n in range(1, window) for bad in combinations(range(n), tolerance(n)))
    return whole and short


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin: the one way texts and items are read."""
    return word_hashes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), True)


def seeds_of(words: np.ndarray, shape: tuple[int, ...], number: int) -> np.ndarray:
    """The seeds of a shape at each place; the shape's number is part of the hash."""
    return mix(combine(words, shape) + np.uint64(number))


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges [first, first + count), one after the other."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def good_windows(same: np.ndarray, length: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of diagonals one after the other, each of so many words and with windows of so many: the good windows' diagonals and first words."""
    sums = np.concatenate([[0], np.cumsum(same)])
    windows = length - size + 1
    begin = ragged(np.cumsum(length) - length, windows)
    owner = np.repeat(np.arange(len(length)), windows)
    wide = size[owner]
    good = sums[begin + wide] - sums[begin] >= wide - np.array([tolerance(n) for n in range(WINDOW + 1)])[wide]
    return owner[good], begin[good]


class Index:
    """Seeds of items: hashes sorted, with the item and the place of its word that the seed begins at; and the items' words."""

    def __init__(self, texts: pa.Array, least_words: int = LEAST_WORDS):
        self.words, self.at = words_of(texts)
        sizes = np.diff(self.at)
        sizes = np.where(sizes >= least_words, sizes, 0)
        self.size = np.minimum(sizes, WINDOW)
        self.shapes = [(n, shape, where) for n in np.unique(self.size[self.size > 0]).tolist() for shape, where in shapes_of(n)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, (n, shape, where) in enumerate(self.shapes):
            h = seeds_of(self.words, shape, k)
            chosen = np.flatnonzero(self.size == n)
            first = self.at[chosen] + max(where, 0)
            count = np.maximum(self.at[chosen + 1] - self.at[chosen] - shape[-1], 0) if where < 0 else np.ones(len(chosen), np.int64)
            place = ragged(first, count)
            found.append((h[place], np.repeat(chosen, count), place))
        hashes, item, place = (np.concatenate([x[j] for x in found]) if found else np.zeros(0, t) for j, t in enumerate((np.uint64, np.int64, np.int64)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order].astype(np.int32), place[order].astype(np.int32)
        # a bit for each prefix of a hash that is there
        self.bits = int(np.clip(np.ceil(np.log2(max(1, 16 * len(hashes)))), 10, FILTER_BITS))
        mark = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.filter = np.zeros(1 << (self.bits - 3), np.uint8)
        np.bitwise_or.at(self.filter, mark >> 3, (1 << (mark & 7)).astype(np.uint8))

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of texts' words that a seed of an item begins at, with the range of that seed's rows."""
        out = []
        for k, (_, shape, _) in enumerate(self.shapes):
            h = seeds_of(words, shape, k)
            mark = h >> np.uint64(64 - self.bits)
            where = np.flatnonzero(self.filter[(mark >> np.uint64(3)).astype(np.int64)] >> (mark & np.uint64(7)).astype(np.uint8) & 1)
            a, b = (np.searchsorted(self.hashes, h[where], side) for side in ("left", "right"))
            inside = (b > a) & (where + shape[-1] < at[np.searchsorted(at, where, "right")])
            out.append((where[inside], a[inside], b[inside]))
        return tuple(np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in range(3))

    def find(self, words: np.ndarray, at: np.ndarray, first_only: bool = False) -> tuple[np.ndarray, ...]:
        """Of texts whose words these are: text, item, how many of the text's words windows along the best diagonal cover, first and
        last such word. With first_only, a text is left as soon as one item is found, and only the texts are of use."""
        where, a, b = self.hits(words, at)
        order = np.argsort(where, kind="stable")
        where, a, b = where[order], a[order], b[order]
        text = np.searchsorted(at, where, "right") - 1
        done = np.zeros(len(at), bool)
        ends = np.cumsum(b - a)
        rows: list[tuple[np.ndarray, ...]] = []
        low, base = 0, 0
        while low < len(where):
            high = max(low + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            base, some, low = int(ends[high - 1]), np.arange(low, high), high
            some = some[~done[text[some]]] if first_only else some
            for begin in range(0, int((b[some] - a[some]).max(initial=0)), CHUNK):  # a seed that very many items have, in steps
                count = np.clip(b[some] - a[some] - begin, 0, CHUNK)
                row = ragged(a[some] + begin, count)
                own = np.repeat(text[some], count)
                diagonals = np.unique(np.stack([own, self.item[row].astype(np.int64), np.repeat(where[some], count) - self.place[row]], 1), axis=0)
                if first_only:
                    diagonals = diagonals[~done[diagonals[:, 0]]]
                got = self.verify(words, at, diagonals)
                done[got[0]] = True
                rows.append(got)
        found = [np.concatenate([r[j] for r in rows]) if rows else np.zeros(0, np.int64) for j in range(5)]
        order = np.lexsort((found[3], -found[2], found[1], found[0]))
        found = [x[order] for x in found]
        best = np.ones(len(order), bool)
        best[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
        return tuple(x[best] for x in found)

    def verify(self, words: np.ndarray, at: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows along diagonals (text, item, word of the texts less word of the items): text, item, covered words, first, last."""
        text, item, shift = diagonals.T if len(diagonals) else np.zeros((3, 0), np.int64)
        a, b = np.maximum(at[text], self.at[item] + shift), np.minimum(at[text + 1], self.at[item + 1] + shift)
        size = self.size[item]
        fits = b - a >= size
        text, item, shift, a, b, size = (x[fits] for x in (text, item, shift, a, b, size))
        out: list[tuple[np.ndarray, ...]] = []
        ends, low, base = np.cumsum(b - a), 0, 0
        while low < len(text):
            high = max(low + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            base, s, low = int(ends[high - 1]), slice(low, high), high
            length = b[s] - a[s]
            place = ragged(a[s], length)
            owner, begin = good_windows(words[place] == self.words[place - np.repeat(shift[s], length)], length, size[s])
            wide = size[s][owner]
            first = np.cumsum(length) - length
            marks = np.zeros(len(place) + 1, np.int64)
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + wide, -1)
            covered = np.add.reduceat((np.cumsum(marks)[:-1] > 0).astype(np.int64), first)
            some, at_first = np.unique(owner, return_index=True)
            at_last = np.searchsorted(owner, some, "right") - 1
            start = a[s][some] - first[some] - at[text[s][some]]
            out.append((text[s][some], item[s][some], covered[some], begin[at_first] + start, begin[at_last] + wide[at_last] - 1 + start))
        return tuple(np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in range(5))


def contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each id and item whose passage a text of the id holds: id, item_id, n_words (of the text, covered by
    windows along the best diagonal), first_word and last_word (places in that text). Ids of any type; a null id is one too."""
    work = work_dir(docs.sparkSession, "decontaminate")
    known = numbered(items, item_id, item_text, work)
    texts = docs.select(*[c.alias(n) for c, n in zip(pick(docs, id_column, text_column), ("id", "text"))])
    kind = dict(docs.dtypes)[id_column]
    if size_of(known) <= block_bytes:
        held, numbers = _broadcast(known, least_words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, most_bytes=SLICE_BYTES):
                    text, item, *more = held.value.find(*words_of(part.column(1)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(numbers[item]), *(pa.array(x) for x in more)], ["id", "item", "n_words", "first_word", "last_word"])

        found = texts.mapInArrow(run, f"id {kind}, item long, n_words long, first_word long, last_word long")
    else:
        found = _joined(texts.select("id", F.col("id").alias("ref"), "text"), known, work, least_words)
    best = found.groupBy("id", "item").agg(F.max(F.struct("n_words", (-F.col("first_word")).alias("f"), "last_word")).alias("b"))
    named = known.select(F.col("n").alias("item"), F.col("id").alias("item_id"))
    return best.join(named, "item").select(F.col("id").alias(id_column), "item_id", "b.n_words", (-F.col("b.f")).alias("first_word"), "b.last_word")


def decontaminate(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs, with all columns, whose text holds no passage of an item. What is decided is the text, so rows with
    equal texts go or stay together, whatever their ids."""
    work = work_dir(docs.sparkSession, "decontaminate")
    known = numbered(items, item_id, item_text, work)
    at = docs.columns.index(text_column)
    if size_of(known) <= block_bytes:
        held, _ = _broadcast(known, least_words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, text_column, SLICE_BYTES):
                    keep = np.ones(part.num_rows, bool)
                    keep[held.value.find(*words_of(part.column(at)), first_only=True)[0]] = False
                    yield part.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    ref = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    texts = docs.select(pick(docs, text_column)[0].alias("text")).where("text is not null")
    found = _joined(texts.select(F.lit(None).cast("long").alias("id"), ref.cast("string").alias("ref"), "text"), known, work, least_words, ("ref",))
    gone = stored(found.select("ref").distinct().withColumnRenamed("ref", "_text_key"), f"{work}/gone")
    own = pick(docs, text_column)[0]
    keyed = docs.withColumn("_text_key", F.struct(F.xxhash64(own), F.xxhash64(F.lit(1), own)).cast("string"))
    return restricted(keyed, gone, "left_anti").select(*pick(docs, *docs.columns))


def numbered(items: DataFrame, item_id: str, item_text: str, work: str) -> DataFrame:
    """The distinct items that have a text, stored: n, id, text."""
    rows = items.select(*[c.alias(n) for c, n in zip(pick(items, item_id, item_text), ("id", "text"))]).where("text is not null").distinct()
    return stored(rows.withColumn("n", F.monotonically_increasing_id()).select("n", "id", "text"), f"{work}/items")


def size_of(known: DataFrame) -> int:
    return int(known.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0])


def _broadcast(known: DataFrame, least_words: int):
    """The index of items whose size was checked, sent to executors once; and the items' numbers."""
    rows = known.select("n", "text").orderBy("n").toArrow()
    texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return known.sparkSession.sparkContext.broadcast(Index(texts, least_words)), rows.column("n").to_numpy().astype(np.int64)


# benchmarks that are not sent to executors: seeds as tables


def _seeds(rows: DataFrame, least_words: int, sent=None, sizes: tuple[int, ...] = tuple(range(1, WINDOW + 1)), whole: bool = False) -> DataFrame:
    """From ref and text: ref, h (a seed), size (of its window), at (its first word), from_ and around (words within a window of it).

    Of items, each has the seeds of its own size; of texts (sent: a filter), all seeds that pass it.
    """
    kind = dict(rows.dtypes)["ref"]
    numbers, k = [], 0
    for n in range(1, WINDOW + 1):
        for shape, where in shapes_of(n):
            numbers.append((k, n, shape, where))
            k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most_bytes=SLICE_BYTES):
                words, at = words_of(part.column(1))
                count = np.diff(at)
                own = np.where(count >= least_words, np.minimum(count, WINDOW), 0)
                for k, n, shape, where in numbers:
                    if n not in sizes:
                        continue
                    h = seeds_of(words, shape, k)
                    if sent is None:
                        chosen = np.flatnonzero(own == n)
                        place = ragged(at[chosen] + max(where, 0), np.maximum(count[chosen] - shape[-1], 0) if where < 0 else np.ones(len(chosen), np.int64))
                    else:
                        bits, held = sent.value
                        mark = h >> np.uint64(64 - bits)
                        place = np.flatnonzero(held[(mark >> np.uint64(3)).astype(np.int64)] >> (mark & np.uint64(7)).astype(np.uint8) & 1)
                        place = place[place + shape[-1] < at[np.searchsorted(at, place, "right")]]
                    for begin in range(0, len(place), 1 << 14):
                        p = place[begin : begin + (1 << 14)]
                        text = np.searchsorted(at, p, "right") - 1
                        a, b = np.maximum(at[text], p - WINDOW + 1), np.minimum(at[text + 1], p + shape[-1] + WINDOW)
                        around = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]), pa.int32()), pa.array(words[ragged(a, b - a)].view(np.int64)))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(h[p].view(np.int64)), pa.array(np.full(len(p), n)), pa.array(p - at[text]), pa.array(p - a), around], ["ref", "h", "size", "at", "before", "around"])

    return rows.select("ref", "text").mapInArrow(run, f"ref {kind}, h long, size long, at long, before long, around array<long>")


def _joined(texts: DataFrame, known: DataFrame, work: str, least_words: int, by: tuple[str, ...] = ("id", "item")) -> DataFrame:
    """What find() gives, for a benchmark of any size: ref as id (and as ref), item, n_words, first_word, last_word."""
    seeds = stored(_seeds(known.select(F.col("n").alias("ref"), "text"), least_words), f"{work}/seeds")
    total = seeds.count()
    bits = int(np.clip(np.ceil(np.log2(max(1, 16 * total))), 10, FILTER_BITS))
    mark = F.shiftrightunsigned("h", 64 - bits)
    marks = seeds.groupBy(F.shiftright(mark, 5).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 31 as int))")).alias("v")).toArrow()
    held = np.zeros(1 << (bits - 5), np.uint32)
    held[marks.column("w").to_numpy()] = marks.column("v").to_numpy().astype(np.uint32)
    sent = texts.sparkSession.sparkContext.broadcast((bits, held.view(np.uint8)))
    sizes = tuple(r["size"] for r in seeds.select("size").distinct().collect())
    own = _seeds(texts, least_words, sent, sizes)
    if "item" not in by:  # a seed with the same words around it need be compared once
        seeds = seeds.groupBy("h", "size", "before", "around").agg(F.min("ref").alias("ref"), F.min("at").alias("at"))
    x = own.select("h", F.col("ref").alias("id"), F.col("at").alias("ta"), F.col("before").alias("tb"), F.col("around").alias("tw"))
    y = seeds.select("h", "size", F.col("ref").alias("item"), F.col("at").alias("ia"), F.col("before").alias("ib"), F.col("around").alias("iw"))
    kind = dict(texts.dtypes)["ref"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(begin, 1 << 14)
                size, ta, tb, ib, ia = (part.column(c).to_numpy() for c in ("size", "ta", "tb", "ib", "ia"))
                (tw, t0, t1), (iw, i0, i1) = ((x.values.to_numpy(), x.offsets.to_numpy()[:-1], x.offsets.to_numpy()[1:]) for x in (part.column("tw"), part.column("iw")))
                back = np.minimum(tb, ib)
                t0, i0 = t0 + tb - back, i0 + ib - back
                n = np.minimum(t1 - t0, i1 - i0)
                some = np.flatnonzero(n >= size)
                owner, at = good_windows(tw[ragged(t0[some], n[some])] == iw[ragged(i0[some], n[some])], n[some], size[some])
                row, start = some[owner], at - (np.cumsum(n[some]) - n[some])[owner]
                # of the windows that hold the seed's first word, from the first to the last all words are covered
                holds = (start <= back[row]) & (back[row] < start + size[row])
                row, start = row[holds], start[holds] + (ta - back)[row[holds]]
                row, first = np.unique(row, return_index=True)
                last = np.append(first[1:], len(start))[: len(first)] - 1
                got = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([got.column("id"), got.column("item"), pa.array((ta - ia)[row]), pa.array(start[first]), pa.array(start[last] + size[row] - 1)], ["id", "item", "shift", "lo", "hi"])

    good = x.join(y, "h").select("id", "item", "size", "ta", "tb", "tw", "ia", "ib", "iw").mapInArrow(run, f"id {kind}, item long, shift long, lo long, hi long")
    if "item" not in by:
        return good.select(F.col("id").alias("ref")).distinct()
    # the covered words of each diagonal: of each stretch, what none before it covers
    over = Window.partitionBy("id", "item", "shift").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce(F.max("hi").over(over), F.col("lo") - 1))
    each = good.distinct().withColumn("fresh", F.greatest(fresh, F.lit(0)))
    return each.groupBy("id", "item", "shift").agg(F.sum("fresh").alias("n_words"), F.min("lo").alias("first_word"), F.max("hi").alias("last_word"))
