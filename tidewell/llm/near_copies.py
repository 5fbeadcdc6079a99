"""MinHash near-dedup with bottom-k sketches from one hash function (operator 9).

A text's set is its distinct shingles of five words; its sketch is the SKETCH smallest of their hashes, all by the same
function. For two texts of similarity J, each of the k smallest hashes of the union is in both sketches with
probability J, so sketches of linked texts share most values. The steps:

1. Sketch every text, in one pass. Texts with equal sets are one class and go on as one.
2. Screen: among the PROBE smallest values of a text with a link, a quarter at least are also in another text's sketch, but
   for a chance of some millionths; only texts for which that holds go on.
3. Inverted lists of the retained values. Texts on one list of at most SHORT texts are candidates with each other. A
   linked text differs from its partner in at most a quarter of its set; so a text with clearly more than a quarter
   of its retained values on short lists meets every partner on one of those, and leaves the long lists.
4. What stays on long lists are large groups of copies, and texts made of what many share. Among these alone, whole
   sets are read. With their shingles in the order from rare to common, two linked sets share one of their first
   quarter, and where they first share one, enough of both must be left for the overlap. Nor can their parities, a bit
   for each class of shingles that says whether the set has an odd number of them, differ in more places than the sets
   in shingles. Both hold always, not by chance. So they meet on lists of those shingles: on short ones with each other, on long ones with a few pivots.
5. Candidates are estimated on the sketch of the union, and verified on full sets. Where both sketches hold the whole
   sets, that is at once; else the sets are read from the texts. Texts already known to be in one component need no
   further comparison, so the first round verifies the best open candidate of each text, and later ones what is left.
6. Texts of one long list that are still in different components are then compared with each other.

Empty sets are linked with nothing. Rows with equal ids are one node, linked by all of
their texts: where an id has several, classes take the place of ids, and an id joins its classes. A null id has its size and no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import connected, pick, restricted, stored, text_slices
from tidewell.llm.words import shingles, word_hashes

WORDS, PERCENT = 5, 75
SKETCH, PROBE, SHORT, PIVOTS = 128, 16, 12, 2
#: Share of retained values on short lists above which a text leaves the long lists: a quarter, and four deviations
#: of a sketch's share if the sketch holds a part of the set only.
RARE_WHOLE, RARE_PART = 0.25, 0.42
PARITY_LONGS = 16
#: Rows of one list that a task takes at once; a longer list is dealt to several.
BLOCK = 1000
#: Candidates whose estimate is over five deviations below the limit are dropped: a linked pair with a chance under 1e-6. Small
#: sets are estimated exactly.
LEAST_ESTIMATE, LIKELY_ESTIMATE = 0.55, 0.70


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each text."""
    words, at = word_hashes(texts, False)
    ends = at.tolist()
    for a, b in zip(ends, ends[1:]):
        yield shingles(words[a:b], WORDS)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of two ascending sets."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity on the sketch of the union."""
    union = np.union1d(a, b)[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum()) / max(1, len(union))


def sketch(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_shingles, d1 and d2 (128 bits that stand for the whole set) and values (the sketch, ascending), or text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most_bytes=2 << 20):
                n, one, two, values = [], [], [], []
                for s in sets_of(part.column(1)):
                    n.append(len(s))
                    # sums of two functions of the hashes: the same for the same set
                    one.append(int((s * (s | np.uint64(1)) ^ (s >> np.uint64(17))).sum(dtype=np.uint64) >> np.uint64(1)))
                    two.append(int((s * np.uint64(0xD6E8FEB86659FD93) ^ (s >> np.uint64(32))).sum(dtype=np.uint64) >> np.uint64(1)))
                    values.append((s[:SKETCH] >> np.uint64(1)).astype(np.int64))
                sizes = np.cumsum([0, *map(len, values)])
                listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), part.column(1) if with_text else listed], ["id", "n_shingles", "d1", "d2", "text" if with_text else "values"])

    rows = docs.select(*[c.alias(x) for c, x in zip(pick(docs, id_column, text_column), ("id", "text"))]).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, " + ("text string" if with_text else "values array<long>"))


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) with their estimate e, those far below the limit left out; sure where the sets are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, sure = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            whole = (np.asarray(batch.column(4)) <= SKETCH) & (np.asarray(batch.column(5)) <= SKETCH)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.asarray(x.values), np.asarray(y.values)
                if whole[k]:
                    sure[k] = linked(x, y)
                    e[k] = float(sure[k])
                else:
                    e[k] = estimate(x, y)
            keep = pa.array(e >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(e).filter(keep), pa.array(sure).filter(keep)], ["a", "b", "e", "sure"])

    x = sketches.select(F.col("id").alias("a"), F.col("values").alias("x"), F.col("n").alias("nx"))
    y = sketches.select(F.col("id").alias("b"), F.col("values").alias("y"), F.col("n").alias("ny"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(run, "a long, b long, e double, sure boolean")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) that are linked, on full sets. A text is moved once for each of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in text_slices(batch, "x", 2 << 20):
                good = []
                for k in range(one.num_rows):
                    good.append(linked(*(next(sets_of(one.column(c).slice(k, 1))) for c in (2, 3))))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([one.column(0).filter(keep), one.column(1).filter(keep)], ["a", "b"])

    x = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """id, values (the whole set) and parity (PARITY_LONGS times 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most_bytes=2 << 20):
                values = [(s >> np.uint64(1)).astype(np.int64) for s in sets_of(part.column(1))]
                sizes = np.cumsum([0, *map(len, values)])
                listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
                bits = 64 * PARITY_LONGS
                parity = [np.packbits((np.bincount(v % bits, minlength=bits) & 1).astype(np.uint8)).view(np.int64) for v in values]
                odd = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * PARITY_LONGS, pa.int32()), pa.array(np.concatenate(parity) if parity else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), listed, odd], ["id", "values", "parity"])

    return texts.select("id", "text").mapInArrow(run, "id long, values array<long>, parity array<long>")


def _alike(one: str, other: str, size: Column) -> Column:
    """Whether two parities differ in no more places than two linked sets of that size together may in shingles."""
    differ = reduce(lambda s, k: s + F.bit_count(F.col(one)[k].bitwiseXOR(F.col(other)[k])), range(PARITY_LONGS), F.lit(0))
    return differ * (100 + PERCENT) <= (100 - PERCENT) * size


def _blocks(rows: Column) -> Column:
    """How many blocks so many rows are dealt to."""
    return F.ceil(rows / BLOCK).cast("int")


def _each(blocks: str) -> Column:
    """One row for each block."""
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _meeting(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("v",)) -> DataFrame:
    """Pairs on one list, or block of one, (v, id, n, at, parity) whose sets can still overlap enough if this is the first place they share."""
    kept = [c for c in ("component",) if c in left.columns]
    x = left.select(*on, F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("parity").alias("xa"), *[F.col(c).alias("ca") for c in kept])
    y = right.select(*on, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("parity").alias("xb"), *[F.col(c).alias("cb") for c in kept])
    size = F.col("na") + F.col("nb")
    enough = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (100 + PERCENT) >= PERCENT * size
    apart = F.col("ca") != F.col("cb") if kept else F.col("a") < F.col("b")
    return x.join(y, reduce(lambda c, k: c & (x[k] == y[k]), on, apart & enough & _alike("xa", "xb", size)))


def _extended(components: DataFrame, edges: DataFrame, work: str) -> DataFrame:
    """components (node, component), joined further by edges (a, b) between components."""
    more = connected(edges, work)
    old = components.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(old.union(more.join(components, "node", "left_anti").select("node", "component")), f"{work}/extended")


def _settle(candidates: DataFrame, components: DataFrame, texts: DataFrame, work: str) -> DataFrame:
    """Join components by candidates (a, b, e, sure) that are linked; candidates inside one component are not looked at."""
    sure = candidates.where("sure")
    if not components.isEmpty():
        sure = _between(sure, components).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    components = _extended(components, sure.select("a", "b"), f"{work}/sure")
    candidates = candidates.where("not sure")
    for k in range(3):
        open_ = _between(candidates, components)
        if k < 1:
            # the best candidate of each text; the rest waits
            best = open_.groupBy("b").agg(F.max_by(F.struct("a", "b", "ca", "cb"), F.struct("e", "a")).alias("p")).select("p.*")
            side = open_.groupBy("a").agg(F.max_by(F.struct("a", "b", "ca", "cb"), F.struct("e", "b")).alias("p")).select("p.*")
            now = best.union(side).distinct()
        else:
            now = open_.where(F.col("e") >= (LIKELY_ESTIMATE if k == 1 else 0.0)).select("a", "b", "ca", "cb")
        now = stored(now, f"{work}/now{k}")
        if now.isEmpty():
            if k < 1:
                break
            continue
        good = _verified(now, texts).join(now, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        components = _extended(components, good, f"{work}/round{k}")
        # what was compared is done, linked or not
        if k < 2:
            candidates = stored(open_.select("a", "b", "e").join(now, ["a", "b"], "left_anti"), f"{work}/open{k}")
    return components


def _between(candidates: DataFrame, components: DataFrame) -> DataFrame:
    """Candidates whose texts are in different components, with those: ca and cb."""
    left = components.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = components.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    named = candidates.join(left, "a", "left").join(right, "b", "left").select("a", "b", "e", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    return named.where("ca <> cb")


def _by_class(docs: DataFrame, sk: DataFrame, work: str, id_column: str, text_column: str) -> DataFrame:
    """id and component where ids have several texts: near_copies() of one text of each class, under the class's number."""
    keys = ["d1", "d2", "n_shingles"]
    sized = sk.where("n_shingles > 0 and id is not null").select("id", *keys)
    numbered = stored(sized.select(*keys).distinct().withColumn("c", F.monotonically_increasing_id()), f"{work}/numbered")
    one = sketch(docs, id_column, text_column, with_text=True).where("n_shingles > 0 and id is not null").groupBy(*keys).agg(F.min("text").alias("text"))
    one = stored(one.join(numbered, keys).select("c", "text"), f"{work}/class-texts")
    found = near_copies(one, f"{work}/by-class", "c", "text").select("c", F.col("component_id").alias("part"))
    placed = stored(sized.join(numbered, keys).join(found, "c").select("id", "part").distinct(), f"{work}/parts")
    # an id joins the components of its texts
    first = placed.groupBy("id").agg(F.min("part").alias("a"))
    joins = connected(placed.join(first, "id").select("a", F.col("part").alias("b")), f"{work}/ids")
    root = placed.join(joins.select(F.col("node").alias("part"), F.col("component").alias("root")), "part", "left").select("id", F.coalesce("root", "part").alias("root")).distinct()
    return stored(root.join(root.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component"), f"{work}/of-ids")


def near_copies(docs: DataFrame, work: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: id, n_shingles, component_id (the smallest id reachable over links) and kept (whether that is itself)."""
    spark = docs.sparkSession
    sk = stored(sketch(docs, id_column, text_column), f"{work}/sketches")
    sized = sk.where("n_shingles > 0 and id is not null")
    differ = reduce(lambda x, y: x | y, [F.min(c) != F.max(c) for c in ("d1", "d2", "n_shingles")])
    repeated = sized.groupBy("id").agg(F.count("*").alias("rows"), differ.alias("differ")).where("rows > 1").agg(F.count("*").alias("ids"), F.max("differ").alias("differ")).first()
    if repeated["differ"]:
        out = sk.select("id", "n_shingles").join(_by_class(docs, sk, work, id_column, text_column), "id", "left")
        out = out.select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
    classes = stored(sized.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep")), f"{work}/classes")
    others = stored(sized.select("id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]).where("id <> rep").select("id").distinct(), f"{work}/others")
    reps = restricted(sized, others, "left_anti").select("id", F.col("n_shingles").alias("n"), "values")
    if repeated["ids"]:
        reps = reps.groupBy("id").agg(F.max(F.struct("n", "values")).alias("r")).select("id", "r.n", "r.values")

    # 2. screen
    probe = reps.select("id", "n", F.explode(F.slice("values", 1, PROBE)).alias("v"))
    shared = probe.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
    hits = probe.join(shared, "v").groupBy("id", "n").agg(F.count("*").alias("hits"))
    enough = F.greatest(F.lit(1), F.floor(F.least("n", F.lit(PROBE)) * 0.25))
    suspects = stored(hits.where(F.col("hits") >= enough).select("id"), f"{work}/suspects")
    going = stored(restricted(reps, suspects), f"{work}/going")

    # 3. inverted lists
    post = going.select("id", F.explode("values").alias("v"))
    counts = post.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    lists = stored(post.join(counts, "v").select("v", "id", "c"), f"{work}/lists")
    long_share = lists.where(F.col("c") > SHORT).groupBy("id").agg(F.count("*").alias("long"))
    rare = 1 - F.col("long") / F.size("values")
    whole = F.col("n") * 4 <= SKETCH * 3
    hot = stored(going.join(long_share, "id").where(rare <= F.when(whole, F.lit(RARE_WHOLE)).otherwise(F.lit(RARE_PART))).select("id"), f"{work}/hot")

    short = lists.where(F.col("c") <= SHORT).select("v", "id").join(hot.withColumn("hot", F.lit(True)), "id", "left").select("v", "id", F.coalesce("hot", F.lit(False)).alias("hot"))
    left, right = short.select("v", F.col("id").alias("a"), F.col("hot").alias("ha")), short.where("not hot").select("v", F.col("id").alias("b"))
    pairs = left.join(right, "v").where("a < b or (ha and a <> b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # 4. whole sets of those that stay on long lists, from rare to common shingles
    texts = docs.select(*[c.alias(x) for c, x in zip(pick(docs, id_column, text_column), ("id", "text"))]).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    whole_sets = stored(_whole_sets(restricted(texts, hot).dropDuplicates(["id"])), f"{work}/whole-sets")
    shingled = whole_sets.select("id", F.size("values").alias("n"), F.explode("values").alias("v"))
    common = shingled.groupBy("v").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "v")) - 1
    first = shingled.join(common, "v").withColumn("at", place).where("f > 1 and at <= floor(n / 4)").select("v", "id", "n", "at")
    first = stored(first, f"{work}/first-quarter")
    counted = first.join(first.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "v").join(whole_sets.select("id", "parity"), "id")
    few = counted.where(F.col("c") <= SHORT)
    met = _meeting(few, few).select("a", "b")
    dealt = F.pmod(F.xxhash64("id"), _blocks(F.col("c"))).cast("int")
    member = stored(counted.where(F.col("c") > SHORT).select("v", "id", "n", "at", "parity", _blocks(F.col("c")).alias("blocks"), dealt.alias("block")), f"{work}/members")
    chosen = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "parity")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = member.groupBy("v").agg(F.max("blocks").alias("blocks"), *chosen).select("v", _each("blocks").alias("block"), F.array_distinct(F.array(*[F.struct(f"p{k}.id", f"p{k}.n", f"p{k}.parity") for k in range(PIVOTS)])).alias("ps"))
    to_pivot = member.join(pivots, ["v", "block"]).select("id", "n", "parity", F.explode("ps").alias("p")).where((F.col("id") != F.col("p.id")) & _alike("parity", "p.parity", F.col("n") + F.col("p.n")))
    star = to_pivot.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()

    # 5. estimate and verify
    sketches = going.select("id", "values", "n")
    candidates = stored(_estimated(pairs.union(met).union(star).distinct(), sketches), f"{work}/candidates")
    unsure = candidates.where("not sure")
    wanted = stored(unsure.select(F.col("a").alias("id")).union(unsure.select("b")).union(hot).distinct(), f"{work}/wanted")
    texts = stored(restricted(texts, wanted).dropDuplicates(["id"]), f"{work}/texts")
    joined = _settle(candidates, spark.createDataFrame([], "node long, component long"), texts, f"{work}/first")

    # 6. what long lists leave in different components
    at = stored(member.join(joined.select(F.col("node").alias("id"), "component"), "id", "left").select("v", "id", "n", "at", "parity", "blocks", "block", F.coalesce("component", "id").alias("component")), f"{work}/placed")
    per = at.groupBy("v", "component", "blocks").agg(F.count("*").alias("n"))
    main = per.groupBy("v").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("blocks").alias("blocks"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    apart = at.join(main.select("v", "main", _blocks(F.col("others")).alias("rows"), _each("blocks").alias("block")), ["v", "block"])
    # all blocks of a list by all of its texts outside the main component, these in blocks as well
    outside = apart.where("component <> main").withColumn("row", F.pmod(F.xxhash64("id", F.lit(1)), "rows").cast("int")).withColumn("block", _each("blocks"))
    cross = _meeting(outside, apart.withColumn("row", _each("rows")), ("v", "row", "block")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stored(_estimated(cross, sketches), f"{work}/left")
    if not left.isEmpty():
        joined = _settle(left, joined, texts, f"{work}/last")

    names = joined.select(F.col("node").alias("rep"), "component")
    named = classes.join(names, "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = sk.select("id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    out = out.select(F.col("id").alias(id_column), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, work: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs of which each group keeps one: the smallest id. Rows with a null id all stay."""
    gone = near_copies(docs, work, id_column, text_column).where("not kept").select(F.col(id_column).cast(dict(docs.dtypes)[id_column]).alias(id_column)).distinct()
    gone = stored(gone, f"{work}/gone")
    return restricted(docs, gone, "left_anti").select(*[f"`{c}`" for c in docs.columns])
