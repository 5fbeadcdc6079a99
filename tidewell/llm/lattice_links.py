"""Embedding near-dedup by lattice hashing (operator 2).

Each table projects a vector on eight random directions and decodes the result to the nearest point of the E8 lattice;
that point is the vector's cell. Besides its own cell a vector probes two neighbouring ones: the lattice's shortest
vectors of either kind (two units, or eight halves) that lean most towards where the vector lies in its cell. Two vectors meet in a
table if they share a cell or one probes the other's; those that meet are compared by cosine in double precision.

Equal vectors of a label are one class and go on as one with the number of their ids. The cells of a pair are known from both
vectors' codes, so a pair that meets more than once counts in the first place only: counts add up without a list of
pairs. A cell with many vectors is cut into blocks of BLOCK, and each pair of blocks is a task of its own, which
returns a row for each vector: how many it is linked with, and the smallest of its component in these blocks.

Recall depends on SCALE and TABLES alone; with these, pairs at cosine 0.98 exactly are found with a probability of over 0.99,
closer ones more often (tests/llm measures it against brute force).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import connected, pick, stored
from tidewell.llm.words import mix

TABLES, SCALE, PROBES, BLOCK, LEAST_COSINE = 10, 1.25, 2, 768, 0.98


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum."""
    whole = np.round(x)
    odd = whole.sum(1) % 2 != 0
    error = x - whole
    worst = np.abs(error).argmax(1)
    rows = np.flatnonzero(odd)
    whole[rows, worst[rows]] += np.where(error[rows, worst[rows]] >= 0, 1, -1)
    return whole


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: whole coordinates, or all halves, of an even sum."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def neighbours(x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two neighbouring cells towards which x leans: by two units, and by eight halves."""
    r = x - cell
    sign = np.where(r >= 0, 1.0, -1.0)
    two = np.zeros_like(r)
    top = np.argsort(-np.abs(r), axis=1, kind="stable")[:, :2]
    rows = np.arange(len(r))
    for k in range(2):
        two[rows, top[:, k]] = sign[rows, top[:, k]]
    half = sign / 2
    odd = (half < 0).sum(1) % 2 != 0
    least = np.abs(r).argmin(1)
    half[rows[odd], least[odd]] *= -1
    return cell + two, cell + half


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near one: exact, and squares cannot overflow or vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def codes(vectors: np.ndarray, tables: int = TABLES, scale: float = SCALE) -> np.ndarray:
    """For each vector and table: hashes of its own cell and of the cells it probes, (n, tables * (1 + PROBES))."""
    unit = scaled(vectors)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    out = np.zeros((len(unit), tables * (1 + PROBES)), np.int64)
    for t in range(tables):
        directions = np.random.Generator(np.random.PCG64([20240229, unit.shape[1], t])).standard_normal((unit.shape[1], 8))
        x = unit @ (directions * scale)
        cell = nearest_e8(x)
        for k, point in enumerate((cell, *neighbours(x, cell))):
            h = np.full(len(x), np.uint64(t + 1))
            for column in (np.round(point * 2).astype(np.int64)).T:
                h = mix(h * np.uint64(0x100000001B3) + column.view(np.uint64))
            out[:, t * (1 + PROBES) + k] = h.view(np.int64)
    return out


def _coded(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            listed = [None] * batch.num_rows
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = np.asarray(batch.column(3).take(pa.array(at)).flatten(), np.float64).reshape(len(at), n)
                for i, c in zip(at, codes(x)):
                    listed[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed, pa.list_(pa.int64()))], ["rep", "label", "n", "x", "codes"])

    return reps.mapInArrow(run, f"rep long, label {dict(reps.dtypes)['label']}, n long, x {dict(reps.dtypes)['x']}, codes array<long>")


def meets(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Whether vectors with codes a and b meet in table t, for all pairs."""
    own = t * (1 + PROBES)
    out = a[:, own, None] == b[None, :, own]
    for k in range(1, 1 + PROBES):
        out |= (a[:, own + k, None] == b[None, :, own]) | (a[:, own, None] == b[None, :, own + k])
    return out


def _compared(block: pa.Table) -> pa.Table:
    """All pairs between the two sides of a block, of which at least one vector is at home in the cell."""
    rep, n, side, home, table, low, high = (np.asarray(block.column(c)) for c in ("rep", "n", "side", "home", "t", "i", "j"))
    t, inner = int(table[0]), int(low[0]) == int(high[0])
    width = len(block.column("x").chunk(0)[0])
    x = np.concatenate([np.asarray(c.flatten(), np.float64) for c in block.column("x").chunks]).reshape(len(rep), width)
    code = np.concatenate([np.asarray(c.flatten()) for c in block.column("codes").chunks]).reshape(len(rep), -1)
    order = np.argsort(rep, kind="stable")
    rep, n, side, home, x, code = rep[order], n[order], side[order], home[order], x[order], code[order]
    x = scaled(x)
    a = np.arange(len(rep)) if inner else np.flatnonzero(side == low[0])
    b = a if inner else np.flatnonzero(side == high[0])
    length = np.sqrt((x * x).sum(1))
    cosine = (x[a] @ x[b].T) / (length[a][:, None] * length[b][None, :])
    good = (cosine >= LEAST_COSINE) & (home[a][:, None] | home[b][None, :]) & (rep[a][:, None] != rep[b][None, :])
    if inner:
        good = np.triu(good, 1)
    for k in range(t):
        if not good.any():
            break
        good &= ~meets(code[a], code[b], k)
    # where each is at home and probes the other's cell, the pair counts in the home of the smaller id
    own = t * (1 + PROBES)
    both = np.zeros_like(good)
    back = np.zeros_like(good)
    for k in range(1, 1 + PROBES):
        both |= code[a][:, own + k, None] == code[b][None, :, own]
        back |= code[a][:, own, None] == code[b][None, :, own + k]
    first_home = np.where(rep[a][:, None] < rep[b][None, :], home[a][:, None], home[b][None, :])
    good &= ~(both & back) | first_home
    links = np.zeros(len(rep), np.int64)
    np.add.at(links, a, good @ n[b])
    np.add.at(links, b, good.T @ n[a])
    # the smallest of each component: labels sink along links until they rest
    root = np.arange(len(rep))
    p, q = np.nonzero(good)
    p, q = a[p], b[q]
    while True:
        least = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, least)
        np.minimum.at(new, q, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    some = links > 0
    return pa.table({"rep": rep[some], "links": links[some], "root": rep[root[some]]}, schema=pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))


def lattice_links(df: DataFrame, work: str, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", block: int = BLOCK) -> DataFrame:
    """For each row: id, n_links (other vectors linked directly), component_id (the smallest id reachable) and kept.

    Vectors are compared only if their labels are equal and not null and they have as many components. Vectors that are
    null, empty, zero, or hold null or non-finite components are linked with nothing; their size does not matter else.
    Repeated rows (id, label and vector) are one vector and get equal results. An id with several vectors is one node, which has
    the links of all of them; n_links is each vector's own. A row with a null id counts as a link of others, each
    such row as one, and links others with each other, but has no component of its own and is kept.
    """
    rows = df.select(*[c.alias(x) for c, x in zip(pick(df, id_column, vector_column, label_column), ("id", "x", "label"))]).select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), "label")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("x").isNotNull() & fine, F.lit(False))
    flagged = rows.withColumn("valid", valid)
    # an equal vector's rows, and then its ids, are added up before vectors are dealt
    by_id = flagged.where("valid").groupBy("label", "x", "id").agg(F.count("*").alias("rows"))
    weight = F.when(F.col("id").isNull(), F.col("rows")).otherwise(1)
    classes = by_id.groupBy("label", "x").agg(F.min("id").alias("least"), F.sum(weight).alias("n"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), f"{work}/classes")
    reps = stored(_coded(classes.select("rep", "label", "n", "x")), f"{work}/reps")

    posted = reps.select("rep", F.posexplode("codes").alias("at", "code"), "label", F.size("x").alias("d"))
    posted = posted.select("rep", F.xxhash64("code", "label", "d", F.floor(F.col("at") / (1 + PROBES))).alias("key"), F.floor(F.col("at") / (1 + PROBES)).cast("int").alias("t"), (F.col("at") % (1 + PROBES) == 0).alias("home"))
    cells = posted.groupBy("key").agg(F.count("*").alias("c"), F.max("home").alias("any")).where("any and c > 1").select("key", F.ceil(F.col("c") / block).cast("int").alias("parts"))
    member = posted.join(cells, "key").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = member.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("rep", "key", "t", "home", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))
    held = dealt.join(reps.select("rep", "n", "x", "codes"), "rep")
    found = stored(held.groupBy("key", "i", "j").applyInArrow(_compared, "rep long, links long, root long"), f"{work}/found")

    edges = found.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    ids = flagged.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    repeated = not ids.isEmpty()
    if repeated:  # the vectors of one id are one node
        of_ids = flagged.where("valid").join(ids, "id").select("id", "label", "x").distinct().join(classes, ["label", "x"]).select("id", "rep")
        edges = edges.union(of_ids.join(of_ids.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b")))
    graph = connected(edges, f"{work}/graph").select(F.col("node").alias("rep"), F.col("component").alias("root"))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = stored(classes.join(counted, "rep", "left").join(graph, "rep", "left").select("label", "x", "least", "n", "links", F.coalesce("root", "rep").alias("root")), f"{work}/named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(smallest, "root").select("label", "x", F.lit(True).alias("valid"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    out = flagged.join(named, ["label", "x", "valid"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    if repeated:  # rows of an id that are no vectors belong to its component too
        out = stored(out, f"{work}/rows")
        out = out.drop("component_id").join(out.groupBy("id").agg(F.min("component_id").alias("component_id")), "id", "left")
    out = out.select(F.col("id").alias(id_column), "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
