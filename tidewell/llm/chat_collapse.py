"""Chat formatting after collapsing cumulative snapshots (operator 6), by DataFrame functions alone.

Logs often keep a conversation once after each turn, so most logged conversations are prefixes of longer ones. Each
turn gets a hash of its place, role and text; the sum of the hashes up to a turn is the hash of that prefix (a sum, so
it can be added up in parts). A conversation goes if its whole hash, with its length, is among the prefixes that end
before another conversation's last turn, or if an equal conversation has a smaller id. Both are anti-joins on distinct
keys, so a first turn that millions share is one row. Places and sums of one conversation are worked out per range
partition and then added over the partitions it spans: a conversation of any length is never in one task.

Defined results: rows equal in all four columns are one turn; turns are in the order of turn (null first), role, and
text (its first TIE_CHARACTERS characters, then its hash); a null role is `unknown`, a null text is empty; rows without conv_id are one conversation with
a null id. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import pick, stored

PART_TURNS = 256
#: Characters that put turns of one place and role in order; they move with the narrow rows.
TIE_CHARACTERS = 64
#: How a turn is written.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _halves(name: str) -> list[Column]:
    """A 64-bit hash as two columns whose sums cannot overflow."""
    return [(F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_lo"), F.shiftrightunsigned(name, 32).alias(f"{name}_hi")]


def _turns(df: DataFrame) -> DataFrame:
    names = ("conv_id", "turn", "role", "text")
    return df.select(*[c.alias(n) for c, n in zip(pick(df, *names), names)]).select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def placed(turns: DataFrame, work: str) -> DataFrame:
    """Distinct turns without their text: conv_id, turn, role, h (hash of text), place (from 1), size, p1, p2 (prefix hash)."""
    narrow = turns.select("conv_id", "turn", "role", F.left("text", F.lit(TIE_CHARACTERS)).alias("tie"), F.xxhash64("text", F.lit(1)).alias("h"), F.xxhash64(F.lit(2), "text", "role").alias("h2")).distinct()
    keys = ["conv_id", "turn", "role", "tie", "h", "h2"]
    ordered = stored(narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("tie"), f"{work}/ordered")
    ordered = ordered.withColumn("range", F.shiftright("at", 33))

    # places: the rows of a conversation are together within a range, and ranges are in order
    spans = ordered.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    over = Window.partitionBy("conv_id").orderBy("range")
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy("conv_id")))
    a, b = ordered.alias("a"), spans.alias("b")
    at = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.range") == F.col("b.range"))).select("a.*", "b.size", (F.col("b.before") + F.col("a.at") - F.col("b.first") + 1).alias("place"))
    hashed = at.withColumn("x", F.xxhash64("place", "role", "h")).withColumn("y", F.xxhash64("h2", "place")).select("*", *_halves("x"), *_halves("y")).drop("x", "y")

    # running sums within a range, then the sums of the ranges before
    sums = ["x_lo", "x_hi", "y_lo", "y_hi"]
    within = Window.partitionBy("conv_id", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("conv_id", "range", "turn", "role", "h", "h2", "place", "size", *[F.sum(s).over(within).alias(s) for s in sums])
    earlier = hashed.groupBy("conv_id", "range").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = earlier.select("conv_id", "range", *[F.coalesce(F.sum(s).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(s) for s in sums])
    r, e = running.alias("r"), earlier.alias("e")
    total = r.join(e, F.col("r.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("r.range") == F.col("e.range")))
    add = [(F.col(f"r.{s}") + F.col(f"e.{s}")).alias(s) for s in sums]
    return total.select("r.conv_id", "r.turn", "r.role", "r.h", "r.h2", "r.place", "r.size", *add).select(
        "conv_id", "turn", "role", "h", "h2", "place", "size", F.xxhash64("x_lo", "x_hi").alias("p1"), F.xxhash64("y_hi", "y_lo").alias("p2")
    )


def maximal(places: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no prefix of a longer one and no repetition: conv_id and size."""
    whole = places.where("place = size").groupBy("size", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    prefixes = places.where("place < size").select(F.col("place").alias("size"), "p1", "p2").distinct()
    return whole.join(prefixes, ["size", "p1", "p2"], "left_anti").select("conv_id", "size")


def format_chats(df: DataFrame, work: str, part_turns: int = PART_TURNS) -> DataFrame:
    """Render the maximal conversations: conv_id, part, n_turns (of the conversation), text.

    A conversation of at most part_turns turns is one part, a longer one is cut into parts of that many.
    """
    turns = _turns(df)
    places = stored(placed(turns, work), f"{work}/places")
    kept = maximal(places).alias("k")
    p = places.alias("p")
    wanted = p.join(kept, F.col("p.conv_id").eqNullSafe(F.col("k.conv_id"))).select("p.conv_id", "p.turn", "p.role", "p.h", "p.h2", "p.place", "p.size").alias("w")
    text = turns.select("*", F.xxhash64("text", F.lit(1)).alias("h"), F.xxhash64(F.lit(2), "text", "role").alias("h2")).dropDuplicates(["conv_id", "turn", "role", "h", "h2"]).alias("t")
    same = F.lit(True)
    for c in ("h", "h2", "role"):
        same = same & (F.col(f"t.{c}") == F.col(f"w.{c}"))
    for c in ("conv_id", "turn"):
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}"))
    line = F.concat(F.lit(OPEN), F.col("t.role"), F.lit("\n"), F.col("t.text"), F.lit(CLOSE))
    lines = text.join(wanted, same).select("w.conv_id", F.col("w.size").alias("n_turns"), F.floor((F.col("w.place") - 1) / part_turns).alias("part"), F.struct(F.col("w.place").alias("place"), line.alias("line")).alias("x"))
    # at most part_turns rows in a group
    parts = lines.groupBy("conv_id", "part").agg(F.max("n_turns").alias("n_turns"), F.array_sort(F.collect_list("x")).alias("x"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("x", lambda v: v["line"]), "").alias("text"))
