"""The driver's queries over the engine's own operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.config import Transfer
from tidewell.folders import work_dir as folder
from tidewell.functions import coerce as C
from tidewell.operators import archive, quality
from tidewell.operators.merge import deduplicate, last_version, merge, upsert
from tidewell.operators.store import Table
from tidewell.plans.projection import plan, require
from tidewell.sources.descriptors import Parquet
from tidewell.sources.frames import read as read_source
from tidewell.sources.http import exploded
from tidewell.sources.jdbc import partition_bounds, range_columns, split_range
from tidewell.streaming.chunks import page
from tidewell.streaming.state import latest
from tidewell.streaming.window import api_days, conjunction, first_lower, null_watermarks, snapshot_max, type_of, watermark_column, window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(df: DataFrame, **settings) -> DataFrame:
    return df.select(*plan(df.schema, Transfer(dest_table="t", source_table="t", **settings)).columns)


# projections


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total, o_orderdate FROM orders")
def project_include_exclude_rename(spark, d):
    return projected(table(spark, d, "orders"), exclude=["o_orderpriority"], rename={"o_totalprice": "total"})


@query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, upper(o_orderpriority) AS o_orderpriority FROM orders")
def project_expression(spark, d):
    return projected(table(spark, d, "orders"), include=["o_orderkey", "o_totalprice", "o_orderpriority"], column_transforms={"o_orderpriority": "upper(o_orderpriority)", "o_totalprice": "o_totalprice * 2"})


_EXACT = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')"


@query(f"SELECT o_orderkey, CAST(CAST({_EXACT} AS DECIMAL(18,3)) AS DECIMAL(18,2)) AS price FROM orders")
def project_type_override(spark, d):
    exact = table(spark, d, "orders").select("o_orderkey", F.concat(F.floor("o_totalprice").cast("string"), F.lit("."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")).cast("decimal(18,3)").alias("price"))
    return projected(exact, type_overrides={"price": "Decimal(18, 2)"})


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def project_decode_type(spark, d):
    return projected(table(spark, d, "orders"), include=["o_orderkey", "o_custkey"], column_transforms={"o_custkey": "o_custkey"}, column_transform_types={"o_custkey": "Utf8"})


@query("SELECT count(*) FILTER (WHERE o_custkey % 7 = 0) AS o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS o_orderstatus FROM orders")
def required_null_counts(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"))
    return require(rows, ["o_custkey", "o_orderstatus"])


# windows


def windowed(df: DataFrame, name: str, lower: str | None, upper: str | None, lookback: int = 0, expr: str | None = None) -> DataFrame:
    wm = watermark_column(df, name, expr)
    return df.where(conjunction(window(wm, type_of(df, wm), lower, upper, lookback)))


_EVENTS = ["event_id", "ts", "user_id", "event_type", "value"]


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts <= (SELECT max(ts) FROM events)")
def watermark_initial(spark, d):
    events = table(spark, d, "events").select(*_EVENTS)
    upper = snapshot_max(events, F.col("ts")).first()["upper"]
    return windowed(events, "ts", first_lower(None, None, False, upper), upper)


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-25'")
def watermark_window(spark, d):
    return windowed(table(spark, d, "events").select(*_EVENTS), "ts", "2024-01-15 00:00:00", "2024-01-25 00:00:00")


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def watermark_open_upper(spark, d):
    return windowed(table(spark, d, "events").select(*_EVENTS), "ts", "2024-01-15 00:00:00", None)


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts <= TIMESTAMP '2024-01-15'")
def watermark_open_lower(spark, d):
    return windowed(table(spark, d, "events").select(*_EVENTS), "ts", None, "2024-01-15 00:00:00")


@query("SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS ts FROM events WHERE greatest(ts, ts + INTERVAL 1 HOUR * (event_id % 24)) > TIMESTAMP '2024-01-15 12:00:00'")
def watermark_source_expr(spark, d):
    events = windowed(table(spark, d, "events"), "ts", "2024-01-15 12:00:00", None, expr="greatest(ts, ts + make_dt_interval(0, cast(event_id % 24 as int)))")
    return projected(events, include=["event_id", "ts"], column_transforms={"ts": "cast(date_trunc('day', ts) as timestamp_ntz)"})


@query("SELECT CAST(max(ts) AS VARCHAR) AS upper FROM events")
def snapshot_max_text(spark, d):
    return snapshot_max(table(spark, d, "events"), F.col("ts"))


@query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def partition_bounds_orders(spark, d):
    return partition_bounds(table(spark, d, "orders"), "o_orderkey")


def sliced(df: DataFrame, column: str, n: int, nullable: bool) -> DataFrame:
    """Rows of each slice, as the partitioned reader would deal them."""
    row = partition_bounds(df, column).first()
    slices = range_columns(column, split_range(row["lo"], row["hi"], n), nullable)
    number = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(slices))):
        number = F.when(c, F.lit(i)).otherwise(number)
    return df.groupBy(number.alias("slice")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT min(o_orderkey) AS lo, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 4.0) AS BIGINT) AS step FROM orders)
SELECT CAST((o_orderkey - lo) // step AS INTEGER) AS slice, count(*) AS n FROM orders, b GROUP BY 1""")
def range_partition_counts(spark, d):
    return sliced(table(spark, d, "orders"), "o_orderkey", 4, False)


@query("""SELECT CASE WHEN user_id % 7 = 0 THEN 3 ELSE (user_id % 7 - 1) // 2 END::INTEGER AS slice, count(*) AS n FROM events GROUP BY 1""")
def null_key_partition(spark, d):
    return sliced(table(spark, d, "events").select(F.nullif(F.col("user_id") % 7, F.lit(0)).alias("k")), "k", 3, True)


@query("SELECT count(*) FILTER (WHERE event_id % 10 = 0) AS n FROM events")
def null_watermark_count(spark, d):
    return null_watermarks(table(spark, d, "events"), F.when(F.col("event_id") % 10 != 0, F.col("ts")))


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts > TIMESTAMP '2024-01-15' - INTERVAL 259200 SECOND")
def lookback_seconds(spark, d):
    return windowed(table(spark, d, "events").select(*_EVENTS), "ts", "2024-01-15 00:00:00", None, lookback=259_200)


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-14'")
def lookback_date_ceil(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return windowed(events, "day", "2024-01-15", None, lookback=3600).withColumn("day", F.col("day").cast("string"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-10' GROUP BY event_type")
def seed_value(spark, d):
    events = table(spark, d, "events")
    lower = first_lower(None, "2024-01-10 00:00:00", False, snapshot_max(events, F.col("ts")).first()["upper"])
    return windowed(events, "ts", lower, None).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events)")
def seed_current_max(spark, d):
    events = table(spark, d, "events")
    lower = first_lower(None, None, True, snapshot_max(events, F.col("ts")).first()["upper"])
    return windowed(events, "ts", lower, None).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 100")
def keyset_page(spark, d):
    return page(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", None, 100)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 250 ORDER BY event_id LIMIT 100")
def keyset_resume(spark, d):
    return page(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", "250", 100)


@query("SELECT event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY event_type")
def state_latest(spark, d):
    return latest(table(spark, d, "events"), ["event_type"], "ts", ["event_id", "value"])


# merges

_T = "(SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01')"
_S = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01')"


def _target(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderdate <= timestamp_ntz'1999-01-01'")


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderdate > timestamp_ntz'1998-01-01'").withColumn("o_totalprice", F.col("o_totalprice") + 1)


def _merged(key: str, columns: list[str], t: str, s: str, where: str = "TRUE") -> str:
    out = ", ".join(f"CASE WHEN s.{key} IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in columns)
    return f"SELECT {out} FROM {t} t FULL JOIN {s} s ON t.{key} = s.{key} WHERE {where}"


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(_merged("o_orderkey", _ORDERS, _T, _S))
def merge_upsert(spark, d):
    return merge(_target(spark, d), _staged(spark, d), ["o_orderkey"], "o_orderdate")


@query(_merged("o_orderkey", _ORDERS, _T, _S))
def merge_upsert_full_join(spark, d):
    return merge(_target(spark, d), _staged(spark, d), ["o_orderkey"], "o_orderdate", lookup=False)


@query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE turn < 3),
s AS (SELECT conv_id, turn, upper(role) AS role, length(text) + 1 AS n FROM conversations WHERE turn > 1)
SELECT coalesce(s.conv_id, t.conv_id) AS conv_id, coalesce(s.turn, t.turn) AS turn, coalesce(s.role, t.role) AS role, coalesce(s.n, t.n) AS n
FROM t FULL JOIN s ON t.conv_id = s.conv_id AND t.turn = s.turn""")
def merge_composite_key(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return merge(c.where("turn < 3"), c.where("turn > 1").withColumns({"role": F.upper("role"), "n": F.col("n") + 1}), ["conv_id", "turn"])


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 > 0")
def merge_insert_only(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    one, two = (c.where(f"c_custkey % 3 = {k}").select("c_nationkey", "c_mktsegment") for k in (1, 2))
    return merge(one.distinct(), two, ["c_nationkey", "c_mktsegment"])


_W = "(SELECT * FROM {s} WHERE o_orderdate <= TIMESTAMP '1998-07-01')"


@query(f"""WITH s AS {_W.format(s=_S)}, t AS {_T}, b AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM s)
SELECT t.* FROM t, b WHERE t.o_orderdate NOT BETWEEN lo AND hi UNION ALL
({_merged("o_orderkey", _ORDERS, "(SELECT t.* FROM t, b WHERE t.o_orderdate BETWEEN lo AND hi)", "s")})""")
def merge_pruned(spark, d):
    return merge(_target(spark, d), _staged(spark, d).where("o_orderdate <= timestamp_ntz'1998-07-01'"), ["o_orderkey"], "o_orderdate", prune="o_orderdate")


@query(f"""WITH t AS {_T}, s AS (SELECT * REPLACE (o_orderdate + INTERVAL 400 DAY AS o_orderdate) FROM {_W.format(s=_S)}), b AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM s)
SELECT t.* FROM t, b WHERE t.o_orderdate NOT BETWEEN lo AND hi UNION ALL
({_merged("o_orderkey", _ORDERS, "(SELECT t.* FROM t, b WHERE t.o_orderdate BETWEEN lo AND hi)", "s")})""")
def merge_pruned_mutable_duplicates(spark, d):
    moved = _staged(spark, d).where("o_orderdate <= timestamp_ntz'1998-07-01'").withColumn("o_orderdate", F.expr("o_orderdate + interval 400 days"))
    return merge(_target(spark, d), moved, ["o_orderkey"], "o_orderdate", prune="o_orderdate")


@query(f"""WITH s AS (SELECT * FROM {_S} WHERE o_orderkey % 10 <> 0 AND o_orderdate <= TIMESTAMP '1998-07-01'), t AS {_T}, b AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM s)
SELECT t.* FROM t, b WHERE t.o_orderdate NOT BETWEEN lo AND hi UNION ALL
({_merged("o_orderkey", _ORDERS, "(SELECT t.* FROM t, b WHERE t.o_orderdate BETWEEN lo AND hi)", "s", "s.o_orderkey IS NOT NULL")})""")
def merge_delete_stale(spark, d):
    s = _staged(spark, d).where("o_orderkey % 10 <> 0 and o_orderdate <= timestamp_ntz'1998-07-01'")
    return merge(_target(spark, d), s, ["o_orderkey"], "o_orderdate", prune="o_orderdate", delete_stale=True)


@query("""WITH t AS (SELECT nullif(o_custkey % 5, 0) AS k, max(o_orderkey) AS v FROM orders GROUP BY 1),
s AS (SELECT nullif(o_custkey % 9, 0) AS k, min(o_orderkey) AS v FROM orders GROUP BY 1)
SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.v IS NOT NULL THEN s.v ELSE t.v END AS v FROM t FULL JOIN s ON t.k = s.k""")
def merge_null_key(spark, d):
    o = table(spark, d, "orders")
    t = o.groupBy(F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("k")).agg(F.max("o_orderkey").alias("v"))
    s = o.groupBy(F.nullif(F.col("o_custkey") % 9, F.lit(0)).alias("k")).agg(F.min("o_orderkey").alias("v"))
    return merge(t, s, ["k"])


_DEDUP = "SELECT event_id, ts, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"


@query(_DEDUP)
def staging_dedup(spark, d):
    return deduplicate(table(spark, d, "events").select(*_EVENTS), ["user_id"], "ts")


@query("SELECT DISTINCT user_id FROM events")
def staging_dedup_no_watermark(spark, d):
    return deduplicate(table(spark, d, "events").select("user_id", "event_id"), ["user_id"]).select("user_id")


@query("""SELECT c_custkey, c_name, c_acctbal, v FROM (SELECT c_custkey, c_name, c_acctbal, 1 AS v, 1 AS q FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, upper(c_name), c_acctbal, c_custkey % 3, 2 FROM customer WHERE c_custkey % 3 > 0)
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC, q DESC) = 1""")
def replacing_final(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    one = c.where("c_custkey % 2 = 0").withColumns({"v": F.lit(1).cast("long"), "q": F.lit(1)})
    two = c.where("c_custkey % 3 > 0").withColumns({"c_name": F.upper("c_name"), "v": F.col("c_custkey") % 3, "q": F.lit(2)})
    return last_version(one.unionByName(two), ["c_custkey"], "v", "q").select("c_custkey", "c_name", "c_acctbal", "v")


# tables


def _new(spark: SparkSession, name: str, df: DataFrame, **settings) -> Table:
    t = Table(spark, folder(spark, name))
    base = t.create(df.schema, **settings)
    t.append(t.stage(df, base))
    return t


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1")
def append_union(spark, d):
    n = table(spark, d, "nation")
    t = _new(spark, "append", n)
    t.append(t.stage(n.where("n_regionkey = 1"), t.manifest()))
    return t.read()


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 10, lower(r_name) FROM region")
def insert_select_by_name(spark, d):
    r = table(spark, d, "region")
    t = _new(spark, "by-name", r)
    t.append(t.stage(r.select(F.lower("r_name").alias("r_name"), (F.col("r_regionkey") + 10).alias("r_regionkey")), t.manifest()))
    return t.read()


@query("SELECT * FROM supplier WHERE s_nationkey < 10")
def full_swap(spark, d):
    s = table(spark, d, "supplier")
    t = _new(spark, "swap", s)
    t.replace(t.stage(t.read().where("s_nationkey < 10"), t.manifest()))
    return t.read()


@query("SELECT n_nationkey, n_name, n_regionkey, NULL::VARCHAR AS note FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey, lower(n_name) FROM nation")
def evolve_add_column(spark, d):
    n = table(spark, d, "nation")
    t = _new(spark, "evolve", n)
    more = n.withColumns({"n_nationkey": F.col("n_nationkey") + 100, "note": F.lower("n_name")})
    t.append(t.stage(more, t.evolve(more.schema)))
    return t.read()


@query(_merged("o_orderkey", _ORDERS, _T, _S))
def table_merge(spark, d):
    t = _new(spark, "merge", _target(spark, d), key=["o_orderkey"])
    t.merge(t.stage(_staged(spark, d), t.manifest()), _ORDERS, ["o_orderkey"], "o_orderdate")
    return t.read()


@query(f"""WITH s AS (SELECT * FROM {_S} WHERE o_orderkey % 10 <> 0 AND o_orderdate <= TIMESTAMP '1998-07-01'), t AS {_T}, b AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM s)
SELECT t.* FROM t, b WHERE t.o_orderdate NOT BETWEEN lo AND hi UNION ALL
({_merged("o_orderkey", _ORDERS, "(SELECT t.* FROM t, b WHERE t.o_orderdate BETWEEN lo AND hi)", "s", "s.o_orderkey IS NOT NULL")})""")
def table_merge_pruned_delete_stale(spark, d):
    t = _new(spark, "merge-stale", _target(spark, d), key=["o_orderkey"], partition_by="o_orderdate")
    s = _staged(spark, d).where("o_orderkey % 10 <> 0 and o_orderdate <= timestamp_ntz'1998-07-01'")
    t.merge(t.stage(s, t.manifest()), _ORDERS, ["o_orderkey"], "o_orderdate", prune="o_orderdate", delete_stale=True)
    return t.read()


@query("SELECT (SELECT count(*) FROM customer WHERE c_nationkey < 5) AS before, (SELECT count(*) FROM customer WHERE c_nationkey < 9) AS after")
def destination_row_count(spark, d):
    c = table(spark, d, "customer")
    t = _new(spark, "count", c.where("c_nationkey < 5"))
    before = t.count()
    t.append(t.stage(c.where("c_nationkey between 5 and 8"), t.manifest()))
    return t.read().agg(F.lit(before).cast("long").alias("before"), F.count("*").alias("after"))


# coercions

_TEXT = "CASE p_partkey % 8 WHEN 0 THEN '12.345' WHEN 1 THEN '-12.345' WHEN 2 THEN '5.' WHEN 3 THEN '.5' WHEN 4 THEN '1e3' WHEN 5 THEN 'abc' WHEN 6 THEN '12345678.9' ELSE ' 7.005 ' END"
_GUARD = r"'^[+-]?(\d+\.?\d*|\.\d+)$'"


def _parts(spark: SparkSession, d: str, text: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(text).alias("t"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(trim({_TEXT}), {_GUARD}) THEN TRY_CAST(trim({_TEXT}) AS DECIMAL(10,2)) END AS v FROM part")
def decimal_text_grammar(spark, d):
    return _parts(spark, d, _TEXT).select("p_partkey", C.as_decimal(F.col("t"), 10, 2).alias("v"))


@query("SELECT o_orderkey, CAST(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS DECIMAL(12,2)) AS v FROM orders")
def decimal_round_half_away(spark, d):
    text = F.concat(F.floor("o_totalprice").cast("string"), F.lit("."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    return table(spark, d, "orders").select("o_orderkey", C.as_decimal(text, 12, 2).alias("v"))


@query("SELECT o_orderkey, TRY_CAST(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5' AS DECIMAL(6,1)) AS v FROM orders")
def decimal_overflow_null(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.as_decimal(F.concat(F.floor("o_totalprice").cast("string"), F.lit(".5")), 6, 1).alias("v"))


@query("SELECT o_orderkey, CASE WHEN 1800 + o_orderkey % 600 BETWEEN 1900 AND 2299 THEN CAST(make_date(1800 + o_orderkey % 600, 1, 1) AS VARCHAR) END AS v FROM orders")
def date_range_clamp(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.in_range(F.expr("make_date(cast(1800 + o_orderkey % 600 as int), 1, 1)"), T.DateType()).cast("string").alias("v"))


@query("SELECT o_orderkey, CASE WHEN 1800 + o_orderkey % 600 BETWEEN 1900 AND 2299 THEN CAST(make_timestamp(1800 + o_orderkey % 600, 12, 31, 23, 59, 59.999999) AS VARCHAR) END AS v FROM orders")
def timestamp_range_clamp(spark, d):
    at = F.expr("make_timestamp_ntz(cast(1800 + o_orderkey % 600 as int), 12, 31, 23, 59, 59.999999)")
    return table(spark, d, "orders").select("o_orderkey", C.in_range(at, T.TimestampNTZType()).cast("string").alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS v FROM events")
def date_parse(spark, d):
    s = F.col("ts")
    text = F.when(F.col("event_id") % 5 == 0, F.date_format(s, "yyyy-MM-dd")).when(F.col("event_id") % 5 == 1, F.date_format(s, "yyyyMMdd")).when(F.col("event_id") % 5 == 2, F.date_format(s, "yyyyMMddHHmmss")).when(F.col("event_id") % 5 == 3, F.unix_timestamp(s.cast("timestamp")).cast("string")).otherwise("2024-13-45")
    return table(spark, d, "events").select("event_id", C.as_date(text).cast("string").alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE date_trunc('second', ts) END AS v FROM events")
def timestamp_parse(spark, d):
    s = F.col("ts")
    text = F.when(F.col("event_id") % 5 == 0, F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 5 == 1, F.date_format(s, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 5 == 2, F.date_format(s, "yyyyMMddHHmmss")).when(F.col("event_id") % 5 == 3, F.unix_timestamp(s.cast("timestamp")).cast("string")).otherwise("20261399999999")
    return table(spark, d, "events").select("event_id", C.as_timestamp(text, zoned=False).alias("v"))


_INTS = "CASE p_partkey % 6 WHEN 0 THEN '12' WHEN 1 THEN ' -7 ' WHEN 2 THEN '12.7' WHEN 3 THEN '' WHEN 4 THEN '99999999999999999999' ELSE '+5' END"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(trim({_INTS}), '^[+-]?[0-9]+$') THEN TRY_CAST(trim({_INTS}) AS BIGINT) END AS v FROM part")
def int_parse(spark, d):
    return _parts(spark, d, _INTS).select("p_partkey", C.as_integer(F.col("t")).alias("v"))


_FLOATS = "CASE p_partkey % 6 WHEN 0 THEN '1.5' WHEN 1 THEN '1e3' WHEN 2 THEN '1d' WHEN 3 THEN '' WHEN 4 THEN '-.25' ELSE 'x' END"


@query(f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1000::DOUBLE WHEN 4 THEN -0.25::DOUBLE END AS v FROM part")
def float_parse(spark, d):
    return _parts(spark, d, _FLOATS).select("p_partkey", C.as_float(F.col("t")).alias("v"))


_BOOLS = "CASE p_partkey % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'y' WHEN 3 THEN ' t ' WHEN 4 THEN '0' WHEN 5 THEN '2' ELSE 'Yes' END"


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 6 THEN true END AS v FROM part")
def bool_parse(spark, d):
    return _parts(spark, d, _BOOLS).select("p_partkey", C.as_boolean(F.col("t")).alias("v"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS v FROM part")
def base64_parse(spark, d):
    text = F.when(F.col("p_partkey") % 4 != 3, F.base64(F.col("p_name").cast("binary"))).otherwise("***")
    return table(spark, d, "part").select("p_partkey", C.as_bytes(text).cast("string").alias("v"))


@query("SELECT p_size % 4 <> 0 AS flag, count(*) AS n, count(*) FILTER (WHERE p_size % 4 NOT IN (0, 1)) AS collapsed FROM part GROUP BY 1")
def tinyint_bool_collapse(spark, d):
    flag, collapsed = C.as_flag(F.col("p_size") % 4)
    return table(spark, d, "part").groupBy(flag.alias("flag")).agg(F.count("*").alias("n"), F.count_if(collapsed).alias("collapsed"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_path_extract(spark, d):
    return table(spark, d, "events").select("event_id", C.as_integer(C.json_text(F.col("props"), "k")).alias("k"), C.json_text(F.col("props"), "none").alias("none"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 2 = 0")
def json_records_explode(spark, d):
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"data":{"rows":['), F.col("props"), F.lit(',{"k":-1}]}}'))).otherwise(F.concat(F.lit('{"data":{"rows":'), F.col("props"), F.lit("}}")))
    rows = exploded(table(spark, d, "events").select("event_id", body.alias("body")), "body", "data.rows")
    return rows.select("event_id", C.as_integer(C.json_text(F.col("record"), "k")).alias("k"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def csv_records(spark, d):
    where = folder(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").write.option("header", True).csv(where)
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(where).select(C.as_integer(F.col("c_custkey")).alias("c_custkey"), "c_name", C.as_integer(F.col("c_nationkey")).cast("int").alias("c_nationkey"))


@query(f"""SELECT count(*) FILTER (WHERE p_partkey % 6 IN (2, 4)) AS ints, count(*) FILTER (WHERE p_partkey % 6 IN (2, 5)) AS floats,
count(*) FILTER (WHERE p_partkey % 7 IN (2, 5)) AS bools FROM part""")
def coercion_counts(spark, d):
    p = table(spark, d, "part").select(*[F.expr(e).alias(n) for n, e in (("i", _INTS), ("f", _FLOATS), ("b", _BOOLS))])
    kinds = (("i", "ints", T.LongType()), ("f", "floats", T.DoubleType()), ("b", "bools", T.BooleanType()))
    return p.agg(*[F.sum(C.lost(F.col(n), C.coerced(F.col(n), k), k)).alias(a) for n, a, k in kinds])


@query("SELECT count(*) AS there, count(*) AS gone, min('x' || event_id) AS sample FROM events")
def fully_coerced_temporal(spark, d):
    text = F.concat(F.lit("x"), F.col("event_id").cast("string"))
    there, gone, sample = C.fully_lost(text, C.as_timestamp(text), T.TimestampType())
    return table(spark, d, "events").agg(there.alias("there"), gone.alias("gone"), sample.alias("sample"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE '-' END || printf('%02d', (event_id * 7919) % 800) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 59 AS VARCHAR), 2, '0')
|| CASE WHEN event_id % 3 = 0 THEN '' ELSE '.' || lpad(CAST(event_id % 1000 + 1 AS VARCHAR), 6, '0') END AS v FROM events""")
def time_text(spark, d):
    hours, e = (F.col("event_id") * 7919) % 800, F.col("event_id")
    micros = ((hours * 3600 + (e % 60) * 60 + e % 59) * 1_000_000 + F.when(e % 3 == 0, 0).otherwise(e % 1000 + 1)) * F.when(e % 2 == 0, 1).otherwise(-1)
    return table(spark, d, "events").select("event_id", C.time_text(micros).alias("v"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-17' AND DATE '2024-01-24' GROUP BY 1")
def api_window_days(spark, d):
    first, last = api_days("2024-01-20", None, datetime(2024, 1, 1).date(), datetime(2024, 1, 24).date(), 3, datetime(2024, 2, 1).date())
    day = F.col("ts").cast("date")
    return table(spark, d, "events").where(day.between(F.lit(first), F.lit(last))).groupBy(day.cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def archive_roundtrip(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("dt"))
    return archive.by_day(events, "dt", folder(spark, "archive")).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""SELECT * FROM (VALUES ('o_orderkey not_null', true, 0::BIGINT), ('o_orderkey unique', true, 0::BIGINT), ('row_count', true, 0::BIGINT)) v(expectation, success, unexpected)
UNION ALL SELECT 'o_orderstatus in_set', count(*) = 0, count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'o_totalprice between', count(*) = 0, count(*) FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 200000""")
def quality_suite(spark, d):
    suite = quality.Suite([quality.not_null("o_orderkey"), quality.unique("o_orderkey"), quality.row_count(1), quality.in_set("o_orderstatus", ["F", "O"]), quality.between("o_totalprice", 1000, 200000)])
    return suite.evaluate(table(spark, d, "orders"))


@query("""SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY n_name""")
def source_query_join(spark, d):
    t = Transfer(dest_table="t", source_query="SELECT o_orderdate, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
    rows = read_source(spark, Parquet(d), t)
    return windowed(rows, "o_orderdate", "1996-01-01 00:00:00", "1998-01-01 00:00:00").groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1")
def staging_dedup_lineitem(spark, d):
    rows = table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return deduplicate(rows, ["l_orderkey", "l_linenumber"], "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey")


__all__ = ["ORACLE_SQL", "QUERIES", "upsert"]
