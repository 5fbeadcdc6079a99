import random

import duckdb
import pytest

from tidewell.errors import ConfigError
from tidewell.operators.merge import deduplicate, merge

SCHEMA = "k int, j int, p int, v int, w int"


def duck_merge(t, s, prune, delete):
    c = duckdb.connect()
    for name, rows in (("t", t), ("s", s)):
        c.execute(f"create table {name} (k int, j int, p int, v int, w int)")
        if rows:
            c.executemany(f"insert into {name} values (?, ?, ?, ?, ?)", rows)
    one = "(select * from s qualify row_number() over (partition by k, j order by w desc nulls last, p desc nulls last, v desc nulls last) = 1)"
    window = " and t.p between (select min(p) from s) and (select max(p) from s)" if prune else ""
    inside = "t.p between (select min(p) from s) and (select max(p) from s)"
    stale = f" when not matched by source and {inside} then delete" if delete else ""
    c.execute(f"merge into t using {one} s on t.k = s.k and t.j = s.j{window} when matched then update set p = s.p, v = s.v, w = s.w when not matched then insert values (s.k, s.j, s.p, s.v, s.w){stale}")
    return sorted(c.execute("select * from t").fetchall(), key=str)


@pytest.mark.parametrize("seed", range(12))
def test_same_as_duckdb(spark, seed):
    r = random.Random(seed)
    some = lambda n, m: None if r.random() < 0.15 else r.randrange(m)
    make = lambda n: [(some(0, 5), some(0, 2), some(0, 6), r.randrange(9), r.randrange(9)) for _ in range(n)]
    t, s = make(r.choice([0, 3, 15])), make(r.choice([0, 2, 10]))
    prune, delete = seed % 3 > 0, seed % 3 > 1
    want = duck_merge(t, s, prune, delete)
    a, b = spark.createDataFrame(t, SCHEMA), spark.createDataFrame(s, SCHEMA)
    for lookup in (True, False):
        got = merge(a, b, ["k", "j"], "w", "p" if prune else None, delete, lookup)
        assert sorted((tuple(x) for x in got.collect()), key=str) == want


def test_columns_that_the_transfer_lacks_stay(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, extra int")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    for lookup in (True, False):
        assert sorted(map(tuple, merge(t, s, ["k"], lookup=lookup).collect())) == [(1, "a", 10), (2, "B", 20), (3, "C", None)]


def test_all_key_table_and_empty_key(spark):
    t = spark.createDataFrame([(1, 1)], "a int, b int")
    s = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "a int, b int")
    assert sorted(map(tuple, merge(t, s, ["a", "b"]).collect())) == [(1, 1), (1, 2)]
    with pytest.raises(ConfigError):
        merge(t, s, [])


def test_dedup_keeps_latest(spark):
    rows = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (1, None, "none"), (None, 1, "x"), (None, 2, "y")], "k int, w int, v string")
    assert sorted(map(str, deduplicate(rows, ["k"], "w").select("v").collect())) == ["Row(v='new')", "Row(v='y')"]
