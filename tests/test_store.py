import pytest
from pyspark.sql import functions as F

from tidewell.errors import CommitConflict, ConfigError
from tidewell.operators.store import Table


def test_swap_is_atomic_and_readers_keep_the_old_rows(spark, lake):
    t = Table(spark, f"{lake}/t")
    rows = spark.range(100).withColumnRenamed("id", "k")
    base = t.create(rows.schema)
    t.append(t.stage(rows, base))
    old = t.read()
    t.replace(t.stage(rows.where("k < 10"), t.manifest()))
    assert t.count() == 10 and old.count() == 100


def test_a_taken_number_is_a_conflict(spark, lake):
    t = Table(spark, f"{lake}/t")
    rows = spark.range(3)
    base = t.create(rows.schema)
    parts = t.stage(rows, base)
    t.append(parts)
    with pytest.raises(CommitConflict):
        t._commit(base, parts=parts)
    assert t.count() == 3


def test_final_read_keeps_the_last_version(spark, lake):
    t = Table(spark, f"{lake}/t")
    schema = "k int, v int, w string"
    t.create(spark.createDataFrame([], schema).schema, key=["k"], version="v", engine="ReplacingMergeTree")
    for rows in ([(1, 1, "a"), (2, 5, "b")], [(1, 1, "later"), (2, 4, "smaller")], [(3, 0, "c")]):
        t.append(t.stage(spark.createDataFrame(rows, schema), t.manifest()))
    assert t.count() == 5
    assert sorted(map(tuple, t.read(final=True).collect())) == [(1, 1, "later"), (2, 5, "b"), (3, 0, "c")]
    t.compact()
    assert t.count() == 3


def test_pruned_merge_takes_over_untouched_days(spark, lake):
    t = Table(spark, f"{lake}/t")
    rows = spark.range(40).select(F.col("id").alias("k"), F.expr("date_add(date'2024-01-01', cast(id % 10 as int))").alias("d"), F.lit(0).alias("v"))
    base = t.create(rows.schema, key=["k"], partition_by="d")
    t.append(t.stage(rows, base))
    before = {p.day: p.path for p in t.manifest().parts}
    assert len(before) == 10
    new = rows.where("d between date'2024-01-03' and date'2024-01-04' and k <> 2").withColumn("v", F.lit(1))
    t.merge(t.stage(new, t.manifest()), ["k", "d", "v"], ["k"], None, "d", delete_stale=True)
    after = {p.day: p.path for p in t.manifest().parts}
    assert all((before[d] == after[d]) == (d not in ("2024-01-03", "2024-01-04")) for d in before)
    assert t.read().where("v = 1").count() == 7 and t.count() == 39


def test_evolution_and_checks(spark, lake):
    t = Table(spark, f"{lake}/t")
    one = spark.createDataFrame([(1, "a")], "k int, Name string")
    t.append(t.stage(one, t.create(one.schema)))
    two = spark.createDataFrame([(2, "b", 1.5)], "k int, name string, amount double")
    assert t.evolve(two.schema, any_case=True).struct.fieldNames() == ["k", "Name", "amount"]
    assert t.evolve(two.schema, any_case=False).struct.fieldNames() == ["k", "Name", "amount", "name"]
    with pytest.raises(ConfigError):
        Table(spark, f"{lake}/u").create(one.schema, partition_by="k")
    with pytest.raises(ConfigError):
        Table(spark, f"{lake}/u").create(one.schema, key=["none"])


def merged_days(spark, lake, zone):
    """One key per day near midnight, merged with a later time of the same day."""
    import os
    import time

    old = os.environ.get("TZ")
    os.environ["TZ"] = zone
    time.tzset()
    try:
        t = Table(spark, f"{lake}/{zone}")
        sql = "select id as k, timestamp'2024-03-01 00:30:00' + make_dt_interval(cast(id as int)) + make_dt_interval(0, {h}) as at, '{v}' as v from range(20)"
        rows = spark.sql(sql.format(h=0, v="old"))
        t.append(t.stage(rows, t.create(rows.schema, key=["k"], partition_by="at")))
        new = spark.sql(sql.format(h=23, v="new")).where("k between 5 and 9")
        t.merge(t.stage(new, t.manifest()), ["k", "at", "v"], ["k"], "at", prune="at")
        return sorted((r["k"], r["v"]) for r in t.read().collect())
    finally:
        os.environ.pop("TZ") if old is None else os.environ.update(TZ=old)
        time.tzset()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_pruned_merges_do_not_hang_on_the_drivers_time_zone(spark, lake, zone):
    got = merged_days(spark, lake, zone)
    # the window begins at 23:30 of the first new day, so that day's old row is outside it
    assert [k for k, v in got if v == "new"] == [5, 6, 7, 8, 9] and [k for k, v in got if v == "old"] == [0, 1, 2, 3, 4, 5, *range(10, 20)]


def test_a_manifest_that_is_cut_off_is_no_commit(spark, lake):
    t = Table(spark, f"{lake}/t")
    rows = spark.range(3)
    t.append(t.stage(rows, t.create(rows.schema)))
    number = t.manifest().number
    t.files._write(*t.files._at(f"{lake}/t/_commits/{number + 1:012d}.json"), '{"number": 3, "par')
    assert t.count() == 3
    t.append(t.stage(rows, t.manifest()))
    assert t.count() == 6 and t.manifest().number == number + 1
    assert not [n for n in t.files.names(f"{lake}/t/_commits") if n.endswith(".tmp")]


def test_a_merge_that_loses_leaves_nothing(spark, lake):
    t = Table(spark, f"{lake}/t")
    rows = spark.range(5).withColumnRenamed("id", "k")
    t.append(t.stage(rows, t.create(rows.schema, key=["k"])))
    parts = t.stage(rows, t.manifest())
    before = set(t.files.names(f"{lake}/t/data"))
    commit = t._commit
    t._commit = lambda *a, **b: (_ for _ in ()).throw(CommitConflict("lost"))
    with pytest.raises(CommitConflict):
        t.merge(parts, ["k"], ["k"])
    t._commit = commit
    assert set(t.files.names(f"{lake}/t/data")) == before and t.count() == 5
    t.discard(parts)
    assert len(t.files.names(f"{lake}/t/data")) == 1
