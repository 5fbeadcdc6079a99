import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e, sys; q, o = e.queries(), e.oracle_sql(); assert 'merge_upsert' in q and set(o) <= set(q); assert 'tidewell.llm' not in sys.modules; print(len(q))"


def test_without_the_training_data_operators(tmp_path):
    where = tmp_path / "repo"
    shutil.copytree(ROOT, where, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=where, env={**os.environ, "PYTHONPATH": str(where)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_without_what_the_training_data_operators_need(tmp_path):
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
    says = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'merge_upsert' in q and set(o) <= set(q) and not [n for n in q if n.startswith('op')]"
    done = subprocess.run([sys.executable, "-c", says], cwd=ROOT, env={**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_flagship_query(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 1500 and df.columns[0] == "o_orderkey"
    assert set(e.oracle_sql()) <= set(e.queries())


def test_windows_reach_the_scan(spark):
    """Filters and columns of an incremental read are pushed into Parquet."""
    import __spark_entry__ as e

    plan = e.queries()["watermark_window"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in plan and "props" not in plan


def test_small_merges_do_not_shuffle_the_target(spark):
    import __spark_entry__ as e

    df = e.queries()["merge_upsert"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "FullOuter" not in plan


def test_staged_rows_beyond_a_broadcast_are_joined_once(spark):
    """Between what Spark broadcasts and what it does not: one dedup, one full join."""
    from tidewell.operators.merge import merge

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
        df = merge(orders, orders.where("o_orderkey % 2 = 0"), ["o_orderkey"], "o_orderdate")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("FullOuter") == 1 and plan.count("max(struct") == 1 and "Window" not in plan
