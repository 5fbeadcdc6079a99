import json
import threading
from datetime import date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

import tidewell as tw
from tidewell.config import Transfer, validate
from tidewell.operators import quality
from tidewell.operators.store import Table
from tidewell.sources.http import csv_records, records_of, report_url, wait_seconds
from tidewell.sources.jdbc import split_range
from tidewell.streaming.window import api_days
from tidewell.sync import Throttle

START = datetime(2024, 1, 1)


def write(spark, folder, rows, schema="id bigint, amount double, write_date timestamp_ntz", name="src"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def rows(a, b, at=START):
    return [(i, i * 1.5, at + timedelta(seconds=i)) for i in range(a, b)]


@pytest.mark.parametrize("dedup", ["merge", "lazy"])
def test_incremental_runs_converge(spark, tmp_path, lake, dedup):
    src, target = tw.Parquet(str(tmp_path)), tw.Lake(lake, dedup)
    call = lambda **more: tw.sync(src, target, "t", spark=spark, source_table="src", mode="incremental", watermark="write_date", key=["id"], **more)
    write(spark, tmp_path, rows(1, 101))
    assert call().rows_written == 100
    write(spark, tmp_path, rows(1, 101) + rows(101, 151))
    assert call().rows_written == 50
    assert call().rows_written == 0
    t = Table(spark, f"{lake}/t").read(final=True)
    assert t.count() == 150 and t.agg(F.sum("amount")).first()[0] == sum(1.5 * i for i in range(1, 151))


@pytest.mark.parametrize("dedup", ["merge", "lazy"])
def test_lookback_reads_late_rows(spark, tmp_path, lake, dedup):
    src, target = tw.Parquet(str(tmp_path)), tw.Lake(lake, dedup)
    call = lambda **more: tw.sync(src, target, "t", spark=spark, source_table="src", mode="incremental", watermark="write_date", key=["id"], **more)
    write(spark, tmp_path, rows(1, 101))
    call()
    write(spark, tmp_path, [(1, 99999.0, START + timedelta(seconds=60))] + rows(2, 101))
    assert call().rows_written == 0
    assert call(lookback_seconds=45).rows_written == 46
    got = {r["id"]: r["amount"] for r in Table(spark, f"{lake}/t").read(final=True).collect()}
    assert len(got) == 100 and got[1] == 99999.0 and got[60] == 90.0


def test_full_refresh_mapping_and_clamp(spark, tmp_path, lake):
    data = [(1, "a", date(2024, 5, 1)), (2, "b", date(3000, 1, 1)), (3, "c", date(1000, 1, 1))]
    write(spark, tmp_path, data, "id bigint, name string, day date")
    r = tw.sync(tw.Parquet(str(tmp_path)), tw.Lake(lake), "t", spark=spark, source_table="src", rename={"name": "label"}, column_transforms={"name": "upper(name)"})
    got = sorted(map(tuple, Table(spark, f"{lake}/t").read().collect()))
    assert got == [(1, "A", date(2024, 5, 1)), (2, "B", None), (3, "C", None)]
    assert r.coerced == {"day": 2} and r.rows_written == 3
    write(spark, tmp_path, data[:1], "id bigint, name string, day date")
    tw.sync(tw.Parquet(str(tmp_path)), tw.Lake(lake), "t", spark=spark, source_table="src", rename={"name": "label"})
    assert Table(spark, f"{lake}/t").count() == 1


def test_gate_vetoes(spark, tmp_path, lake):
    write(spark, tmp_path, [(i, None) for i in range(200)], "id bigint, note string")
    src, target, seen = tw.Parquet(str(tmp_path)), tw.Lake(lake), []
    tw.sync(src, target, "t", spark=spark, source_table="src", validate=tw.Suite([quality.not_null("id"), quality.unique("id")], seen.append))
    with pytest.raises(tw.ValidationFailed):
        tw.sync(src, target, "t", spark=spark, source_query="select id + 1000 as id, note from src", validate=tw.Suite([quality.not_null("note")], seen.append))
    t = Table(spark, f"{lake}/t")
    assert [s["success"] for s in seen] == [True, False] and t.read().agg(F.max("id")).first()[0] == 199
    assert len(t.files.names(f"{lake}/t/data")) == 1  # nothing staged is left


def test_a_crash_before_the_cursor_converges(spark, tmp_path, lake, monkeypatch):
    write(spark, tmp_path, rows(1, 51))
    src, target = tw.Parquet(str(tmp_path)), tw.Lake(lake)
    call = lambda: tw.sync(src, target, "t", spark=spark, source_table="src", mode="inc", watermark="write_date", key=["id"])
    from tidewell.streaming.state import StateTable

    with monkeypatch.context() as m:
        m.setattr(StateTable, "append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            call()
    assert call().rows_written == 50 and Table(spark, f"{lake}/t").count() == 50


def test_chunks_resume_with_the_frozen_bound(spark, tmp_path, lake, monkeypatch):
    write(spark, tmp_path, rows(1, 101))
    src, target = tw.Parquet(str(tmp_path)), tw.Lake(lake, "lazy")
    call = lambda: tw.sync(src, target, "t", spark=spark, source_table="src", mode="inc", watermark="write_date", key=["id"], chunk_rows=30)
    from tidewell.sync import Run

    done, real = [], Run.promote

    def dies(self, *a):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(1)
        return real(self, *a)

    with monkeypatch.context() as m:
        m.setattr(Run, "promote", dies)
        with pytest.raises(RuntimeError):
            call()
    assert Table(spark, f"{lake}/t").count() == 60
    write(spark, tmp_path, rows(1, 101) + rows(101, 111))
    assert call().rows_written == 40  # up to the bound of the run that died
    assert call().rows_written == 10
    assert Table(spark, f"{lake}/t").count() == 110


def test_archive(spark, tmp_path, lake):
    write(spark, tmp_path, rows(1, 501))
    target = tw.Lake(lake, archive=tw.Archive(f"{lake}/archive", "raw"))
    tw.sync(tw.Parquet(str(tmp_path)), target, "t", spark=spark, source_table="src")
    back = spark.read.parquet(f"{lake}/archive/raw/t")
    assert back.count() == 500 and {"dt", "run"} <= set(back.columns)


def test_required_columns(spark, tmp_path, lake):
    write(spark, tmp_path, [(1, None), (None, "x")], "id bigint, note string")
    with pytest.raises(tw.ConfigError, match="id .1 rows"):
        tw.sync(tw.Parquet(str(tmp_path)), tw.Lake(lake), "t", spark=spark, source_table="src", not_null=["id"])


def test_derby_in_ranges(spark, lake, tmp_path):
    url = f"jdbc:derby:{tmp_path}/derby;create=true"
    data = spark.createDataFrame([(i if i % 9 else None, f"row-{i}", i * 1.5) for i in range(1, 101)], "ID int, NAME string, AMOUNT double")
    data.write.jdbc(url, "SRC", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    src = tw.Jdbc(dsn=url)
    from tidewell.sources import jdbc

    df = jdbc.read(spark, src, Transfer(dest_table="t", source_table="SRC", partition_column="ID", parallelism=3))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    r = tw.sync(src, tw.Lake(lake), "t", spark=spark, source_table="SRC", partition_column="ID", parallelism=3, exclude=["AMOUNT"])
    assert r.rows_written == 100 and Table(spark, f"{lake}/t").read().columns == ["ID", "NAME"]


def test_split_range():
    assert split_range(10, 25, 3) == [(10, 15), (16, 21), (22, 25)]
    big = split_range(0, 2**63 - 1, 4)
    assert len(big) == 4 and big[-1][1] == 2**63 - 1 and all(a[1] + 1 == b[0] for a, b in zip(big, big[1:]))


class Handler(BaseHTTPRequestHandler):
    fails = 0

    def do_GET(self):
        u = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        if u.path == "/flaky" and Handler.fails < 2:
            Handler.fails += 1
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        if u.path == "/report":
            body = b"\xef\xbb\xbfid,name,cost\n1,\"a, b\",1.50\n2,c\n"
        elif u.path == "/api/raw-data/export/app/app1/installs_report/v5":
            body = b"You've reached your maximum number of reports" if q["from"] == "2020-01-01" else b"id,name\n7,x\n"
        else:
            n = int(q.get("cursor", 0))
            body = json.dumps({"data": {"rows": [{"id": n * 2 + k, "at": {"ts": q["from"] + "T00:00:00Z"}, "ok": "yes" if k else "maybe"} for k in range(2)]}, "next": n + 1 if n < 2 else None}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_pages_and_cursor(spark, server, lake):
    src = tw.HttpApi(columns=[("id", "INTEGER"), ("ts", "TIMESTAMP", "at.ts"), ("ok", "BOOLEAN")], url=server + "/flaky?from={from}&to={to}", records_path="data.rows", cursor_path="next", cursor_param="cursor", from_date="2024-01-01", lookback_days=3)
    r = tw.sync(src, tw.Lake(lake), "t", spark=spark, mode="append", today=date(2024, 1, 20))
    t = Table(spark, f"{lake}/t").read()
    assert (r.rows_written, r.new_watermark, r.coerced) == (6, "2024-01-20", {"ok": 3})
    assert sorted(x["id"] for x in t.collect()) == list(range(6))
    tw.sync(src, tw.Lake(lake), "t", spark=spark, mode="append", today=date(2024, 1, 25))
    assert Table(spark, f"{lake}/t").read().agg(F.max("ts").cast("string")).first()[0] == "2024-01-17 00:00:00"


def test_reports(spark, server, lake):
    src = tw.HttpApi(columns={"id": "INTEGER", "cost": "NUMERIC"}, url=server + "/report", format="csv", from_date="2024-01-01")
    tw.sync(src, tw.Lake(lake), "t", spark=spark, today=date(2024, 1, 2))
    assert sorted((r["id"], str(r["cost"])) for r in Table(spark, f"{lake}/t").read().collect()) == [(1, "1.500000000"), (2, "None")]
    limited = tw.AppsFlyer(columns={"id": "INTEGER"}, app_id="app1", base_url=server, from_date="2020-01-01", to_date="2020-01-02")
    with pytest.raises(Exception, match="quota is used up"):
        tw.sync(limited, tw.Lake(lake), "u", spark=spark)
    assert report_url({"url": "u", "params": {"b": "2", "a": "1"}}, "f", "t") == "u?from=f&to=t&a=1&b=2"


def test_records_and_csv():
    assert records_of({"a": [1, 2]}, "a") == [1, 2] and records_of({"a": {"x": 1}}, "a") == [{"x": 1}] and records_of({"a": None}, "a") == [] and records_of({}, "a.b") == []
    with pytest.raises(tw.ConfigError):
        list(csv_records(b"id\n1\n", ["id", "none"]))
    assert [wait_seconds(k) for k in (1, 2, 3, 7, 9)] == [0.25, 0.5, 1.0, 15.0, 15.0]


def test_api_days():
    d = date.fromisoformat
    assert api_days("2024-07-20", None, None, None, 3, d("2024-07-25")) == (d("2024-07-17"), d("2024-07-25"))
    assert api_days("2024-07-02", None, d("2024-07-01"), None, 3, d("2024-07-25"))[0] == d("2024-07-01")
    assert api_days("2024-07-30", None, None, d("2024-07-25"), 0, d("2024-07-26")) == (d("2024-07-25"), d("2024-07-25"))
    with pytest.raises(tw.ConfigError):
        api_days(None, None, None, None, 0, d("2024-07-25"))


def test_throttle_gives_no_idle_credit():
    now, slept = [0.0], []
    t = Throttle(10, clock=lambda: now[0], sleep=slept.append)
    t.take(20)
    t.take(5)
    now[0] = 100.0
    t.take(5)
    t.take(5)
    assert slept == [2.0, 0.5]


MERGE, LAZY, PG = tw.Lake("/x"), tw.Lake("/x", "lazy"), tw.Parquet("/x")
INC = {"source_table": "s", "mode": "incremental", "watermark": "w", "key": ["k"]}


@pytest.mark.parametrize(
    ("settings", "target"),
    [
        ({}, MERGE),
        ({"source_table": "s", "mode": "append", "watermark": "w"}, MERGE),
        ({"source_table": "s", "mode": "incremental"}, MERGE),
        ({"source_table": "s", "lookback_seconds": 5}, MERGE),
        ({"source_table": "s", "mode": "incremental", "watermark": "w"}, MERGE),
        ({"source_table": "s", "mode": "incremental", "watermark": "w"}, LAZY),
        (INC | {"seed_watermark": "1", "skip_to_max": True}, MERGE),
        ({"source_table": "s", "skip_to_max": True}, MERGE),
        (INC | {"chunk_rows": 5}, MERGE),
        (INC | {"chunk_rows": 0}, LAZY),
        (INC | {"chunk_rows": 5, "validate": print}, LAZY),
        (INC | {"delete_stale_in_window": True}, MERGE),
        (INC | {"merge_prune_partition_by": "d"}, LAZY),
        (INC | {"key": list("abcde")}, MERGE),
        ({"source_table": "s", "parallelism": 0}, MERGE),
        ({"source_table": "s", "max_memory_bytes": 100}, MERGE),
        ({"source_table": "s", "column_transforms": {"a": " "}}, MERGE),
        ({"source_table": "s", "column_transform_types": {"a": "Int64"}}, MERGE),
        ({"source_table": "s", "type_overrides": {"a": "Decimal(50, 2)"}}, MERGE),
        ({"source_table": "s", "numeric_as_decimal": "Float64"}, MERGE),
    ],
)
def test_requests_that_make_no_sense(settings, target):
    with pytest.raises(tw.ConfigError):
        validate(Transfer(dest_table="t", **settings), PG, target)


def test_api_and_descriptor_rules():
    api = tw.HttpApi(columns={"a": "STRING"}, url="http://x")
    for bad in ({"column_transforms": {"a": "a"}}, {"chunk_rows": 5}, {"lookback_seconds": 5}):
        with pytest.raises(tw.ConfigError):
            validate(Transfer(dest_table="t", mode="incremental", key=["a"], **bad), api, MERGE)
    for make in (lambda: tw.Postgres(), lambda: tw.Postgres(dsn="postgresql://h/d", host="h"), lambda: tw.MySQL(host="h", client_cert_file="c"), lambda: tw.HttpApi(url="u", method="PUT"), lambda: tw.HttpApi(url="u", cursor_path="a"), lambda: tw.Lake("/x", "other")):
        with pytest.raises(tw.ConfigError):
            make()
    with pytest.raises(tw.ConfigError):
        tw.HttpApi(columns=[("a", "STRING"), ("a", "STRING")], url="u").schema()
    pg = tw.Postgres(dsn="postgresql://me:p%40w@db:5433/shop?sslmode=require")
    assert pg.jdbc_url() == "jdbc:postgresql://db:5433/shop" and pg.properties("x")["password"] == "p@w" and pg.properties("x")["sslmode"] == "require"
    assert tw.MySQL(host="h", database="d").properties("x")["zeroDateTimeBehavior"] == "CONVERT_TO_NULL"


def test_missing_watermark_names_the_columns(spark, tmp_path, lake):
    write(spark, tmp_path, [(1, "a")], "id bigint, name string")
    with pytest.raises(tw.ConfigError, match="updated.*id, name"):
        tw.sync(tw.Parquet(str(tmp_path)), tw.Lake(lake), "t", spark=spark, source_table="src", mode="inc", watermark="updated", key=["id"])


def test_cli(spark, tmp_path, lake, monkeypatch, capsys):
    from tidewell import cli

    write(spark, tmp_path, rows(1, 11))
    monkeypatch.setenv("SRC_DIR", str(tmp_path))
    job = tmp_path / "job.toml"
    job.write_text(f'[source]\ntype = "parquet"\npath = "${{SRC_DIR}}"\n[target]\ntype = "lake"\npath = "{lake}"\n[sync]\ndest_table = "t"\nsource_table = "src"\n')
    assert cli.main(["run", str(job)]) == 0 and "rows_written=10" in capsys.readouterr().out
    job.write_text("[source]\ntype = 'nope'\n[target]\n[sync]\n")
    with pytest.raises(SystemExit):
        cli.main(["run", str(job)])
    assert cli.main([]) == 2


def test_progress_errors_do_not_stop_a_run(spark, tmp_path, lake):
    write(spark, tmp_path, rows(1, 11))
    seen = []

    def shows(p):
        seen.append(p.rows_written)
        raise ValueError("display")

    tw.sync(tw.Parquet(str(tmp_path)), tw.Lake(lake), "t", spark=spark, source_table="src", on_progress=shows)
    assert seen == [10]


def test_bytes_written_are_those_of_the_files(spark, tmp_path, lake):
    write(spark, tmp_path, rows(1, 11))
    done = tw.sync(tw.Parquet(str(tmp_path)), tw.Lake(lake), "t", spark=spark, source_table="src")
    import os

    files = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{lake}/t/data") for f in names if f.endswith(".parquet")]
    assert 0 < sum(files) <= done.bytes_written <= 2 * sum(files) + 1000


def test_job_files_say_what_is_wrong(tmp_path, monkeypatch):
    from tidewell.cli import Job
    from tidewell.errors import ConfigError

    monkeypatch.delenv("NO_SUCH_NAME", raising=False)
    job = tmp_path / "job.toml"
    tail = "[target]\ntype = 'lake'\npath = '/x'\n[sync]\n"
    for text, says in (("[source]\ntype='parquet'\npath='${NO_SUCH_NAME}'\n" + tail, "NO_SUCH_NAME"), ("[source]\ntype='parquet'\npth='x'\n" + tail, "has no field pth"), ("[source]\n" + tail, "type is missing"), ("[source]\n", r"\[target\], \[sync\]"), ("= 1", "cannot be read")):
        job.write_text(text)
        with pytest.raises(ConfigError, match=says):
            Job.read(str(job))
    with pytest.raises(ConfigError, match="cannot be read"):
        Job.read(str(tmp_path / "none.toml"))
    job.write_text("[source]\ntype='parquet'\npath='a'\n[target]\ntype='lake'\npath='/x'\n[target.archive]\npath='/y'\n[sync]\ndest_table='t'\n")
    made = Job.read(str(job))
    assert made.target.archive.path == "/y" and made.settings == {"dest_table": "t"}
