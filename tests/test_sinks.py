import pytest
from pyspark.sql import types as T

from tidewell.errors import ConfigError
from tidewell.operators.sinks import BigQuerySink, ClickHouseSink, Sink


def test_options_of_the_warehouse_writer():
    s = BigQuerySink("ds", project_id="p", partition_by="day", cluster_by=["a", "b"])
    assert isinstance(s, Sink)
    assert s.options("t") == {"table": "p.ds.t", "writeMethod": "direct", "parentProject": "p", "partitionField": "day", "partitionType": "DAY", "clusteredFields": "a,b", "writeAtLeastOnce": "false"}
    assert BigQuerySink("ds", method="indirect", bucket="b").options("t") == {"table": "ds.t", "writeMethod": "indirect", "temporaryGcsBucket": "b"}
    for wrong in ({"method": "other"}, {"method": "indirect"}, {"cluster_by": list("abcde")}):
        with pytest.raises(ConfigError):
            BigQuerySink("ds", **wrong)


def test_tables_of_the_column_store():
    s = ClickHouseSink("h", "db", engine="ReplacingMergeTree", key=["id"], version="at")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType(), False), T.StructField("price", T.DecimalType(12, 2)), T.StructField("name", T.StringType())])
    assert isinstance(s, Sink) and s.url() == "jdbc:clickhouse://h:8123/db"
    assert s.create_table(schema, "t") == "CREATE TABLE IF NOT EXISTS `db`.`t` (`id` Int64, `at` DateTime64(6, 'UTC'), `price` Nullable(Decimal(12, 2)), `name` Nullable(String)) ENGINE = ReplacingMergeTree(at) ORDER BY (`id`)"
    assert s.table_options(schema)["createTableOptions"] == "ENGINE = ReplacingMergeTree(at) ORDER BY (`id`)"
    with pytest.raises(ConfigError):
        s.create_table(T.StructType([T.StructField("a", T.ArrayType(T.LongType()))]), "t")
