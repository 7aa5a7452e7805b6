"""JSON topics, upsert topics with deletes, and configuration as of each change."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rillhouse import bindings, schemas
from rillhouse.operators import dimensions
from rillhouse.operators.latest import latest_of_topic
from rillhouse.sinks.tables import current_dimensions, dimension_changes
from rillhouse.sinks.topics import as_topic, as_upserts
from rillhouse.sources.records import topic_rows
from rillhouse.sources.streams import kafka_text, parquet_rows
from rillhouse.streaming import jobs
from rillhouse.workspace import new_folder


def test_topic_rows(spark):
    texts = ['{"id":"a","row_op_ts":"2024-01-01T00:00:00.000Z","old":{"x":"1"}}', '{"id":"b","more":1}', "{}", " {}",
             '{"id":"a"', "[1]", "null", "", None, '"text"', '{"old":[1]}']
    raw = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, seq long")
    rows, dirty = topic_rows(raw, schemas.table_schema(["id", "old", "row_op_ts"]))
    assert rows.columns == ["id", "old", "row_op_ts", "seq"]
    assert sorted((r.seq, r.id, r.old) for r in rows.collect()) == [(0, "a", {"x": "1"}), (1, "b", None), (2, None, None), (3, None, None)]
    assert sorted(r.seq for r in dirty.collect()) == list(range(4, len(texts)))


def test_topic_round_trip(spark):
    rows = spark.createDataFrame([("a", None, {"k": None, "l": 'q"'}), ("é\n", "2", None)], "id string, b string, old map<string,string>")
    back, dirty = topic_rows(as_topic(rows, "t"), rows.schema)
    assert dirty.count() == 0 and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_upsert_topic(spark):
    schema = "key string, value string, partition int, seq long"
    records = [
        ("a", "1", 0, 1), ("a", "2", 0, 5), ("a", "1", 0, 1),  # read twice
        ("b", "1", 1, 9), ("b", None, 1, 10),  # deleted
        ("c", None, 0, 2), ("c", "3", 0, 7),  # came back
        ("d", "old", 0, 900), ("d", "new", 2, 3),  # moved to another partition
        (None, "x", 0, 11), ("e", None, 0, 12),
    ]
    got = latest_of_topic(spark.createDataFrame(records, schema))
    assert sorted((r.key, r.value) for r in got.collect()) == [("a", "2"), ("c", "3"), ("d", "new")]


def test_upsert_records(spark):
    rows = spark.createDataFrame([("1", None, "x", False), ("2", "k", None, True), ("3", "k", "y", None)], "a string, b string, c string, gone boolean")
    got = as_upserts(rows, "t", ["a", "b"], ["a", "b", "c"], F.col("gone")).collect()
    assert [(r.key, r.value) for r in got] == [
        ('{"a":"1","b":null}', '{"a":"1","c":"x"}'),
        ('{"a":"2","b":"k"}', None),
        ('{"a":"3","b":"k"}', '{"a":"3","b":"k","c":"y"}'),
    ]


def test_start_positions(spark):
    with pytest.raises(ValueError):
        kafka_text(spark, "t", "host:1", starting="earliest", since_ms=5)


CHANGE = "database string, table string, type string, data map<string,string>, old map<string,string>, ts string"
CONFIG = "source_table string, sink_table string, sink_columns string, sink_pk string, sink_extend string, deleted boolean, ts_ms long, seq long"


def history_rows(rng, n):
    """Random configuration changes: (table, sink, deleted, time, place)."""
    return [(rng.choice("abc"), f"s{i}", rng.random() < 0.2, rng.randrange(0, n), i) for i in range(n)]


@pytest.mark.parametrize("block", [dimensions.HISTORY_BLOCK, 1, 3])
def test_routing_as_of(spark, block):
    rng = random.Random(block)
    log = history_rows(rng, 60)
    config = spark.createDataFrame([(t, s, f"id,{s}", None, None, d, at, n) for t, s, d, at, n in log], CONFIG)
    records = [(t, at) for t in "abcz" for at in [-1, *range(0, 62), None]]
    changes = [("shop", t, "insert", {"id": "1", "s5": "x", "s9": "y"}, None, None if at is None else str(at)) for t, at in records]
    history = dimensions.config_history(config.repartition(3), block)
    got = dimensions.route_dimensions_as_of(spark.createDataFrame(changes, CHANGE), history, F.col("ts"))
    assert set(got.columns) == {"database", "table", "type", "data", "old", "ts", "sink_table"}
    expected = []
    for table, at in records:
        known = [(when, n, s, d) for t, s, d, when, n in log if t == table and at is not None and when <= at]
        if known and not max(known)[3]:
            sink = max(known)[2]
            expected.append((table, at, sink, ["id", *[c for c in ("s5", "s9") if c == sink]]))
    assert sorted((r.table, int(r.ts), r.sink_table, sorted(r.data)) for r in got.collect()) == sorted(expected)


def test_a_change_without_a_time_is_refused(spark):
    config = spark.createDataFrame([("a", "s", "id", None, None, False, None, 1)], CONFIG)
    changes = spark.createDataFrame([("shop", "a", "insert", {"id": "1"}, None, "1")], CHANGE)
    with pytest.raises(Exception, match="without a time"):
        dimensions.route_dimensions_as_of(changes, dimensions.config_history(config), F.col("ts")).collect()


def test_no_configuration(spark):
    changes = spark.createDataFrame([("shop", "a", "insert", {"id": "1"}, None, "1")], CHANGE)
    history = dimensions.config_history(spark.createDataFrame([], CONFIG))
    assert dimensions.route_dimensions_as_of(changes, history, F.col("ts")).collect() == []


def test_dimension_job_as_of_each_change(spark):
    """Both sides of a configuration change in one micro-batch, and a record that arrives after it."""
    root = new_folder(spark, "dim")
    log = [("user", "dim_user", "id,name", None, None, False, 10, 1), ("user", "dim_person", "id", None, None, False, 20, 2)]
    config = spark.createDataFrame(log, CONFIG)
    job = jobs.DimensionJob(spark, root, lambda: config, as_of=F.col("ts"))
    for batch in ([("1", "9"), ("2", "12"), ("3", "20")], [("4", "19"), ("5", "25")]):
        rows = [('{"table":"user","type":"insert","ts":"%s","data":{"id":"%s","name":"n"}}' % (ts, key),) for key, ts in batch]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").parquet(f"{root}/topic_db")
        raw = parquet_rows(spark, f"{root}/topic_db", schemas.text_struct("value"))
        from rillhouse.sources.records import cdc_envelope

        job.start(cdc_envelope(raw)).awaitTermination()
    got = dimension_changes(spark, root).select("sink_table", F.to_json("data").alias("d")).collect()
    assert sorted((r.sink_table, r.d) for r in got) == [
        ("dim_person", '{"id":"3"}'),
        ("dim_person", '{"id":"5"}'),
        ("dim_user", '{"id":"2","name":"n"}'),
        ("dim_user", '{"id":"4","name":"n"}'),
    ]
    now = current_dimensions(dimension_changes(spark, root), dimensions.latest_config(config))
    assert {r.key[0] for r in now.where("sink_table = 'dim_person'").collect()} == {"3", "5"}


def test_visitor_state_expires(spark):
    """A day is remembered for the given time after it was written, by the clock."""
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    schema = "mid string, last_page_id string, ts bigint, seq bigint, value string"

    def visit(seq, ttl_ms):
        frame = spark.createDataFrame([("m", None, 1000 + seq, seq, "v")], schema)
        frame.coalesce(1).write.mode("append").parquet(folder)
        jobs.start_day_visit(parquet_rows(spark, folder, frame.schema), root, ttl_ms=ttl_ms).awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(f"{root}/dwd_traffic_day_visit").collect())

    ttl = 20_000
    assert visit(1, ttl) == [1]
    assert visit(2, ttl) == [1]
    time.sleep(ttl / 1000 + 1)
    assert visit(3, ttl) == [1, 3]


def test_customer_topic_has_deletes_and_repeats(spark):
    records = bindings.customer_topic(spark, "/root/testdata/sf0.001")
    assert records.where("value is null").count() > 0
    assert records.count() > records.select("partition", "seq").distinct().count()
