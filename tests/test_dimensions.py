"""Change records, configuration and dimension tables."""

import json

import pytest
from pyspark.sql import functions as F

from rillhouse import registry, schemas
from rillhouse.operators import dimensions
from rillhouse.sinks.tables import (
    current_dimensions,
    dimension_changes,
    dimension_table,
    sync_dimension_tables,
)
from rillhouse.sinks.topics import as_topic
from rillhouse.sources.records import cdc_envelope, config_changes, split_cdc, split_config
from rillhouse.sources.streams import parquet_rows
from rillhouse.streaming import jobs
from rillhouse.workspace import new_folder, shared_folder


def text(spark, *records):
    rows = [(r if isinstance(r, str) else json.dumps(r), i) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "value string, seq bigint")


def change(table="t", kind="insert", data=None, ts=1):
    return {"database": "shop", "table": table, "type": kind, "data": data or {}, "ts": ts}


def test_cdc_parsing(spark):
    bad = ['{"table":"t"', "[1]", "null", "", '{"type":"insert","data":{}}', '{"table":"t","type":"insert","data":[1]}']
    good = change(data={"id": 5, "price": 1.5, "note": None, "nested": {"a": 1}})
    markers = [change(kind="bootstrap-start"), change(kind="bootstrap-complete")]
    kept = [change(kind=k) for k in ("bootstrap-insert", "delete", "update")]
    usable, dirty = split_cdc(cdc_envelope(text(spark, good, *markers, *kept, *bad)))
    rows = {r.seq: r for r in usable.collect()}
    assert sorted(rows) == [0, 3, 4, 5]
    assert rows[0].data == {"id": "5", "price": "1.5", "note": None, "nested": '{"a":1}'}
    assert rows[0].ts == "1"
    assert sorted(r.value for r in dirty.collect()) == sorted(bad)


def config_record(columns, source="cart", sink="dim_cart", pk=None, extend=None):
    return {
        "source_table": source, "sink_table": sink, "sink_columns": columns,
        "sink_pk": pk, "sink_extend": extend,
    }


def test_latest_config_and_delete(spark):
    first, second = config_record("id"), config_record("id,sku_name")
    log = config_changes(text(spark, {"before": None, "after": first}, {"before": first, "after": second}))
    config = dimensions.latest_config(log)
    assert [r.sink_columns for r in config.collect()] == ["id,sku_name"]

    rows = spark.createDataFrame(
        [("shop", "cart", "insert", {"id": "1", "name": "n", "sku_name": "s"}, None, "1")],
        schemas.CDC_ENVELOPE,
    )
    routed = dimensions.route_dimensions(rows, config).collect()
    assert [(r.sink_table, r.data) for r in routed] == [("dim_cart", {"id": "1", "sku_name": "s"})]

    gone = config_changes(
        text(spark, {"before": None, "after": first}, {"before": second, "after": None})
    )
    none = dimensions.latest_config(gone)
    assert none.count() == 0
    assert dimensions.route_dimensions(rows, none).count() == 0


def test_changes_are_ordered_by_their_time(spark):
    """Change time first, then the place in the source; malformed text is kept apart."""
    def at(ts_ms, sink, **row):
        return {"before": None, "after": config_record("id", sink=sink, **row), "ts_ms": ts_ms}

    raw = text(spark, at(5, "s0"), at(9, "s1"), at(9, "s2"), at(7, "s3"), "{bad", "[1]", '{"after":{}}')
    changes, dirty = split_config(raw)
    assert [r.sink_table for r in dimensions.latest_config(changes).collect()] == ["s2"]
    assert sorted(r.value for r in dirty.collect()) == ["[1]", '{"after":{}}', "{bad"]
    placed = raw.withColumn("partition", F.pmod("seq", F.lit(2)))
    newest = dimensions.latest_config(config_changes(placed))
    assert [r.sink_table for r in newest.collect()] == ["s1"]
    timed = config_changes(raw.withColumn("seq", F.lit(None).cast("bigint")).where("value like '%s3%'"))
    assert dimensions.latest_config(timed).count() == 1
    unknown = text(spark, {"before": None, "after": config_record("id")})
    unknown = config_changes(unknown.withColumn("seq", F.lit(None).cast("bigint")))
    with pytest.raises(Exception, match="without time or place"):
        dimensions.latest_config(unknown).collect()


@pytest.mark.parametrize(
    "columns, kept", [("id,sku_name", {"id", "sku_name"}), (" id , name ", {"id", "name"}), ("", set())]
)
def test_whitelist_is_exact(spark, columns, kept):
    df = spark.createDataFrame([({"id": "1", "name": "n", "sku_name": "s"}, columns)], "d map<string,string>, c string")
    assert set(df.select(dimensions.keep_columns(F.col("d"), F.col("c"))).first()[0]) == kept


def test_tables_are_created_once(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS dims")
    rows = [
        ("a", "dim_a", "id,name", None, None),
        ("b", "dim_b", "b_id, b_name", "b_id", "COMMENT 'kept'"),
    ]
    config = dimensions.with_defaults(spark.createDataFrame(rows, schemas.TABLE_PROCESS))
    created = sync_dimension_tables(spark, config, "dims.")
    assert sum(text.startswith("CREATE") for text in created) == 2
    assert sync_dimension_tables(spark, config, "dims.") == []
    assert spark.table("dims.dim_b").dtypes == [("b_id", "string"), ("b_name", "string")]
    properties = dict(spark.sql("SHOW TBLPROPERTIES dims.dim_a").collect())
    assert properties["primary_key"] == "id"


def test_dimension_job_follows_its_configuration(spark):
    folder, root = new_folder(spark, "topic_db"), new_folder(spark, "dim")
    spark.sql("CREATE DATABASE IF NOT EXISTS dims2")
    state = {"columns": "id,name"}

    def config():
        row = tuple(config_record(state["columns"], "cart", "dim_cart").values())
        return spark.createDataFrame([row], schemas.TABLE_PROCESS)

    def run(*records):
        text(spark, *records).coalesce(1).write.mode("append").parquet(folder)
        raw = parquet_rows(spark, folder, spark.read.parquet(folder).schema)
        job = jobs.DimensionJob(spark, root, config, create="dims2.")
        job.start(cdc_envelope(raw)).awaitTermination()

    one = {"id": "1", "name": "it's", "secret": "x"}
    run(change("cart", data=one), change("other", data={"id": "9"}), "{bad")
    run(change("cart", "update", {**one, "name": None}, 2), change("cart", data={"id": "2"}, ts=2))
    state["columns"] = "id,name,secret"
    run(change("cart", "delete", one, 3))

    rows = dimension_changes(spark, root)

    def current(changes, **options):
        now = current_dimensions(changes, config(), **options)
        return dimension_table(now, "dim_cart", ["id", "name", "secret"]).collect()

    assert {(r.id, r.name, r.secret) for r in current(rows)} == {("1", "it's", "x"), ("2", None, None)}
    assert [r.id for r in current(rows, apply_deletes=True)] == ["2"]
    before = current(rows.where("batch_id < 2"))
    assert {(r.id, r.name) for r in before} == {("1", None), ("2", None)}
    assert spark.table("dims2.dim_cart").columns == ["id", "name", "secret"]
    assert [r.value for r in spark.read.parquet(f"{root}/dirty_data").collect()] == ["{bad"]


def test_sink_fed_by_two_sources(spark):
    rows = [tuple(config_record("id,name", "a", "dim").values()), tuple(config_record("id, code", "b", "dim").values())]
    config = spark.createDataFrame(rows, schemas.TABLE_PROCESS)
    assert dimensions.sink_layouts(config.collect()) == {"dim": ["id", "name", "code"]}


def test_topic_records(spark):
    df = spark.createDataFrame([("1", "n", None)], "id string, name string, gone string")
    row = as_topic(df, "dwd", key="id").first()
    assert (row.topic, json.loads(row.key), json.loads(row.value)) == (
        "dwd", {"id": "1"}, {"id": "1", "name": "n"}
    )
    raw = as_topic(df.withColumn("value", F.lit("as is")), "dwd").first()
    assert raw.value == "as is"


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x").startswith(shared_folder(spark))


def test_a_table_follows_its_configuration(spark):
    """Columns gained and lost between two batches of the job; the catalogue shows both."""
    spark.sql("create database if not exists follow")
    root, now = new_folder(spark, "dim"), {}

    def config(columns):
        rows = [("user", "dim_user", columns, "id", None), ("person", "dim_user", "id", "id", None)]
        return spark.createDataFrame(rows, schemas.TABLE_PROCESS)

    job = jobs.DimensionJob(spark, root, lambda: config(now["columns"]), create="follow.")

    def properties():
        return {r["key"]: r["value"] for r in spark.sql("show tblproperties follow.dim_user").collect()}

    for n, columns in enumerate(["id, name", "id,name,Age", "age,id"]):
        now["columns"] = columns
        frame = spark.createDataFrame([('{"table":"user","type":"insert","ts":"1","data":{"id":"%d"}}' % n,)], "value string")
        job.process(cdc_envelope(frame), n)
        if n == 0:
            spark.sql("insert into follow.dim_user values ('1', 'n')")
    assert spark.table("follow.dim_user").columns == ["id", "name", "Age"]
    assert [tuple(r) for r in spark.table("follow.dim_user").collect()] == [("1", "n", None)]
    assert properties()["active_columns"] == "id,age" and properties()["primary_key"] == "id"
    spark.sql("drop database follow cascade")


def test_change_text_of_one_task_is_read_by_several(spark):
    """A file holds few rows, so a table that one task writes is not left to one task again."""
    path = f"{new_folder(spark, 'text')}/topic_db"
    rows = 2 * registry.ROWS_PER_FILE + 1
    registry._append_text(spark.range(0, rows, 1, 1).select(F.col("id").cast("string").alias("value")), path)
    written = spark.read.parquet(path)
    assert (len(written.inputFiles()), written.count()) == (3, rows)
