"""Streaming forms against their batch counterparts, over several micro-batches."""

import time

import pytest
from pyspark.sql import functions as F

from rillhouse import bindings, schemas
from rillhouse.operators import visits
from rillhouse.plans import traffic
from rillhouse.sinks.topics import as_topic, stream_files, to_topics
from rillhouse.sources.streams import file_text, parquet_rows
from rillhouse.streaming import jobs, processors
from rillhouse.streaming.progress import dropped_rows, watch
from rillhouse.workspace import new_folder

SF = "/root/testdata/sf0.001"
WITHIN = 6 * 3600 * 1000
THIRDS = [(0, 300), (300, 700), (700, 10**9)]


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def feed(frame, folder, start):
    """Append the frame to a folder in time order and run the job after each part."""
    for low, high in THIRDS:
        part = frame.where((F.col("seq") >= low) & (F.col("seq") < high))
        part.coalesce(1).write.mode("append").parquet(folder)
        start().awaitTermination()


@pytest.fixture
def page_text(spark):
    pages = bindings.page_views(spark, SF)
    return pages.withColumn("value", F.to_json(F.struct("mid", "ts")))


def test_user_jump_over_restarts(spark, page_text):
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    feed(
        page_text,
        folder,
        lambda: jobs.start_user_jump(parquet_rows(spark, folder, page_text.schema), root, WITHIN),
    )
    got = rows_of(spark.read.parquet(f"{root}/dwd_traffic_user_jump_detail"), "mid", "ts", "seq")
    batch = rows_of(visits.user_jump(page_text, WITHIN), "mid", "ts", "seq")
    assert set(got) <= set(batch) and len(got) == len(set(got))
    newest = max(r.ts for r in page_text.collect())
    # What is missing still waits for its window to close.
    assert all(ts + WITHIN >= newest for _, ts, _ in set(batch) - set(got))


def test_user_jump_keeps_ties_and_lagging_rows(spark):
    """Rows of an earlier micro-batch's newest time, and rows that lag within the delay."""
    schema = "mid string, last_page_id string, ts bigint, seq bigint, value string"

    def run(delay, *batches):
        folder, root = new_folder(spark, "in"), new_folder(spark, "out")
        for rows in batches:
            frame = spark.createDataFrame([(m, p, t, s, "v") for m, p, t, s in rows], schema)
            frame.coalesce(1).write.mode("append").parquet(folder)
            pages = parquet_rows(spark, folder, frame.schema)
            jobs.start_user_jump(pages, root, 10_000, delay=delay).awaitTermination()
        return rows_of(spark.read.parquet(f"{root}/dwd_traffic_user_jump_detail"), "mid", "ts")

    far = ("far", None, 900_000, 9)
    tied = run("1 millisecond", [("a", None, 100_000, 1)], [("b", None, 100_000, 2)], [far])
    assert tied == [("a", 100_000), ("b", 100_000)]
    # The page at 95 s arrives after the entry at 100 s and is its predecessor.
    late = [("a", None, 93_000, 1), ("a", None, 100_000, 3), ("c", None, 100_000, 4)]
    found = run("1 minute", late, [("a", "p", 95_000, 2), ("c", "p", 104_000, 5)], [far])
    assert found == [("a", 100_000)]
    with pytest.raises(ValueError):
        processors.user_jump_stream(spark.createDataFrame([], schema), 10_000, "0 seconds")


def test_dropped_rows_are_counted(spark):
    """Rows that lag further than the delay are dropped, and a listener tells how many."""
    schema = "mid string, last_page_id string, ts bigint, seq bigint, value string"
    folder, root, listener = new_folder(spark, "in"), new_folder(spark, "out"), watch(spark)
    late = []
    for rows in ([("a", 100_000)], [("a", 101_000), ("b", 98_999), ("c", 99_500), ("d", 99_000)], [("a", 1)]):
        frame = spark.createDataFrame([(m, None, t, i, "v") for i, (m, t) in enumerate(rows)], schema)
        frame.coalesce(1).write.mode("append").parquet(folder)
        pages = parquet_rows(spark, folder, frame.schema)
        query = jobs.start_user_jump(pages, root, 10_000, delay="1 second")
        query.awaitTermination()
        late.append(dropped_rows(query))
    assert late == [0, 2, 1]
    for _ in range(50):
        if sum(listener.rows.values()) == 3:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert listener.rows == {str(query.id): 3}


def test_devices_share_bounce_states(spark):
    """Many devices are settled in few calls, each by its own rows."""
    schema = "mid string, last_page_id string, ts bigint, seq bigint, value string"
    rows = [(f"m{i}", "p" if j else None, 100_000 + 4_000 * j * (i % 2) + 20_000 * j, 2 * i + j, "v") for i in range(1500) for j in (0, 1)]
    rows += [(f"n{i}", "p" if j else None, 100_000 + 4_000 * j, 4000 + 2 * i + j, "v") for i in range(1500) for j in (0, 1)]
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    for part in (rows, [("far", None, 900_000, 9, "v")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        query = jobs.start_user_jump(parquet_rows(spark, folder, spark.createDataFrame([], schema).schema), root, 10_000)
        query.awaitTermination()
        held = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
        assert held <= processors.BOUNCE_GROUPS
    got = rows_of(spark.read.parquet(f"{root}/dwd_traffic_user_jump_detail"), "mid")
    assert got == sorted((f"m{i}",) for i in range(1500))


def test_unique_visitor_forgets_no_late_row(spark):
    schema = "mid string, last_page_id string, ts bigint, seq bigint"
    day, folder, root = 86_400_000, new_folder(spark, "in"), new_folder(spark, "out")
    batches = [[(9 * day + 5, 1), (9 * day + 3, 2), (9 * day + 3, 3)], [(2 * day, 4), (9 * day, 5), (10 * day, 6)]]
    for rows in batches:
        frame = spark.createDataFrame([("m", None, t, s) for t, s in rows], schema).coalesce(1)
        frame.write.mode("append").parquet(folder)
        pages = parquet_rows(spark, folder, frame.schema)
        jobs.start_unique_visitor(pages, root).awaitTermination()
    got = rows_of(spark.read.parquet(f"{root}/dwd_traffic_unique_visitor_detail"), "ts", "seq")
    assert got == [(2 * day, 4), (9 * day + 3, 2), (10 * day, 6)]
    with pytest.raises(ValueError):
        processors.unique_visitor_stream(frame, keep_days=0)


def test_unique_visitor_over_restarts(spark, page_text):
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    feed(
        page_text,
        folder,
        lambda: jobs.start_unique_visitor(parquet_rows(spark, folder, page_text.schema), root),
    )
    got = rows_of(spark.read.parquet(f"{root}/dwd_traffic_unique_visitor_detail"), "mid", "dt")
    assert got == rows_of(visits.unique_visitor(page_text), "mid", "dt")


@pytest.mark.parametrize("held", [processors.HELD_ROWS, 2])
def test_first_of_task(spark, monkeypatch, held):
    monkeypatch.setattr(processors, "HELD_ROWS", held)
    rows = [("hot", i % 3, i * 7919 % 1000, i % 11, None) for i in range(2000)] + [(f"m{i}", 0, 5, i, "x") for i in range(40)]
    frame = spark.createDataFrame(rows, "mid string, day int, ts bigint, seq bigint, last_page_id string").coalesce(2)
    got = [tuple(r) for r in processors.first_of_task(frame, ["mid", "day"]).collect()]
    least = {}
    for row in rows:
        least[row[:2]] = min(row[2:4], least.get(row[:2], row[2:4]))
    assert {k: min(r[2:4] for r in got if r[:2] == k) for k in least} == least
    if held > 2:
        assert len(got) <= 40 + 2 * 3
    assert processors.first_of_task(frame.limit(0), ["mid"]).collect() == []


def test_one_device_has_nearly_all_rows(spark):
    """Rows that claim nothing go by the state; flags and visitors are those of the batch form."""
    text = bindings.log_text(spark, SF)
    hot = F.regexp_replace("value", '"mid":"[0-8][^"]*"', '"mid":"hot"').alias("value")
    text = text.select(F.when(F.col("seq") % 10 > 0, hot).otherwise(F.col("value")).alias("value"), "seq")
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    feed(text, folder, lambda: jobs.start_log_split(parquet_rows(spark, folder, text.schema), root))
    batch = traffic.log_outputs(text)
    tables = jobs.log_tables(root)
    for name in ("page", "error"):
        got = rows_of(spark.read.parquet(tables[name]), "mid", "is_new", "seq")
        assert got == rows_of(batch[name], "mid", "is_new", "seq"), name
    pages = bindings.page_views(spark, SF).withColumn("mid", F.lit("hot"))
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    feed(pages, folder, lambda: jobs.start_unique_visitor(parquet_rows(spark, folder, pages.schema), root))
    got = rows_of(spark.read.parquet(f"{root}/dwd_traffic_unique_visitor_detail"), "mid", "dt", "ts")
    assert got == rows_of(visits.unique_visitor(pages), "mid", "dt", "ts")


def test_day_visit_with_expiring_state(spark, page_text):
    processors.use_rocksdb(spark)
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")

    def start():
        pages = parquet_rows(spark, folder, page_text.schema)
        rows = processors.day_visit_stream(pages)
        # Expiry by the clock keeps an availableNow query running for ever.
        return stream_files(rows, f"{root}/out", f"{root}/ck").trigger(once=True).start()

    feed(page_text, folder, start)
    got = rows_of(spark.read.parquet(f"{root}/out"), "mid", "dt", "ts", "seq")
    assert got == rows_of(visits.unique_visitor(page_text), "mid", "dt", "ts", "seq")


def test_log_split_over_restarts(spark):
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    text = bindings.log_text(spark, SF)

    def start():
        return jobs.start_log_split(parquet_rows(spark, folder, text.schema), root)

    feed(text, folder, start)
    batch = traffic.log_outputs(text)
    tables = jobs.log_tables(root)
    for name in ("page", "start", "display", "action", "error"):
        got = rows_of(spark.read.parquet(tables[name]), "mid", "is_new", "seq")
        assert got == rows_of(batch[name], "mid", "is_new", "seq"), name
    # Downstream, the page table is itself a source.
    pages = spark.read.parquet(tables["page"])
    assert rows_of(visits.unique_visitor(pages), "seq") == rows_of(
        visits.unique_visitor(batch["page"]), "seq"
    )


def test_text_files_as_source(spark):
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    bindings.log_text(spark, SF).select("value").write.text(folder)
    jobs.start_dirty(file_text(spark, folder), root).awaitTermination()
    got = spark.read.parquet(jobs.log_tables(root)["dirty"]).count()
    assert got == traffic.clean_log(bindings.log_text(spark, SF))[1].count()


def test_jobs_take_a_sink(spark):
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    bindings.log_text(spark, SF).select("value").write.text(folder)
    names = []

    def sink(rows, name, checkpoint):
        names.append(name)
        return stream_files(as_topic(rows, name), f"{root}/elsewhere", checkpoint)

    jobs.start_dirty(file_text(spark, folder), root, sink=sink).awaitTermination()
    rows = spark.read.parquet(f"{root}/elsewhere")
    assert names == [schemas.LOG_TOPICS["dirty"]] == [r.topic for r in rows.select("topic").distinct().collect()]
    writer = to_topics("host:9092")(file_text(spark, folder), "topic", f"{root}/ck")
    assert hasattr(writer, "trigger")


def test_envelope_schema_reads_back(spark):
    everything = bindings.as_envelopes(bindings.order_changes(spark, SF)["order_info"])
    assert [f.name for f in everything.schema] == [f.name for f in schemas.CDC_ENVELOPE]
