"""The registered queries: each dataflow bound to the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillhouse import bindings, schemas
from rillhouse.functions import dates
from rillhouse.operators import dimensions, routing, visits
from rillhouse.operators.latest import latest_by_key, latest_of_topic
from rillhouse.operators.skew import estimated_bytes, find_hot_keys, lookup_join, skew_join, split_finely
from rillhouse.oracle import HORIZON_DAYS, LATE_MS, WITHIN_MS
from rillhouse.plans import trade, traffic
from rillhouse.sinks.tables import current_dimension, current_dimensions, dimension_changes
from rillhouse.sinks.topics import as_topic, start_table, stream_files
from rillhouse.sources.records import cdc_envelope, config_changes, split_cdc, split_config, topic_rows
from rillhouse.sources.streams import parquet_rows
from rillhouse.streaming import jobs
from rillhouse.streaming import trade as trade_jobs
from rillhouse.streaming.progress import dropped_rows
from rillhouse.workspace import new_folder, tidied

Query = Callable[[SparkSession, str], DataFrame]

# Columns that settle which of several rows of one moment counts as the newest.
ORDER_TIES = ("type", "order_status", "user_id")
PAY_TIES = ("callback_time", "payment_type_code", "user_id")

_QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    """Register a query under its function name, run under UTC."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    _QUERIES[fn.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- trade ----------------------------------------------------------------------


def _pre_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    split_finely(spark, bindings.table(spark, sf_dir, "lineitem"))
    return trade.order_pre_process(
        bindings.order_changes(spark, sf_dir), bindings.base_dic(spark)
    )


def _paid(spark: SparkSession, sf_dir: str, success_only: bool) -> DataFrame:
    split_finely(spark, bindings.table(spark, sf_dir, "lineitem"))
    cdc, dic = bindings.order_changes(spark, sf_dir), bindings.base_dic(spark)
    placed = trade.order_detail(trade.order_pre_process(cdc, dic))
    return trade.pay_detail(cdc, placed, dic, success_only).drop("row_op_ts")


@_query
def trade_order_pre_process(spark, sf_dir):
    rows = _pre_process(spark, sf_dir).drop("row_op_ts")
    return rows.withColumn("old", F.to_json("old"))


@_query
def trade_order_pre_process_latest(spark, sf_dir):
    rows = trade_order_pre_process(spark, sf_dir).withColumn("_v", F.col("oi_ts").cast("bigint"))
    return latest_by_key(rows, ["id"], ["_v", *ORDER_TIES]).drop("_v")


@_query
def trade_order_detail(spark, sf_dir):
    return trade.order_detail(_pre_process(spark, sf_dir)).drop("row_op_ts")


@_query
def trade_cancel_detail(spark, sf_dir):
    return trade.cancel_detail(_pre_process(spark, sf_dir)).drop("row_op_ts")


@_query
def trade_pay_detail_all(spark, sf_dir):
    return _paid(spark, sf_dir, success_only=False)


@_query
def trade_pay_detail_success(spark, sf_dir):
    return _paid(spark, sf_dir, success_only=True)


@_query
def trade_pay_detail_latest(spark, sf_dir):
    rows = _paid(spark, sf_dir, success_only=False).withColumn("_v", F.col("ts").cast("bigint"))
    return latest_by_key(rows, ["order_detail_id"], ["_v", *PAY_TIES]).drop("_v")


@_query
def trade_cart_add(spark, sf_dir):
    return trade.cart_add(bindings.cart_log(spark, sf_dir), bindings.base_dic(spark))


@_query
def trade_cart_add_latest(spark, sf_dir):
    rows = trade_cart_add(spark, sf_dir).withColumn("_v", F.col("ts").cast("bigint"))
    return latest_by_key(rows, ["id"], ["_v"]).drop("_v")


# --- change records and dimensions ------------------------------------------------


@_query
def cdc_filter_markers(spark, sf_dir):
    usable, _ = split_cdc(cdc_envelope(bindings.cdc_text(spark, sf_dir)))
    data = F.col("data")
    return usable.select(
        "database", "table", "type", data["id"].alias("id"), data["name"].alias("name"), "ts", "seq"
    )


@_query
def cdc_dirty_split(spark, sf_dir):
    _, dirty = split_cdc(cdc_envelope(bindings.cdc_text(spark, sf_dir)))
    return dirty


@_query
def dim_config_latest(spark, sf_dir):
    return dimensions.latest_config(config_changes(bindings.config_text(spark, sf_dir)))


@_query
def dim_ddl(spark, sf_dir):
    config = dimensions.with_defaults(dim_config_latest(spark, sf_dir))
    return config.select("source_table", dimensions.create_table_text().alias("ddl"))


@_query
def dim_whitelist(spark, sf_dir):
    kept = dimensions.keep_columns(F.col("data"), F.col("sink_columns"))
    return bindings.wide_payloads(spark, sf_dir).select("event_id", F.to_json(kept).alias("data"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = dimensions.latest_config(bindings.dimension_config(spark))
    return dimensions.route_dimensions(bindings.dimension_changes(spark, sf_dir), config)


@_query
def dim_routed_rows(spark, sf_dir):
    return _routed(spark, sf_dir).select(
        F.col("table").alias("source_table"), "sink_table", "type", "ts", F.to_json("data").alias("data")
    )


@_query
def dim_routed_as_of(spark, sf_dir):
    """Records routed by the configuration of their own time; it changes all along."""
    history = dimensions.config_history(bindings.config_log(spark, sf_dir))
    changes = bindings.routed_history(spark, sf_dir)
    return dimensions.route_dimensions_as_of(changes, history, F.col("ts")).select(
        F.col("table").alias("source_table"), "sink_table", "ts", F.to_json("data").alias("data")
    )


@_query
def upsert_topic_latest(spark, sf_dir):
    newest = latest_of_topic(bindings.customer_topic(spark, sf_dir))
    rows, _ = topic_rows(newest, schemas.text_struct("c_custkey", "c_nationkey", "c_mktsegment"))
    return rows.drop("partition", "seq")


def _customers(spark: SparkSession, sf_dir: str, apply_deletes: bool) -> DataFrame:
    columns = ["c_custkey", "c_nationkey", "c_mktsegment"]
    rows = dimensions.dimension_rows(_routed(spark, sf_dir), "dim_customer", columns)
    rows = rows.withColumn("ts", F.col("ts").cast("bigint"))
    return current_dimension(rows, ["c_custkey"], ["ts"], apply_deletes).select(*columns)


@_query
def dim_upsert_latest(spark, sf_dir):
    return _customers(spark, sf_dir, apply_deletes=False)


@_query
def dim_upsert_deletes(spark, sf_dir):
    return _customers(spark, sf_dir, apply_deletes=True)


# --- traffic --------------------------------------------------------------------


def _outputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return traffic.log_outputs(bindings.log_text(spark, sf_dir))


@_query
def log_page(spark, sf_dir):
    rows = routing.as_json(_outputs(spark, sf_dir)["page"])
    return rows.select("mid", "is_new", "last_page_id", "ts", "seq", "value")


@_query
def log_start(spark, sf_dir):
    rows = routing.as_json(_outputs(spark, sf_dir)["start"])
    return rows.select("mid", "is_new", "ts", "seq", "value")


@_query
def log_display(spark, sf_dir):
    rows = routing.as_json(_outputs(spark, sf_dir)["display"])
    item = F.variant_get("display", "$.item", "string").alias("item")
    return rows.select("mid", "is_new", "ts", "seq", item, "value")


@_query
def log_action(spark, sf_dir):
    rows = routing.as_json(_outputs(spark, sf_dir)["action"])
    item = F.variant_get("action", "$.item", "string").alias("item")
    return rows.select("mid", "is_new", "ts", "seq", item, "value")


@_query
def log_error(spark, sf_dir):
    rows = routing.as_json(_outputs(spark, sf_dir)["error"])
    return rows.select("mid", "is_new", "ts", "seq", "value")


@_query
def log_dirty(spark, sf_dir):
    return traffic.clean_log(bindings.log_text(spark, sf_dir))[1]


@_query
def log_is_new_fixed(spark, sf_dir):
    log, _ = traffic.clean_log(bindings.log_text(spark, sf_dir))
    return visits.fix_is_new(log).select("mid", "is_new", "ts", "seq")


@_query
def traffic_unique_visitor(spark, sf_dir):
    return visits.unique_visitor(bindings.page_views(spark, sf_dir))


def _log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rows of the log split; the flag is not needed downstream."""
    log, _ = traffic.clean_log(bindings.log_text(spark, sf_dir))
    return routing.page_rows(log).select("mid", "last_page_id", "ts", "seq")


@_query
def traffic_unique_visitor_from_log(spark, sf_dir):
    return visits.unique_visitor(_log_pages(spark, sf_dir))


@_query
def traffic_user_jump(spark, sf_dir):
    return visits.user_jump(bindings.page_views(spark, sf_dir), WITHIN_MS)


@_query
def traffic_user_jump_match(spark, sf_dir):
    return visits.user_jump(bindings.page_views(spark, sf_dir), WITHIN_MS, "match")


@_query
def traffic_user_jump_timeout(spark, sf_dir):
    return visits.user_jump(bindings.page_views(spark, sf_dir), WITHIN_MS, "timeout")


@_query
def traffic_user_jump_from_log(spark, sf_dir):
    return visits.user_jump(_log_pages(spark, sf_dir), WITHIN_MS)


@_query
def date_util(spark, sf_dir):
    ms = F.col("ms")
    rows = bindings.events(spark, sf_dir).select(
        "event_id",
        dates.day_of_millis(ms).alias("day"),
        dates.second_of_millis(ms).alias("second"),
        dates.day_of_millis(ms, "+08:00").alias("day_east8"),
    )
    return rows.withColumns(
        {
            "day_ms": dates.millis_of_text(F.col("day")),
            "second_ms": dates.millis_of_text(F.col("second"), full=True),
        }
    )


# --- streaming --------------------------------------------------------------------
#
# Each runs a job over the tables as streams until everything is worked off, and
# returns the table it wrote.


@_query
def stream_cart_add(spark, sf_dir):
    root = new_folder(spark, "cart")
    rows = trade.cart_add(bindings.cart_log(spark, sf_dir, stream=True), bindings.base_dic(spark))
    writer = stream_files(rows, f"{root}/dwd_trade_cart_add", f"{root}/checkpoint")
    writer.trigger(**jobs.NOW).start().awaitTermination()
    return spark.read.parquet(f"{root}/dwd_trade_cart_add")


@_query
def stream_log_split(spark, sf_dir):
    root = new_folder(spark, "log")
    raw = bindings.log_text(spark, sf_dir, stream=True)
    running = [jobs.start_dirty(raw, root), jobs.start_log_split(raw, root)]
    for query in running:
        query.awaitTermination()
    tables = jobs.log_tables(root)
    dirty = spark.read.parquet(tables["dirty"]).withColumns(
        {c: F.lit(None).cast("string") for c in ("mid", "is_new")}
    )
    rows = dirty.select(F.lit("dirty").alias("output"), "mid", "is_new", "seq", "value")
    for name in ("page", "start", "display", "action", "error"):
        part = spark.read.parquet(tables[name])
        rows = rows.unionAll(part.select(F.lit(name), "mid", "is_new", "seq", "value"))
    return rows


@_query
def stream_unique_visitor(spark, sf_dir):
    root = new_folder(spark, "visitor")
    jobs.start_unique_visitor(
        bindings.page_views(spark, sf_dir, stream=True), root
    ).awaitTermination()
    return spark.read.parquet(f"{root}/dwd_traffic_unique_visitor_detail")


@_query
def stream_day_visit(spark, sf_dir):
    """First visits of each day by the job whose state expires."""
    root = new_folder(spark, "day-visit")
    pages = bindings.page_views(spark, sf_dir, stream=True).withColumn("value", F.col("last_page_id"))
    jobs.start_day_visit(pages, root).awaitTermination()
    return spark.read.parquet(f"{root}/dwd_traffic_day_visit").drop("value")


@_query
def stream_user_jump_closed(spark, sf_dir):
    """Pages arrive in several files and micro-batches, some of them late."""
    root = new_folder(spark, "jump")
    folder = f"{root}/pages"
    for part in bindings.page_arrivals(spark, sf_dir):
        rows = part.withColumn("value", F.to_json(F.struct("mid", "ts")))
        rows.write.mode("append").parquet(folder)
        pages = parquet_rows(spark, folder, rows.schema)
        delay = f"{bindings.LAG_MS} milliseconds"
        jobs.start_user_jump(pages, root, WITHIN_MS, delay=delay).awaitTermination()
    return spark.read.parquet(f"{root}/dwd_traffic_user_jump_detail").select("mid", "ts", "seq")


@_query
def stream_late_rows(spark, sf_dir):
    """Pages per arrival, and those that the watermark dropped as too late."""
    root = new_folder(spark, "late")
    folder, counts = f"{root}/pages", []
    for i, part in enumerate(bindings.page_arrivals(spark, sf_dir)):
        rows = part.withColumn("value", F.to_json(F.struct("mid", "ts")))
        rows.write.mode("append").parquet(folder)
        pages = parquet_rows(spark, folder, rows.schema)
        query = jobs.start_user_jump(pages, root, WITHIN_MS, delay=f"{LATE_MS} milliseconds")
        query.awaitTermination()
        taken = sum(p.numInputRows for p in query.recentProgress)
        counts.append((i, taken, dropped_rows(query)))
    return spark.createDataFrame(counts, "arrival int, pages long, dropped long")


#: Micro-batches in which the registered trade jobs take in their change log.
ARRIVALS = 6


#: Bytes of order lines on disk for each file in which an arrival brings them.
FILE_BYTES = 32 << 20


def _files(spark: SparkSession, sf_dir: str) -> int:
    """Files a table and arrival, so that neither writing nor reading one is left to a single task."""
    return 1 + estimated_bytes(bindings.table(spark, sf_dir, "lineitem")) // (FILE_BYTES * ARRIVALS)


def _append(root: str, changes: dict[str, DataFrame], files: int) -> None:
    """Append change records to the folders of their tables, in exactly so many files each.

    A table of few rows is made up with empty files: the next micro-batches count them.
    """

    def append(rows: DataFrame, folder: str) -> None:
        spark, path = rows.sparkSession, f"{root}/topic_db/{folder}"
        rows.repartition(files).write.mode("append").parquet(path, compression="zstd")
        found = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
        for _ in range(-found % files):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)

    writes = [partial(append, bindings.as_envelopes(rows), name) for name, rows in changes.items()]
    with tidied(next(iter(changes.values())).sparkSession):
        jobs.together(*writes)


def _topic(spark: SparkSession, root: str, names: Iterable[str], files: int) -> dict[str, DataFrame]:
    """One stream a source table, of so many files a micro-batch."""
    return {
        name: parquet_rows(spark, f"{root}/topic_db/{name}", schemas.CDC_ENVELOPE, files_per_batch=files)
        for name in names
    }


def _table(spark: SparkSession, root: str, name: str, columns: list[str], stream: bool = False) -> DataFrame:
    return parquet_rows(spark, f"{root}/{name}", schemas.table_schema(columns), stream)


def _order_job(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, DataFrame]]:
    """Folder of the tables, and change log, of a finished order job; records arrive in no order."""
    root = new_folder(spark, "trade")
    log = bindings.order_changes(spark, sf_dir)
    files = _files(spark, sf_dir)
    _append(root, log, ARRIVALS * files)
    cdc = _topic(spark, root, log, files)
    trade_jobs.start_order_pre_process(cdc, root, bindings.base_dic(spark)).awaitTermination()
    return root, cdc


def _order_stream(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "dwd_trade_order_pre_process", schemas.ORDER_PRE_PROCESS, stream=True)


@_query
def stream_order_pre_process_latest(spark, sf_dir):
    root, _ = _order_job(spark, sf_dir)
    rows = _table(spark, root, "dwd_trade_order_pre_process", schemas.ORDER_PRE_PROCESS)
    rows = rows.withColumns({"_v": F.col("oi_ts").cast("bigint"), "_p": trade_jobs.most_promoted()})
    newest = latest_by_key(rows, ["id"], ["_v", *ORDER_TIES, "_p"])
    return newest.withColumn("old", F.to_json("old")).drop("_v", "_p", "row_op_ts")


def _most_promoted(rows: DataFrame) -> DataFrame:
    newest = latest_by_key(rows.withColumn("_p", trade_jobs.most_promoted()), ["id"], ["_p"])
    return newest.drop("_p", "row_op_ts")


@_query
def stream_order_detail_latest(spark, sf_dir):
    root, _ = _order_job(spark, sf_dir)
    trade_jobs.start_order_detail(_order_stream(spark, root), root).awaitTermination()
    return _most_promoted(_table(spark, root, "dwd_trade_order_detail", schemas.ORDER_DETAIL))


@_query
def stream_cancel_detail_latest(spark, sf_dir):
    root, _ = _order_job(spark, sf_dir)
    trade_jobs.start_cancel_detail(_order_stream(spark, root), root).awaitTermination()
    return _most_promoted(_table(spark, root, "dwd_trade_cancel_detail", schemas.CANCEL_DETAIL))


@_query
def stream_pay_detail_latest(spark, sf_dir):
    root, cdc = _order_job(spark, sf_dir)
    trade_jobs.start_order_detail(_order_stream(spark, root), root).awaitTermination()
    placed = _table(spark, root, "dwd_trade_order_detail", schemas.ORDER_DETAIL, stream=True)
    trade_jobs.start_pay_detail(cdc, placed, root, bindings.base_dic(spark)).awaitTermination()
    rows = _table(spark, root, "dwd_trade_pay_detail_suc", schemas.PAY_DETAIL)
    rows = rows.withColumns({"_v": F.col("ts").cast("bigint"), "_p": trade_jobs.most_promoted()})
    newest = latest_by_key(rows, ["order_detail_id"], ["_v", *PAY_TIES, "_p"])
    return newest.drop("_v", "_p", "row_op_ts")


@_query
def stream_order_detail_from_topic(spark, sf_dir):
    """Placed lines from the JSON text of the order topic, which has malformed records."""
    root = new_folder(spark, "topic")
    rows = _pre_process(spark, sf_dir)
    text = as_topic(rows, "dwd_trade_order_pre_process").select("value")
    number = F.pmod(F.xxhash64("value"), F.lit(5))
    broken = text.where(number == 0).select(F.expr("left(value, length(value) - 1)").alias("value"))
    text.unionAll(broken).unionAll(spark.range(1).select(F.lit("[1]"))).write.parquet(f"{root}/topic")
    stream = parquet_rows(spark, f"{root}/topic", schemas.text_struct("value"))
    usable, dirty = topic_rows(stream, schemas.table_schema(schemas.ORDER_PRE_PROCESS))
    start_table(dirty, "dirty_data", root, jobs.NOW).awaitTermination()
    trade_jobs.start_order_detail(usable, root).awaitTermination()
    placed = _table(spark, root, "dwd_trade_order_detail", schemas.ORDER_DETAIL)
    return placed.drop("row_op_ts")


def _horizon_root(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, DataFrame]]:
    """Folder and change log of a finished order job whose rows meet within the horizon only."""
    root = new_folder(spark, "horizon")
    log = bindings.horizon_changes(spark, sf_dir)
    # A last record a table, far ahead, lets the watermark pass all rows.
    files = _files(spark, sf_dir)
    for changes in [*bindings.by_time(log, ARRIVALS), bindings.heartbeats(spark, log, 4_000_000_000)]:
        _append(root, changes, files)
    cdc = _topic(spark, root, log, files)
    trade_jobs.start_order_pre_process(
        cdc, root, bindings.base_dic(spark), join_horizon=f"{HORIZON_DAYS} days"
    ).awaitTermination()
    return root, cdc


@_query
def stream_order_horizon(spark, sf_dir):
    """Order lines and what lies within a horizon of their time, from joins whose state is bounded."""
    root, _ = _horizon_root(spark, sf_dir)
    rows = _table(spark, root, "dwd_trade_order_pre_process", schemas.ORDER_PRE_PROCESS)
    return rows.withColumn("old", F.to_json("old")).drop("row_op_ts")


@_query
def stream_pay_horizon(spark, sf_dir):
    """Payments of placed lines within the horizon, the second join of the chain."""
    root, cdc = _horizon_root(spark, sf_dir)
    trade_jobs.start_order_detail(_order_stream(spark, root), root).awaitTermination()
    placed = _table(spark, root, "dwd_trade_order_detail", schemas.ORDER_DETAIL, stream=True)
    # Placed lines leave their job out of event-time order, by up to the whole span of the data.
    mode = {"join_horizon": f"{HORIZON_DAYS} days", "delay": "10000 days"}
    trade_jobs.start_pay_detail(cdc, placed, root, bindings.base_dic(spark), **mode).awaitTermination()
    return _table(spark, root, "dwd_trade_pay_detail_suc", schemas.PAY_DETAIL).drop("row_op_ts")


#: Rows of a file of change text: one that a single task has written is read by several.
ROWS_PER_FILE = 50_000


def _append_text(text: DataFrame, path: str) -> None:
    """Append change text in files of few rows."""
    text.write.option("maxRecordsPerFile", ROWS_PER_FILE).mode("append").parquet(path)


@_query
def stream_dim_upsert(spark, sf_dir):
    """All dimension tables; the configuration of one changes between two batches."""
    root = new_folder(spark, "dim")
    changes = bindings.dimension_changes(spark, sf_dir)
    text = changes.select("ts", F.to_json(F.struct(*changes.columns)).alias("value"))
    config = dimensions.latest_config(bindings.dimension_config(spark))
    narrow = F.when(F.col("sink_table") == "dim_customer", "c_custkey,c_mktsegment")
    early = config.withColumn("sink_columns", F.coalesce(narrow, "sink_columns"))
    for first, current in ((True, early), (False, config)):
        part = text.where((F.col("ts") == "1") == first).select("value")
        _append_text(part, f"{root}/topic_db")
        raw = parquet_rows(spark, f"{root}/topic_db", schemas.text_struct("value"))
        job = jobs.DimensionJob(spark, root, lambda c=current: c)
        job.start(cdc_envelope(raw)).awaitTermination()
    now = current_dimensions(dimension_changes(spark, root), config)
    return now.select("sink_table", F.concat_ws(",", "key").alias("key"), F.to_json("data").alias("data"))


@_query
def dim_config_dirty(spark, sf_dir):
    return split_config(bindings.config_text(spark, sf_dir, malformed=True))[1]


@_query
def dim_config_by_time(spark, sf_dir):
    """Changes with coarse times, so that many tie and their place decides."""
    return dimensions.latest_config(config_changes(bindings.config_text(spark, sf_dir, timed=True)))


@_query
def traffic_user_jump_skewed(spark, sf_dir):
    """Half of all pages on one device, which is found and whose time line is cut into slices."""
    pages = bindings.page_views(spark, sf_dir)
    mid = F.when(F.col("seq") % 2 == 0, "hot").otherwise(F.col("mid"))
    return visits.user_jump(pages.withColumn("mid", mid), WITHIN_MS)


@_query
def trade_order_detail_skewed(spark, sf_dir):
    """Half of all lines in one order; the lookup meets a given table without a broadcast."""
    lines = bindings.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "hot").otherwise(F.col("l_orderkey").cast("string")).alias("order"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )
    orders = bindings.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_order"), "o_orderstatus"
    )
    more = spark.range(1).select(F.lit("hot").alias("o_order"), F.lit("H").alias("o_orderstatus"))
    hot = find_hot_keys(lines=(lines, F.col("order")))["lines"]
    joined = skew_join(lines, orders.unionAll(more), ("order", "o_order"), "left", hot)
    parts = bindings.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = lookup_join(joined, parts, ("l_partkey", "p_partkey"), max_bytes=0)
    counted = named.groupBy("order", "o_orderstatus").agg(
        F.count("*").alias("lines"), F.count("p_name").alias("named")
    )
    return counted.withColumnRenamed("order", "order_key").withColumnRenamed("o_orderstatus", "status")
