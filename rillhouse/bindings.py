"""Change logs and client logs derived from the driver's tables.

Every input row takes part. The rules that give rows their role (which line has
a coupon, which event text is malformed) are restated in SQL in ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillhouse import schemas
from rillhouse.operators.skew import lookup_join
from rillhouse.sinks.topics import as_upserts
from rillhouse.sources.streams import parquet_rows


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A table of the driver, as a stream of its files if asked."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not stream:
        return rows
    return parquet_rows(spark, sf_dir, rows.schema, glob=f"{name}.parquet")


def base_dic(spark: SparkSession) -> DataFrame:
    """The code dictionary; codes such as R and 5-LOW are missing on purpose."""
    names = {"A": "search", "N": "promotion", "1-URGENT": "wallet", "2-HIGH": "card"}
    values = F.array(*(F.struct(F.lit(code), F.lit(name)) for code, name in names.items()))
    rows = spark.range(1).select(F.inline(values).alias("dic_code", "dic_name"))
    absent = {f.name: F.lit(None).cast(f.dataType) for f in schemas.BASE_DIC.fields[2:]}
    return rows.withColumns(absent)


def _payload(**values: Column) -> Column:
    """A payload map with every value as text."""
    return F.create_map(
        *[part for k, v in values.items() for part in (F.lit(k), v.cast("string"))]
    )


def _typed(**values: Column) -> Column:
    """A payload struct with every value as text."""
    return F.struct(*[v.cast("string").alias(k) for k, v in values.items()])


def _envelope(rows: DataFrame, name: str, kind: Column, data: Column, old: Column, ts: Column):
    return rows.select(
        F.lit("shop").alias("database"),
        F.lit(name).alias("table"),
        kind.alias("type"),
        data.alias("data"),
        old.alias("old"),
        ts.cast("string").alias("ts"),
    )


def _no_map() -> Column:
    return F.lit(None).cast("map<string,string>")


def _day(stamp: str) -> Column:
    return F.col(stamp).cast("date")


def _seconds(stamp: str) -> Column:
    """Epoch seconds of a midnight timestamp."""
    return F.unix_date(_day(stamp)).cast("bigint") * 86400


def _money(name: str) -> Column:
    return F.col(name).cast("decimal(16,2)")


def _with_id(lines: DataFrame) -> DataFrame:
    cents = (_money("l_extendedprice") * 100).cast("bigint")
    line_id = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, _day("l_shipdate")
    )
    return lines.withColumn("line_id", line_id)


def order_changes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Change log of orders, their lines and promotions, and payments, by table."""
    insert, update = F.lit("insert"), F.lit("update")
    raw = table(spark, sf_dir, "lineitem")
    lines = _with_id(raw)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")

    details = _envelope(
        _with_id(lookup_join(raw, parts, ("l_partkey", "p_partkey"))),
        "order_detail",
        insert,
        _typed(
            id=F.col("line_id"),
            order_id=F.col("l_orderkey"),
            sku_id=F.col("l_partkey"),
            sku_name=F.col("p_name"),
            create_time=F.col("l_shipdate"),
            source_id=F.col("l_suppkey"),
            source_type=F.col("l_returnflag"),
            sku_num=F.floor("l_quantity"),
            order_price=_money("l_extendedprice"),
            split_total_amount=_money("l_extendedprice"),
            split_activity_amount=_money("l_discount"),
            split_coupon_amount=_money("l_tax"),
        ),
        _no_map(),
        _seconds("l_shipdate"),
    )

    def order_info(time: Column, state: Column) -> Column:
        return _typed(
            id=F.col("o_orderkey"),
            user_id=F.col("o_custkey"),
            province_id=F.col("o_custkey") % 25,
            operate_time=time,
            order_status=state,
        )

    placed = _envelope(
        orders,
        "order_info",
        insert,
        order_info(F.lit(None), F.lit("1001")),
        _no_map(),
        _seconds("o_orderdate"),
    )
    was = F.when(status.isin("F", "P"), _payload(order_status=F.lit("1001"))).otherwise(
        _payload(total_amount=F.lit("0"))
    )
    changed = _envelope(
        orders.where(status.isin("F", "P") | (F.col("o_orderkey") % 2 == 0)),
        "order_info",
        update,
        order_info(F.col("o_orderdate"), F.when(status == "F", "1002").otherwise("1003")),
        was,
        _seconds("o_orderdate") + 3600,
    )
    activities = _envelope(
        lines.where("l_discount >= 0.05"),
        "order_detail_activity",
        insert,
        _typed(
            order_detail_id=F.col("line_id"),
            activity_id=F.col("l_suppkey") % 5,
            activity_rule_id=F.col("l_suppkey") % 7,
        ),
        _no_map(),
        _seconds("l_shipdate"),
    )
    coupons = _envelope(
        lines.where("l_tax >= 0.04"),
        "order_detail_coupon",
        insert,
        _typed(order_detail_id=F.col("line_id"), coupon_id=F.col("l_partkey") % 11),
        _no_map(),
        _seconds("l_shipdate"),
    )

    def payment(time: Column, state: str) -> Column:
        return _typed(
            user_id=F.col("o_custkey"),
            order_id=F.col("o_orderkey"),
            payment_type=F.col("o_orderpriority"),
            callback_time=time,
            payment_status=F.lit(state),
        )

    asked = _envelope(
        orders.where(status.isin("F", "P")),
        "payment_info",
        insert,
        payment(F.lit(None), "1601"),
        _no_map(),
        _seconds("o_orderdate"),
    )
    paid = _envelope(
        orders.where(status == "F"),
        "payment_info",
        update,
        payment(F.col("o_orderdate"), "1602"),
        _payload(payment_status=F.lit("1601")),
        _seconds("o_orderdate") + 7200,
    )
    return {
        "order_detail": details,
        "order_info": placed.unionAll(changed),
        "order_detail_activity": activities,
        "order_detail_coupon": coupons,
        "payment_info": asked.unionAll(paid),
    }


#: How much later than its line each coupon of ``horizon_changes`` comes, per coupon number.
COUPON_LAG_DAYS = 60


def horizon_changes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The order change log with coupons that come later than their lines, some very late."""
    log = order_changes(spark, sf_dir)
    late = F.col("data")["coupon_id"].cast("bigint") * (COUPON_LAG_DAYS * 86400)
    coupons = log["order_detail_coupon"]
    ts = (F.col("ts").cast("bigint") + late).cast("string")
    return log | {"order_detail_coupon": coupons.withColumn("ts", ts)}


def by_time(log: dict[str, DataFrame], parts: int) -> list[dict[str, DataFrame]]:
    """A change log in parts that follow one another in event time, which all tables share."""
    at, spans = F.col("ts").cast("bigint"), None
    for rows in log.values():
        span = rows.agg(F.min(at).alias("low"), F.max(at).alias("high"))
        spans = span if spans is None else spans.unionAll(span)
    low, high = spans.agg(F.min("low"), F.max("high")).first()
    low, high = low or 0, (high or 0) + 1
    part = F.floor((at - low) * parts / F.lit(high - low))
    return [{name: rows.where(part == i) for name, rows in log.items()} for i in range(parts)]


def heartbeats(spark: SparkSession, log: dict[str, DataFrame], ts: int) -> dict[str, DataFrame]:
    """One record a table that meets no other: it moves the event time on."""
    rows = {}
    for name, changes in log.items():
        texts = {f: F.lit(f"{name}-heartbeat") for f in changes.schema["data"].dataType.names}
        rows[name] = _envelope(spark.range(1), name, F.lit("insert"), _typed(**texts), _no_map(), F.lit(ts))
    return rows


def as_envelopes(changes: DataFrame) -> DataFrame:
    """Change records with their typed payload turned into a text map."""
    names = changes.schema["data"].dataType.names
    return changes.withColumn("data", _payload(**{n: F.col("data")[n] for n in names}))


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Events with their time in epoch milliseconds."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    millis = F.timestamp_diff("MILLISECOND", epoch, F.col("ts"))
    return table(spark, sf_dir, "events", stream).withColumn("ms", millis)


def cart_log(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Change log of shopping carts, from events."""
    kind = F.col("event_type")
    num = F.floor("value")
    malformed = kind == "error"
    before = (
        F.when(kind == "view", F.floor(F.col("value") / 2).cast("string"))
        .when(kind == "purchase", (num + 1).cast("string"))
        .when(malformed, "1")
    )
    return _envelope(
        events(spark, sf_dir, stream),
        "cart_info",
        F.when(kind == "click", "insert").otherwise("update"),
        _payload(
            id=F.concat_ws("-", "user_id", F.col("event_id") % 20),
            user_id=F.col("user_id"),
            sku_id=F.col("event_id") % 20,
            source_id=F.col("event_id") % 7,
            source_type=F.element_at(
                F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("event_id") % 3 + 1).cast("int")
            ),
            sku_num=F.when(malformed, "x").otherwise(num.cast("string")),
        ),
        F.when(~kind.isin("click", "signup"), _payload(sku_num=before)),
        F.col("event_id"),
    )


def _text_of(value: Column) -> Column:
    return F.to_json(value)


def cdc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-record text from events, with markers and malformed records."""
    n = F.col("event_id")
    good = _text_of(
        F.struct(
            F.lit("shop").alias("database"),
            F.lit("events").alias("table"),
            F.when(n % 50 == 0, "bootstrap-start").otherwise("insert").alias("type"),
            F.struct(n.alias("id"), F.col("event_type").alias("name")).alias("data"),
            F.col("ms").alias("ts"),
        )
    )
    value = (
        F.when(n % 97 == 0, F.concat(F.lit('{"table":"events","type":"insert","data":{"id":'), n))
        .when(n % 101 == 0, F.lit("[1]"))
        .when(n % 103 == 0, F.lit('{"table":"events","type":"insert","data":[1]}'))
        .otherwise(good)
    )
    return events(spark, sf_dir).select(value.alias("value"), n.alias("seq"))


def log_text(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Client log text from events, with malformed records."""
    n, kind = F.col("event_id"), F.col("event_type")

    def objects(count: Column, key: str) -> Column:
        steps = F.sequence(F.lit(1), count.cast("int"))
        return F.when(
            count > 0, F.transform(steps, lambda i: F.struct(F.concat(F.lit(key), i).alias("item")))
        )

    good = _text_of(
        F.struct(
            F.struct(
                F.col("user_id").cast("string").alias("mid"),
                F.when(kind == "signup", "1").otherwise("0").alias("is_new"),
            ).alias("common"),
            F.struct(
                kind.alias("page_id"),
                F.when(~kind.isin("view", "signup"), F.concat(F.lit("p"), n % 10)).alias(
                    "last_page_id"
                ),
            ).alias("page"),
            F.when(n % 10 == 0, F.struct(F.lit("icon").alias("entry"))).alias("start"),
            F.when(kind == "error", F.struct((n % 7).alias("code"))).alias("err"),
            objects(n % 4, "d").alias("displays"),
            objects(n % 3, "a").alias("actions"),
            F.col("ms").alias("ts"),
        )
    )
    value = (
        F.when(n % 97 == 0, F.concat(F.lit('{"common":{"mid":"'), "user_id", F.lit('"')))
        .when(n % 101 == 0, F.lit("[1]"))
        .when(n % 103 == 0, F.concat(F.lit('{"page":{},"ts":'), "ms", F.lit("}")))
        .otherwise(good)
    )
    return events(spark, sf_dir, stream).select(value.alias("value"), n.alias("seq"))


def page_views(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Every event as a page view; views and signups start a visit."""
    kind = F.col("event_type")
    return events(spark, sf_dir, stream).select(
        F.col("user_id").cast("string").alias("mid"),
        F.when(~kind.isin("view", "signup"), F.concat(F.lit("p"), F.col("event_id") % 10)).alias(
            "last_page_id"
        ),
        F.col("ms").alias("ts"),
        F.col("event_id").alias("seq"),
    )


#: How far the late pages of ``page_arrivals`` lag behind their time.
LAG_MS = 3 * 3600 * 1000


def page_arrivals(spark: SparkSession, sf_dir: str, parts: int = 5) -> list[DataFrame]:
    """The page views in the order of arrival, in parts: every seventh lags behind its time."""
    pages = page_views(spark, sf_dir)
    lag = F.when(F.col("seq") % 7 == 0, LAG_MS).otherwise(0)
    span = pages.agg(F.min("ts").alias("low"), (F.max("ts") + LAG_MS + 1).alias("high")).first()
    low, high = span.low or 0, span.high or 1
    part = F.floor((F.col("ts") + lag - low) * parts / F.lit(high - low))
    return [pages.where(part == i) for i in range(parts)]


def dimension_config(spark: SparkSession) -> DataFrame:
    """Configuration change log of the routed tables."""
    rows = [
        # source, sink, columns, key, options, deleted, seq
        ("region", "dim_area", "r_regionkey", "r_regionkey", None, False, 1),
        ("region", "dim_region", "r_regionkey,r_name", "r_regionkey", None, False, 2),
        ("nation", "dim_nation", "id,n_name", None, None, False, 3),
        ("customer", "dim_customer", "c_custkey,c_nationkey,c_mktsegment", "c_custkey", "", False, 4),
        ("supplier", "dim_supplier", "s_suppkey, s_name , s_acctbal", "s_suppkey", None, False, 5),
        ("part", "dim_part", "p_partkey", "p_partkey", None, False, 6),
        ("part", "dim_part", "p_partkey", "p_partkey", None, True, 7),
    ]
    schema = ", ".join(f"{f.name} string" for f in schemas.TABLE_PROCESS.fields)
    return spark.createDataFrame(rows, f"{schema}, deleted boolean, seq bigint")


def dimension_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of the dimension tables; updates and deletes repeat a key."""
    insert = F.lit("insert")
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    part = table(spark, sf_dir, "part")

    def customer_row(segment: Column) -> Column:
        return _payload(
            c_custkey=F.col("c_custkey"),
            c_name=F.col("c_name"),
            c_nationkey=F.col("c_nationkey"),
            c_acctbal=_money("c_acctbal"),
            c_mktsegment=segment,
        )

    segment = F.col("c_mktsegment")
    new_segment = F.concat(segment, F.lit("-2"))
    log = [
        (region, "region", insert, _payload(r_regionkey=F.col("r_regionkey"), r_name=F.col("r_name")), 1),
        (
            nation,
            "nation",
            insert,
            _payload(
                id=F.col("n_nationkey"), n_name=F.col("n_name"), n_regionkey=F.col("n_regionkey")
            ),
            1,
        ),
        (customer, "customer", F.lit("bootstrap-insert"), customer_row(segment), 1),
        (customer.where("c_acctbal < 5000"), "customer", F.lit("update"), customer_row(new_segment), 2),
        (customer.where(segment == "MACHINERY"), "customer", F.lit("delete"), customer_row(segment), 3),
        (
            supplier,
            "supplier",
            insert,
            _payload(
                s_suppkey=F.col("s_suppkey"), s_name=F.col("s_name"), s_acctbal=_money("s_acctbal")
            ),
            1,
        ),
        (part, "part", insert, _payload(p_partkey=F.col("p_partkey"), p_name=F.col("p_name")), 1),
    ]
    changes = None
    for rows, name, kind, data, ts in log:
        own = _envelope(rows, name, kind, data, _no_map(), F.lit(ts))
        changes = own if changes is None else changes.unionAll(own)
    return changes


def config_text(
    spark: SparkSession, sf_dir: str, timed: bool = False, malformed: bool = False
) -> DataFrame:
    """A long configuration change log from events, as text: one source table per user.

    ``timed`` adds the change's time, cut to days; ``malformed`` breaks some records.
    """
    kind = F.col("event_type")
    row = F.struct(
        F.concat(F.lit("src_"), "user_id").alias("source_table"),
        F.concat(F.lit("dim_"), "user_id", F.lit("_"), kind).alias("sink_table"),
        sink_columns_of(kind).alias("sink_columns"),
        F.when(kind != "view", "sku_id").alias("sink_pk"),
        F.when(kind == "click", "COMMENT 'clicked'").alias("sink_extend"),
    )
    removed = kind == "error"
    day = [(F.col("ms") - F.col("ms") % 86_400_000).alias("ts_ms")] if timed else []
    change = F.struct(
        F.when(removed, row).alias("before"), F.when(~removed, row).alias("after"), *day
    )
    value, n = _text_of(change), F.col("event_id")
    if malformed:
        value = (
            F.when(n % 97 == 0, F.concat(F.lit('{"after":{"source_table":"src_'), "user_id"))
            .when(n % 101 == 0, F.lit("[1]"))
            .when(n % 103 == 0, F.lit('{"after":{}}'))
            .otherwise(value)
        )
    return events(spark, sf_dir).select(value.alias("value"), n.alias("seq"))


#: Steps by which the records of ``routed_history`` lie behind their event.
HISTORY_STEP_MS = 6 * 3600 * 1000


def config_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration change log of ``config_text`` with the times of its events."""
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        F.concat(F.lit("src_"), "user_id").alias("source_table"),
        F.concat(F.lit("dim_"), "user_id", F.lit("_"), kind).alias("sink_table"),
        sink_columns_of(kind).alias("sink_columns"),
        F.lit(None).cast("string").alias("sink_pk"),
        F.lit(None).cast("string").alias("sink_extend"),
        (kind == "error").alias("deleted"),
        F.col("ms").alias("ts_ms"),
        F.col("event_id").alias("seq"),
    )


def routed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records of the tables of ``config_log``, some at the time of a change, some later."""
    at = F.col("ms") + F.col("event_id") % 5 * HISTORY_STEP_MS
    rows = _envelope(
        wide_payloads(spark, sf_dir).join(events(spark, sf_dir).select("event_id", "user_id", "ms"), "event_id"),
        "",
        F.lit("update"),
        F.col("data"),
        _no_map(),
        at,
    )
    return rows.withColumn("table", F.concat(F.lit("src_"), F.col("data")["sku_id"]))


def sink_columns_of(kind: Column) -> Column:
    return (
        F.when(kind == "view", "id,name")
        .when(kind == "click", "sku_id, sku_name ")
        .when(kind == "signup", "sku_id,sku_name,price")
        .otherwise("sku_id")
    )


def wide_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads from events next to the columns wanted of them."""
    return events(spark, sf_dir).select(
        F.col("event_id"),
        sink_columns_of(F.col("event_type")).alias("sink_columns"),
        _payload(
            id=F.col("event_id"),
            name=F.col("event_type"),
            sku_id=F.col("user_id"),
            sku_name=F.concat(F.lit("sku-"), "user_id"),
            price=F.floor("value"),
        ).alias("data"),
    )


def customer_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an upsert topic of customers, with deletes, and every third record read twice."""
    changes = dimension_changes(spark, sf_dir).where(F.col("table") == "customer")
    columns = ["c_custkey", "c_nationkey", "c_mktsegment"]
    records = None
    for step in ("1", "2", "3"):
        rows = changes.where(F.col("ts") == step).select("type", *[F.col("data")[c].alias(c) for c in columns])
        some = as_upserts(rows, "dim_customer", columns[:1], columns, F.col("type") == "delete")
        number = F.get_json_object("key", "$.c_custkey").cast("bigint")
        some = some.withColumn("seq", number + int(step) * 100_000_000)
        records = some if records is None else records.unionAll(some)
    records = records.withColumn("partition", F.pmod(F.crc32("key"), F.lit(4)).cast("int"))
    return records.unionAll(records.where("seq % 3 = 0"))
