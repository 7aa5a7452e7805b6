"""Trade dataflows on small hand-made change logs."""

import pytest

from rillhouse import schemas
from rillhouse.functions import dates, values
from rillhouse.operators.latest import latest_by_key
from rillhouse.plans import trade
from pyspark.sql import functions as F


def changes(spark, *rows):
    return spark.createDataFrame(
        [("shop", t, kind, data, old, ts) for t, kind, data, old, ts in rows], schemas.CDC_ENVELOPE
    )


@pytest.fixture
def dic(spark):
    return spark.createDataFrame([("A", "search", None, None, None)], schemas.BASE_DIC)


def cart(kind, num, old=None, source="A"):
    data = {"id": "1", "user_id": "u", "sku_id": "s", "source_id": "q", "source_type": source}
    return ("cart_info", kind, {**data, "sku_num": num}, old, "7")


@pytest.mark.parametrize(
    "row, expected",
    [
        (cart("insert", "3"), "3"),
        (cart("update", "5", {"sku_num": "3"}), "2"),
        (cart("update", "2", {"sku_num": "5"}), None),
        (cart("update", "2", {"other": "5"}), None),
        (cart("update", "2"), None),
        (cart("update", "x", {"sku_num": "1"}), None),
        (cart("delete", "3"), None),
    ],
)
def test_cart_add(spark, dic, row, expected):
    rows = trade.cart_add(changes(spark, row), dic).collect()
    assert [r.sku_num for r in rows] == ([] if expected is None else [expected])


def test_cart_columns_and_unknown_code(spark, dic):
    df = trade.cart_add(changes(spark, cart("insert", "3"), cart("insert", "4", source="?")), dic)
    assert df.columns == schemas.CART_ADD
    names = {r.source_type_code: r.source_type_name for r in df.collect()}
    assert names == {"A": "search", "?": None}


def order(kind, status, old=None, time=None, oid="o1", ts="1"):
    data = {"id": oid, "user_id": "u", "province_id": "p", "operate_time": time}
    return ("order_info", kind, {**data, "order_status": status}, old, ts)


def line(lid="l1", oid="o1", created="2022-01-01 10:11:12"):
    data = {
        "id": lid, "order_id": oid, "sku_id": "s", "sku_name": "n", "create_time": created,
        "source_id": "q", "source_type": "A", "sku_num": "2", "order_price": "10.5",
        "split_total_amount": "21.0", "split_activity_amount": None, "split_coupon_amount": None,
    }
    return ("order_detail", "insert", data, None, "1")


def activity(lid, aid):
    data = {"order_detail_id": lid, "activity_id": aid, "activity_rule_id": f"r{aid}"}
    return ("order_detail_activity", "insert", data, None, "1")


def coupon(lid, cid):
    return ("order_detail_coupon", "insert", {"order_detail_id": lid, "coupon_id": cid}, None, "1")


def test_order_chain(spark, dic):
    log = changes(
        spark,
        line("l1"), line("l2"), line("l3", oid="missing"),
        order("insert", "1001"),
        order("update", "1003", {"order_status": "1001"}, "2022-01-02 00:00:00", ts="2"),
        order("delete", "1003"),
        activity("l1", "a"), coupon("l1", "c"), coupon("l2", "d"),
    )
    pre = trade.order_pre_process(log, dic)
    assert pre.columns == schemas.ORDER_PRE_PROCESS
    assert pre.schema == schemas.table_schema(schemas.ORDER_PRE_PROCESS) or all(
        a.dataType == b.dataType
        for a, b in zip(pre.schema, schemas.table_schema(schemas.ORDER_PRE_PROCESS))
    )
    rows = {(r.id, r.type): r for r in pre.collect()}
    assert set(rows) == {(i, t) for i in ("l1", "l2") for t in ("insert", "update")}
    one = rows["l1", "update"]
    assert (one.activity_id, one.activity_rule_id, one.coupon_id) == ("a", "ra", "c")
    assert (one.date_id, one.operate_date_id) == ("2022-01-01", "2022-01-02")
    assert one.split_original_amount == "21.0000"
    assert rows["l1", "insert"].operate_date_id is None
    assert (rows["l2", "insert"].activity_id, rows["l2", "insert"].coupon_id) == (None, "d")

    detail = trade.order_detail(pre)
    assert detail.columns == schemas.ORDER_DETAIL and detail.count() == 2
    cancel = trade.cancel_detail(pre)
    assert cancel.columns == schemas.CANCEL_DETAIL
    assert {(r.id, r.date_id, r.ts) for r in cancel.collect()} == {
        ("l1", "2022-01-02", "2"), ("l2", "2022-01-02", "2")
    }


@pytest.mark.parametrize(
    "event",
    [
        order("update", "1003", {"total_amount": "1"}),
        order("update", "1003"),
        order("update", "1002", {"order_status": "1001"}),
        order("insert", "1003", {"order_status": "1001"}),
    ],
)
def test_not_cancelled(spark, dic, event):
    pre = trade.order_pre_process(changes(spark, line(), event), dic)
    assert trade.cancel_detail(pre).count() == 0


def payment(kind, status, ts):
    data = {"user_id": "u", "order_id": "o1", "payment_type": "A", "callback_time": "t", "payment_status": status}
    return ("payment_info", kind, data, None, ts)


def test_payments(spark, dic):
    log = changes(
        spark, line("l1"), line("l2"), order("insert", "1001"),
        payment("insert", "1601", "5"), payment("update", "1602", "6"), payment("insert", "1602", "7"),
    )
    placed = trade.order_detail(trade.order_pre_process(log, dic))
    paid = trade.pay_detail(log, placed, dic)
    assert paid.columns == schemas.PAY_DETAIL and paid.count() == 6
    success = trade.pay_detail(log, placed, dic, success_only=True).collect()
    assert {(r.order_detail_id, r.ts, r.payment_type_name) for r in success} == {
        ("l1", "6", "search"), ("l2", "6", "search")
    }


def test_several_promotions_multiply(spark, dic):
    log = changes(
        spark, line(), order("insert", "1001"),
        activity("l1", "a"), activity("l1", "b"), coupon("l1", "c"), coupon("l1", "d"),
    )
    pre = trade.order_pre_process(log, dic)
    assert sorted((r.activity_id, r.coupon_id) for r in pre.collect()) == [
        ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")
    ]


def test_conform_is_positional(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert trade.conform(df, ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(ValueError):
        trade.conform(df, ["x"])


def test_latest_by_key(spark):
    df = spark.createDataFrame(
        [("a", 1, 1), ("a", 2, 1), ("a", 2, 2), ("b", 1, None), ("b", 1, 0)], "k string, v int, seq int"
    )
    newest = latest_by_key(df, ["k"], ["v", "seq"])
    assert sorted(tuple(r) for r in newest.collect()) == [("a", 2, 2), ("b", 1, 0)]


@pytest.mark.parametrize(
    "text, day",
    [(None, None), ("2022-01-01 10:11:12", "2022-01-01"), ("soon", None), ("2022-13-01", None)],
)
def test_day_of_text(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(dates.day_of_text(F.col("t"))).first()[0] == day


def test_amounts(spark):
    df = spark.createDataFrame([("2", "10.5"), ("x", "1"), (None, "1")], "a string, b string")
    out = [r[0] for r in df.select(values.amount_product(F.col("a"), F.col("b"))).collect()]
    assert out == ["21.0000", None, None]


def test_dates_in_a_zone(spark):
    df = spark.createDataFrame([(1640995200000,)], "ts bigint")  # 2022-01-01 00:00 UTC
    row = df.select(
        dates.day_of_millis(F.col("ts")),
        dates.second_of_millis(F.col("ts"), "+08:00"),
        dates.day_of_millis(F.col("ts"), "-01:00"),
        dates.millis_of_text(F.lit("2022-01-01")),
        dates.millis_of_text(F.lit("2022-01-01 08:00:00"), full=True),
        dates.millis_of_text(F.lit("x")),
    ).first()
    assert tuple(row) == (
        "2022-01-01", "2022-01-01 08:00:00", "2021-12-31",
        1640995200000 - 8 * 3600 * 1000, 1640995200000, None,
    )
