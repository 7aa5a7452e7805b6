"""Trade dataflows over the database change log.

Each step is a plain DataFrame function, used alike by the batch queries and by
the streaming job. The change log is either one frame of envelopes, whose
payloads are text maps, or one frame per source table, whose payloads may be
typed structs; the latter lets Spark prune payload columns down to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillhouse import schemas
from rillhouse.functions.dates import day_of_text
from rillhouse.functions.values import amount_product, fields, whole
from rillhouse.operators.skew import HotKeys, find_hot_keys, lookup_join, skew_join

CANCELLED = "1003"
PAID = "1602"

def _data(name: str) -> Column:
    return F.col("data")[name]


def _old(name: str) -> Column:
    return F.col("old")[name]


ChangeLog = DataFrame | Mapping[str, DataFrame]


def changes_of(log: ChangeLog, table: str) -> DataFrame:
    """The change records of one source table."""
    if isinstance(log, DataFrame):
        return log.where(F.col("table") == table)
    return log[table]


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Name columns by position, as an insert into a declared table does."""
    if len(df.columns) != len(columns):
        raise ValueError(f"{len(df.columns)} columns for a table of {len(columns)}")
    return df.toDF(*columns)


def _with_name(rows: DataFrame, dic: DataFrame, code: str, name: str) -> DataFrame:
    """Add the dictionary name of a code column; an unknown code gives null."""
    names = dic.select("dic_code", F.col("dic_name").alias(name))
    return lookup_join(rows, names, (code, "dic_code")).drop("dic_code")


# --- inputs taken from the change log ------------------------------------------


def cart_changes(cdc: ChangeLog) -> DataFrame:
    """Cart lines added, or whose quantity went up; ``sku_num`` is the increase."""
    new, old = whole(_data("sku_num")), whole(_old("sku_num"))
    inserted = F.col("type") == "insert"
    raised = (F.col("type") == "update") & _old("sku_num").isNotNull() & (new > old)
    increase = F.when(inserted, _data("sku_num")).otherwise((new - old).cast("string"))
    return changes_of(cdc, "cart_info").where(inserted | raised).select(
        *fields(F.col("data"), "id", "user_id", "sku_id", "source_id", "source_type"),
        increase.alias("sku_num"),
        "ts",
    )


def detail_inserts(cdc: ChangeLog) -> DataFrame:
    """Order lines placed."""
    return changes_of(cdc, "order_detail").where(F.col("type") == "insert").select(
        *fields(F.col("data"), "id", "order_id", "sku_id", "sku_name", "create_time"),
        *fields(F.col("data"), "source_id", "source_type", "sku_num"),
        amount_product(_data("sku_num"), _data("order_price")).alias("split_original_amount"),
        *fields(F.col("data"), "split_total_amount", "split_activity_amount", "split_coupon_amount"),
        F.col("ts").alias("od_ts"),
    )


def order_events(cdc: ChangeLog) -> DataFrame:
    """Orders placed, and every later update of them."""
    return changes_of(cdc, "order_info").where(F.col("type").isin("insert", "update")).select(
        _data("id").alias("oi_id"),
        *fields(F.col("data"), "user_id", "province_id", "operate_time", "order_status"),
        "type",
        "old",
        F.col("ts").alias("oi_ts"),
    )


def activity_inserts(cdc: ChangeLog, ts: str | None = None) -> DataFrame:
    """Promotions applied to order lines; ``ts`` names a column for the time of the change."""
    return changes_of(cdc, "order_detail_activity").where(F.col("type") == "insert").select(
        _data("order_detail_id").alias("act_id"),
        *fields(F.col("data"), "activity_id", "activity_rule_id"),
        *([F.col("ts").alias(ts)] if ts else []),
    )


def coupon_inserts(cdc: ChangeLog, ts: str | None = None) -> DataFrame:
    """Coupons used on order lines; ``ts`` names a column for the time of the change."""
    return changes_of(cdc, "order_detail_coupon").where(F.col("type") == "insert").select(
        _data("order_detail_id").alias("cou_id"),
        *fields(F.col("data"), "coupon_id"),
        *([F.col("ts").alias(ts)] if ts else []),
    )


def payment_events(cdc: ChangeLog, success_only: bool = False) -> DataFrame:
    """Payment changes: all of them, or only updates to the paid state."""
    changes = changes_of(cdc, "payment_info")
    if success_only:
        changes = changes.where(
            (F.col("type") == "update") & (_data("payment_status") == PAID)
        )
    return changes.select(
        _data("order_id").alias("pay_order_id"),
        *fields(F.col("data"), "payment_type", "callback_time"),
        F.col("ts").alias("pay_ts"),
    )


# --- steps of the order dataflow ------------------------------------------------


def attach_promotions(
    details: DataFrame,
    activities: DataFrame,
    coupons: DataFrame,
    hot: dict[str, HotKeys] | None = None,
) -> DataFrame:
    """Order lines with their activity and coupon, if any."""
    if hot is None:
        hot = hot_promotions(activities, coupons)
    with_activity = skew_join(
        details, activities, ("id", "act_id"), "left", hot_right=hot["activities"]
    )
    return skew_join(
        with_activity, coupons, ("id", "cou_id"), "left", hot_right=hot["coupons"]
    ).drop("act_id", "cou_id")


def hot_promotions(activities: DataFrame, coupons: DataFrame) -> dict[str, HotKeys]:
    """Lines with very many promotions: the right side of a left join, which AQE does not split.

    The lines themselves have one row each, and inner joins are left to AQE.
    """
    return find_hot_keys(
        activities=(activities, F.col("act_id")), coupons=(coupons, F.col("cou_id"))
    )


def finish_order_rows(joined: DataFrame, dic: DataFrame) -> DataFrame:
    """The wide order row from joined lines and order events."""
    named = _with_name(joined, dic, "source_type", "source_type_name")
    return named.withColumns(
        {
            "date_id": day_of_text(F.col("create_time")),
            "operate_date_id": day_of_text(F.col("operate_time")),
            "row_op_ts": F.current_timestamp(),
        }
    ).select(*schemas.ORDER_PRE_PROCESS)


# --- dataflows ------------------------------------------------------------------


def cart_add(cdc: ChangeLog, dic: DataFrame) -> DataFrame:
    """Cart additions."""
    named = _with_name(cart_changes(cdc), dic, "source_type", "source_type_name")
    return conform(
        named.select(
            "id", "user_id", "sku_id", "source_id", "source_type", "source_type_name", "sku_num", "ts"
        ),
        schemas.CART_ADD,
    )


def order_pre_process(cdc: ChangeLog, dic: DataFrame) -> DataFrame:
    """Order lines joined with every event of their order: an append change log.

    Promotions are attached before the order events multiply the rows.
    """
    details, orders = detail_inserts(cdc), order_events(cdc)
    activities, coupons = activity_inserts(cdc), coupon_inserts(cdc)
    wide = attach_promotions(details, activities, coupons)
    joined = skew_join(wide, orders, ("order_id", "oi_id"), "inner")
    return finish_order_rows(joined, dic)


def order_detail(pre_process: DataFrame) -> DataFrame:
    """Placed orders: the rows whose order event is the insert."""
    return conform(
        pre_process.where(F.col("type") == "insert").select(
            *"id order_id user_id sku_id sku_name province_id activity_id".split(),
            *"activity_rule_id coupon_id date_id create_time source_id source_type".split(),
            *"source_type_name sku_num split_original_amount split_activity_amount".split(),
            *"split_coupon_amount split_total_amount od_ts row_op_ts".split(),
        ),
        schemas.ORDER_DETAIL,
    )


def cancel_detail(pre_process: DataFrame) -> DataFrame:
    """Cancelled orders: updates that change the status to cancelled."""
    return conform(
        pre_process.where(
            (F.col("type") == "update")
            & _old("order_status").isNotNull()
            & (F.col("order_status") == CANCELLED)
        ).select(
            *"id order_id user_id sku_id sku_name province_id activity_id".split(),
            *"activity_rule_id coupon_id operate_date_id operate_time source_id".split(),
            *"source_type source_type_name sku_num split_original_amount".split(),
            *"split_activity_amount split_coupon_amount split_total_amount".split(),
            *"oi_ts row_op_ts".split(),
        ),
        schemas.CANCEL_DETAIL,
    )


def finish_payment_rows(joined: DataFrame, dic: DataFrame) -> DataFrame:
    """The payment row from joined payments and placed order lines."""
    named = _with_name(joined, dic, "payment_type", "payment_type_name")
    return conform(
        named.select(
            *"id order_id user_id sku_id sku_name province_id activity_id".split(),
            *"activity_rule_id coupon_id payment_type payment_type_name".split(),
            *"callback_time source_id source_type_code source_type_name sku_num".split(),
            *"split_original_amount split_activity_amount split_coupon_amount".split(),
            *"split_total_amount pay_ts row_op_ts".split(),
        ),
        schemas.PAY_DETAIL,
    )


def pay_detail(
    cdc: ChangeLog,
    placed: DataFrame,
    dic: DataFrame,
    success_only: bool = False,
    hot: dict[str, HotKeys] | None = None,
) -> DataFrame:
    """Paid order lines: each payment joined with the placed lines of its order.

    ``hot`` may carry hot order ids known for ``payments`` and ``placed``;
    without them the inner join is left to AQE.
    """
    payments, hot = payment_events(cdc, success_only), hot or {}
    joined = skew_join(
        payments,
        placed,
        ("pay_order_id", "order_id"),
        "inner",
        hot.get("payments"),
        hot.get("placed"),
    )
    return finish_payment_rows(joined, dic)
