"""Schemas of the sources and the column lists of the warehouse tables.

The table columns are fixed values: consumers read them by name and sinks
write them by position, so neither names nor order may change.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def text_struct(*names: str) -> T.StructType:
    """A struct of nullable string columns."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Database change log: one row change per record.
CDC_ENVELOPE = T.StructType(
    [
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("data", _TEXT_MAP),
        T.StructField("old", _TEXT_MAP),
        T.StructField("ts", T.StringType()),
    ]
)

# Routing configuration, one row per source table.
TABLE_PROCESS = text_struct(
    "source_table", "sink_table", "sink_columns", "sink_pk", "sink_extend"
)

# Change record of the configuration table: the row before and after.
TABLE_PROCESS_CHANGE = T.StructType(
    [
        T.StructField("before", TABLE_PROCESS),
        T.StructField("after", TABLE_PROCESS),
        T.StructField("ts_ms", T.LongType()),  # when the change was made
    ]
)

BASE_DIC = T.StructType(
    [
        T.StructField("dic_code", T.StringType(), False),
        T.StructField("dic_name", T.StringType()),
        T.StructField("parent_code", T.StringType()),
        T.StructField("create_time", T.TimestampType()),
        T.StructField("operate_time", T.TimestampType()),
    ]
)

CART_ADD = (
    "id user_id sku_id source_id source_type_code source_type_name sku_num ts"
).split()

ORDER_PRE_PROCESS = (
    "id order_id user_id order_status sku_id sku_name province_id activity_id "
    "activity_rule_id coupon_id date_id create_time operate_date_id operate_time "
    "source_id source_type source_type_name sku_num split_original_amount "
    "split_activity_amount split_coupon_amount split_total_amount type old od_ts "
    "oi_ts row_op_ts"
).split()

ORDER_DETAIL = (
    "id order_id user_id sku_id sku_name province_id activity_id activity_rule_id "
    "coupon_id date_id create_time source_id source_type_code source_type_name "
    "sku_num split_original_amount split_activity_amount split_coupon_amount "
    "split_total_amount ts row_op_ts"
).split()

CANCEL_DETAIL = (
    "id order_id user_id sku_id sku_name province_id activity_id activity_rule_id "
    "coupon_id date_id cancel_time source_id source_type_code source_type_name "
    "sku_num split_original_amount split_activity_amount split_coupon_amount "
    "split_total_amount ts row_op_ts"
).split()

PAY_DETAIL = (
    "order_detail_id order_id user_id sku_id sku_name province_id activity_id "
    "activity_rule_id coupon_id payment_type_code payment_type_name callback_time "
    "source_id source_type_code source_type_name sku_num split_original_amount "
    "split_activity_amount split_coupon_amount split_payment_amount ts row_op_ts"
).split()

_NOT_TEXT = {"row_op_ts": T.TimestampType(), "old": _TEXT_MAP}


def table_schema(columns: list[str]) -> T.StructType:
    """Struct of a warehouse table: text, except the version stamp and old values."""
    return T.StructType(
        [T.StructField(c, _NOT_TEXT.get(c, T.StringType())) for c in columns]
    )


# Topic names of the log and trade jobs (fixed values).
LOG_TOPICS = {
    "page": "dwd_traffic_page_log",
    "start": "dwd_traffic_start_log",
    "display": "dwd_traffic_display_log",
    "action": "dwd_traffic_action_log",
    "error": "dwd_traffic_error_log",
    "dirty": "dirty_data",
}
