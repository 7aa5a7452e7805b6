"""Batch jobs: the dataflows run over whole logs, each intermediate table written once.

A later step reads the table an earlier one wrote, so nothing is parsed, repaired
or joined twice, and a lost executor costs at most the step at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillhouse import schemas
from rillhouse.operators import routing, visits
from rillhouse.operators.dimensions import route_dimensions
from rillhouse.operators.skew import HotKeys
from rillhouse.plans import trade
from rillhouse.sinks.tables import dimension_changes
from rillhouse.sources.records import parse_log, split_log


def store(rows: DataFrame, folder: str) -> DataFrame:
    """Write a table and read it back with its declared schema."""
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def run_log_split(raw: DataFrame, root: str, tz: str | None = None) -> dict[str, DataFrame]:
    """The log split: parsed once, repaired once, then routed to its tables."""
    parsed = store(parse_log(raw), f"{root}/state/parsed_log")
    log, dirty = split_log(parsed)
    repaired = store(visits.fix_is_new(log, tz=tz), f"{root}/state/repaired_log")
    outputs = {**routing.route_log(repaired), "dirty": dirty}
    return {
        name: store(rows, f"{root}/{schemas.LOG_TOPICS[name]}") for name, rows in outputs.items()
    }


def run_visits(
    pages: DataFrame, root: str, within_ms: int = 10_000, tz: str | None = None
) -> dict[str, DataFrame]:
    """Daily unique visitors and bounced visits of the stored page table."""
    return {
        "unique_visitor": store(
            visits.unique_visitor(pages, tz), f"{root}/dwd_traffic_unique_visitor_detail"
        ),
        "user_jump": store(
            visits.user_jump(pages, within_ms), f"{root}/dwd_traffic_user_jump_detail"
        ),
    }


def run_trade(
    cdc: trade.ChangeLog,
    dic: DataFrame,
    root: str,
    success_only: bool = False,
    hot: dict[str, HotKeys] | None = None,
) -> dict[str, DataFrame]:
    """The trade chain, each table built from the stored one before it."""
    pre = store(trade.order_pre_process(cdc, dic), f"{root}/dwd_trade_order_pre_process")
    placed = store(trade.order_detail(pre), f"{root}/dwd_trade_order_detail")
    return {
        "cart_add": store(trade.cart_add(cdc, dic), f"{root}/dwd_trade_cart_add"),
        "order_pre_process": pre,
        "order_detail": placed,
        "cancel_detail": store(trade.cancel_detail(pre), f"{root}/dwd_trade_cancel_detail"),
        "pay_detail": store(
            trade.pay_detail(cdc, placed, dic, success_only, hot),
            f"{root}/dwd_trade_pay_detail_suc",
        ),
    }


def run_dimensions(changes: DataFrame, config: DataFrame, root: str) -> DataFrame:
    """Change rows of all dimension tables, routed and written in one go.

    ``current_dimensions`` reads the tables off them.
    """
    rows = route_dimensions(changes, config).select("sink_table", "type", "ts", "data")
    spread = rows.hint("rebalance", F.col("sink_table"))
    folder = f"{root}/dimensions/batch_id=0"
    spread.write.mode("overwrite").partitionBy("sink_table").parquet(folder)
    return dimension_changes(changes.sparkSession, root)
