"""Batch jobs end to end: stored tables equal the queries over the same inputs."""

import pytest
from pyspark.sql import functions as F

from rillhouse import bindings
from rillhouse.operators import dimensions, skew, visits
from rillhouse.plans import batch, trade, traffic
from rillhouse.sinks.tables import current_dimensions, dimension_table
from rillhouse.workspace import new_folder

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_log_split_and_visits(spark):
    raw, root = bindings.log_text(spark, SF), new_folder(spark, "batch")
    stored, direct = batch.run_log_split(raw, root), traffic.log_outputs(raw)
    for name in direct:
        assert stored[name].columns == direct[name].columns
        assert rows_of(stored[name], "seq") == rows_of(direct[name], "seq"), name
    assert rows_of(stored["page"], "seq", "is_new") == rows_of(direct["page"], "seq", "is_new")
    done = batch.run_visits(stored["page"], root, within_ms=3_600_000)
    assert rows_of(done["unique_visitor"], "seq") == rows_of(
        visits.unique_visitor(direct["page"]), "seq"
    )
    assert rows_of(done["user_jump"], "seq") == rows_of(
        visits.user_jump(direct["page"], 3_600_000), "seq"
    )


def test_trade_chain(spark):
    cdc = {**bindings.order_changes(spark, SF), "cart_info": bindings.cart_log(spark, SF)}
    dic = bindings.base_dic(spark)
    done = batch.run_trade(cdc, dic, new_folder(spark, "batch"))
    pre = trade.order_pre_process(cdc, dic)
    assert rows_of(done["order_pre_process"], "id", "oi_ts") == rows_of(pre, "id", "oi_ts")
    paid = trade.pay_detail(cdc, trade.order_detail(pre), dic)
    assert rows_of(done["pay_detail"], "order_detail_id", "ts", "payment_type_name") == rows_of(
        paid, "order_detail_id", "ts", "payment_type_name"
    )
    assert done["cart_add"].count() == trade.cart_add(cdc["cart_info"], dic).count()


def test_dimensions(spark):
    config = dimensions.latest_config(bindings.dimension_config(spark))
    changes = bindings.dimension_changes(spark, SF)
    rows = batch.run_dimensions(changes, config, new_folder(spark, "batch"))
    now = current_dimensions(rows, config)
    sinks = {r.sink_table for r in now.select("sink_table").distinct().collect()}
    assert sinks == {"dim_region", "dim_nation", "dim_customer", "dim_supplier"}
    columns = ["s_suppkey", "s_name", "s_acctbal"]
    suppliers = dimension_table(now, "dim_supplier", columns)
    assert suppliers.columns == columns and suppliers.where("s_name is null").count() == 0
    for sink, source in (("dim_customer", "customer"), ("dim_nation", "nation")):
        assert now.where(F.col("sink_table") == sink).count() == bindings.table(spark, SF, source).count()
    left = current_dimensions(rows, config, apply_deletes=True).where("sink_table = 'dim_customer'")
    assert 0 < left.count() < now.where("sink_table = 'dim_customer'").count()


def test_small_tables_are_refused_not_cut(spark):
    assert len(skew.collect_small(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        skew.collect_small(spark.range(6), 5)
