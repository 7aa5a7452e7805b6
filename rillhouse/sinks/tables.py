"""Keyed tables: change logs read as their latest rows, and the creation of dimension tables.

Parquet has no in-place update, so a keyed table is an append log of versions and is
read through ``latest_by_key``. Tables written by batch have one folder per micro-batch;
a replayed batch overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillhouse.functions.values import split_list
from rillhouse.operators.dimensions import create_table_text, sink_layouts, with_defaults
from rillhouse.operators.latest import latest_by_key
from rillhouse.operators.skew import collect_small


def current_dimension(
    rows: DataFrame, keys: Sequence[str], version: Sequence[str], apply_deletes: bool = False
) -> DataFrame:
    """Current rows of a dimension table from its change rows.

    By default every change is an upsert, deletes included; ``apply_deletes``
    removes keys whose newest change is a delete.
    """
    newest = latest_by_key(rows, keys, version)
    return newest.where(F.col("type") != "delete") if apply_deletes else newest


DIMENSION_ROWS = "type string, ts string, data map<string,string>, batch_id bigint, sink_table string"


def dimension_changes(spark: SparkSession, root: str) -> DataFrame:
    """All change rows that a dimension job has written below ``root``."""
    return spark.read.schema(DIMENSION_ROWS).parquet(f"{root}/dimensions")


def current_dimensions(
    changes: DataFrame, config: DataFrame, apply_deletes: bool = False
) -> DataFrame:
    """Current rows of all dimension tables: (sink_table, key, data).

    ``key`` has the values of the columns that the configuration names as the
    table's key. Versions are ordered by batch, then by the change's time.
    """
    keys = (
        with_defaults(config)
        .groupBy("sink_table")
        .agg(F.min("sink_pk").alias("sink_pk"))
        .select("sink_table", split_list(F.col("sink_pk")).alias("_names"))
    )
    key = F.transform("_names", lambda name: F.col("data")[name])
    rows = changes.join(keys, "sink_table").withColumns(
        {"key": key, "_at": F.col("ts").cast("bigint")}
    )
    newest = current_dimension(rows, ["sink_table", "key"], ["batch_id", "_at"], apply_deletes)
    return newest.select("sink_table", "key", "data")


def dimension_table(current: DataFrame, sink_table: str, columns: Sequence[str]) -> DataFrame:
    """One dimension table with its columns spread out."""
    own = current.where(F.col("sink_table") == sink_table)
    return own.select(*[F.col("data")[c].alias(c) for c in columns])


def _active_columns(spark: SparkSession, name: str) -> str | None:
    """The columns in use, as the table's property has them."""
    found = spark.sql(f"SHOW TBLPROPERTIES {name}").where("key = 'active_columns'").first()
    return found and found["value"]


def sync_dimension_tables(spark: SparkSession, config: DataFrame, prefix: str = "") -> list[str]:
    """Bring the catalogue in line with a configuration; returns the statements run.

    Absent tables are created. A table whose configuration has gained columns gets them, null in
    older rows. A column that the configuration has lost stays, since its old values cannot be
    dropped from files, but is no longer among the table's ``active_columns``, a table property in the
    order of the configuration. Running it again changes nothing.
    """
    rows = with_defaults(config).withColumn("ddl", create_table_text(prefix))
    routes = collect_small(rows.select("sink_table", "sink_columns", "ddl").orderBy("sink_table", "source_table"))
    statements = []

    def run(statement: str) -> None:
        spark.sql(statement)
        statements.append(statement)

    created = {r["sink_table"]: r["ddl"] for r in reversed(routes)}
    for table, columns in sink_layouts(routes).items():
        name = f"{prefix}{table}"
        if not spark.catalog.tableExists(name):
            run(created[table])
        known = {c.lower() for c in spark.table(name).columns}
        missing = [c for c in columns if c.lower() not in known]
        if missing:
            added = ", ".join(f"`{c}` STRING" for c in missing)
            run(f"ALTER TABLE {name} ADD COLUMNS ({added})")
        active = ",".join(columns)
        if _active_columns(spark, name) != active:
            run(f"ALTER TABLE {name} SET TBLPROPERTIES ('active_columns' = '{active}')")
    return statements
