"""Configuration-driven routing of change records to dimension tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rillhouse.functions.values import split_list
from rillhouse.operators.latest import latest_by_key
from rillhouse.operators.skew import lookup_join


def latest_config(changes: DataFrame) -> DataFrame:
    """Current configuration: the newest change of each source table, unless a delete.

    Changes are ordered by their own time, then by their place in the source
    (``partition`` and ``seq``), which alone is no order across partitions. A
    change with neither is refused by an error.
    """
    order = [c for c in ("ts_ms", "partition", "seq") if c in changes.columns]
    refused = F.raise_error(F.lit("a configuration change without time or place")).cast("bigint")
    known = F.coalesce(*(F.col(c).cast("bigint") for c in order if c != "partition"), refused)
    ranked = changes.withColumn("_known", known)
    newest = latest_by_key(ranked, ["source_table"], [*order, "_known"])
    return newest.where(~F.col("deleted")).drop("deleted", "_known", *order)


def keep_columns(payload: Column, sink_columns: Column) -> Column:
    """The payload entries whose key is exactly one of the configured columns."""
    wanted = split_list(sink_columns)
    return F.map_filter(payload, lambda k, _: F.array_contains(wanted, k))


def route_dimensions(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Change records of configured tables, trimmed and tagged with their sink table.

    Configuration is joined as it stands now, so it must be loaded before the
    records it applies to: rows of a table without configuration are left out.
    """
    routes = config.select("source_table", "sink_table", "sink_columns")
    joined = lookup_join(changes, routes, ("table", "source_table"), "inner")
    return joined.withColumn("data", keep_columns(F.col("data"), F.col("sink_columns"))).drop(
        "source_table", "sink_columns"
    )


# --- configuration as of each change ----------------------------------------------

#: Versions of one source table that are searched together.
HISTORY_BLOCK = 1024


def _position(starts: Column, at: Column) -> Column:
    """How many of the ascending ``starts`` lie at or before ``at``, by binary search."""
    # Steps of falling powers of two, the first of which reaches over half the array.
    bits = F.length(F.bin(F.size(starts).cast("bigint")))
    steps = F.transform(F.sequence(F.lit(1), bits), lambda i: F.pow(F.lit(2), bits - i).cast("int"))

    def step(found: Column, width: Column) -> Column:
        further = found + width
        reached = (further <= F.size(starts)) & (F.get(starts, further - 1) <= at)
        return F.when(reached, further).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def config_history(changes: DataFrame, block: int = HISTORY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The versions of the configuration, from its change log: (blocks, index).

    A version lasts from the time ``ts_ms`` of its change to that of the next one of
    its source table; of several changes of one time the last counts, by their place
    (``partition`` and ``seq``). ``blocks`` has up to ``block`` successive versions a
    row and ``index`` the first time of each of a table's blocks, so no row grows with
    the length of a history. A change without a time is refused by an error.
    """
    refused = F.raise_error(F.lit("a configuration change without a time")).cast("bigint")
    timed = changes.withColumn("_since", F.coalesce(F.col("ts_ms").cast("bigint"), refused))
    places = [c for c in ("partition", "seq") if c in changes.columns]
    if places:
        timed = latest_by_key(timed, ["source_table", "_since"], places)
    number = F.row_number().over(Window.partitionBy("source_table").orderBy("_since"))
    version = F.struct(
        F.col("_since").alias("since"), "sink_table", "sink_columns", F.coalesce("deleted", F.lit(False)).alias("deleted")
    )
    numbered = timed.withColumns({"_block": F.floor((number - 1) / block).cast("int"), "_version": version})
    blocks = numbered.groupBy("source_table", "_block").agg(F.array_sort(F.collect_list("_version")).alias("_versions"))
    blocks = blocks.withColumn("_first", F.get("_versions", F.lit(0))["since"])
    index = blocks.groupBy("source_table").agg(F.array_sort(F.collect_list("_first")).alias("_firsts"))
    key = F.concat_ws("/", "_block", "source_table").alias("_history")
    return blocks.select(key, "_versions"), index


def route_dimensions_as_of(
    changes: DataFrame, history: tuple[DataFrame, DataFrame], at: Column
) -> DataFrame:
    """Change records routed by the configuration that was valid at their own time ``at``.

    ``at`` has the unit of the configuration's ``ts_ms``. A record of the very time of a
    configuration change is routed by the new version; one before the first version, or
    while the configuration is deleted, or without a time, is left out.
    """
    blocks, index = history
    placed = changes.withColumn("_at", at.cast("bigint"))
    placed = lookup_join(placed, index, ("table", "source_table"), "inner")
    block = _position(F.col("_firsts"), F.col("_at")) - 1
    placed = placed.withColumn("_at_block", F.concat_ws("/", block, "table")).drop("_firsts", "source_table")
    met = lookup_join(placed, blocks, ("_at_block", "_history"), "inner")
    version = F.get("_versions", _position(F.col("_versions")["since"], F.col("_at")) - 1)
    met = met.withColumn("_version", version).where("not _version.deleted")
    kept = keep_columns(F.col("data"), F.col("_version.sink_columns"))
    return met.withColumns({"data": kept, "sink_table": F.col("_version.sink_table")}).drop(
        "_at", "_at_block", "_history", "_versions", "_version"
    )


def create_table_text(prefix: str = "") -> Column:
    """``CREATE TABLE`` text of a configuration row with its defaults filled in.

    Columns are text; the key is kept as a table property for the upsert sink.
    """
    columns = F.transform(split_list(F.col("sink_columns")), lambda c: F.concat(c, F.lit(" STRING")))
    return F.concat(
        F.lit(f"CREATE TABLE IF NOT EXISTS {prefix}"),
        F.col("sink_table"),
        F.lit(" ("),
        F.concat_ws(", ", columns),
        F.lit(") USING parquet TBLPROPERTIES ('primary_key' = '"),
        F.col("sink_pk"),
        F.lit("')"),
        F.when(F.trim("sink_extend") != "", F.concat(F.lit(" "), F.trim("sink_extend"))).otherwise(""),
    )


def with_defaults(config: DataFrame) -> DataFrame:
    """Configuration with its defaults filled in: key ``id`` and no options."""
    return config.withColumns(
        {
            "sink_pk": F.coalesce("sink_pk", F.lit("id")),
            "sink_extend": F.coalesce("sink_extend", F.lit("")),
        }
    )


def sink_layouts(routes: Iterable[Row]) -> dict[str, list[str]]:
    """Columns of each sink table; tables fed by several sources have all of theirs."""
    layouts: dict[str, list[str]] = {}
    for route in routes:
        layout = layouts.setdefault(route["sink_table"], [])
        names = [c.strip() for c in route["sink_columns"].split(",")]
        layout += [c for c in dict.fromkeys(names) if c and c not in layout]
    return layouts


def dimension_rows(routed: DataFrame, sink_table: str, columns: list[str]) -> DataFrame:
    """The routed rows of one sink table with its columns spread out."""
    own = routed.where(F.col("sink_table") == sink_table)
    meta = [c for c in routed.columns if c not in ("data", "old", "sink_table", "database", "table")]
    clash = set(meta) & set(columns)
    kept = [F.col(c).alias(f"_{c}") if c in clash else F.col(c) for c in meta]
    return own.select(*[F.col("data")[c].alias(c) for c in columns], *kept)
