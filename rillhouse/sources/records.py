"""Parsing of raw records: change envelopes, configuration changes, client logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillhouse.schemas import CDC_ENVELOPE, TABLE_PROCESS_CHANGE

def parse_once(raw: DataFrame, name: str, parsed: Column) -> DataFrame:
    """Add a parsed column that later filters cannot make Spark parse again.

    A filter over a projected expression is pushed below the projection, with a
    copy of the expression. It cannot be pushed below a generator.
    """
    return raw.select("*", F.explode(F.array(parsed)).alias(name))


BOOTSTRAP_MARKERS = ("bootstrap-start", "bootstrap-complete")


def cdc_envelope(raw: DataFrame) -> DataFrame:
    """Change records parsed from ``value`` text, next to the raw text.

    Payload numbers become text and JSON nulls become null values. For text that
    does not parse as a change record, ``_corrupt_record`` holds the text.
    """
    schema = T.StructType(CDC_ENVELOPE.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = parse_once(raw, "_rec", F.from_json("value", schema))
    kept = [c for c in raw.columns if c != "value"]
    return parsed.select("value", *kept, "_rec.*")


def is_change() -> Column:
    """Whether an envelope is usable: a table, an event type and an object payload."""
    return (
        F.col("_corrupt_record").isNull()
        & F.col("table").isNotNull()
        & F.col("type").isNotNull()
        & F.col("data").isNotNull()
    )


def is_marker() -> Column:
    """Whether an envelope only marks the start or end of a bootstrap."""
    marker = F.col("_corrupt_record").isNull() & F.col("type").isin(*BOOTSTRAP_MARKERS)
    return F.coalesce(marker, F.lit(False))


def split_cdc(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(change records without markers, raw text of unusable records)."""
    usable = parsed.where(is_change() & ~is_marker()).drop("value", "_corrupt_record")
    dirty = parsed.where(~is_change() & ~is_marker())
    return usable, dirty.select("value", *(["seq"] if "seq" in parsed.columns else []))


def topic_rows(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of a JSON topic under its declared schema, text of unusable records).

    The place in the source (``partition`` and ``seq``, as far as known) stays with the rows. Text
    that is no JSON object, or has a field that does not fit its type, is unusable; a missing field
    is null, and a field that is not declared is ignored. A record without text is unusable too.
    """
    corrupt = T.StructField("_corrupt_record", T.StringType())
    parsed = parse_once(raw, "_rec", F.from_json("value", T.StructType([*schema.fields, corrupt])))
    place = [c for c in ("partition", "seq") if c in raw.columns]
    usable = F.col("_rec").isNotNull() & F.col("_rec._corrupt_record").isNull() & F.col("value").rlike(r"^\s*\{")
    rows = parsed.where(usable).select(*[F.col(f"_rec.{f.name}") for f in schema.fields], *place)
    return rows, parsed.where(~F.coalesce(usable, F.lit(False))).select("value", *place)


def split_config(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(configuration change log, text of unusable records) from change-record text.

    One row per change with the configuration columns and ``deleted``; for a
    delete the columns are those of the removed row. ``ts_ms`` is the time of the
    change, ``partition`` and ``seq`` its place in the source, as far as known.
    """
    change = parse_once(raw, "_c", F.from_json("value", TABLE_PROCESS_CHANGE))
    row = F.coalesce("_c.after", "_c.before")
    deleted = F.col("_c.after").isNull() & F.col("_c.before").isNotNull()
    usable = row.isNotNull() & row["source_table"].isNotNull()
    place = [c for c in ("partition", "seq") if c in raw.columns]
    changes = change.where(usable).select(
        row.alias("_row"), deleted.alias("deleted"), F.col("_c.ts_ms").alias("ts_ms"), *place
    )
    dirty = change.where(~F.coalesce(usable, F.lit(False))).select("value", *place)
    return changes.select("_row.*", "deleted", "ts_ms", *place), dirty


def config_changes(raw: DataFrame) -> DataFrame:
    """The configuration change log of ``split_config``."""
    return split_config(raw)[0]


def _object(doc: Column, path: str) -> Column:
    """A nested value kept whole as variant; JSON null counts as absent."""
    found = F.try_variant_get(doc, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def parse_log(raw: DataFrame) -> DataFrame:
    """Client log records parsed from ``value`` text; other columns are carried along.

    Nested objects stay whole as variants, whatever fields they hold; the few
    fields the dataflows compute with become typed columns. ``mid`` or ``ts`` is
    null where the text is no log record.
    """
    doc = F.col("_doc")
    parsed = parse_once(raw, "_doc", F.try_parse_json("value"))
    carried = [c for c in raw.columns if c not in ("value", "seq")]
    return parsed.select(
        "value",
        "seq",
        *carried,
        F.try_variant_get(doc, "$.common.mid", "string").alias("mid"),
        F.try_variant_get(doc, "$.common.is_new", "string").alias("is_new"),
        F.try_variant_get(doc, "$.page.last_page_id", "string").alias("last_page_id"),
        F.try_variant_get(doc, "$.ts", "bigint").alias("ts"),
        _object(doc, "$.common").alias("common"),
        _object(doc, "$.page").alias("page"),
        _object(doc, "$.start").alias("start"),
        _object(doc, "$.err").alias("err"),
        F.try_variant_get(doc, "$.displays", "array<variant>").alias("displays"),
        F.try_variant_get(doc, "$.actions", "array<variant>").alias("actions"),
    )


def is_log_record() -> Column:
    """Whether a parsed record has a device id and an event time.

    Text that is no JSON object has neither; without them a record can be
    neither keyed nor ordered.
    """
    return F.col("mid").isNotNull() & F.col("ts").isNotNull()


def split_log(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log records, raw text of dirty records)."""
    usable = parsed.where(is_log_record()).drop("value")
    return usable, parsed.where(~is_log_record()).select("value", "seq")
